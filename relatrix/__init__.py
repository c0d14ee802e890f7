"""relatrix: dependency, change and corpus analysis as PySpark DataFrame operators."""
