"""Session builder and the settings every relatrix query relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; keyword dots are written as `__`."""
    b = SparkSession.builder.appName("relatrix")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Make any session fit for the library's Python operators.

    Arrow batches are kept to 2,000 rows and 4 MB (a longer row is a batch of its own), and the package is shipped
    to the executors once per application, so workers need no shared PYTHONPATH.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp()) / "relatrix_code.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
        _shipped.add(sc.applicationId)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A local one is set only where a local session names none (tests); on a cluster
    executors would not see it, so that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (jsc.isLocal() and not spark.sparkContext.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "relatrix-checkpoints"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it back from there. Not for loops: the plan keeps its
    size estimates, which joins multiply; see stored()."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below the shared checkpoint folder and read back: no lineage, and the size of its files
    as the planner's estimate. The caller of a loop gives each round back by discard()."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of stored() tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
