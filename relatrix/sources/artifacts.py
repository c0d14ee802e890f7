"""Readers and writers of the state documents: health (JSON or Markdown), journal, library, git status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("status", "last_updated", "reason", "source_hash", "verification")


def read_health_json(spark: SparkSession, path: str) -> DataFrame:
    """{"files": {file: {status, ...}}} or {file: {...}} as rows; absent fields are empty."""
    row = "map<string,struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"
    d = spark.read.text(path, wholetext=True)
    table = F.coalesce(F.from_json("value", f"struct<files:{row}>")["files"], F.from_json("value", row))
    d = d.select(F.explode(table).alias("file", "r")).filter("r IS NOT NULL")
    return d.select("file", *[F.coalesce(F.col("r")[f], F.lit("")).alias(f) for f in FIELDS])


def read_health_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Table rows: file, status, last updated, reason."""
    d = spark.read.text(path).filter(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[\s:|-]+$"))
    cells = F.transform(F.split("value", r"\|"), lambda c: F.btrim(F.trim(c), F.lit("`")))
    d = d.select(cells.alias("c")).filter((F.size("c") >= 5) & ~F.lower(F.col("c")[1]).isin("file", "file path"))
    empty = F.lit("")
    return d.select(F.col("c")[1].alias("file"), F.col("c")[2].alias("status"), F.col("c")[3].alias("last_updated"), F.col("c")[4].alias("reason"), empty.alias("source_hash"), empty.alias("verification"))


def read_health(spark: SparkSession, json_path: str | None, markdown_path: str | None = None) -> DataFrame:
    """JSON wins if it has a row."""
    if json_path:
        d = read_health_json(spark, json_path)
        if markdown_path is None or d.limit(1).count():
            return d
    return read_health_markdown(spark, markdown_path)


def health_json(health: DataFrame) -> DataFrame:
    """One JSON object per row, ready for a text sink."""
    return health.select(F.to_json(F.struct("*")).alias("value"))


def health_markdown(health: DataFrame) -> DataFrame:
    """Table lines in file order."""
    return health.orderBy("file").select(F.concat(F.lit("| `"), "file", F.lit("` | "), "status", F.lit(" | "), F.coalesce("reason", F.lit("")), F.lit(" |")).alias("value"))


def write_journal(entries: DataFrame, path: str) -> None:
    """Append, one directory a day."""
    entries.withColumn("day", F.to_date("stamp")).write.mode("append").partitionBy("day").parquet(path)


def read_journal(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """All days, or one by partition pruning."""
    d = spark.read.parquet(path)
    return d.filter(F.col("day") == F.lit(day).cast("date")) if day else d


def git_status(lines: DataFrame) -> DataFrame:
    """(value) of `status --porcelain` -> path, deleted; a rename is a deletion and a change."""
    state, rest = F.substring("value", 1, 2), F.substring(F.col("value"), F.lit(4), F.length("value"))
    pair = lambda p, gone: F.struct(F.btrim(p, F.lit('" ')).alias("path"), gone.alias("deleted"))
    renamed = state.contains("R")
    both = F.array(pair(F.split_part(rest, F.lit(" -> "), F.lit(1)), F.lit(True)), pair(F.split_part(rest, F.lit(" -> "), F.lit(2)), F.lit(False)))
    d = lines.filter(F.length("value") > 3)
    return d.select(F.explode(F.when(renamed, both).otherwise(F.array(pair(rest, state.contains("D"))))).alias("c")).select("c.*")


def git_name_status(lines: DataFrame) -> DataFrame:
    """(value) of `diff --name-status` -> path, deleted."""
    c = F.split("value", "\t")
    pair = lambda p, gone: F.struct(p.alias("path"), gone.alias("deleted"))
    renamed = F.col("value").startswith("R")
    both = F.array(pair(F.get(c, F.lit(1)), F.lit(True)), pair(F.get(c, F.lit(2)), F.lit(False)))
    d = lines.filter(F.size(c) > 1)
    return d.select(F.explode(F.when(renamed, both).otherwise(F.array(pair(F.get(c, F.lit(1)), F.col("value").startswith("D"))))).alias("c")).select("c.*")


def library(edges: DataFrame) -> DataFrame:
    """Adjacency: one row per source with its sorted targets."""
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("targets"))


def mermaid(edges: DataFrame, n: int = 80) -> DataFrame:
    return edges.orderBy("src", "dst").limit(n).select(F.concat(F.lit('  "'), "src", F.lit('" --> "'), "dst", F.lit('"')).alias("value"))
