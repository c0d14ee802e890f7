"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut, prepare

UNIT = 1 << 30


def split_points(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Distinct inner boundaries at the quantiles of a size-weighted key sample."""
    if len(sample) == 0:
        return np.empty(0, np.int64)
    s = np.sort(sample)
    return np.unique(s[(np.arange(1, ranges) * len(s)) // ranges])


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    text_col: str = "text",
    id_col: str = "doc_id",
    overhead: int = 16,
    range_bytes: int = 256 << 20,
    oversample: int = 16,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: the id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), key_range.

    size is the UTF-8 bytes of the text (null: none) plus `overhead`. Rows are ordered by a hash of the text, so equal
    texts stand together, then by hashes of the id. Keys drawn with a chance proportional to size give the boundaries
    of at least 4 ranges a shard (about one per `range_bytes`, 65,536 at most); a range with over twice the mean
    bytes, such as that of one very frequent text, is subdivided by the second hash. Exact sums per range then place
    every row on the line of all bytes, and a shard is an equal stretch of it: shards differ by a document at most.
    slot counts a shard's rows from 0 without gaps. With `carry` the input's columns come along as the struct `row`.

    Null ids hash as empty; repeated rows are told apart by their place in the input; an empty table gives no rows;
    other columns are ignored. The driver sees at most 16 sampled keys and two sums for each range.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("k"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
        F.xxhash64(text).alias("k1"),
        F.monotonically_increasing_id().alias("uid"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    d = d.withColumn("k2", F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), "uid"))
    d = cut(d)
    total, rows = d.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if rows == 0:
        total = 1
    ranges = int(min(65536, max(4 * shards, total // range_bytes)))
    chance = F.col("size") * F.lit(ranges * oversample / total)
    drawn = F.pmod(F.xxhash64("k2", F.lit(1)), F.lit(UNIT)) / UNIT < chance
    sample = d.filter(drawn).select("k1").toPandas()["k1"].to_numpy(np.int64)
    points = split_points(sample, ranges)

    @F.pandas_udf("int")
    def range_of(k1: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, k1.to_numpy(), side="right").astype(np.int32))

    sums = d.groupBy(range_of("k1").alias("r")).agg(F.sum("size")).toPandas().to_numpy(np.int64)
    held = np.zeros(len(points) + 1, np.int64)
    held[sums[:, 0]] = sums[:, 1]
    mean = max(1.0, total / len(held))
    pieces = np.where(held > 2 * mean, np.ceil(held / mean), 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(pieces)])

    @F.pandas_udf("int")
    def part_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        r = np.searchsorted(points, k1.to_numpy(), side="right")
        u = (k2.to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(33)).astype(np.int64)
        return pd.Series((first[r] + ((u * pieces[r]) >> 31)).astype(np.int32))

    d = d.withColumn("part", part_of("k1", "k2"))
    exact = d.groupBy("part").agg(F.sum("size"), F.count("*")).toPandas().to_numpy(np.int64)
    exact = exact[np.argsort(exact[:, 0])]
    before = np.cumsum(exact[:, 1:], axis=0) - exact[:, 1:]
    starts = spark.createDataFrame(
        pd.DataFrame({"part": exact[:, 0].astype(np.int32), "bytes_before": before[:, 0], "rows_before": before[:, 1]}), "part int, bytes_before long, rows_before long"
    )
    line = Window.partitionBy("part").orderBy("k1", "k2", "uid")
    d = d.withColumn("in_part", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("n_part", F.row_number().over(line) - 1)
    # At most two rows for each of at most 65,536 ranges: bounded, whatever the input.
    d = d.join(F.broadcast(starts), "part")
    middle = 2 * (F.col("bytes_before") + F.col("in_part")) + F.col("size")
    d = d.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * total))).cast("int"))
    d = d.withColumn("place", F.col("rows_before") + F.col("n_part"))
    d = cut(d.select("k", "size", "crc", "shard", "place", "part", *(["row"] if carry else [])))
    opens = {int(s): int(p) for s, p in d.groupBy("shard").agg(F.min("place")).collect()}
    table = F.array(*[F.lit(opens.get(s, 0)).cast("long") for s in range(shards)])
    return d.select(
        *(["row"] if carry else []),
        F.col("k").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.get(table, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("part").alias("key_range"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> DataFrame:
    """Write the records, with shard, slot and key_range (input columns of these names are replaced), as Parquet under
    `path`/shard=N; returns what was written."""
    made = ("shard", "slot", "key_range")
    d = assign_shards(docs, shards, carry=True, **options)
    d = d.select(*[F.col("row").getField(n).alias(n) for n in docs.columns if n not in made], *made)
    d.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)
