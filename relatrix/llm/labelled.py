"""A bounded, reproducible sample of labelled training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

UNIT = 1 << 30


def text_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, y, u): at most about `max_rows` labelled rows outside the held-out fifth; u is uniform in [0, 1).

    Ids are chosen by a hash, so reruns agree; of several labels of one id the largest counts. The chosen ids are
    bounded by `max_rows` and so may be broadcast; the texts are written once to the checkpoint folder.
    """
    lab = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (text_remainder(id_col, 5) != 0))
    lab = lab.groupBy(F.col(id_col).alias("lk")).agg(F.max(label).cast("int").alias("y"))
    n = lab.count()
    u = F.pmod(F.xxhash64("lk", F.lit(5)), F.lit(UNIT)) / UNIT
    lab = lab.withColumn("u", u / min(1.0, max_rows / max(1, n))).filter(F.col("u") < 1)
    d = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return cut(d.join(F.broadcast(lab), F.col("k") == F.col("lk")).select("k", "t", "y", "u"))
