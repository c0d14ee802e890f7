"""The index file of a git checkout (versions 2 and 3): which files git knows to be unchanged, and their blobs."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

ENTRIES = "array<struct<rel:string,size:bigint,mtime_s:bigint,mtime_ns:bigint,oid:string>>"


def parse_index(data: bytes, oid_bytes: int = 20) -> list[tuple[str, int, int, int, str]] | None:
    """(path, size, seconds, nanoseconds, blob) of the entries outside merges; None for what is no such index."""
    if data[:4] != b"DIRC" or len(data) < 12:
        return None
    version, count = struct.unpack_from(">II", data, 4)
    if version not in (2, 3):
        return None
    out, at = [], 12
    try:
        for _ in range(count):
            seconds, nanos = struct.unpack_from(">II", data, at + 8)
            (size,) = struct.unpack_from(">I", data, at + 36)
            oid = data[at + 40 : at + 40 + oid_bytes]
            (flags,) = struct.unpack_from(">H", data, at + 40 + oid_bytes)
            name = at + 42 + oid_bytes + (2 if flags & 0x4000 else 0)
            if flags & 0x4000 and version < 3:
                return None
            end = name + (flags & 0x0FFF) if flags & 0x0FFF < 0x0FFF else data.index(b"\0", name)
            if end > len(data):
                return None
            if not flags & 0x3000:
                out.append((data[name:end].decode("utf-8"), size, seconds, nanos, oid.hex()))
            at += (end - at + 8) & ~7
    except (struct.error, ValueError):
        return None
    return out


def git_index(spark: SparkSession, path: str, oid_bytes: int = 20) -> DataFrame:
    """(rel, size, mtime_s, mtime_ns, oid, racy) of the index file at `path`; no rows if it cannot be read as one.

    racy: stamped at or after the index itself, so the file may have changed in the same tick.
    """

    def entries(content: pd.Series) -> pd.Series:
        names = ("rel", "size", "mtime_s", "mtime_ns", "oid")
        return pd.Series([[dict(zip(names, e)) for e in parse_index(c, oid_bytes) or []] for c in content])

    d = prepare(spark).read.format("binaryFile").load(path)
    written = F.unix_micros("modificationTime").alias("written")
    d = d.select(written, F.explode(F.pandas_udf(entries, ENTRIES)("content")).alias("e")).select("written", "e.*")
    at = F.col("mtime_s") * 1_000_000 + F.floor(F.col("mtime_ns") / 1000)
    racy = F.when((F.col("mtime_ns") == 0) | (F.col("written") % 1_000_000 == 0), F.col("mtime_s") >= F.floor(F.col("written") / 1_000_000)).otherwise(at >= F.col("written"))
    return d.select("rel", "size", "mtime_s", "mtime_ns", "oid", racy.alias("racy"))


def vouched(index: DataFrame, stat: DataFrame) -> DataFrame:
    """(rel, oid) of the files (rel, size, mtime_us) that still have their entry's size and time and are not racy. An entry
    without nanoseconds is compared by seconds."""
    d = index.filter("NOT racy").withColumnRenamed("size", "known").join(stat.select("rel", "size", "mtime_us"), "rel")
    seconds, micros = F.floor(F.col("mtime_us") / 1_000_000), F.col("mtime_us") % 1_000_000
    same = (F.col("mtime_s") == seconds) & ((F.col("mtime_ns") == 0) | (F.floor(F.col("mtime_ns") / 1000) == micros))
    return d.filter(same & (F.col("size") % (1 << 32) == F.col("known"))).select("rel", "oid")


def same_blobs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rel) that two checkouts vouch for with the same blob: equal without being read."""
    return a.join(b, ["rel", "oid"], "left_semi").select("rel")
