"""Journal: parsing, duplicate suppression, search, pending items."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare


def parse(texts: DataFrame) -> DataFrame:
    """(text) of whole journal files -> stamp, action, file, reason. A block is `## [STAMP] ACTION` or
    `## STAMP - ACTION`, then `File:` and `Reason:`, each in bold or not."""
    block = r"(?m)^#+ \[?(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\]? (?:[-—|] )?(.+)\n+(?:\* |- )?\**File:?\**:? *(.*)\n+(?:\* |- )?\**Reason:?\**:? *(.*)$"
    parts = [F.regexp_extract_all("text", F.lit(block), i) for i in (1, 2, 3, 4)]
    d = texts.select(F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abcd")])).alias("e"))
    strip = lambda c: F.regexp_replace(F.trim(c), "^`|`$", "")
    e = [F.col("e").getField(n) for n in ("a", "b", "c", "d")] if "a" in d.schema["e"].dataType.names else [F.col("e").getField(str(i)) for i in range(4)]
    return d.select(F.to_timestamp_ntz(e[0]).alias("stamp"), F.trim(e[1]).alias("action"), strip(e[2]).alias("file"), F.trim(e[3]).alias("reason"))


def search(journal: DataFrame, query: str = "", file: str | None = None) -> DataFrame:
    """Case-sensitive containment in reason or file, and the exact file; an empty query matches all."""
    d = journal.filter(F.coalesce(F.col("reason").contains(query), F.lit(False)) | F.col("file").contains(query)) if query else journal
    return d if file is None else d.filter(F.col("file") == file)


def why(journal: DataFrame, file: str) -> DataFrame:
    return journal.filter(F.col("file") == file)


def by_day(journal: DataFrame) -> DataFrame:
    return journal.groupBy(F.date_format("stamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def suppress_duplicates(journal: DataFrame, window_s: int = 120, keys: tuple[str, ...] = ("action", "file", "reason"), order: str = "event_id", by_day: bool = True) -> DataFrame:
    """Greedy: an entry is dropped if a *kept* one of the same keys (and day) is at most `window_s` older, or newer.

    Entries of a key stand in the order of their stamp, then `order`, in one sorted partition, through which a task
    goes batch by batch with one key and one stamp in hand: a very long key costs time, not memory. The day is part of
    the key in the journal's own rule, which also splits long keys. An entry without a stamp is kept.
    """
    prepare(journal.sparkSession)
    names = journal.columns
    by = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] + ([F.to_date("stamp").alias("kd")] if by_day else [])
    stamp = F.unix_micros(F.col("stamp").cast("timestamp")).alias("us")
    d = journal.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *by, stamp, F.col(f"`{order}`").alias("o"))
    by = [c for c in d.columns if c[0] == "k"]
    d = d.repartition(*by).sortWithinPartitions(*by, "us", "o")
    width, gap = len(names), window_s * 1_000_000
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(journal.schema.fields)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            kept = np.zeros(b.num_rows, bool)
            own = zip(*(b.column(i).to_pylist() for i in range(width, width + len(by))))
            for i, (k, s) in enumerate(zip(own, b.column(width + len(by)).to_pylist())):
                if k != key:
                    key, last = k, None
                kept[i] = s is None or last is None or s - last > gap
                if kept[i] and s is not None:
                    last = s
            yield pa.RecordBatch.from_arrays(b.columns[:width], [f"c{i}" for i in range(width)]).filter(pa.array(kept))

    return d.mapInArrow(keep, ", ".join(kinds)).toDF(*names)


def pending(journal: DataFrame, order: str = "event_id") -> DataFrame:
    """One open item per file: its first message."""
    return journal.groupBy("file").agg(F.min_by("action", order).alias("message"), F.min(order).alias("first"))


def _matches(files: DataFrame, reasons: DataFrame) -> DataFrame:
    """(file, key, why, pos, c): every key that names a file; c is 0 for the exact key, 1 for a directory, 2 for a glob.

    Exact keys and directories meet the file and its ancestors by equality, whatever their number; only globs are tried
    on every file.
    """
    r = reasons.select("key", "why", "pos", (F.col("key").contains("*") | F.col("key").contains("?")).alias("glob"))
    parts = F.split("file", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    f = files.select("file").distinct()
    ups = F.concat(ups, F.array(F.concat("file", F.lit("/"))))
    plain = f.select("file", F.explode(ups).alias("key")).join(r, "key")
    plain = plain.select("file", "key", "why", "pos", F.when(F.col("file") == F.col("key"), 0).otherwise(1).alias("c"))
    quoted = F.regexp_replace("key", r"([\\.^$|()\[\]{}+])", r"\\$1")
    rx = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    globs = f.join(r.filter("glob").withColumn("rx", rx), F.rlike("file", F.col("rx"))).select("file", "key", "why", "pos", F.lit(2).alias("c"))
    return plain.unionByName(globs)


def reason_for(files: DataFrame, reasons: DataFrame) -> DataFrame:
    """(file) x (key, why, pos) -> (file, key, why): the exact key, else the longest directory, else the longest glob.

    In globs `*` crosses directories.
    """
    order = F.struct("c", (-F.length("key")).alias("l"), F.col("pos"))
    return _matches(files, reasons).groupBy("file").agg(F.min_by(F.struct("key", "why"), order).alias("m")).select("file", "m.key", "m.why")


def unused_reasons(files: DataFrame, reasons: DataFrame) -> DataFrame:
    """The reasons whose key names no file; a key that another one beats is used all the same."""
    return reasons.join(_matches(files, reasons).select("key").distinct(), "key", "left_anti")


#: Documents that are no sources of their own.
ARTIFACTS = ("file_health.md", "file_health.json", "pending_updates.md", "library.md")


def artifact(path: Column, staging: str = ".relatrix") -> Column:
    """Whether a path is a state document: a wiki, a file of the staging folder, a journal day or one of the fixed names."""
    return path.endswith(".wiki.md") | path.startswith(f"{staging}/") | path.startswith("journal/") | path.isin(*ARTIFACTS)


def reason_lines(text: str) -> list[tuple[str, str]]:
    """(key, why) of a JSON object of strings, or of lines `key=why`; empty lines and `#` comments are dropped."""
    if text.strip().startswith("{"):
        try:
            table = json.loads(text)
            return [(k, v) for k, v in table.items() if isinstance(v, str)]
        except ValueError:
            pass
    lines = [x.strip() for x in text.splitlines()]
    return [tuple(x.split("=", 1)) for x in lines if x and not x.startswith("#") and "=" in x]


def plan_changes(changes: DataFrame, reasons: DataFrame, default: str | None = None, only: list[str] | None = None) -> DataFrame:
    """(file, deleted) -> (file, deleted, why): the changes to record, why null where no reason fits.

    State documents are left out, and with `only` (keys, directories with a final slash, or globs) what none names.
    """
    d = changes.filter(~artifact(F.col("file"))).select("file", "deleted").distinct()
    if only:
        keys = changes.sparkSession.createDataFrame([(k, "", i) for i, k in enumerate(only)], "key string, why string, pos int")
        d = d.join(_matches(d, keys).select("file").distinct(), "file", "left_semi")
    d = d.join(reason_for(d, reasons).select("file", "why"), "file", "left")
    return d if default is None else d.withColumn("why", F.coalesce("why", F.lit(default)))


def new_entries(journal: DataFrame, entries: DataFrame, window_s: int = 120) -> DataFrame:
    """The entries (stamp, action, file, reason) that are not yet in the journal: one of the same action, file, reason and
    day that is at most `window_s` older, or newer, makes an entry a duplicate; so does an equal one of the batch."""
    old = journal.select("action", "file", "reason", F.col("stamp").alias("old"), F.to_date("stamp").alias("day"))
    d = entries.dropDuplicates(["action", "file", "reason"]).withColumn("day", F.to_date("stamp"))
    near = F.timestamp_diff("SECOND", F.col("old"), F.col("stamp")) <= window_s
    hit = d.join(old, ["action", "file", "reason", "day"]).filter(near).select("action", "file", "reason", "day").distinct()
    return d.join(hit, ["action", "file", "reason", "day"], "left_anti").select("stamp", "action", "file", "reason")
