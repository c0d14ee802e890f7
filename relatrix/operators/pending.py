"""The pending list: one open item per file, as a table and as the lines of its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the document.
TITLE = "# Pending Updates"
EMPTY_NOTE = "(no pending items — run check-changes after making edits)"
CLOSING = " — refresh the wiki, then mark-green"


def file_of(line: Column) -> Column:
    """The file of a line `- path: message` or of an older `- path — message` or `- path - message`; else null."""
    body = F.trim(line)
    item = body.startswith("- ")
    rest = F.substring(body, F.lit(3), F.length(body))
    at = F.instr(rest, ": ")
    new = F.trim(F.substring(rest, F.lit(1), at - 1))
    old = F.trim(F.split_part(F.split_part(rest, F.lit(" — "), F.lit(1)), F.lit(" - "), F.lit(1)))
    path = F.when((at > 0) & (new != ""), new).otherwise(old)
    return F.when(item & (path != ""), path)


def parse(lines: DataFrame) -> DataFrame:
    """(pos, value) -> (file, message): the first item of each file."""
    f = file_of(F.col("value"))
    rest = F.regexp_extract(F.trim("value"), r"^- .*?(?:: | — | - )(.*)$", 1)
    d = lines.select("pos", f.alias("file"), rest.alias("message")).filter("file IS NOT NULL")
    return d.groupBy("file").agg(F.min_by("message", "pos").alias("message"))


def append(pending: DataFrame, items: DataFrame) -> DataFrame:
    """(file, message) with the first new message of each file that is not listed yet."""
    new = items.groupBy("file").agg(F.min("message").alias("message")).join(pending.select("file"), "file", "left_anti")
    return pending.select("file", "message").unionByName(new)


def remove(pending: DataFrame, files: DataFrame) -> DataFrame:
    return pending.join(files.select("file"), "file", "left_anti")


def record_message(reason: Column) -> Column:
    return F.concat(reason, F.lit(CLOSING))


def document(pending: DataFrame) -> DataFrame:
    """(pos, value): the document's lines, with the note where nothing is open."""
    spark = pending.sparkSession
    head = spark.createDataFrame([(0, TITLE), (1, "")], "pos long, value string")
    items = pending.select((F.row_number().over(_by_file()) + 1).cast("long").alias("pos"), F.concat(F.lit("- "), "file", F.lit(": "), "message").alias("value"))
    none = pending.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(2).cast("long").alias("pos"), F.lit(EMPTY_NOTE).alias("value"))
    return head.unionByName(items).unionByName(none).orderBy("pos")


def _by_file():
    from pyspark.sql import Window

    # One document of one project: its items are one sequence.
    return Window.orderBy("file")
