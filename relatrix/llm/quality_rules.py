"""Line-first cleaning: rules per line, then rejection of documents that lose too much. Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word and symbol classes of the contract, and the line rules' patterns (valid in Java and RE2).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"
TERMINAL = r"[.!?…:;,\"'”’»)\]。！？][\x20\x09-\x0D]*\z"
SHOUT = r"[!?]"
SEPARATOR = r"[|»›•·→>]"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript",
    "click here", "sign in now", "sign in here", "sign up now", "sign up here", "log in to", "login to",
    "subscribe to our", "skip to content", "skip to main content", "back to top", "share this", "powered by", "lorem ipsum",
)
SHORT_LINE = 4
WINDOW = 5


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, also where the body is a lambda that uses it for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def solid(text: Column) -> Column:
    """Code points of the words."""
    return F.length(F.array_join(words_of(text), ""))


def boilerplate(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        out = out | low.contains(phrase)
    return out


def line_fails(line: Column, phrases: Column) -> Column:
    """Any of the three rules for one line that has a word; `phrases`: the document has a boilerplate phrase.

    The tests that need no word count come first: few lines get beyond them.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    n, marks, separators = count(WORD), count(SYMBOL), count(SEPARATOR)
    punctuation = (
        (~line.rlike(TERMINAL) & (n < SHORT_LINE))
        | ((count(SHOUT) > SHORT_LINE) & (n >= SHORT_LINE) & (count(SHOUT) > n))
        | ((marks >= 3) & (marks * 2 > n))
    )
    navigation = (separators >= 3) & (separators * 3 >= n)
    return punctuation | navigation | (phrases & boilerplate(line))


def repeated_words(words: Column) -> Column:
    """Words inside a window of five that occurs twice or more in the same array, its first occurrence included."""
    hashes = let(
        words,
        lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(
            ranked,
            lambda s: F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]), F.lit(False)) | F.coalesce((x["h"] == F.get(s, i + 1)["h"]), F.lit(False))),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(some).cast("long")


def clean_lines(docs: DataFrame, text_col: str = "text", min_kept: float = 0.5) -> DataFrame:
    """One row per input row: `row` (the input's columns as a struct), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, kept_chars, base_failed, kept and clean_text.

    clean_text holds the lines that have a word, pass every line rule and were not seen earlier in the document. A
    document is rejected if base_failed (fewer than 10 words, or over 20 % of its words in repeated windows of five)
    or if its clean text has less than `min_kept` of its word characters. A null or empty text has no words and is
    rejected; repeated rows are judged each; the other columns are only carried, whatever their names.

    Everything happens inside the row: no shuffle, no window, no Python.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    d = d.select("row", "t", words_of(F.col("t")).alias("words"), lines.alias("lines"), boilerplate(F.col("t")).alias("phrases"))
    d = d.withColumn("good", F.array_distinct(F.filter("lines", lambda x: ~line_fails(x, F.col("phrases")))))
    d = d.select(
        "row",
        "good",
        F.size("lines").alias("n_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    d = d.withColumn("clean_text", F.array_join("good", "\n"))
    # Where every line passed, nothing is counted again.
    left = F.when(F.size("good") == F.col("n_lines"), F.col("word_chars")).otherwise(solid(F.col("clean_text")).cast("long"))
    d = d.withColumn("kept_chars", left).drop("good", "n_lines")
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= min_kept * F.col("word_chars")))


def kept_documents(docs: DataFrame, text_col: str = "text", min_kept: float = 0.5) -> DataFrame:
    """The documents that are kept, with their clean text; the input's columns.

    The row number in the condition keeps the optimizer from moving the filter below the projection, where it would
    work out every measure a second time.
    """
    d = clean_lines(docs, text_col, min_kept).withColumn("line_", F.monotonically_increasing_id())
    fields = [F.col("clean_text") if n == text_col else F.col("row").getField(n) for n in docs.columns]
    return d.filter(F.col("kept") & (F.col("line_") >= 0)).select(*[f.alias(n) for f, n in zip(fields, docs.columns)])


def oracle_sql(min_kept: float = 0.5) -> str:
    """The op4 query's rows in DuckDB SQL, from the same patterns."""
    q = lambda s: s.replace("'", "''")
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    n = f"len(regexp_extract_all(x, '{WORD}'))"
    marks = f"len(regexp_extract_all(x, '{SYMBOL}'))"
    phrases = " OR ".join(f"contains(lower(x), '{b}')" for b in BOILERPLATE)
    seps = f"len(regexp_extract_all(x, '{SEPARATOR}'))"
    fails = f"""((NOT regexp_matches(x, '{q(TERMINAL)}') AND {n} < {SHORT_LINE})
      OR ({n} >= {SHORT_LINE} AND len(regexp_extract_all(x, '{SHOUT}')) > {n})
      OR ({marks} >= 3 AND {marks} * 2 > {n})
      OR ({seps} >= 3 AND {seps} * 3 >= {n})
      OR {phrases})"""
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
g AS (SELECT r, p, list_slice(words, p, p + 4) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS p FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g),
cover AS (SELECT r, least(5, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 5)) AS k FROM twice WHERE n > 1),
reps AS (SELECT r, sum(k) AS k FROM cover GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '{SYMBOL}')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words,
        length(translate(array_to_string(list_distinct(list_filter(lines, lambda x: NOT {fails})), ''), {blanks}, '')) AS kept_chars
      FROM w LEFT JOIN reps USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= {min_kept} * word_chars AS kept
FROM b"""
