"""Driver tables as the relations of the data model, in DataFrame form and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, physical_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: rel = source/lang/doc_id.txt."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel"),
        "doc_id",
        text.alias("text"),
        F.octet_length(text).cast("long").alias("size"),
        content_hash(text).alias("hash"),
        physical_lines(text).alias("n_lines"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as repeated evidence for edges part key -> supplier key, one space of nodes; every row but self-references."""
    d = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey")
    return d.select(
        F.col("l_partkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_linenumber").cast("long").alias("line"),
        (F.col("l_returnflag") == "R").alias("conditional"),
        ((F.col("l_linestatus") == "O") & (F.col("l_discount") >= 0.08)).alias("dynamic"),
        (F.col("l_tax") >= 0.04).alias("via_barrel"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with labels as health rows."""
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "lid")
    d = files(spark, sf_dir).join(lab, F.col("doc_id") == F.col("lid"), "left")
    seen = F.col("lid").isNotNull()
    return d.select(
        F.col("rel").alias("file"),
        F.when(~seen, "Yellow").when(F.col("toxic") == 1, "Red").when(F.col("quality") == 1, "Green").otherwise("Yellow").alias("status"),
        F.when(~seen, "Initial stub").when(F.col("toxic") == 1, "missing on disk").when(F.col("quality") == 1, "marked green").otherwise("content changed since last mark-green").alias("reason"),
        F.when(seen & (F.col("toxic") == 0) & (F.col("quality") == 1), F.get(F.array(*map(F.lit, ("verified", "forced", "no_wiki", "unchecked", "legacy"))), (F.col("doc_id") % 7).cast("int"))).alias("verification"),
        F.col("hash").alias("source_hash"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").alias("stamp"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file"),
        F.get_json_object("props", "$.k").alias("reason"),
        "event_id",
    )


def overlay_tree(base: DataFrame) -> DataFrame:
    """A branch over `files`: a tenth deleted, a tenth changed, a tenth of copies added."""
    kept = base.filter("doc_id % 10 <> 7")
    changed = F.col("doc_id") % 10 == 3
    kept = kept.select("rel", "doc_id", F.when(changed, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"), F.when(changed, F.col("n_lines") + 40).otherwise(F.col("n_lines")).alias("n_lines"))
    added = base.filter("doc_id % 10 = 5").select(F.concat(F.lit("added/"), "rel").alias("rel"), (F.col("doc_id") + 1000000).alias("doc_id"), "hash", "n_lines")
    return kept.unionByName(added)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """href values of pages, scripts and comments dropped, with their position in the page."""
    p = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<script.*?</script>", ""), r"(?s)<!--.*?-->", "")
    return p.select("page_id", "url", F.posexplode(F.regexp_extract_all(body, F.lit('href="([^"]*)"'), 1)).alias("pos", "raw")).withColumn("pos", F.col("pos").cast("long"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new_text"))
    return c.select("conv_id", "turn", F.col("text").alias("old_text")).join(nxt, ["conv_id", "turn"])


SQL = r"""
files_v AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS rel, doc_id, coalesce(text, '') AS text,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  'sha256:' || sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS hash,
  CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), ''))
    + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS n_lines FROM documents),
raw_v AS (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey * 8 + l_linenumber AS seq, CAST(l_linenumber AS BIGINT) AS line,
  l_returnflag = 'R' AS conditional, l_linestatus = 'O' AND l_discount >= 0.08 AS dynamic, l_tax >= 0.04 AS via_barrel
  FROM lineitem WHERE l_partkey <> l_suppkey),
edges_v AS (SELECT src, dst, min_by(line, seq) AS line, bool_or(conditional) AS conditional, bool_or(dynamic) AS dynamic,
  bool_and(via_barrel) AS via_barrel FROM raw_v GROUP BY src, dst),
conf_v AS (SELECT *, CAST(CASE WHEN dynamic THEN 0.4 WHEN conditional THEN 0.55 WHEN via_barrel THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence,
  CASE WHEN dynamic THEN 'dynamic_literal' WHEN conditional THEN 'conditional_guard' WHEN via_barrel THEN 'via_barrel' ELSE 'resolved_static' END AS reason
  FROM edges_v),
health_v AS (SELECT rel AS file, f.doc_id,
  CASE WHEN l.doc_id IS NULL THEN 'Yellow' WHEN toxic = 1 THEN 'Red' WHEN quality = 1 THEN 'Green' ELSE 'Yellow' END AS status,
  CASE WHEN l.doc_id IS NULL THEN 'Initial stub' WHEN toxic = 1 THEN 'missing on disk' WHEN quality = 1 THEN 'marked green' ELSE 'content changed since last mark-green' END AS reason,
  CASE WHEN l.doc_id IS NOT NULL AND toxic = 0 AND quality = 1 THEN
    CASE f.doc_id % 7 WHEN 0 THEN 'verified' WHEN 1 THEN 'forced' WHEN 2 THEN 'no_wiki' WHEN 3 THEN 'unchecked' WHEN 4 THEN 'legacy' END END AS verification,
  hash AS source_hash FROM files_v f LEFT JOIN labels l ON f.doc_id = l.doc_id),
journal_v AS (SELECT ts AS stamp, event_type AS action, 'user/' || user_id AS file, json_extract_string(props, '$.k') AS reason, event_id FROM events),
tree_v AS (SELECT rel, doc_id, CASE WHEN doc_id % 10 = 3 THEN hash || 'x' ELSE hash END AS hash,
    CASE WHEN doc_id % 10 = 3 THEN n_lines + 40 ELSE n_lines END AS n_lines FROM files_v WHERE doc_id % 10 <> 7
  UNION ALL SELECT 'added/' || rel, doc_id + 1000000, hash, n_lines FROM files_v WHERE doc_id % 10 = 5),
refs_v AS (SELECT page_id, url, CAST(unnest(range(len(h))) AS BIGINT) AS pos, unnest(h) AS raw FROM (SELECT page_id, url,
  regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), 'href="([^"]*)"', 1) AS h FROM pages))
"""
