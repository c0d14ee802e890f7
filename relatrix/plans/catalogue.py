"""The query catalogue: each query over the driver tables, with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, files, graph, health, journal, overlay
from ..session import prepare, stored
from ..sources import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MAX_LINES, MAX_FAN_IN = 50, 2


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a query; `sql` follows the adapters' CTEs."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            head = "WITH RECURSIVE " if recursive else "WITH "
            ORACLES[name] = head + A.SQL.strip() + ("\n" + body if body.upper().startswith("SELECT") or body.startswith("(") else ",\n" + body)
        return f

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_edges(A.raw_edges(spark, d))


EDGE = "src, dst, line, conditional, dynamic, via_barrel"


@query("edge_merge", f"SELECT src, dst, min_by(line, seq) AS line, bool_or(conditional) AS conditional, bool_or(dynamic) AS dynamic, bool_and(via_barrel) AS via_barrel FROM raw_v GROUP BY src, dst")
def _(s, d):
    return graph.merge_edges(A.raw_edges(s, d))


@query("edge_confidence", f"SELECT {EDGE}, confidence, reason FROM conf_v")
def _(s, d):
    return graph.with_confidence(edges(s, d))


HUB = "(SELECT dst FROM edges_v GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def hub(e: DataFrame, side: str):
    """The node that most edges meet at `side`: one row."""
    return F.broadcast(e.groupBy(side).agg(F.count("*").alias("n_")).orderBy(F.desc("n_"), side).limit(1).select(side))


@query("dependents_of", f"SELECT DISTINCT src FROM edges_v WHERE dst = {HUB}")
def _(s, d):
    e = edges(s, d)
    return e.join(hub(e, "dst"), "dst").select("src").distinct()


@query("dependencies_of", "SELECT src, dst, line, confidence, reason FROM conf_v WHERE src = (SELECT src FROM edges_v GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)")
def _(s, d):
    e = edges(s, d)
    return graph.with_confidence(e.join(hub(e, "src"), "src")).select("src", "dst", "line", "confidence", "reason")


@query("dependents_by_group", "SELECT src // 10 AS dir, count(DISTINCT src) AS n FROM edges_v GROUP BY 1 ORDER BY n DESC, dir LIMIT 20")
def _(s, d):
    return graph.edge_groups(edges(s, d), F.floor(F.col("src") / 10).cast("long"))


@query("fan_in_top20", "SELECT dst, count(*) AS dependents FROM edges_v GROUP BY dst ORDER BY dependents DESC, dst LIMIT 20")
def _(s, d):
    return graph.top_dependents(edges(s, d))


@query("low_conf_total", "SELECT count(*) AS n FROM conf_v WHERE confidence < 0.65 AND NOT dynamic")
def _(s, d):
    return graph.low_confidence(edges(s, d)).agg(F.count("*").alias("n"))


@query("low_conf_by_src", "SELECT src, count(*) AS n FROM conf_v WHERE confidence < 0.65 AND NOT dynamic GROUP BY src")
def _(s, d):
    return graph.low_confidence(edges(s, d)).groupBy("src").agg(F.count("*").alias("n"))


@query("reason_code_counts", "SELECT reason, count(*) AS n FROM conf_v GROUP BY reason")
def _(s, d):
    return graph.with_confidence(edges(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query("flagged_edges", "SELECT count(*) AS n FROM conf_v WHERE conditional OR dynamic OR via_barrel OR confidence < 0.8")
def _(s, d):
    return graph.with_confidence(edges(s, d)).agg(F.count_if(F.expr("conditional OR dynamic OR via_barrel OR confidence < 0.8")).alias("n"))


@query(
    "impact_depth3",
    """w(node, affected, depth) AS (SELECT dst, src, 1 FROM edges_v UNION
  SELECT w.node, e.src, w.depth + 1 FROM w JOIN edges_v e ON e.dst = w.affected WHERE w.depth < 3)
SELECT node, affected, CAST(min(depth) AS BIGINT) AS depth FROM w WHERE node <> affected GROUP BY node, affected""",
    recursive=True,
)
def _(s, d):
    return graph.impact(edges(s, d), 3)


@query(
    "impact_of_hub",
    f"""s AS (SELECT dst AS node FROM {HUB}),
w(node, depth) AS (SELECT node, 0 FROM s UNION SELECT e.src, w.depth + 1 FROM w JOIN edges_v e ON e.dst = w.node WHERE w.depth < 3)
SELECT node AS affected, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node HAVING min(depth) > 0""",
    recursive=True,
)
def _(s, d):
    e = stored(edges(s, d))
    return graph.impact_of(e, hub(e, "dst").select(F.col("dst").alias("node")), 3)


REACH = "reach(src, dst) AS (SELECT src, dst FROM edges_v UNION SELECT r.src, e.dst FROM reach r JOIN edges_v e ON r.dst = e.src)"
SCC = REACH + """,
nodes AS (SELECT src AS node FROM edges_v UNION SELECT dst FROM edges_v),
scc AS (SELECT node, least(node, coalesce(min(b.dst), node)) AS component FROM nodes
  LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) b ON b.src = node GROUP BY node),
cyc AS (SELECT component, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1)"""


@query("reachability_closure", REACH + " SELECT src, dst FROM reach", recursive=True)
def _(s, d):
    return graph.closure(edges(s, d))


def components(s, d):
    e = stored(edges(s, d))
    return e, graph.strong_components(e)


@query("scc_components", SCC + " SELECT node, component FROM scc", recursive=True)
def _(s, d):
    return components(s, d)[1]


@query(
    "cycle_report",
    SCC
    + """, o AS (SELECT a.component, count(*) AS n FROM edges_v JOIN scc a ON a.node = src JOIN scc b ON b.node = dst WHERE a.component <> b.component GROUP BY 1)
SELECT component, size, coalesce(n, 0) AS external_edges, CAST(size * 2.0 + coalesce(n, 0) * 0.8 AS DOUBLE) AS score,
  CASE WHEN size >= 8 OR coalesce(n, 0) >= 20 THEN 'HIGH' WHEN size >= 3 OR coalesce(n, 0) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN size <= 2 THEN 'audit_and_directional_split' ELSE 'extract_shared_module' END AS strategy
FROM cyc LEFT JOIN o USING (component)""",
    recursive=True,
)
def _(s, d):
    return graph.cycle_report(*components(s, d))


INSIDE = ", inside AS (SELECT a.component, c.* FROM conf_v c JOIN scc a ON a.node = src JOIN scc b ON b.node = dst WHERE a.component = b.component)"


@query("cycle_break_hint", SCC + INSIDE + " SELECT component, src, dst, confidence FROM inside QUALIFY row_number() OVER (PARTITION BY component ORDER BY confidence, src, dst) = 1", recursive=True)
def _(s, d):
    return graph.break_hints(*components(s, d))


@query("in_cycle_edges", SCC + INSIDE + " SELECT src, dst, component FROM inside", recursive=True)
def _(s, d):
    return graph.in_cycle(*components(s, d)).select("src", "dst", "component")


@query("list_paths_root", "SELECT 'dir' AS kind, split_part(rel, '/', 1) || '/' AS path, count(*) AS n FROM files_v GROUP BY 2")
def _(s, d):
    return files.list_paths(A.files(s, d), "")


@query("list_paths_prefix", "SELECT 'dir' AS kind, split_part(rel, '/', 2) || '/' AS path, count(*) AS n FROM files_v WHERE starts_with(rel, 'src1/') GROUP BY 2")
def _(s, d):
    return files.list_paths(A.files(s, d), "src1")


@query(
    "folder_cards",
    """u AS (SELECT '' AS prefix, split_part(rel, '/', 1) AS child, false AS direct FROM files_v
  UNION ALL SELECT split_part(rel, '/', 1), split_part(rel, '/', 2), false FROM files_v
  UNION ALL SELECT split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2), split_part(rel, '/', 3), true FROM files_v)
SELECT prefix, count(*) FILTER (direct) AS n_files, count(DISTINCT child) FILTER (NOT direct) AS n_dirs, count(*) AS file_count FROM u GROUP BY prefix""",
)
def _(s, d):
    return files.folder_cards(A.files(s, d))


LINE = f"la AS (SELECT rel AS file, 'line_count' AS kind, n_lines AS value, CAST({MAX_LINES} AS BIGINT) AS threshold FROM files_v WHERE n_lines > {MAX_LINES})"
FAN = f"fa AS (SELECT CAST(dst AS VARCHAR) AS file, 'fan_in' AS kind, count(*) AS value, CAST({MAX_FAN_IN} AS BIGINT) AS threshold FROM edges_v GROUP BY dst HAVING count(*) > {MAX_FAN_IN})"


def line_alerts(s, d):
    return files.line_alerts(A.files(s, d), MAX_LINES)


def fan_alerts(s, d):
    e = edges(s, d).select(F.col("src").cast("string"), F.col("dst").cast("string"))
    return files.fan_in_alerts(e, e.select(F.col("dst").alias("file")), MAX_FAN_IN)


@query("line_alerts", LINE + " SELECT * FROM la")
def _(s, d):
    return line_alerts(s, d)


@query("fan_in_alerts", FAN + " SELECT * FROM fa")
def _(s, d):
    return fan_alerts(s, d)


@query("ranked_alerts", LINE + ", " + FAN + " SELECT * FROM (SELECT * FROM la UNION ALL SELECT * FROM fa) ORDER BY value / threshold DESC, file, kind LIMIT 10")
def _(s, d):
    return files.ranked_alerts(line_alerts(s, d).unionByName(fan_alerts(s, d)))


@query("modularity_by_kind", LINE + ", " + FAN + " SELECT kind, count(*) AS n, max(value) AS largest FROM (SELECT * FROM la UNION ALL SELECT * FROM fa) GROUP BY kind")
def _(s, d):
    return files.modularity_by_kind(line_alerts(s, d).unionByName(fan_alerts(s, d)))


@query("content_hash", "SELECT rel, size, hash, n_lines FROM files_v")
def _(s, d):
    return A.files(s, d).select("rel", "size", "hash", "n_lines")


@query("duplicate_content", "SELECT hash, count(*) AS n, min(rel) AS first_rel FROM files_v GROUP BY hash HAVING count(*) > 1")
def _(s, d):
    return files.duplicate_content(A.files(s, d))


COUNTS = "count(*) AS total, count(*) FILTER (status = 'Green') AS green, count(*) FILTER (status = 'Yellow') AS yellow, count(*) FILTER (status = 'Red') AS red"


@query(
    "health_summary",
    f"SELECT {COUNTS}, " + ", ".join(f"count(*) FILTER (status = 'Green' AND verification = '{v}') AS {v}" for v in health.VERIFICATIONS)
    + ", count(*) FILTER (status = 'Green' AND verification IS NULL) AS other FROM health_v",
)
def _(s, d):
    return health.summary(A.health(s, d))


@query("metrics_snapshot", f"SELECT {COUNTS} FROM health_v")
def _(s, d):
    return health.metrics(A.health(s, d))


@query("healing_stats", "SELECT count(*) FILTER (reason = 'Initial stub') AS stub_count, count(*) AS total FROM health_v")
def _(s, d):
    return health.healing_stats(A.health(s, d))


@query(
    "health_ranked",
    """SELECT file, status, reason, CAST(CASE WHEN status = 'Red' THEN 0 WHEN status = 'Yellow' AND reason <> 'Initial stub' THEN 1
  WHEN reason = 'Initial stub' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM health_v ORDER BY rank, file LIMIT 10""",
)
def _(s, d):
    return health.ranked(A.health(s, d))


@query(
    "readiness",
    """SELECT CASE WHEN count(*) = 0 THEN 'blocked' WHEN count(*) FILTER (status = 'Red') > 0 THEN 'not_ready'
  WHEN count(*) FILTER (status = 'Yellow' AND reason <> 'Initial stub') > 0 THEN 'ready_with_agent_wiki_work' ELSE 'ready_for_daemon' END AS readiness FROM health_v""",
)
def _(s, d):
    return health.readiness(A.health(s, d))


@query("stub_seed", "SELECT file, 'Yellow' AS status, 'Initial stub' AS reason, source_hash FROM health_v WHERE reason = 'Initial stub'")
def _(s, d):
    lab = A.table(s, d, "labels").select(F.col("doc_id").alias("lid"))
    f = A.files(s, d)
    return health.seed_stubs(f, f.join(lab, F.col("doc_id") == F.col("lid"), "left_semi").select(F.col("rel").alias("file")))


@query(
    "next_actions",
    LINE
    + """, al AS (SELECT la.*, h.file IS NOT NULL AS changed FROM la LEFT JOIN (SELECT file FROM health_v WHERE status = 'Yellow' AND contains(reason, 'content changed')) h USING (file)
  ORDER BY NOT changed, value / threshold DESC, file, kind LIMIT 10)
SELECT CAST(1 AS BIGINT) AS priority, 'record_deletion' AS action, file, reason FROM health_v WHERE status = 'Red'
UNION ALL SELECT 2, 'prepare_edit', file, reason FROM health_v WHERE status = 'Yellow' AND reason <> 'Initial stub'
UNION ALL SELECT 3, 'review_modularity', file, kind || ' ' || value || ' > ' || threshold FROM al
UNION ALL SELECT 4, 'review_low_confidence_edges', NULL, n || ' actionable low-confidence project edges (see get_dependencies)'
  FROM (SELECT count(*) AS n FROM conf_v WHERE confidence < 0.65 AND NOT dynamic) WHERE n > 0""",
)
def _(s, d):
    return health.next_actions(A.health(s, d), line_alerts(s, d), graph.low_confidence(edges(s, d)))


@query(
    "check_changes",
    """SELECT file, CASE WHEN t.rel IS NULL THEN 'Red' ELSE 'Yellow' END AS status,
  CASE WHEN t.rel IS NULL THEN 'missing on disk (check-changes)' ELSE 'content changed since last mark-green' END AS reason,
  NOT CASE WHEN t.rel IS NULL THEN status = 'Red' ELSE status = 'Yellow' AND contains(reason, 'content changed since last mark-green') END AS journal
FROM health_v h LEFT JOIN tree_v t ON h.file = t.rel WHERE t.rel IS NULL OR t.hash <> h.source_hash""",
)
def _(s, d):
    return health.check_changes(A.health(s, d), A.overlay_tree(A.files(s, d)))


@query(
    "overlay_diff",
    """SELECT coalesce(f.rel, t.rel) AS rel, CASE WHEN f.rel IS NULL THEN 'added' WHEN t.rel IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM files_v f FULL JOIN tree_v t ON f.rel = t.rel WHERE f.rel IS NULL OR t.rel IS NULL OR f.hash <> t.hash""",
)
def _(s, d):
    f = A.files(s, d)
    return overlay.differing(f, A.overlay_tree(f))


@query(
    "overlay_new_alerts",
    f"""SELECT rel AS file, 'line_count' AS kind, n_lines AS value, CAST({MAX_LINES} AS BIGINT) AS threshold FROM tree_v WHERE n_lines > {MAX_LINES}
  AND rel NOT IN (SELECT rel FROM files_v WHERE n_lines > {MAX_LINES})""",
)
def _(s, d):
    f = A.files(s, d)
    return overlay.new_alerts(files.line_alerts(f, MAX_LINES), files.line_alerts(A.overlay_tree(f), MAX_LINES))


@query("overlay_table", "SELECT rel, hash, n_lines FROM tree_v")
def _(s, d):
    f = A.files(s, d)
    t = A.overlay_tree(f)
    return overlay.overlaid(f.select("rel", "hash", "n_lines"), t.select("rel", "hash", "n_lines"), overlay.differing(f, t))


@query("journal_by_day", "SELECT strftime(stamp, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT file) AS files FROM journal_v GROUP BY 1")
def _(s, d):
    return journal.by_day(A.journal(s, d))


@query("journal_search", "SELECT stamp, action, file, reason FROM journal_v WHERE (contains(reason, '7') OR contains(file, '7')) AND file = 'user/17'")
def _(s, d):
    return journal.search(A.journal(s, d), "7", "user/17").drop("event_id")


@query("why_file", "SELECT stamp, action, file, reason FROM journal_v WHERE file = 'user/3'")
def _(s, d):
    return journal.why(A.journal(s, d), "user/3").drop("event_id")


@query(
    "journal_dedup",
    """o AS (SELECT *, row_number() OVER (PARTITION BY action, file ORDER BY stamp, event_id) AS n FROM journal_v),
w AS (SELECT action, file, n, stamp AS kept, event_id, true AS keep FROM o WHERE n = 1 UNION ALL
  SELECT o.action, o.file, o.n, CASE WHEN o.stamp - w.kept > INTERVAL 6 HOUR THEN o.stamp ELSE w.kept END, o.event_id, o.stamp - w.kept > INTERVAL 6 HOUR
  FROM w JOIN o ON o.action = w.action AND o.file = w.file AND o.n = w.n + 1)
SELECT action, file, event_id FROM w WHERE keep""",
    recursive=True,
)
def _(s, d):
    return journal.suppress_duplicates(A.journal(s, d), 6 * 3600, ("action", "file"), by_day=False).select("action", "file", "event_id")


@query("pending_first", "SELECT file, min_by(action, event_id) AS message, min(event_id) AS first FROM journal_v GROUP BY file")
def _(s, d):
    return journal.pending(A.journal(s, d))


REASONS = [("src1/en/1.txt", "exact", 0), ("src1/", "whole source", 1), ("src1/fr/", "one language", 2), ("*/es/*", "glob", 3), ("*/es/1*", "longer glob", 4)]
KEYS = "k(key, why, pos) AS (VALUES " + ", ".join(map(str, REASONS)) + ")"
MATCH = """m AS (SELECT rel AS file, key, why, pos, CASE WHEN rel = key THEN 0 WHEN ends_with(key, '/') AND starts_with(rel, key) THEN 1
  WHEN contains(key, '*') AND regexp_matches(rel, '(?s)^' || replace(replace(key, '.', '\\.'), '*', '.*') || '$') THEN 2 END AS c FROM files_v, k)"""


@query("reason_for", f"{KEYS}, {MATCH} SELECT file, key, why FROM m WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY c, length(key) DESC, pos) = 1".replace("\\\\", "\\"))
def _(s, d):
    return journal.reason_for(A.files(s, d).withColumnRenamed("rel", "file"), s.createDataFrame(REASONS, "key string, why string, pos int"))


@query("stale_rows", "SELECT rel FROM files_v WHERE rel NOT IN (SELECT rel FROM tree_v)")
def _(s, d):
    f = A.files(s, d)
    return overlay.stale_rows(f, A.overlay_tree(f))


@query("validate", "SELECT file, 'missing' AS problem FROM health_v WHERE reason = 'Initial stub' UNION ALL SELECT f.rel, 'content_drift' FROM files_v f JOIN tree_v t USING (rel) WHERE f.hash <> t.hash")
def _(s, d):
    f = A.files(s, d)
    return overlay.validate(f, A.health(s, d).filter("reason <> 'Initial stub'"), A.overlay_tree(f))


@query("prune", "SELECT file, status, reason FROM health_v WHERE file IN (SELECT rel FROM tree_v) AND (starts_with(file, 'src1/') OR starts_with(file, 'src2/'))")
def _(s, d):
    return overlay.prune(A.health(s, d), A.overlay_tree(A.files(s, d)), ["src1", "src2"]).select("file", "status", "reason")


@query("remove_node", f"SELECT {EDGE} FROM edges_v WHERE src % 7 <> 3 AND dst % 7 <> 3")
def _(s, d):
    e = edges(s, d)
    return overlay.remove_node(e, e.select(F.col("src").alias("file")).union(e.select("dst")).distinct().filter("file % 7 = 3")).select(*EDGE.split(", "))


@query(
    "consistency",
    "SELECT src, dst, 'missing_reverse' AS problem FROM edges_v WHERE (src + dst) % 5 = 0",
)
def _(s, d):
    e = edges(s, d)
    return overlay.consistency(e, e.filter("(src + dst) % 5 <> 0"))


FIRST = "split_part(ltrim(raw, '/'), '/', 1)"


@query("ref_class", "SELECT CASE WHEN starts_with(raw, '/') THEN 'root' WHEN contains(raw, '://') THEN 'external' ELSE 'relative' END AS class, count(*) AS n FROM refs_v GROUP BY 1")
def _(s, d):
    raw = F.col("raw")
    kind = F.when(raw.startswith("/"), "root").when(raw.contains("://"), "external").otherwise("relative")
    return A.refs(s, d).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "ref_resolve",
    f"""p AS (SELECT split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', 1) AS head, min(url) AS target FROM pages GROUP BY 1)
SELECT page_id, pos, raw, target FROM refs_v LEFT JOIN p ON head = {FIRST}""",
)
def _(s, d):
    head = lambda c: F.substring_index(c, "/", 1)
    p = A.table(s, d, "pages").groupBy(head(F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("head")).agg(F.min("url").alias("target"))
    r = A.refs(s, d).withColumn("head", head(F.ltrim(F.col("raw"), F.lit("/"))))
    return r.join(p, "head", "left").select("page_id", "pos", "raw", "target")


@query("changed_ranges")
def _(s, d):
    p = A.text_pairs(s, d)
    return p.select("conv_id", "turn", drift.ranges_column(F.col("old_text"), F.col("new_text")).alias("ranges"))
