"""Health rows: summaries, ranking, readiness, seeding, transitions, actions, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import under_prefix
from .files import severity

STUB = "Initial stub"
CHANGED = "content changed since last mark-green"
VERIFICATIONS = ("verified", "forced", "no_wiki", "unchecked", "legacy")


def is_green(s: Column) -> Column:
    return s.contains("Green") | s.contains("🟢")


def is_red(s: Column) -> Column:
    return s.contains("Red") | s.contains("🔴")


def is_yellow(s: Column) -> Column:
    return s.contains("Yellow") | s.contains("🟡")


def summary(health: DataFrame) -> DataFrame:
    """One row; what is neither green nor red counts as yellow; green rows by verification, the rest as other."""
    green, red = is_green(F.col("status")), ~is_green(F.col("status")) & is_red(F.col("status"))
    known = F.coalesce(F.col("verification").isin(*VERIFICATIONS), F.lit(False))
    return health.agg(
        F.count("*").alias("total"),
        F.count_if(green).alias("green"),
        F.count_if(~green & ~red).alias("yellow"),
        F.count_if(red).alias("red"),
        *[F.count_if(green & (F.col("verification") == v)).alias(v) for v in VERIFICATIONS],
        F.count_if(green & ~known).alias("other"),
    )


def metrics(health: DataFrame) -> DataFrame:
    """Like summary, but a status of no known colour counts nowhere."""
    s = F.col("status")
    green, red = is_green(s), is_red(s)
    return health.agg(
        F.count("*").alias("total"), F.count_if(green).alias("green"), F.count_if(~green & ~red & is_yellow(s)).alias("yellow"), F.count_if(~green & red).alias("red")
    )


def healing_stats(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("reason") == STUB).alias("stub_count"), F.count("*").alias("total"))


def rank(status: Column, reason: Column) -> Column:
    return F.when(is_red(status), 0).when(is_yellow(status) & (reason != STUB), 1).when(reason == STUB, 2).otherwise(3)


def ranked(health: DataFrame, n: int | None = 10) -> DataFrame:
    d = health.select("file", "status", "reason", rank(F.col("status"), F.col("reason")).cast("long").alias("rank")).orderBy("rank", "file")
    return d if n is None else d.limit(n)


def readiness(health: DataFrame, has_map: bool = True, has_health: bool = True, scope_ok: bool = True, scope_risk: bool = False) -> DataFrame:
    """One row; a container or a missing configured directory wins over everything else."""
    s = F.col("status")
    d = health.agg(F.count("*").alias("n"), F.count_if(is_red(s)).alias("red"), F.count_if(is_yellow(s) & (F.col("reason") != STUB)).alias("work"))
    return d.select(
        F.when(F.lit(scope_risk), "map_ok_scope_risk")
        .when(~F.lit(has_map) | ~F.lit(has_health) | (F.col("n") == 0), "blocked")
        .when(~F.lit(scope_ok), "map_ok_scope_risk")
        .when(F.col("red") > 0, "not_ready")
        .when(F.col("work") > 0, "ready_with_agent_wiki_work")
        .otherwise("ready_for_daemon")
        .alias("readiness")
    )


def seed_stubs(files: DataFrame, health: DataFrame) -> DataFrame:
    """Mapped files without a health row, as stubs."""
    d = files.select(F.col("rel").alias("file"), "hash").join(health.select("file"), "file", "left_anti")
    return d.select("file", F.lit("Yellow").alias("status"), F.lit(STUB).alias("reason"), F.col("hash").alias("source_hash"))


def check_changes(health: DataFrame, live: DataFrame, indexed: DataFrame | None = None, watched: DataFrame | None = None) -> DataFrame:
    """The next status of every watched file that is dirty: (file, status, reason, journal).

    live: (rel, hash) on disk; indexed: (rel, hash) of the map, the baseline where the health row has no hash. Missing
    on disk is Red; a hash that differs from the baseline is Yellow; a row that says so already is not journaled again.
    watched: further (file) names, which are dirty only when they are gone, having no baseline.
    """
    monitored = watched
    h = health.select("file", F.col("status").alias("old"), F.col("reason").alias("why"), F.col("source_hash").alias("base"))
    watched = h
    if indexed is not None:
        watched = h.join(indexed.select(F.col("rel").alias("file"), F.col("hash").alias("mapped")), "file", "full_outer")
        watched = watched.withColumn("base", F.coalesce(F.when(F.col("base").startswith("sha256:"), F.col("base")), "mapped"))
    if monitored is not None:
        watched = watched.join(monitored.select("file").distinct(), "file", "full_outer")
    d = watched.join(live.select(F.col("rel").alias("file"), F.col("hash").alias("live")), "file", "left")
    gone, moved = F.col("live").isNull(), F.col("live") != F.col("base")
    old = F.coalesce("old", F.lit(""))
    noted = F.when(gone, is_red(old)).otherwise(is_yellow(old) & F.coalesce(F.col("why").contains(CHANGED), F.lit(False)))
    return d.filter(gone | moved).select(
        "file", F.when(gone, "Red").otherwise("Yellow").alias("status"), F.when(gone, "missing on disk (check-changes)").otherwise(CHANGED).alias("reason"), (~noted).alias("journal")
    )


def next_actions(health: DataFrame, alerts: DataFrame, low_edges: DataFrame, prefix: str = "", scope_risk: bool = False, listed: int | None = 10) -> DataFrame:
    """(priority, action, file, reason): scope, deletions, edits, alerts (changed files first, then severity), low
    confidence; lookup_only if there is nothing else."""
    h = health.filter(under_prefix(F.col("file"), prefix))
    row = lambda p, a, f, r: (F.lit(p).cast("long").alias("priority"), F.lit(a).alias("action"), f.alias("file"), r.alias("reason"))
    s, none = F.col("status"), F.lit(None).cast("string")
    red = h.filter(is_red(s)).select(*row(1, "record_deletion", F.col("file"), F.col("reason")))
    edit = h.filter(~is_red(s) & is_yellow(s) & (F.col("reason") != STUB)).select(*row(2, "prepare_edit", F.col("file"), F.col("reason")))
    changed = health.filter(is_yellow(s) & F.col("reason").contains("content changed")).select("file", F.lit(1).alias("changed"))
    a = alerts.filter(under_prefix(F.col("file"), prefix)).join(changed, "file", "left").orderBy(F.col("changed").isNull(), F.desc(severity()), "file", "kind")
    a = a if listed is None else a.limit(listed)
    alert = a.select(*row(3, "review_modularity", F.col("file"), F.concat(F.col("kind"), F.lit(" "), F.col("value").cast("string"), F.lit(" > "), F.col("threshold").cast("string"))))
    low = low_edges.agg(F.count("*").alias("n")).filter("n > 0").select(
        *row(4, "review_low_confidence_edges", none, F.concat(F.col("n").cast("string"), F.lit(" actionable low-confidence project edges (see get_dependencies)")))
    )
    out = red.unionByName(edit).unionByName(alert).unionByName(low)
    if scope_risk:
        out = out.unionByName(low_edges.sparkSession.range(1).select(*row(1, "fix_scope", none, F.lit("scope risk"))))
        return out
    idle = out.agg(F.count("*").alias("n")).filter("n = 0").select(*row(5, "lookup_only", none, F.lit("Health clean. Use prepare_edit for lookup.")))
    return out.unionByName(idle)


def wiki_verdict(rows: DataFrame) -> DataFrame:
    """rows: file, symbols (array, null without an extractor), wiki, old_symbols, wiki_hash, old_wiki_hash -> issues, warning.

    A new symbol the wiki does not name; a removed one it still names in backquotes; a changed surface with an unchanged
    wiki. Without a wiki or an extractor there is nothing to say; without an earlier surface there is a warning.
    """
    old = F.coalesce("old_symbols", F.array().cast("array<string>"))
    baseline = (F.size(old) > 0) | (F.coalesce("old_wiki_hash", F.lit("")) != "")
    new = F.transform(F.filter("symbols", lambda x: ~F.col("wiki").contains(x)), lambda x: F.concat(F.lit("undocumented_new_symbols: "), x))
    gone = F.filter(F.array_except(old, F.col("symbols")), lambda x: F.col("wiki").contains(F.concat(F.lit("`"), x, F.lit("`"))))
    gone = F.transform(gone, lambda x: F.concat(F.lit("wiki_mentions_removed_symbols: "), x))
    moved = F.array_sort(F.array_distinct(old)) != F.array_sort(F.array_distinct("symbols"))
    stale = baseline & moved & (F.coalesce("old_wiki_hash", F.lit("")) != "") & (F.col("wiki_hash") == F.col("old_wiki_hash"))
    empty = F.array().cast("array<string>")
    judged = (F.coalesce("wiki", F.lit("")) != "") & F.col("symbols").isNotNull()
    issues = F.concat(new, F.when(baseline, gone).otherwise(empty), F.when(stale, F.array(F.lit("wiki_not_updated_for_api_change"))).otherwise(empty))
    return rows.select("*", F.when(judged, issues).otherwise(empty).alias("issues"), F.when(judged & ~baseline, F.lit("no_symbol_baseline")).alias("warning"))


def mark_green(health: DataFrame, verdicts: DataFrame, force: bool = False, reason: str = "") -> DataFrame:
    """The next health table: files whose verdict has no issue (or all, with a reason, by force) become Green.

    The row keeps the surface it was judged by: source_hash, public_symbols and wiki_hash, the baseline of the next
    verdict. verification: no_wiki, unchecked (no extractor for the language), forced (there were issues) or verified.
    """
    if force and not reason.strip():
        raise ValueError("force needs a reason")
    v = verdicts.select(
        "file", F.size("issues").alias("n_issues"), (F.coalesce("wiki", F.lit("")) == "").alias("bare"), F.col("source_hash").alias("new_hash"),
        F.col("symbols").alias("new_symbols"), F.col("wiki_hash").alias("new_wiki"),
    )
    d = health.join(v, "file", "left")
    go = F.col("n_issues").isNotNull() & (F.lit(force) | F.col("bare") | (F.col("n_issues") == 0))
    how = F.when(F.col("bare"), "no_wiki").when(F.col("new_symbols").isNull(), "unchecked").when(F.col("n_issues") > 0, "forced").otherwise("verified")
    why = F.lit(reason) if reason else F.when(F.col("bare"), "no wiki").otherwise("mark-green")
    new = {
        "status": F.lit("Green"), "reason": why, "verification": how, "source_hash": F.col("new_hash"),
        "public_symbols": F.coalesce("new_symbols", F.array().cast("array<string>")), "wiki_hash": F.when(~F.col("bare"), F.col("new_wiki")).otherwise(""),
    }
    return d.select(*[F.when(go, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in health.columns])


def seed_source_hashes(health: DataFrame, live: DataFrame, force: bool = False, prefix: str = "") -> DataFrame:
    """(file, outcome, hash): what seeding does with each row under `prefix`. Green rows without a sha256 hash (all of
    them by force) get the live one; the others are skipped as not_green, has_hash or missing."""
    d = health.filter(under_prefix(F.col("file"), prefix)).join(live.select(F.col("rel").alias("file"), F.col("hash").alias("live")), "file", "left")
    has = F.coalesce(F.col("source_hash").startswith("sha256:"), F.lit(False)) & ~F.lit(force)
    outcome = F.when(~is_green(F.col("status")), "not_green").when(has, "has_hash").when(F.col("live").isNull(), "missing").otherwise("seeded")
    return d.select("file", outcome.alias("outcome"), F.when(outcome == "seeded", F.col("live")).alias("hash"))


def healable(health: DataFrame, wikis: DataFrame, least: int = 350) -> DataFrame:
    """(file, n_wiki): the stubs that heal_stubs() would turn green."""
    w = wikis.select("file", F.length(F.trim("text")).cast("long").alias("n_wiki"))
    return health.filter(F.col("reason") == STUB).join(w, "file").filter(F.col("n_wiki") >= least).select("file", "n_wiki")


def heal_stubs(health: DataFrame, wikis: DataFrame, least: int = 350) -> DataFrame:
    """Stubs whose trimmed wiki has at least `least` characters become Green and verified."""
    w = wikis.select("file", F.length(F.trim("text")).alias("n_wiki"))
    d = health.join(w, "file", "left")
    go = (F.col("reason") == STUB) & (F.col("n_wiki") >= least)
    new = {"status": F.lit("Green"), "reason": F.lit("healed"), "verification": F.lit("verified")}
    return d.select(*[F.when(go, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in health.columns])


def stale_wikis(health: DataFrame, wikis: DataFrame, live: DataFrame) -> DataFrame:
    """Health rows with a wiki whose source drifted or whose reason says so."""
    d = health.join(wikis.select("file"), "file").join(live.select(F.col("rel").alias("file"), F.col("hash").alias("live")), "file", "left")
    drift = F.col("source_hash").startswith("sha256:") & (F.col("live") != F.col("source_hash"))
    return d.filter(F.coalesce(drift, F.lit(False)) | F.col("reason").contains("content changed")).select("file", "status", "reason")


def record_change(health: DataFrame, changes: DataFrame) -> DataFrame:
    """The next health table after a batch (file, deleted, why): Yellow or Red with the reason; new files are added.

    The whole batch is refused if a file has no reason.
    """
    if changes.filter(F.coalesce(F.trim("why"), F.lit("")) == "").limit(1).count():
        raise ValueError("every change needs a reason")
    d = health.join(changes.select("file", "deleted", "why"), "file", "full_outer")
    hit = F.col("why").isNotNull()
    new = {"status": F.when(F.col("deleted"), "Red").otherwise("Yellow"), "reason": F.col("why"), "verification": F.when(F.col("deleted"), "deleted").otherwise(F.col("verification"))}
    return d.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in health.columns])
