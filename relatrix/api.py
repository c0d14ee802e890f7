"""A project's named queries: one object over a snapshot store and the state tables."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import under_prefix
from .operators import caps, drift, files, graph, health, journal, overlay, pending, wiki
from .session import stored
from .sources.scope import Scope, detect, rel_arg, source_files, tree_files, walk
from .sources.snapshot import Store, update

HEALTH = "file string, status string, reason string, verification string, source_hash string, public_symbols array<string>, wiki_hash string"
JOURNAL = "stamp timestamp_ntz, action string, file string, reason string"
TEXTS = "file string, text string"
PENDING = "file string, message string"
STATE = {"health": HEALTH, "journal": JOURNAL, "baselines": TEXTS, "pending": PENDING}


@dataclass
class Project:
    """Commands return DataFrames. Without a scope, the documents in the root name it (scope.detect()). State changes are worked out and written once, at the time of the command, and kept
    in the object; save() commits all.

    The state tables are parquet under the store; a missing one is empty. A file may be named by a path relative to the
    root, with `./` or backslashes, or by an absolute one; one that is neither on disk nor in the map is an error.
    """

    spark: SparkSession
    root: str
    store_path: str
    scope: Scope | None = None
    max_lines: int = 400
    max_fan_in: int = 25

    def __post_init__(self):
        self.scope = self.scope or detect(self.spark, self.root)
        self.store = Store(self.spark, self.store_path)
        self.state = Store(self.spark, f"{self.store_path}/state")
        v = self.state.version()
        for name, schema in STATE.items():
            known = v and (v == self.state.version_with(name))
            setattr(self, name, self.state.read(name) if known else self.spark.createDataFrame([], schema))

    def save(self) -> int:
        return self.state.write({name: getattr(self, name) for name in STATE})

    def _set(self, **tables: DataFrame) -> None:
        """The next state: all tables are written before one is replaced."""
        done = {name: stored(d) for name, d in tables.items()}
        for name, d in done.items():
            setattr(self, name, d)

    def file_arg(self, file: str) -> str:
        rel = rel_arg(self.root, file)
        if not rel:
            raise ValueError("file is required: a path relative to the project root, such as src/main.rs")
        on_disk = not self.root.partition("://")[1] and (Path(self.root) / rel).exists()
        if not on_disk and not (self.store.version() and self.index().filter(F.col("rel") == rel).limit(1).count()):
            raise FileNotFoundError(f"{rel} is neither on disk nor in the map; list_paths() shows the mapped files")
        return rel

    # the map
    def files(self) -> DataFrame:
        return source_files(self.spark, self.root, self.scope)

    def update_maps(self, full: bool = False, max_files: int | None = None, **resolver) -> dict[str, int]:
        live = self.files()
        counts = update(self.store, live, full, max_files, lambda rels: source_files(self.spark, self.root, self.scope, only=rels), **resolver)
        self._set(health=self.health.unionByName(health.seed_stubs(self.index(), self.health), allowMissingColumns=True))
        return counts

    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def index(self) -> DataFrame:
        return self.store.read("index")

    def list_paths(self, prefix: str = "", depth: int = 1, limit=None) -> DataFrame:
        return caps.capped(files.list_paths(self.index(), prefix, depth).orderBy("kind", "path"), limit)

    def get_dependents(self, file: str, limit=None) -> DataFrame:
        return caps.capped(graph.dependents(self.edges(), self.file_arg(file)).orderBy("src"), limit)

    def get_dependencies(self, file: str, low_confidence_only: bool = False) -> DataFrame:
        d = graph.dependencies(self.edges(), self.file_arg(file))
        return (d.filter((F.col("confidence") < graph.LOW_ACTION) & ~F.col("dynamic")) if low_confidence_only else d).orderBy("dst")

    def get_unresolved(self, file: str) -> DataFrame:
        """What a file refers to outside the project or to no file: raw, reason."""
        return self.store.read("leftovers").filter(F.col("src") == self.file_arg(file)).select("raw", "reason").orderBy("reason", "raw")

    def get_cycles(self) -> DataFrame:
        e = self.edges()
        c = graph.strong_components(e)
        members = graph.cyclic(c).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"))
        hints = graph.break_hints(e, c).select("component", F.struct("src", "dst", "confidence").alias("break_hint"))
        return graph.cycle_report(e, c).join(members, "component").join(hints, "component", "left").orderBy(F.desc("score"), "component")

    def reverse_dependencies(self, limit=20) -> DataFrame:
        return caps.capped(graph.top_dependents(self.edges(), None), limit, 20)

    def impact(self, depth: int = 3) -> DataFrame:
        return graph.impact(self.edges(), depth)

    def diagnostics(self) -> DataFrame:
        """(reason, n) over leftovers and flagged edges."""
        flagged = graph.with_confidence(self.edges()).filter("reason <> 'resolved_static'").select("reason")
        return self.store.read("leftovers").select("reason").union(flagged).groupBy("reason").agg(F.count("*").alias("n"))

    def notes(self) -> DataFrame:
        """Every leftover and flagged edge, in order of file; caps.compact() shortens it."""
        return graph.notes(self.edges(), self.store.read("leftovers")).orderBy("file", "line", "raw")

    def actionable_edges(self) -> DataFrame:
        return graph.actionable(self.edges()).orderBy("file", "path")

    def dependent_dirs(self, file: str) -> DataFrame:
        """Importer counts by directory, for a reply that leaves importers out."""
        up = F.when(F.instr("src", "/") > 0, F.regexp_replace("src", "[^/]*$", "")).otherwise("./")
        return graph.edge_groups(self.edges().filter(F.col("dst") == self.file_arg(file)), up)

    def folder_cards(self) -> DataFrame:
        return files.folder_cards(self.index())

    # health
    def alerts(self, prefix: str = "") -> DataFrame:
        f = self.files().filter(under_prefix(F.col("rel"), prefix))
        return files.line_alerts(f, self.max_lines).unionByName(files.fan_in_alerts(self.edges(), f.select(F.col("rel").alias("file")), self.max_fan_in))

    def health_summary(self) -> DataFrame:
        return health.summary(self.health)

    def metrics_snapshot(self) -> DataFrame:
        return health.metrics(self.health).withColumn("ts", F.current_timestamp())

    def readiness(self) -> DataFrame:
        s = self.scope or Scope()
        return health.readiness(self.health, self.store.version() > 0, True, s.ok, s.container or bool(s.missing_dirs))

    def check_changes(self) -> DataFrame:
        """Dirty files with changed line ranges; the next health and journal take them in."""
        live = self.files()
        d = health.check_changes(self.health, live, self.index().select("rel", "hash"))
        ranges = drift.since_baseline(live.select(F.col("rel").alias("file"), "text"), self.baselines)
        out = d.join(ranges, "file", "left")
        hit = d.select("file", F.col("status").alias("s2"), F.col("reason").alias("r2"))
        new = {"status": F.coalesce("s2", "status"), "reason": F.coalesce("r2", "reason")}
        j = self.health.join(hit, "file", "full_outer")
        out = stored(out)
        self._set(
            health=j.select(*[new[c].alias(c) if c in new else F.col(c) for c in self.health.columns]),
            journal=self._noted(out.filter("journal").select("file", "reason", F.col("status").alias("action"))),
        )
        return out

    def _noted(self, rows: DataFrame) -> DataFrame:
        """The journal with the rows (file, reason, action) that are no duplicates, at the present time."""
        now = F.lit(self.spark.sql("SELECT CAST(localtimestamp() AS STRING)").first()[0]).cast("timestamp_ntz")
        return self.journal.unionByName(journal.new_entries(self.journal, rows.select(now.alias("stamp"), "action", "file", "reason")))

    def suggest_next(self, prefix: str = "") -> DataFrame:
        s = self.scope or Scope()
        low = graph.low_confidence(self.edges()).filter(under_prefix(F.col("src"), prefix))
        return health.next_actions(self.health, self.alerts(prefix), low, prefix, not s.ok).orderBy("priority", "file")

    def wikis(self) -> DataFrame:
        rows = walk(self.root, Scope(), lambda rel: rel.lower().endswith(".md"))
        d = tree_files(self.spark, self.root, rows)
        return wiki.find_wikis(self.index(), d.select("rel", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))

    def verify_wikis(self) -> DataFrame:
        return wiki.verify(self.health, self.files(), self.wikis())

    def mark_green(self, targets: list[str], force: bool = False, reason: str = "") -> DataFrame:
        """Verdicts of the targets; those that pass become Green, with the live text, surface and wiki as baseline."""
        if force and not reason.strip():
            raise ValueError("force needs a reason")
        targets = [self.file_arg(t) for t in targets]
        live = stored(self.files().filter(F.col("rel").isin(targets)).select("rel", "text", "hash"))
        fresh = live.select(F.col("rel").alias("file")).join(self.health.select("file"), "file", "left_anti")
        rows = self.health.unionByName(fresh, allowMissingColumns=True)
        v = stored(wiki.verdicts(rows.filter(F.col("file").isin(targets)), live, self.wikis()).filter("source_hash IS NOT NULL"))
        passed = v.filter((F.size("issues") == 0) | F.lit(force)).select("file")
        kept = self.baselines.join(passed, "file", "left_anti")
        self._set(
            health=health.mark_green(rows.filter("status IS NOT NULL").unionByName(rows.filter("status IS NULL").join(passed, "file", "left_semi")), v, force, reason),
            baselines=kept.unionByName(live.select(F.col("rel").alias("file"), "text").join(passed, "file", "left_semi")),
            pending=pending.remove(self.pending, passed),
        )
        return v.select("file", "issues", "warning")

    def record_changes(
        self, changes: DataFrame, reasons: list[tuple[str, str]] | None = None, default_reason: str | None = None, only: list[str] | None = None,
        green: bool = False, dry_run: bool = False,
    ) -> dict[str, DataFrame]:
        """Record a batch of (file, deleted), each with its reason: from a column `why`, or from `reasons`, ordered
        (key, why) with files, directories or globs as keys, then `default_reason`.

        Replies with tables: recorded (file, deleted, why), missing_reasons (file), unused_reasons (key), and with
        `green` verification_failed (file, issues). Nothing is recorded if a reason is missing, or by a dry run. Changed
        files become Yellow and pending; deleted ones Red, and leave the map with their edges.
        """
        spark = self.spark
        keys = spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(reasons or [])], "key string, why string, pos int")
        if "why" in changes.columns:
            plan = changes.select("file", "deleted", F.when(F.trim("why") != "", F.col("why")).alias("why"))
        else:
            plan = journal.plan_changes(changes, keys, default_reason, only)
        plan = stored(plan)
        reply = {"recorded": plan.filter("why IS NOT NULL"), "missing_reasons": plan.filter("why IS NULL").select("file"), "unused_reasons": journal.unused_reasons(plan, keys).select("key")}
        if reply["missing_reasons"].limit(1).count():
            return {**reply, "recorded": plan.limit(0)}
        if dry_run:
            return reply
        action = F.when(F.col("deleted"), "record-deletion").otherwise("record-change")
        changed, gone = plan.filter("NOT deleted"), plan.filter("deleted").select("file")
        self._set(
            health=health.record_change(self.health, plan),
            journal=self._noted(plan.select("file", F.col("why").alias("reason"), action.alias("action"))),
            pending=pending.append(pending.remove(self.pending, gone), changed.select("file", pending.record_message(F.col("why")).alias("message"))),
        )
        if self.store.version() and gone.limit(1).count():
            at = lambda name, c: self.store.read(name).join(gone.withColumnRenamed("file", c), c, "left_anti")
            tables = {"index": at("index", "rel"), "imports": at("imports", "src"), "edges": overlay.remove_node(self.edges(), gone), "leftovers": at("leftovers", "src")}
            self.store.write(tables)
        if green and changed.limit(1).count():
            v = self.mark_green([r.file for r in changed.select("file").collect()])
            reply["verification_failed"] = v.filter(F.size("issues") > 0).select("file", "issues")
        return reply

    def healable(self) -> DataFrame:
        return health.healable(self.health, self.wikis()).orderBy("file")

    def heal_stubs(self) -> DataFrame:
        self._set(health=health.heal_stubs(self.health, self.wikis()))
        return self.health

    def prune(self, prefixes: list[str] | None = None) -> DataFrame:
        live = self.files()
        self._set(health=overlay.prune(self.health, live, prefixes), pending=self.pending.join(live.select(F.col("rel").alias("file")), "file", "left_semi"))
        return self.health

    def seed_source_hashes(self, force: bool = False, prefix: str = "") -> DataFrame:
        """(outcome, n); green rows without a hash take the live one."""
        d = stored(health.seed_source_hashes(self.health, self.files(), force, prefix))
        new = self.health.join(d.select("file", F.col("hash").alias("seeded")), "file", "left")
        self._set(health=new.withColumn("source_hash", F.coalesce("seeded", "source_hash")).select(*self.health.columns))
        return d.groupBy("outcome").agg(F.count("*").alias("n"))

    def validate(self) -> DataFrame:
        i = self.index()
        return overlay.validate(i, self.health, self.files())

    def prepare_edit(self, file: str) -> DataFrame:
        """One row: health, line count, wiki, importers and imports of a file."""
        e, file = self.edges(), self.file_arg(file)
        f = self.files().filter(F.col("rel") == file).select(F.col("rel").alias("file"), "n_lines", "hash")
        back = e.filter(F.col("dst") == file).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
        ahead = graph.with_confidence(e.filter(F.col("src") == file)).agg(F.array_sort(F.collect_list(F.struct("dst", "confidence", "reason"))).alias("dependencies"))
        d = f.join(self.health.filter(F.col("file") == file).select("file", "status", "reason"), "file", "left")
        d = d.join(self.wikis().filter(F.col("file") == file).select("file", F.col("path").alias("wiki_path"), F.col("text").alias("wiki")), "file", "left")
        return d.join(back.withColumn("file", F.lit(file)), "file").join(ahead.withColumn("file", F.lit(file)), "file")

    # the journal
    def search_journal(self, query: str = "", file: str | None = None, limit=None) -> DataFrame:
        return caps.capped(journal.search(self.journal, query, file).orderBy(F.desc("stamp"), "file"), limit)

    def why_file(self, file: str) -> DataFrame:
        return journal.why(self.journal, rel_arg(self.root, file)).orderBy("stamp")

    def session_bootstrap(self) -> dict[str, DataFrame]:
        return {"readiness": self.readiness(), "summary": self.health_summary(), "actions": self.suggest_next(), "root": self.list_paths()}
