"""Versioned map snapshots and the incremental update."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import build_edges
from ..scan.imports import exported_column, language_column, scan
from ..session import stored

#: Up to so many moved files are named one by one to the file source; beyond, all files are read.
RELOAD = 10_000


class Store:
    """Snapshots under `path`/v=N; a version counts once its commit row is written, so a lost run leaves none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return 0
        return self.spark.read.parquet(f"{self.path}/commits").agg(F.coalesce(F.max("v"), F.lit(0))).first()[0]

    def version_with(self, name: str) -> int:
        """The last version, if it has a table of that name; else 0."""
        v = self.version()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}/{name}")
        return v if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.version()}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        v = self.version() + 1
        for name, d in tables.items():
            d.write.mode("overwrite").parquet(f"{self.path}/v={v}/{name}")
        self.spark.range(1).select(F.lit(v).alias("v")).write.mode("append").parquet(f"{self.path}/commits")
        return v


def plan_update(stat: DataFrame, index: DataFrame | None) -> DataFrame:
    """(rel, size, mtime_us) against the index -> rel, state: skip (size and time match), hash (either moved) or new."""
    if index is None:
        return stat.select("rel", F.lit("new").alias("state"))
    old = index.select("rel", F.col("size").alias("s0"), F.col("mtime_us").alias("m0"))
    d = stat.join(old, "rel", "left")
    same = (F.col("size") == F.col("s0")) & (F.col("mtime_us") == F.col("m0"))
    return d.select("rel", F.when(F.col("s0").isNull(), "new").when(same, "skip").otherwise("hash").alias("state"))


def update(store: Store, files: DataFrame, full: bool = False, budget: int | None = None, reload: Callable[[list[str]], DataFrame] | None = None, **resolver) -> dict[str, int]:
    """One map run: stat test, hash test, scan of what changed, resolution over all scans, one commit.

    files: rel, size, mtime_us, text, hash, of which the stat test reads no contents. `reload` gives the rows of a list
    of files: with it, a run that finds at most RELOAD moved files reads these and no others. Returns the counts of the
    observable contract: skipped, hashed, parsed, removed, dirty (left over by `budget`). Edges are resolved over every
    file's references, so a file that another one's move affects is right without a second pass.
    """
    v = 0 if full else store.version()
    index = store.read("index", v) if v else None
    stat = files.select("rel", "size", "mtime_us")
    state = stored(plan_update(stat, index))
    counts = {r.state: r["count"] for r in state.groupBy("state").count().collect()}
    moved = state.filter("state <> 'skip'").select("rel")
    n_moved = counts.get("hash", 0) + counts.get("new", 0)
    if reload is not None and v and n_moved <= RELOAD:
        contents = reload([r.rel for r in moved.collect()]) if n_moved else files.limit(0)
    else:
        contents = files.join(moved, "rel", "left_semi")
    hashed = stored(contents.select("rel", "size", "mtime_us", "hash"))
    todo = hashed.select("rel", "hash")
    if v:
        todo = todo.join(index.select("rel", F.col("hash").alias("h0")), "rel", "left").filter("h0 IS NULL OR h0 <> hash").select("rel", "hash")
    todo = stored(todo)
    chosen = todo if budget is None else stored(todo.orderBy("rel").limit(budget))
    sources = contents.join(chosen.select("rel"), "rel", "left_semi")
    fresh = scan(sources)
    js = sources.filter(language_column(F.col("rel")) == "javascript")
    exports = js.select("rel", F.explode(exported_column(F.coalesce("text", F.lit("")))).alias("name"))
    later = todo.join(chosen, "rel", "left_anti")
    kept = hashed.join(later.select("rel"), "rel", "left_anti")
    if v:
        here = stat.select("rel")
        old = lambda name, c: store.read(name, v).join(chosen.withColumnRenamed("rel", c), c, "left_anti").join(here.withColumnRenamed("rel", c), c, "left_semi")
        fresh = fresh.unionByName(old("imports", "src"))
        if store.version_with("exports") == v:
            exports = exports.unionByName(old("exports", "rel"))
        same = state.filter("state = 'skip'").select("rel").unionByName(later.select("rel"))
        kept = kept.unionByName(index.join(same, "rel", "left_semi").select(*kept.columns))
    imports, exports = stored(fresh), stored(exports)
    edges, left = build_edges(files, imports, **{"exports": exports, **resolver})
    removed = index.join(stat.select("rel"), "rel", "left_anti").count() if v else 0
    store.write({"index": kept, "imports": imports, "exports": exports, "edges": edges, "leftovers": left})
    parsed, all_todo = chosen.count(), todo.count()
    return {"skipped": counts.get("skip", 0), "hashed": n_moved, "parsed": parsed, "removed": removed, "dirty": all_todo - parsed}
