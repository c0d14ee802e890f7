"""Overlay: a branch answered as base and delta; and checks of two tables against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differing(base: DataFrame, tree: DataFrame) -> DataFrame:
    """(rel, change) for (rel, hash) tables: added, deleted or changed."""
    d = base.select("rel", F.col("hash").alias("hb")).join(tree.select("rel", F.col("hash").alias("ht")), "rel", "full_outer")
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ht").isNull(), "deleted").when(F.col("hb") != F.col("ht"), "changed")
    return d.select("rel", change.alias("change")).filter("change IS NOT NULL")


def overlaid(base: DataFrame, tree: DataFrame, changed: DataFrame, key: str = "rel") -> DataFrame:
    """The branch's table: base rows whose key did not differ, and the tree's rows of those that did."""
    return base.join(changed.select(key), key, "left_anti").unionByName(tree.join(changed.select(key), key, "left_semi"))


def stale_rows(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """Indexed paths that a scan did not see."""
    return indexed.select("rel").join(seen.select("rel"), "rel", "left_anti")


def new_alerts(base: DataFrame, tree: DataFrame) -> DataFrame:
    return tree.join(base, ["file", "kind"], "left_anti")


def remove_node(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those from or to the files of `gone` (file); the importers themselves stay."""
    g = gone.select("file")
    return edges.join(g.withColumnRenamed("file", "src"), "src", "left_anti").join(g.withColumnRenamed("file", "dst"), "dst", "left_anti").select(*edges.columns)


def consistency(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(src, dst, problem): pairs that only one of the two directions has."""
    f, r = forward.select("src", "dst").distinct(), reverse.select("src", "dst").distinct()
    lost = f.join(r, ["src", "dst"], "left_anti").select("src", "dst", F.lit("missing_reverse").alias("problem"))
    return lost.unionByName(r.join(f, ["src", "dst"], "left_anti").select("src", "dst", F.lit("missing_forward").alias("problem")))


def index_consistency(forward: DataFrame, index: DataFrame) -> DataFrame:
    """(file, problem): index rows (rel, dsts) whose targets are not those of the forward edges, and sources of edges
    that the index does not have."""
    own = forward.groupBy(F.col("src").alias("rel")).agg(F.array_sort(F.collect_set("dst")).alias("got"))
    d = index.select("rel", F.array_sort(F.array_distinct("dsts")).alias("want"), F.lit(True).alias("known")).join(own, "rel", "full_outer")
    none = F.slice(F.coalesce("want", "got"), 1, 0)
    problem = F.when(F.col("known").isNull(), "not_in_index").when(F.coalesce("want", none) != F.coalesce("got", none), "index_disagrees")
    return d.select(F.col("rel").alias("file"), problem.alias("problem")).filter("problem IS NOT NULL")


def unchanged(base: DataFrame, tree: DataFrame) -> DataFrame:
    """(rel) of the files that a branch has with the base's content: what is known of them holds for the branch too."""
    return base.select("rel", "hash").join(tree.select("rel", "hash"), ["rel", "hash"], "left_semi").select("rel")


def adopt_unchanged(tree_rows: DataFrame, base_rows: DataFrame, same: DataFrame, key: str = "file") -> DataFrame:
    """The branch's rows, with the base's row where the branch has none and the file is unchanged."""
    known = base_rows.join(same.select(F.col("rel").alias(key)), key, "left_semi").join(tree_rows.select(key), key, "left_anti")
    return tree_rows.unionByName(known.select(*tree_rows.columns))


def validate(files: DataFrame, health: DataFrame, live: DataFrame) -> DataFrame:
    """(file, problem): mapped files without a health row, and files whose live hash is not the indexed one."""
    missing = files.select(F.col("rel").alias("file")).join(health.select("file"), "file", "left_anti").select("file", F.lit("missing").alias("problem"))
    l = live.select("rel", F.col("hash").alias("live"))  # noqa: E741
    drift = files.select("rel", "hash").join(l, "rel").filter("hash <> live").select(F.col("rel").alias("file"), F.lit("content_drift").alias("problem"))
    return missing.unionByName(drift)


def prune(health: DataFrame, live: DataFrame, prefixes: list[str] | None = None, watched: DataFrame | None = None) -> DataFrame:
    """Health rows of live files in scope; watched files stay in any case."""
    from ..functions.text import under_prefix

    scope = F.lit(not prefixes)
    for p in prefixes or []:
        scope = scope | under_prefix(F.col("file"), p)
    d = health.join(live.select(F.col("rel").alias("file"), F.lit(True).alias("on_disk")), "file", "left")
    keep = F.col("on_disk") & scope
    if watched is not None:
        d = d.join(watched.select("file", F.lit(True).alias("watched")).distinct(), "file", "left")
        keep = keep | F.col("watched")
    return d.filter(F.coalesce(keep, F.lit(False))).select(*health.columns)
