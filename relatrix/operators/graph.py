"""Edges: merging, confidence, lookups, closure, strongly connected components, cycle reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import discard, prepare, stored
from .reach import step

#: A graph of at most so many distinct edges is searched by one task (some 200 MB); a larger one by joins until it is.
LOCAL_EDGES = 1_000_000
LOW_ACTION, LOW_DIAGNOSTIC, LOW_LIBRARY = 0.65, 0.6, 0.8


def merge_edges(raw: DataFrame) -> DataFrame:
    """One edge per (src, dst): the first evidence's line, any conditional, any dynamic, all through a barrel."""
    out = [F.min_by("line", "seq").alias("line"), *[F.bool_or(c).alias(c) for c in ("conditional", "dynamic")], F.bool_and("via_barrel").alias("via_barrel")]
    if "names" in raw.columns:
        # The first evidence that names something.
        out.append(F.coalesce(F.min_by("names", F.when(F.size("names") > 0, F.col("seq"))), F.array().cast("array<string>")).alias("names"))
    return raw.groupBy("src", "dst").agg(*out)


def confidence() -> Column:
    return F.when(F.col("dynamic"), 0.4).when(F.col("conditional"), 0.55).when(F.col("via_barrel"), 0.7).otherwise(0.9)


def reason_code() -> Column:
    return F.when(F.col("dynamic"), "dynamic_literal").when(F.col("conditional"), "conditional_guard").when(F.col("via_barrel"), "via_barrel").otherwise("resolved_static")


def with_confidence(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence", confidence()).withColumn("reason", reason_code())


def low_confidence(edges: DataFrame, below: float = LOW_ACTION) -> DataFrame:
    return with_confidence(edges).filter((F.col("confidence") < below) & ~F.col("dynamic"))


def dependents(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("dst") == node).select("src").distinct()


def dependencies(edges: DataFrame, node) -> DataFrame:
    return with_confidence(edges.filter(F.col("src") == node))


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("dependents"))


def top_dependents(edges: DataFrame, n: int | None = 20) -> DataFrame:
    d = fan_in(edges).orderBy(F.desc("dependents"), "dst")
    return d if n is None else d.limit(n)


def edge_groups(edges: DataFrame, group: Column, n: int | None = 20) -> DataFrame:
    """Importer counts by directory of the importer."""
    d = edges.groupBy(group.alias("dir")).agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "dir")
    return d if n is None else d.limit(n)


def impact(edges: DataFrame, depth: int = 3) -> DataFrame:
    """(node, affected, depth): who depends on a node within `depth` steps, at the shortest distance.

    Middle nodes alone are carried from step to step; the last step, by step(), writes every pair once."""
    e = edges.select(F.col("dst").alias("mid"), F.col("src").alias("affected")).dropna().distinct()
    if depth == 1:
        return e.filter("mid <> affected").select(F.col("mid").alias("node"), "affected", F.lit(1).cast("long").alias("depth"))
    e, n = counted(e)
    nodes, n_nodes = counted(e.select("mid").distinct())
    inner, n_inner = counted(e.join(nodes.withColumnRenamed("mid", "affected"), "affected", "left_semi").select("mid", "affected"))
    near = nodes.select(F.col("mid").alias("node"), "mid", F.lit(0).cast("long").alias("depth"))
    new, n_new = inner.filter("mid <> affected").select(F.col("mid").alias("node"), "affected", F.lit(1).cast("long").alias("depth")), n_inner
    for k in range(2, depth + 1):
        seen, n_seen = near.union(new.select("node", F.col("affected").alias("mid"), "depth")), n_nodes + n_new
        if k == depth:
            return step(seen, n_seen, e, n, own=False)
        old = new
        new, n_new = counted(step(seen, n_seen, inner, n_inner, own=False))
        discard(old)


def impact_of(edges: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(affected, depth): who depends on any of `nodes` (node) within `depth` steps, at the shortest distance. Each step
    joins only what the last one found."""
    e = edges.select(F.col("dst").alias("node"), F.col("src").alias("affected")).distinct()
    front = nodes.select("node").distinct()
    seen = front.select("node", F.lit(0).cast("long").alias("depth"))
    for k in range(1, depth + 1):
        front = front.join(e, "node").select(F.col("affected").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.union(front.select("node", F.lit(k).cast("long").alias("depth")))
    return seen.filter("depth > 0").select(F.col("node").alias("affected"), "depth")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """stored(df) and its rows, counted while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge or more; an edge with a null end is none.

    The strong components among nodes with edges in and out are taken as one node each. What is left of those nodes has
    no cycle; it is closed semi-naively, each round from what the last one found. Then every node reaches its edges'
    ends, what these reach, and of a component all members: one step() that writes every pair once."""
    e, n_edges = counted(edges.select("src", "dst").dropna().distinct())
    inner = stored(e.select("src").distinct().join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    leaving = stored(e.join(inner, "src", "left_semi"))
    core = stored(leaving.join(inner.toDF("dst"), "dst", "left_semi").select("src", "dst"))
    members = stored(cyclic(strong_components(core)).select("component", "node"))
    of = lambda d, c: d.join(members.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    ways = lambda d: d.select(F.col("mid").alias("node"), F.col("affected").alias("mid"), F.lit(0).cast("long").alias("depth"))
    dag, n_dag = counted(of(of(core, "src"), "dst").filter("src <> dst").select(F.col("src").alias("mid"), F.col("dst").alias("affected")).distinct())
    known = new = dag
    n, n_known = n_dag, n_dag
    while n:
        got = step(ways(new), n, dag, n_dag, depth=False)
        new, n = counted(got.withColumnRenamed("node", "mid").join(known, ["mid", "affected"], "left_anti"))
        known, n_known = known.union(new), n_known + n
    mids, n_mids = counted(of(e.select("dst").distinct(), "dst").select(F.col("dst").alias("mid")).distinct())
    ends, n_ends = known.union(mids.select("mid", F.col("mid").alias("affected"))), n_known + n_mids
    # Ends that no edge leaves are none of the nodes above: one edge more.
    last = leaving.join(inner.toDF("dst"), "dst", "left_anti").select("src", "dst")
    last, n_last = counted(of(last, "src").select(F.col("src").alias("mid"), F.col("dst").alias("affected")).distinct())
    if n_last:
        more, n_more = counted(step(ways(ends), n_ends, last, n_last, depth=False).withColumnRenamed("node", "mid"))
        ends, n_ends = ends.union(more), n_ends + n_more
    near = of(e, "dst").select(F.col("src").alias("node"), F.col("dst").alias("mid"), F.lit(0).cast("long").alias("depth"))
    return step(near, n_edges, ends, n_ends, members, depth=False).toDF("src", "dst")


def strong_local(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of the strong component of each of the nodes 0, 1, ... (one pass over lists, no recursion)."""
    n = int(max(src.max(), dst.max())) + 1
    order = np.argsort(src, kind="stable")
    heads = dst[order].tolist()
    ends = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    met, low, comp = [-1] * n, [0] * n, [-1] * n
    open_: list[int] = []
    at = list(ends[:n])
    clock = 0
    for root in range(n):
        if met[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if met[v] < 0:
                met[v] = low[v] = clock
                clock += 1
                open_.append(v)
            if at[v] < ends[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if met[w] < 0:
                    path.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], met[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == met[v]:
                cut_at = len(open_) - 1
                while open_[cut_at] != v:
                    cut_at -= 1
                members = open_[cut_at:]
                del open_[cut_at:]
                least = min(members)
                for w in members:
                    comp[w] = least
    return np.array(comp)


def _by_one_task(e: DataFrame) -> DataFrame:
    """(node, component) of the nodes of `e`, a stored table of at most LOCAL_EDGES edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b in batches if b.num_rows])
        if not t.num_rows:
            return
        both = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t["src"].combine_chunks(), t["dst"].combine_chunks())])
        names, codes = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
        comp = strong_local(codes[: t.num_rows], codes[t.num_rows :])
        yield pa.RecordBatch.from_arrays([pa.array(names, both.type), pa.array(names[comp], both.type)], ["node", "component"])

    prepare(e.sparkSession)
    kind = e.schema["src"].dataType.simpleString()
    return e.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _without(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return e.join(nodes.toDF("src"), "src", "left_anti").join(nodes.toDF("dst"), "dst", "left_anti").select("src", "dst")


def _contract(e: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, int]:
    """(edges, (node, before, after), number of edges): inner nodes of chains, no two of them neighbours, leave; an edge
    from the one before to the one after stands for each. A quarter of every chain goes at a time."""
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("before"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("after"))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    inner = ins.filter("n_in = 1").join(outs.filter("n_out = 1"), "node").filter((coin("node") == 1) & (coin("before") == 0))
    inner = stored(inner.select("node", "before", "after"))
    rest = _without(e, inner.select("node")).union(inner.select(F.col("before").alias("src"), F.col("after").alias("dst")))
    out, n = counted(rest.filter("src <> dst").distinct())
    return out, inner, n


def _trim(e: DataFrame) -> tuple[DataFrame, int]:
    """Without the edges at nodes that no edge enters or none leaves: those are alone."""
    both = e.select(F.col("dst").alias("n")).join(e.select(F.col("src").alias("n")), "n", "left_semi").distinct()
    return counted(e.join(both.toDF("src"), "src", "left_semi").join(both.toDF("dst"), "dst", "left_semi").select("src", "dst"))


def _one_colouring(e: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((node, component) found, edges left, number of edges): forward colours by the smallest node that reaches each,
    then a walk back from every colour's root inside its colour."""
    live = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    colors = stored(live.select("node", F.col("node").alias("color")))
    while True:
        got = e.join(colors.toDF("src", "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("in"))
        seen = Observation()
        new = colors.join(got, "node", "left").select("node", F.col("color").alias("old"), F.least("color", F.coalesce("in", "color")).alias("color"))
        new = stored(new.observe(seen, F.sum((F.col("color") != F.col("old")).cast("long")).alias("n")).select("node", "color"))
        discard(colors)
        colors = new
        if not seen.get["n"]:
            break
    inside = e.join(colors.toDF("src", "cs"), "src").join(colors.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst")
    inside = stored(inside)
    front = member = stored(colors.filter("node = color").select("node", F.col("color").alias("component")))
    while True:
        step = inside.join(front.toDF("dst", "component"), "dst").select(F.col("src").alias("node"), "component").distinct()
        front, n = counted(step.join(member, "node", "left_anti"))
        if not n:
            break
        member = stored(member.union(front))
    discard(inside, colors)
    left, n = counted(_without(e, member.select("node")))
    return member, left, n


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node of an edge; component is its smallest node.

    While there are more than `local_edges` distinct edges, rounds of joins make the graph smaller: chains are
    contracted by independent coins, nodes without an edge in or out are trimmed, and where that takes off little, one
    forward colouring and backward walk finds components. What is left then goes through one task; nothing depends on
    where that happens but the time. Contracted nodes come back last, latest first: one is in the component of the node
    before it if the node after it is in the same, and alone otherwise.
    """
    e, n = counted(edges.select("src", "dst").filter("src <> dst").distinct())
    found: list[DataFrame] = []
    chains: list[DataFrame] = []
    turn = 0
    while n > local_edges:
        start, old = n, e
        e, inner, n = _contract(old, turn)
        chains.append(inner)
        discard(old)
        if n:
            old, (e, n) = e, _trim(e)
            discard(old)
        if n > local_edges and n > 0.9 * start:
            old, (member, e, n) = e, _one_colouring(e)
            found.append(member)
            discard(old)
        turn += 1
    if n:
        found.append(_by_one_task(e))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if not found and not chains:
        return nodes.withColumn("component", F.col("node"))
    none = nodes.limit(0).select("node", F.col("node").alias("component"))
    known = none
    for d in found:
        known = known.union(d)
    if not chains:
        return nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    gone = chains[0].select("node")
    for d in chains[1:]:
        gone = gone.union(d.select("node"))
    known = stored(nodes.join(gone, "node", "left_anti").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    for inner in reversed(chains):
        d = inner.join(known.toDF("before", "cb"), "before").join(known.toDF("after", "ca"), "after")
        back = d.select("node", F.when(F.col("cb") == F.col("ca"), F.col("cb")).otherwise(F.col("node")).alias("component"))
        known = stored(known.union(back))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def cyclic(components: DataFrame) -> DataFrame:
    """The members of components of two nodes or more."""
    big = components.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return components.join(big, "component")


def in_cycle(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges inside one component, with it."""
    c = cyclic(components).select("node", "component")
    d = edges.join(c.select(F.col("node").alias("src"), "component"), "src")
    return d.join(c.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst").filter("component = cd").drop("cd")


def cycle_report(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row per cyclic component: size, edges that leave it, score, severity, strategy."""
    c = cyclic(components)
    sizes = c.groupBy("component").agg(F.count("*").alias("size"))
    d = edges.join(c.select(F.col("node").alias("src"), "component"), "src").join(
        components.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst"
    )
    leaving = d.filter("component <> cd").groupBy("component").agg(F.count("*").alias("out"))
    r = sizes.join(leaving, "component", "left").withColumn("external_edges", F.coalesce("out", F.lit(0).cast("long"))).drop("out")
    size, out = F.col("size"), F.col("external_edges")
    return r.select(
        "component",
        "size",
        "external_edges",
        (size * 2.0 + out * 0.8).alias("score"),
        F.when((size >= 8) | (out >= 20), "HIGH").when((size >= 3) | (out >= 5), "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(size <= 2, "audit_and_directional_split").otherwise("extract_shared_module").alias("strategy"),
    )


def break_hints(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The weakest edge inside each cyclic component; ties by (src, dst)."""
    d = with_confidence(in_cycle(edges, components))
    return d.groupBy("component").agg(F.min(F.struct("confidence", "src", "dst")).alias("m")).select("component", "m.src", "m.dst", "m.confidence")


def notes(edges: DataFrame, leftovers: DataFrame) -> DataFrame:
    """(file, raw, line, reason, confidence): leftovers (src, raw, reason) and every edge that is not plainly static."""
    left = leftovers.select(F.col("src").alias("file"), "raw", F.lit(None).cast("long").alias("line"), "reason", F.lit(None).cast("double").alias("confidence"))
    flagged = with_confidence(edges).filter("reason <> 'resolved_static'")
    return left.unionByName(flagged.select(F.col("src").alias("file"), F.col("dst").alias("raw"), F.col("line").cast("long").alias("line"), "reason", "confidence"))


def actionable(edges: DataFrame, below: float = LOW_DIAGNOSTIC) -> DataFrame:
    """(file, path, confidence, reason) of edges below the bound that a reader can do something about."""
    d = with_confidence(edges).filter((F.col("confidence") < below) & (F.col("reason") != "dynamic_literal"))
    return d.select(F.col("src").alias("file"), F.col("dst").alias("path"), "confidence", "reason")


def cycle_members(cycles: DataFrame) -> DataFrame:
    """(file, n): in how many cycles (files) a file is, most first: an order where no edge list is at hand."""
    return cycles.select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file")


def changed_names(old: Column, new: Column) -> Column:
    """The names (first words) whose entries differ between two sorted lists of entries; `*` alone where it is one."""
    name = lambda x: F.split_part(x, F.lit(" "), F.lit(1))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    moved = F.filter(F.array_distinct(F.concat(old, new)), lambda x: count(old, x) != count(new, x))
    names = F.array_sort(F.array_distinct(F.transform(moved, name)))
    return F.when(F.array_contains(names, "*"), F.array(F.lit("*"))).otherwise(names)
