"""Graph, diff, health, journal, scope, snapshot and streaming operators."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from relatrix.functions import text as T
from relatrix.operators import caps, drift, files, graph, health, journal, overlay, reach
from relatrix.plans.registry import ORACLES, QUERIES
from relatrix.sources import artifacts, scope
from relatrix.sources.snapshot import Store, update
from relatrix.streaming.journal_stream import TwoClocks, alert_crossings, suppress_stream

from conftest import SF


def tarjan(n, edges):
    reach = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}


def test_strong_components_on_random_digraphs(spark):
    rng = random.Random(3)
    n = 40
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(55)})
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = tarjan(n, pairs)
    got = {r.node: r.component for r in graph.strong_components(e).collect()}
    assert got == {k: v for k, v in want.items() if k in got}
    closure = {(r.src, r.dst) for r in graph.closure(e).collect()}
    assert all((a, b) in closure for a, b in pairs)


@pytest.mark.parametrize("shape", ["random", "ring", "path", "two rings", "strings"])
def test_strong_components_by_joins_alone(spark, shape):
    """With `local_edges` 0 every round is joins; long chains take rounds by the logarithm of their length."""
    rng = random.Random(4)
    pairs = {
        "random": {(rng.randrange(30), rng.randrange(30)) for _ in range(45)},
        "ring": {(i, (i + 1) % 60) for i in range(60)},
        "path": {(i, i + 1) for i in range(50)} | {(7, 7)},
        "two rings": {(i, (i + 1) % 20) for i in range(20)} | {(i, 20 + (i + 1) % 20) for i in range(20, 40)} | {(3, 25), (39, 60)},
        "strings": {("b", "a"), ("a", "c"), ("c", "b"), ("c", "d")},
    }[shape]
    kind = "string" if shape == "strings" else "long"
    e = spark.createDataFrame(sorted(pairs), f"src {kind}, dst {kind}")
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    want = {names[k]: names[v] for k, v in tarjan(len(names), [(at[a], at[b]) for a, b in pairs]).items()}
    for local in (0, 10**6):
        assert {r.node: r.component for r in graph.strong_components(e, local).collect()} == want


def within(pairs, depth):
    """{(node, what it leads to): least number of edges, one at least, `depth` at most}."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    out = {}
    for node in to:
        front, seen, k = {node}, set(), 0
        while front and k < depth:
            k += 1
            front = {y for x in front for y in to.get(x, ())} - seen
            seen |= front
            out |= {(node, y): k for y in front}
    return out


def join_rows(spark, run):
    """The rows that the joins of run() make, by Spark's own metrics."""
    java = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    store = spark._jsparkSession.sharedState().statusStore()
    before = {x.executionId() for x in java(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for k in {x.executionId() for x in java(store.executionsList())} - before:
        values = java(store.executionMetrics(k))
        for node in java(store.planGraph(k).allNodes()):
            if "Join" in node.name():
                total += sum(int(values[m.accumulatorId()].replace(",", "")) for m in java(node.metrics()) if m.name() == "number of output rows" and m.accumulatorId() in values)
    return total


def shuffled(spark, run):
    """The bytes that the stages of run() write for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(none, False, False, quantiles, none))
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in stages}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("shape, block", [("random", 5), ("strings", 10**6), ("between", 10**6)])
def test_impact_and_closure_equal_brute_force(spark, monkeypatch, shape, block):
    """`between`: a middle node without an edge to another one, an end that no edge leaves, an edge to itself."""
    monkeypatch.setattr(reach, "BLOCK_EDGES", block)
    rng = random.Random(6)
    pairs = {
        "random": sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(16)} | {(20, 21), (21, 22), (0, 20), (22, 22)}),
        "strings": [("b", "a"), ("a", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("é", "a")],
        "between": [(1, 2), (2, 3), (5, 5)],
    }[shape]
    kind = "string" if shape == "strings" else "long"
    e = spark.createDataFrame([*pairs, (None, pairs[0][0]), (pairs[0][0], None)], f"src {kind}, dst {kind}")
    got = graph.closure(e).collect()
    assert sorted(map(tuple, got)) == sorted(within(pairs, 99))
    got = graph.impact(e, 3).collect()
    assert sorted(map(tuple, got)) == sorted((*p, k) for p, k in within([(b, a) for a, b in pairs], 3).items() if p[0] != p[1])


def test_impact_makes_no_row_for_every_way(spark):
    """Full layers: 60 ways lead to each pair two layers apart."""
    pairs = [(60 * k + i, 60 * k + j + 60) for k in range(3) for i in range(60) for j in range(60)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    found = []
    rows = join_rows(spark, lambda: found.extend(graph.impact(e, 3).collect()))
    assert len(found) == 6 * 3600 and rows < 2 * (len(pairs) + len(found))


def test_impact_packs_what_it_copies_to_blocks(spark, monkeypatch):
    """What goes to the 30 blocks of far ends is packed: the whole search takes some 14 bytes an edge, plain lists 46."""
    monkeypatch.setattr(reach, "BLOCK_EDGES", 1000)
    pairs = [(100 * k + i, 100 * k + j + 100) for k in range(3) for i in range(100) for j in range(100) if i != j]
    e = spark.createDataFrame(pairs, "src long, dst long").coalesce(1).localCheckpoint()
    found = []
    n = shuffled(spark, lambda: found.extend(graph.impact(e, 3).collect()))
    assert len(found) == 60_000 - 3 * 100 and n < 30 * len(pairs)


def test_closure_makes_no_row_for_every_way(spark):
    """30 nodes all joined to each other, 300 with 20 edges into them."""
    pairs = [(i, j) for i in range(30) for j in range(30) if i != j] + [(i, (i * 7 + j) % 30) for i in range(100, 400) for j in range(20)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    found = []
    rows = join_rows(spark, lambda: found.extend(graph.closure(e).collect()))
    assert len(found) == 330 * 30 and rows < 2 * (len(pairs) + len(found))


@pytest.mark.parametrize("name", [int, str, lambda i: -(2**62) * (i % 2) + i], ids=["whole", "strings", "far apart"])
def test_blocks_in_small_pieces_equal_brute_force(monkeypatch, name):
    """Many chunks of a slot, rows parted, depths beyond a byte, members of a far end; no session."""
    import pyarrow as pa

    monkeypatch.setattr(reach, "PACK_ROWS", 7)
    monkeypatch.setattr(reach, "OUT_ROWS", 3)
    rng = random.Random(8)
    kind = pa.string() if name is str else pa.int64()
    edges = [(0, name(rng.randrange(12)), 0, name(rng.randrange(12))) for _ in range(40)]
    near = [(n % 3, name(n), rng.choice([0, 1, 126, 127, 200]), name(rng.randrange(14))) for n in range(9) for _ in range(1 + 3 * (n % 4))]
    members = [(0, name(3), 0, name(i)) for i in range(20, 28)]
    parts = []
    for part, rows in enumerate((members, edges, near)):
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), kind, pa.int64(), kind))], ["slot", "key", "depth", "value"])
        chunks = reach._packing(iter(table.to_batches(max_chunksize=3)))
        parts += sorted((part, b["slot"][0].as_py(), b["chunk"][0].as_py()) for b in chunks)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts[i : i + 4])], ["part", "slot", "chunk"]) for i in range(0, len(parts), 4)]
    got = [(r["node"], x, r["depth"]) for b in reach._run(True, True, kind)(iter(batches)) for r in b.to_pylist() for x in r["list"]]
    want = {}
    for _, node, d, mid in near:
        for _, at, _, far in edges:
            for x in [m[3] for m in members] if at == mid and far == name(3) else [far] * (at == mid):
                want[node, x] = min(d + 1, want.get((node, x), 999))
    assert sorted(got) == sorted((*p, d) for p, d in want.items())


def test_nodes_of_other_types(spark):
    e = spark.sql("SELECT date(s) AS src, date(d) AS dst FROM VALUES ('2020-01-01', '2020-01-02'), ('2020-01-02', '2020-01-03') AS t(s, d)")
    assert sorted((str(r.node)[9:], str(r.affected)[9:], r.depth) for r in graph.impact(e, 2).collect()) == [("2", "1", 1), ("3", "1", 2), ("3", "2", 1)]
    e = e.select(F.dayofmonth("src").alias("src"), F.dayofmonth("dst").alias("dst"))
    assert sorted(map(tuple, graph.impact(e, 2).collect())) == [(2, 1, 1), (3, 1, 2), (3, 2, 1)]


def test_closure_moves_edges_few_times(spark, monkeypatch):
    """20 nodes all joined to each other, 2,000 with 20 edges to 300 that lead there. Two bytes an edge for all of
    it; with rows shuffled for each join and copied to every block 31."""
    monkeypatch.setattr(reach, "BLOCK_EDGES", 10_000)
    pairs = [(i, j) for i in range(20) for j in range(20) if i != j] + [(i, i % 20) for i in range(100, 400)]
    pairs += [(i, 100 + (i * 7 + j * 11) % 300) for i in range(1000, 3000) for j in range(20)]
    e = spark.createDataFrame(pairs, "src long, dst long").coalesce(1).localCheckpoint()
    found = []
    n = shuffled(spark, lambda: found.append(graph.closure(e).count()))
    assert found == [20 * 20 + 300 * 20 + 2000 * 40] and n < 10 * len(pairs)


def test_strong_local_on_large_random_graphs():
    import numpy as np

    rng = np.random.default_rng(1)
    ring = np.arange(200_000)
    assert (graph.strong_local(ring, np.roll(ring, -1)) == 0).all()
    assert (graph.strong_local(ring[:-1], ring[1:]) == ring).all()
    a, b = rng.integers(0, 60, 90), rng.integers(0, 60, 90)
    got = graph.strong_local(a, b)
    want = tarjan(len(got), list(zip(a.tolist(), b.tolist())))
    assert {i: int(c) for i, c in enumerate(got)} == want


def test_two_file_cycle(spark):
    raw = spark.createDataFrame([("a", "b", 1, 1, False, False, False, []), ("a", "b", 2, 9, True, False, True, ["x"]), ("b", "a", 3, 2, False, False, True, [])], "src string, dst string, seq long, line long, conditional boolean, dynamic boolean, via_barrel boolean, names array<string>")
    e = graph.merge_edges(raw)
    ab = e.filter("src = 'a'").first()
    assert (ab.line, ab.conditional, ab.via_barrel, ab.names) == (1, True, False, ["x"])
    c = graph.strong_components(e)
    r = graph.cycle_report(e, c).first()
    assert (r["size"], r.severity, r.score, r.strategy) == (2, "LOW", 4.0, "audit_and_directional_split")
    assert graph.break_hints(e, c).first()[1:] == ("a", "b", 0.55)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=25), st.lists(st.sampled_from("abcdefg"), max_size=25))
def test_lines_outside_ranges_are_common(old, new):
    ranges = drift.changed_ranges("\n".join(old) + "\n" if old else "", "\n".join(new) + "\n" if new else "")
    inside = {i for a, b in ranges for i in range(a, b + 1)}
    rest = [x for i, x in enumerate(new, 1) if i not in inside]
    at = 0
    for x in rest:  # the rest is a subsequence of the old text
        while at < len(old) and old[at] != x:
            at += 1
        assert at < len(old)
        at += 1
    assert all(b < c - 1 for (_, b), (c, _) in zip(ranges, ranges[1:]))


def test_ranges():
    assert drift.changed_ranges("1\n2\n3\n4\n5\n", "1\nx\n3\n4\n5\n6\n") == [(2, 2), (6, 6)]
    assert drift.changed_ranges("1\n2\n3\n", "1\n3\n") == [(2, 2)]
    assert drift.changed_ranges("1\r\n2\r\n", "1\n2\n") == []
    assert drift.changed_ranges("a\nb\n", "a\nb") == [(2, 2)] and drift.changed_ranges("a\nb", "a\nb\n") == [(2, 2)]
    assert drift.changed_ranges("a\fb\r\nc\u2028d\r\ne\r\n", "a\fb\r\nc\u2028d\r\nx\r\n") == [(3, 3)]
    assert drift.changed_ranges("", "a\n") == [(1, 1)] and drift.changed_ranges("a\n", "") == []


def test_caps():
    assert [caps.cap(v, 7) for v in (None, 0, 1, "x", "3", -2, True)] == [7, None, 1, 7, 3, 7, 7]


def test_text_functions(spark):
    d = spark.createDataFrame([("a/./b/../c", "x\ny", 1), ("../z", "", 2), ("p/q", "x\n", 3)], "p string, t string, i int")
    rows = d.select(T.normalize_path(F.col("p")), T.physical_lines(F.col("t")), T.line_of(F.col("t"), [F.lit("y"), F.lit("zz")])).collect()
    assert [tuple(r) for r in rows] == [("a/c", 2, 2), ("z", 0, 1), ("p/q", 1, 1)]
    r = spark.createDataFrame([([(3, 3), (5, 8)],)], "r array<struct<start:int,end:int>>").select(T.format_ranges(F.col("r"))).first()[0]
    assert r == "3, 5-8"


def test_alerts(spark):
    f = spark.createDataFrame([("hub.py", 9), ("lib.rs", 2), ("z.py", 3)], "rel string, n_lines long")
    e = spark.createDataFrame([("a", "hub.py"), ("b", "hub.py"), ("a", "lib.rs"), ("b", "lib.rs")], "src string, dst string")
    mapped = f.select(F.col("rel").alias("file"))
    both = files.line_alerts(f, 3).unionByName(files.fan_in_alerts(e, mapped, 1))
    assert [(r.file, r.kind) for r in files.ranked_alerts(both, None).collect()] == [("hub.py", "line_count"), ("hub.py", "fan_in")]
    assert files.line_alerts(f, 0).count() == 0
    new, state = alert_crossings(both, both.filter("kind = 'fan_in'").select("file", "kind"))
    assert [r.kind for r in new.collect()] == ["line_count"] and state.count() == 2


def test_health(spark):
    cols = "file string, status string, reason string, verification string, source_hash string"
    h = spark.createDataFrame([("a", "🟢 Green", "", "verified", "sha256:1"), ("b", "Odd", "", "", ""), ("c", "Yellow", "Initial stub", "", "sha256:3")], cols)
    s = health.summary(h).first()
    assert (s.total, s.green, s.yellow, s.red, s.verified) == (3, 1, 2, 0, 1)
    assert health.metrics(h).first().yellow == 1
    assert health.readiness(h).first()[0] == "ready_for_daemon"
    assert health.readiness(h, scope_risk=True).first()[0] == "map_ok_scope_risk"
    live = spark.createDataFrame([("a", "sha256:2"), ("b", "x")], "rel string, hash string")
    got = {r.file: (r.status, r.journal) for r in health.check_changes(h.filter("file <> 'b'"), live).collect()}
    assert got == {"a": ("Yellow", True), "c": ("Red", True)}
    with pytest.raises(ValueError):
        health.record_change(h, spark.createDataFrame([("a", False, " ")], "file string, deleted boolean, why string"))
    w = spark.createDataFrame([("a", ["new"], "only `old` here", ["old"], "h", "h", "sha256:9")], "file string, symbols array<string>, wiki string, old_symbols array<string>, wiki_hash string, old_wiki_hash string, source_hash string")
    assert health.wiki_verdict(w).first().issues == ["undocumented_new_symbols: new", "wiki_mentions_removed_symbols: old", "wiki_not_updated_for_api_change"]
    healed = health.heal_stubs(h, spark.createDataFrame([("c", "x" * 350)], "file string, text string"))
    assert healed.filter("file = 'c'").first().status == "Green"
    idle = health.next_actions(h, spark.createDataFrame([], "file string, kind string, value long, threshold long"), spark.createDataFrame([], "src string"))
    assert [r.action for r in idle.collect()] == ["lookup_only"]


STAMP = datetime(2024, 1, 1, 23, 59)
ENTRIES = [(STAMP + timedelta(seconds=s), "edit", "f", "r", i) for i, s in enumerate((0, 50, 100, 121, 200, 300, 3600))]
JOURNAL = "stamp timestamp_ntz, action string, file string, reason string, event_id long"


def greedy(rows, window):
    last, out = {}, []
    for r in rows:
        k = (r[1:4], r[0].date())
        if k not in last or (r[0] - last[k]).total_seconds() > window:
            last[k] = r[0]
            out.append(r[4])
    return out


def test_journal_duplicates(spark):
    d = spark.createDataFrame(ENTRIES, JOURNAL)
    assert sorted(r.event_id for r in journal.suppress_duplicates(d).collect()) == greedy(ENTRIES, 120)
    assert journal.search(d, "R").count() == 0 and journal.search(d, "").count() == 7


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame(ENTRIES, JOURNAL).withColumn("stamp", F.col("stamp").cast("timestamp"))
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")).withWatermark("stamp", "1 hour")
    q = suppress_stream(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.event_id for r in journal.suppress_duplicates(spark.createDataFrame(ENTRIES, JOURNAL), by_day=False).collect())


def test_two_clocks():
    now, log = [0.0], []
    loop = TwoClocks(lambda: log.append("c"), lambda: log.append("h"), 10, lambda: now[0])
    assert [loop.tick() for now[0] in (0, 1, 5, 10, 11)] == [True, False, False, True, False]
    assert log.count("c") == 5


def test_scope_and_update(spark, tmp_path):
    root = tmp_path / "tree"
    for rel, text in {"a.py": "import b\n", "b.py": "x = 1\n", "node_modules/c.js": "", "d.txt": "", "e/f.py": "import a\n"}.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "bad.py").write_bytes(b"s = '\xff'\nimport a\n")
    read = lambda: scope.source_files(spark, str(root))
    assert sorted(r.rel for r in read().collect()) == ["a.py", "b.py", "bad.py", "e/f.py"]
    assert [r.rel for r in read().filter("dirty").collect()] == ["bad.py"]
    store = Store(spark, str(tmp_path / "store"))
    assert update(store, read()) == {"skipped": 0, "hashed": 4, "parsed": 4, "removed": 0, "dirty": 0}
    assert update(store, read()) == {"skipped": 4, "hashed": 0, "parsed": 0, "removed": 0, "dirty": 0}
    (root / "b.py").write_text("import e.f\nx = 22\n")
    (root / "bad.py").unlink()
    assert update(store, read()) == {"skipped": 2, "hashed": 1, "parsed": 1, "removed": 1, "dirty": 0}
    assert {(r.src, r.dst) for r in store.read("edges").collect()} == {("a.py", "b.py"), ("b.py", "e/f.py"), ("e/f.py", "a.py")}
    assert scope.path_list("./src/ # x\n# no\n.\nlib\n") == ["src", "lib"]
    s = scope.resolve_scope(["src", "gone"], [], {"src"})
    assert (s.prefixes, s.missing_dirs, s.ok) == (["src"], ["gone"], False)


def test_artifacts(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"files": {"a.py": {"status": "Red", "reason": "gone"}}}')
    (tmp_path / "h.md").write_text("| File | Status | Updated | Reason |\n|---|---|---|---|\n| `b.py` | 🟢 Green | t | ok |\n")
    assert artifacts.read_health(spark, str(tmp_path / "h.json"), str(tmp_path / "h.md")).first()[:2] == ("a.py", "Red")
    (tmp_path / "h.json").write_text("{}")
    assert artifacts.read_health(spark, str(tmp_path / "h.json"), str(tmp_path / "h.md")).first()[:2] == ("b.py", "🟢 Green")
    lines = spark.createDataFrame([(" M a.py",), ("R  x -> y",), (" D z",)], "value string")
    assert [tuple(r) for r in artifacts.git_status(lines).collect()] == [("a.py", False), ("x", True), ("y", False), ("z", True)]


def test_overlay(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel string, hash string")
    tree = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "rel string, hash string")
    diff = overlay.differing(base, tree)
    assert {tuple(r) for r in diff.collect()} == {("b", "changed"), ("c", "deleted"), ("d", "added")}
    assert {tuple(r) for r in overlay.overlaid(base, tree, diff).collect()} == {tuple(r) for r in tree.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).astype(str).values.tolist()))
    assert text(got) == text(want)


def test_a_beaten_reason_is_used(spark):
    files_ = spark.createDataFrame([("a/b.py",), ("a/c/d.py",), ("x.py",)], "file string")
    keys = [("a/", "dir", 0), ("a/b.py", "exact", 1), ("*.py", "glob", 2), ("b/", "none", 3), ("a/c", "no slash", 4), ("a/c/", "deeper", 5)]
    r = spark.createDataFrame(keys, "key string, why string, pos int")
    assert {x.file: x.key for x in journal.reason_for(files_, r).collect()} == {"a/b.py": "a/b.py", "a/c/d.py": "a/c/", "x.py": "*.py"}
    assert {x.key for x in journal.unused_reasons(files_, r).collect()} == {"b/", "a/c"}
