"""A project from first map to green, over the named queries; and the configuration parsers."""

import struct

import pytest

from pyspark.sql import functions as F
from relatrix import api
from relatrix.api import Project
from relatrix.operators import caps, graph, journal, overlay, pending
from relatrix.sources import control, gitindex, projects, scope


def test_project(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    for name, text in {"a.py": "import b\n", "b.py": "import a\ndef go(): pass\n", "c.py": "import a\n", "b.py.wiki.md": "`go` starts it"}.items():
        (root / name).write_text(text)
    p = Project(spark, str(root), str(tmp_path / "store"), max_lines=1, max_fan_in=1)
    assert p.update_maps()["parsed"] == 3
    assert [r.src for r in p.get_dependents("a.py").collect()] == ["b.py", "c.py"]
    cycle = p.get_cycles().first()
    assert (cycle.files, cycle.external_edges, cycle.break_hint.confidence) == (["a.py", "b.py"], 0, 0.9)
    assert {(r.file, r.kind) for r in p.alerts().collect()} == {("b.py", "line_count"), ("a.py", "fan_in")}
    assert p.readiness().first()[0] == "ready_for_daemon" and p.health_summary().first().yellow == 3
    assert p.mark_green(["b.py"]).first().issues == []
    assert p.health.filter("file = 'b.py'").first().verification == "verified"
    p.save()
    (root / "b.py").write_text("import a\ndef went(): pass\n")
    (root / "c.py").unlink()
    q = Project(spark, str(root), str(tmp_path / "store"))
    dirty = {r.file: (r.status, r.changed_lines) for r in q.check_changes().collect()}
    assert dirty["b.py"][0] == "Yellow" and [tuple(x) for x in dirty["b.py"][1]] == [(2, 2)] and dirty["c.py"][0] == "Red"
    actions = [(r.priority, r.action, r.file) for r in q.suggest_next().collect()]
    assert actions == [(1, "record_deletion", "c.py"), (2, "prepare_edit", "b.py")]
    assert {r.file for r in q.search_journal("missing").collect()} == {"c.py"}
    edit = q.prepare_edit("b.py").first()
    assert (edit.wiki_path, edit.wiki) == ("b.py.wiki.md", "`go` starts it") and q.get_unresolved("b.py").count() == 0 and q.healable().count() == 0
    assert edit.dependents == ["a.py"] and [d.dst for d in edit.dependencies] == ["a.py"]
    with pytest.raises(ValueError):
        q.mark_green(["b.py"], force=True)


def test_green_rows_are_the_next_baseline(spark, tmp_path):
    """A symbol that a wiki still names after it is gone, an unchanged wiki of a changed surface, and force."""
    root = tmp_path / "proj"
    (root / "proj").mkdir(parents=True)
    (root / "a.py").write_text("def one(): pass\ndef two(): pass\n")
    (root / "b.py").write_text("import a\n")
    (root / "m.go").write_text("package m\n")
    (root / "a.py.wiki.md").write_text("`one` and `two`")
    (root / "m.go.wiki.md").write_text("about m")
    (root / "proj" / "b.py.wiki.md").write_text("not the wiki of b.py")
    p = Project(spark, str(root), str(tmp_path / "store"))
    p.update_maps()
    assert {(r.file, r.warning) for r in p.mark_green(["./a.py", str(root / "b.py"), "m.go"]).collect()} == {("a.py", "no_symbol_baseline"), ("b.py", None), ("m.go", None)}
    rows = {r.file: r for r in p.health.collect()}
    assert {f: r.verification for f, r in rows.items()} == {"a.py": "verified", "b.py": "no_wiki", "m.go": "unchecked"}
    assert sorted(rows["a.py"].public_symbols) == ["one", "two"] and rows["a.py"].wiki_hash.startswith("sha256:")
    (root / "a.py").write_text("def one(): pass\n")
    v = p.mark_green(["a.py"]).first()
    assert sorted(v.issues) == ["wiki_mentions_removed_symbols: two", "wiki_not_updated_for_api_change"] and v.warning is None
    assert p.baselines.filter("file = 'a.py'").first().text.count("def") == 2
    p.mark_green(["a.py"], force=True, reason="rename only")
    assert p.health.filter("file = 'a.py'").first().verification == "forced"
    p.save()
    assert Project(spark, str(root), str(tmp_path / "store")).health.filter("verification = 'forced'").count() == 1
    with pytest.raises(FileNotFoundError):
        p.get_dependents("nowhere.py")
    with pytest.raises(ValueError):
        p.prepare_edit("")


def test_recording_a_batch(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    for name, text in {"src/a.py": "from src import b\n", "src/b.py": "x = 1\n", "c.py": "from src import a\n"}.items():
        (root / name).write_text(text)
    p = Project(spark, str(root), str(tmp_path / "store"))
    p.update_maps()
    assert p.edges().count() == 2
    batch = spark.createDataFrame([("src/a.py", False), ("src/b.py", True), ("c.py", False), ("c.py.wiki.md", False), ("journal/x.md", False)], "file string, deleted boolean")
    got = p.record_changes(batch, [("src/", "moved"), ("docs/", "none")])
    assert {r.file for r in got["missing_reasons"].collect()} == {"c.py"} and got["recorded"].count() == 0 and p.journal.count() == 0
    assert {r.key for r in got["unused_reasons"].collect()} == {"docs/"}
    (root / "src" / "b.py").unlink()
    args = (batch, [("src/", "moved"), ("src/b.py", "dropped")], "cleanup")
    assert p.record_changes(*args, dry_run=True)["recorded"].count() == 3 and p.journal.count() == 0
    p.record_changes(*args)
    assert {(r.file, r.action, r.reason) for r in p.journal.collect()} == {("src/a.py", "record-change", "moved"), ("src/b.py", "record-deletion", "dropped"), ("c.py", "record-change", "cleanup")}
    assert {(r.src, r.dst) for r in p.edges().collect()} == {("c.py", "src/a.py")} and p.index().count() == 2
    assert {r.file for r in p.pending.collect()} == {"src/a.py", "c.py"}
    stamps = [r.stamp for r in p.journal.collect()]
    p.record_changes(*args)  # within two minutes: duplicates
    assert [r.stamp for r in p.journal.collect()] == stamps
    p.mark_green(["c.py"])
    assert [r.value for r in pending.document(p.pending).collect()] == ["# Pending Updates", "", "- src/a.py: moved — refresh the wiki, then mark-green"]
    only = p.record_changes(batch, default_reason="again", only=["c.py"], green=True)
    assert {r.file for r in only["recorded"].collect()} == {"c.py"} and only["verification_failed"].count() == 0
    assert {(r.outcome, r.n) for r in p.seed_source_hashes().collect()} == {("has_hash", 1), ("not_green", 2)}


def test_pending_lines(spark):
    lines = ["# Pending Updates", "", "- a.py: first: yes", "- b c.py — old form", "- d.py - older", "- a.py: second", pending.EMPTY_NOTE, "-  : x"]
    d = pending.parse(spark.createDataFrame(list(enumerate(lines)), "pos long, value string"))
    assert {(r.file, r.message) for r in d.collect()} >= {("a.py", "first: yes"), ("b c.py", "old form"), ("d.py", "older")}
    assert pending.document(d.limit(0)).collect()[-1].value == pending.EMPTY_NOTE


def test_reason_lines():
    assert journal.reason_lines('{"a/": "x", "n": 1}') == [("a/", "x")]
    assert journal.reason_lines("# c\na.py=b=c\n\n junk \n") == [("a.py", "b=c")]


def test_paths_of_arguments(tmp_path):
    assert scope.rel_arg("/r/proj", "/r/proj/proj/a.py") == "proj/a.py" and scope.rel_arg("/r", "././a\\b.py") == "a/b.py"
    (tmp_path / "link").symlink_to(tmp_path)
    assert scope.rel_arg(str(tmp_path), str(tmp_path / "link" / "x.py")) in ("link/x.py", "x.py")


def test_diagnostics_and_diffs(spark):
    e = spark.createDataFrame([("a", "b", 3, False, False, False), ("a", "c", 4, True, False, False), ("b", "c", 5, False, True, False)], "src string, dst string, line long, conditional boolean, dynamic boolean, via_barrel boolean")
    left = spark.createDataFrame([("a", "os", "external_or_bare")], "src string, raw string, reason string")
    assert {(r.file, r.raw, r.line, r.reason, r.confidence) for r in graph.notes(e, left).collect()} == {("a", "os", None, "external_or_bare", None), ("a", "c", 4, "conditional_guard", 0.55), ("b", "c", 5, "dynamic_literal", 0.4)}
    assert [(r.file, r.path) for r in graph.actionable(e).collect()] == [("a", "c")]
    cycles = spark.createDataFrame([(["a", "b"],), (["b", "c", "d"],)], "files array<string>")
    assert [(r.file, r.n) for r in graph.cycle_members(cycles).collect()][0] == ("b", 2)
    assert [(r.files, r.files_truncated) for r in caps.trim_files(cycles, 2).collect()] == [(["a", "b"], False), (["b", "c"], True)]
    kept, total = caps.compact(cycles.orderBy(F.size("files")), "get_cycles", 1)
    assert kept.count() == 1 and total == 2 and caps.compact(cycles, "get_cycles", 0)[1] is None
    d = spark.createDataFrame([(["f 1", "f 2", "g 1"], ["f 1", "g 2", "h 1"]), (["* x"], []), (["a 1"], ["a 1"])], "old array<string>, new array<string>")
    assert [r[0] for r in d.select(graph.changed_names(F.col("old"), F.col("new"))).collect()] == [["f", "g", "h"], ["*"], []]
    index = spark.createDataFrame([("a", ["c", "b"]), ("b", []), ("x", [])], "rel string, dsts array<string>")
    assert {(r.file, r.problem) for r in overlay.index_consistency(e, index).collect()} == {("b", "index_disagrees")}
    assert {r.problem for r in overlay.index_consistency(e, index.filter("rel <> 'a'")).collect()} == {"index_disagrees", "not_in_index"}


def test_configuration():
    ts = {"web/tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["./*", "x/*"], "u": ["http://x"],}} }'}
    assert projects.ts_aliases(ts)[0] == ("~/*", "web/src/*")
    package = {"p/package.json": '{"name": "@x/p", "exports": {".": {"types": null, "import": "./src/i.ts"}, "./sub": "./src/s.ts"}}'}
    assert projects.packages(package) == [("@x/p", "p", None, {".": "src/i.ts", "./sub": "src/s.ts"})]
    cargo = {"Cargo.toml": '[workspace]\nmembers = ["c/*"]\nexclude = ["c/old*"]', "c/a/Cargo.toml": '[package]\nname = "a-b"\n[lib]\nname = "ab"', "c/old1/Cargo.toml": '[package]\nname = "o"'}
    assert projects.crates(cargo) == [("ab", "c/a")]


def test_journal_text(spark):
    text = "## 2024-01-02 03:04:05 - change\n\nFile: `a.py`\nReason: because\n\n## 2024-01-02 03:05:05 - deletion\nFile: b.py\nReason: gone\n"
    got = journal.parse(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(str(r.stamp), r.action, r.file, r.reason) for r in got] == [("2024-01-02 03:04:05", "change", "a.py", "because"), ("2024-01-02 03:05:05", "deletion", "b.py", "gone")]


def test_names_that_file_sources_hide(spark, tmp_path):
    """Empty files, underscored names and odd characters are part of a tree; excluded folders are not entered."""
    for name in ("pkg/__init__.py", "pkg/_x.py", "pkg/a b%20[1].py", "node_modules/n.js", ".git/h.py", "pkg/.hidden.py", "gen_1/g.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "init" in name else "import pkg\n")
    (tmp_path / "pkg" / "bad.py").write_bytes(b"x = '\xff'\n")
    s = scope.Scope(excludes=(*scope.EXCLUDED, "gen_*"))
    got = {r.rel: (r.n_lines, r.dirty) for r in scope.source_files(spark, str(tmp_path), s).collect()}
    assert got == {"pkg/__init__.py": (0, False), "pkg/_x.py": (1, False), "pkg/a b%20[1].py": (1, False), "pkg/.hidden.py": (1, False), "pkg/bad.py": (1, True)}
    assert [r.rel for r in scope.source_files(spark, str(tmp_path), scope.Scope(["gen_1"], full_tree=False), contents=False).collect()] == ["gen_1/g.py"]
    p = Project(spark, str(tmp_path), str(tmp_path / "store"), s)
    p.update_maps()
    assert ("pkg/_x.py", "pkg/__init__.py") in {(r.src, r.dst) for r in p.edges().collect()}


def test_a_warm_update_reads_what_moved(spark, tmp_path, monkeypatch):
    root = tmp_path / "proj"
    root.mkdir()
    texts = {"a.js": "import {x} from './index'", "index.js": "export * from './x[1]'", "x[1].js": "export const x = 1", "b.py": "import c", "c.py": ""}
    for name, text in texts.items():
        (root / name).write_text(text)
    p = Project(spark, str(root), str(tmp_path / "store"))
    assert p.update_maps() == {"skipped": 0, "hashed": 5, "parsed": 5, "removed": 0, "dirty": 0}
    first = {(r.src, r.dst, r.via_barrel) for r in p.edges().collect()}
    assert first == {("a.js", "index.js", False), ("a.js", "x[1].js", True), ("index.js", "x[1].js", False), ("b.py", "c.py", False)}
    read: list[str] = []
    real = api.source_files
    monkeypatch.setattr(api, "source_files", lambda *a, only=None, **k: (read.extend(only or []), real(*a, only=only, **k))[1])
    assert p.update_maps() == {"skipped": 5, "hashed": 0, "parsed": 0, "removed": 0, "dirty": 0} and read == []
    (root / "x[1].js").write_text("export const x = 22")
    (root / "c.py").unlink()
    assert p.update_maps() == {"skipped": 3, "hashed": 1, "parsed": 1, "removed": 1, "dirty": 0} and read == ["x[1].js"]
    assert {(r.src, r.dst, r.via_barrel) for r in p.edges().collect()} == {("a.js", "index.js", False), ("a.js", "x[1].js", True), ("index.js", "x[1].js", False)}
    assert {r.rel for r in p.index().collect()} == {"a.js", "index.js", "x[1].js", "b.py"}
    assert p.update_maps(full=True)["parsed"] == 4


def test_lock_status_and_deadline(spark, tmp_path):
    folder = str(tmp_path / "state")
    with control.ProjectLock(spark, folder, wait_s=0.3) as mine:
        with mine:
            pass
        with pytest.raises(TimeoutError):
            control.ProjectLock(spark, folder, wait_s=0.2).__enter__()
    with control.ProjectLock(spark, folder, wait_s=0.3):
        (tmp_path / "state" / ".lock").write_text('{"owner": "lost", "at": 1}')
        for f in (tmp_path / "state").glob("*.crc"):
            f.unlink()
        with control.ProjectLock(spark, folder, wait_s=2):
            pass
    assert control.read_status(spark, folder) == {}
    control.write_status(spark, folder, {"parsed": 3})
    assert control.read_status(spark, folder) == {"parsed": 3}
    assert control.within(spark, 60, lambda n: spark.range(n).count(), 5) == 5
    with pytest.raises(ZeroDivisionError):
        control.within(spark, 60, lambda: 1 // 0)
    slow = F.pandas_udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(control.DeadlineExceeded):
        control.within(spark, 0.5, lambda: spark.range(4).select(slow("id")).collect())


def test_scope_of_a_folder(spark, tmp_path):
    for d in ("src/pkg", "lib", "old"):
        (tmp_path / d).mkdir(parents=True)
    s = scope.detect(spark, str(tmp_path))
    assert s.full_tree and s.ok and not s.container
    (tmp_path / "monitored_paths.txt").write_text("src\n# no\nnone\n.\n")
    (tmp_path / "exclude_patterns.txt").write_text("old/*\ngen_*\n")
    s = scope.detect(spark, str(tmp_path))
    assert (s.prefixes, s.missing_dirs, s.full_tree, s.ok) == (["src"], ["none"], False, False) and {"old", "gen_*"} <= set(s.excludes)
    (tmp_path / "map_paths.txt").write_text("lib\n")
    assert scope.detect(spark, str(tmp_path)).prefixes == ["lib"]
    for d in ("src", "lib", "old"):
        (tmp_path / d / ".git").mkdir()
    s = scope.detect(spark, str(tmp_path))
    assert s.container and s.children == ["lib", "old", "src"] and not s.ok


def test_git_index(spark, tmp_path):
    def entry(name, size, seconds, nanos, oid, extended=False, stage=0):
        head = struct.pack(">10I", 0, 0, seconds, nanos, 0, 0, 0o100644, 0, 0, size) + bytes([oid]) * 20
        flags = min(len(name), 0xFFF) | (0x4000 if extended else 0) | stage << 12
        e = head + struct.pack(">H", flags) + (b"\0\0" if extended else b"") + name.encode()
        return e + b"\0" * (8 - len(e) % 8)

    long = "d/" * 2100 + "x.py"
    rows = [entry("a.py", 5, 100, 5000, 1), entry("b.py", 6, 100, 0, 2, extended=True), entry("m.py", 1, 1, 0, 3, stage=2), entry(long, 7, 4_000_000_000, 0, 4)]
    data = b"DIRC" + struct.pack(">II", 3, len(rows)) + b"".join(rows) + b"\0" * 20
    got = gitindex.parse_index(data)
    assert got == [("a.py", 5, 100, 5000, "01" * 20), ("b.py", 6, 100, 0, "02" * 20), (long, 7, 4_000_000_000, 0, "04" * 20)]
    assert gitindex.parse_index(b"DIRC" + struct.pack(">II", 4, 0)) is None and gitindex.parse_index(data[:90]) is None and gitindex.parse_index(b"") is None
    (tmp_path / "index").write_bytes(data)
    d = gitindex.git_index(spark, str(tmp_path / "index"))
    assert {(r.rel, r.racy) for r in d.collect()} == {("a.py", False), ("b.py", False), (long, True)}
    stat = spark.createDataFrame([("a.py", 5, 100_000_005), ("b.py", 6, 100_700_000), (long, 7, 4_000_000_000_000_000)], "rel string, size long, mtime_us long")
    v = gitindex.vouched(d, stat)
    assert {r.rel for r in v.collect()} == {"a.py", "b.py"} and gitindex.same_blobs(v, v.filter("rel = 'a.py'")).count() == 1
