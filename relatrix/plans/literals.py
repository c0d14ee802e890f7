"""Operators on source trees and state rows, over small literal tables; the rows they must give are literals too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caps, drift, files, graph, health, journal, overlay, pending, resolve, wiki
from ..scan import imports, symbols
from ..session import prepare
from ..sources import artifacts, gitindex, projects, scope, snapshot

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        parts = v.replace("'", "''").split("\n")
        return "'" + "' || chr(10) || '".join(parts) + "'"
    return str(v)


def expect(name: str, schema: str, rows: list[tuple]):
    """Register a query whose result, cast to `schema`, is `rows`. Lists are compared as texts joined by `|`."""

    def add(f: Callable[[SparkSession], DataFrame]):
        cols = [c.split() for c in schema.split(", ")]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(prepare(spark))
            kinds = dict(d.dtypes)
            joined = lambda c: F.array_join(F.col(c), "|") if kinds[c].startswith("array") else F.col(c)
            return d.select(*[joined(c).cast(t).alias(c) for c, t in cols])

        out = ", ".join(f"CAST({c} AS {SQL_TYPES[t]}) AS {c}" for c, t in cols)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        QUERIES[name] = run
        ORACLES[name] = f"SELECT {out} FROM (VALUES {values}) AS v({', '.join(c for c, _ in cols)})"
        return f

    return add


def table(s: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return s.createDataFrame(rows, schema)


def tree(s: SparkSession, files: dict[str, str]) -> DataFrame:
    return table(s, "rel string, text string", list(files.items()))


def scanned(s: SparkSession, rel: str, text: str) -> DataFrame:
    return imports.scan(tree(s, {rel: text})).select("spec", "names", "kind", "conditional", "inline_depth")


SCAN = "spec string, names string, kind string, conditional boolean, inline_depth long"

# scanners


@expect(
    "scan_python",
    SCAN,
    [
        ("os", "", "Import", False, 0), ("app.core", "", "Import", False, 0), (".", "a|b", "Import", False, 0), ("..x.y", "z", "Import", False, 0),
        ("late", "", "Import", True, 0), ("plug.one", "", "Dynamic", False, 0),
    ],
)
def _(s):
    text = "import os, app.core as c\nfrom . import (a,\n    b as c)\nfrom ..x.y import z  # import no\n\"\"\"import hidden\"\"\"\ns = \"from q import w\"\nif True:\n    import late\n"
    return scanned(s, "m.py", text + "from __future__ import annotations\nimport_module(\"plug.one\")\n")


@expect(
    "scan_javascript",
    SCAN,
    [
        ("./side", "", "Import", False, 0), ("./m", "a|c", "Import", False, 0), ("./n", "", "Import", False, 0), ("./in", "", "Dynamic", False, 0),
        ("./star", "", "ExportStar", False, 0), ("./from", "q|r", "ExportFrom", False, 0), ("./dyn", "", "Dynamic", False, 0),
    ],
)
def _(s):
    text = "// import 'no'\nimport './side'; import D, {a, b as c} from \"./m\"; import * as N from './n';\nconst r = /import 'x'/; const t = `import 'y' ${require('./in')} `;\n"
    return scanned(s, "m.ts", text + "export * from './star'; export {p as q, r} from './from'; export {local};\nconst m = import('./dyn'); x.import('no')\n")


@expect(
    "scan_rust",
    SCAN,
    [
        ("mod:a", "", "Import", False, 0), ("mod:inner::deep", "", "Import", False, 1), ("super::x::Y", "Y", "Import", False, 1), ("crate::b", "b", "Import", False, 0),
        ("crate::b::C", "D", "Import", False, 0), ("crate::e::*", "", "Import", False, 0), ("helper::run", "", "PathExpr", False, 0),
    ],
)
def _(s):
    text = "mod a; mod inner { use super::x::Y; mod deep; }\nuse crate::{b::{self, C as D}, e::*}; // use no::no;\n"
    return scanned(s, "m.rs", text + "/* mod z; */ fn f<'a>(s: &'a str) { let c = 'x'; helper::run(); Type::new(); let r = r#\"use q::w;\"#; }\n")


@expect(
    "scan_other_languages",
    "src string, spec string",
    [("a.go", "fmt"), ("a.go", "x/y"), ("a.go", "z"), ("b.c", "a.h"), ("b.c", "b.h"), ("c.java", "a.B"), ("c.java", "c.D.e"), ("c.java", "f.*"), ("d.cs", "A.B")],
)
def _(s):
    files = {
        "a.go": 'import (\n "fmt"\n m "x/y" // "no"\n)\nimport "z"', "b.c": '#include "a.h"\n// #include "no.h"\n# include <b.h>\n', "readme.md": "import x",
        "c.java": "import a.B;\nimport static c.D.e;\n/* import no.X; */ import f.*;", "d.cs": "using A.B;\nusing static C.D;\nusing X = Y.Z;\nusing (var q = 1) {}",
    }
    return imports.scan(tree(s, files))


@expect("scan_traps", "src string, spec string", [("e.py", "real")])
def _(s):
    files = {"a.py": "'''\nimport b\n'''\n# import b\ns = 'import b'\n", "c.js": "// import './d'\nconst r = /from '.\\/d'/", "b.rs": "// use a::b;\n/* mod x;\n mod y; */", "e.py": "import real"}
    return imports.scan(tree(s, files))


@expect("language_of", "rel string, language string", [("a.py", "python"), ("b.TSX", "javascript"), ("c.rs", "rust"), ("d.hpp", "c"), ("e.cs", "csharp"), ("f.java", "java"), ("g.go", "go"), ("h.md", "none")])
def _(s):
    d = table(s, "rel string", [(x,) for x in ("a.py", "b.TSX", "c.rs", "d.hpp", "e.cs", "f.java", "g.go", "h.md")])
    return d.select("rel", imports.language_column(F.col("rel")).alias("language"))


@expect(
    "public_symbols",
    "rel string, names string",
    [("a.py", "a|c"), ("b.py", "x|y"), ("c.ts", "b|d|f"), ("d.rs", "A|W|Y|go|m"), ("e.go", None)],
)
def _(s):
    files = {
        "a.py": "def a(): pass\nclass _B: pass\nasync def c(): pass\n  def no(): pass\n", "b.py": "__all__ = ['x', ('no',)]\n__all__ += [\"y\"]\ndef z(): pass",
        "c.ts": "export default function f() {}\nexport {a as b, _c};\nexport const d = 1; const e = 2", "e.go": "func A() {}",
        "d.rs": "pub struct A; struct B; impl A { pub fn m(&self) {} fn n(&self) {} } impl B { pub fn h() {} } pub(crate) fn r() {} pub use x::{Y, Z as W}; pub async fn go() {}",
    }
    return tree(s, files).select("rel", symbols.symbols_column(F.col("rel"), F.col("text")).alias("names"))


@expect("exported_names", "names string", [("local|k|go",)])
def _(s):
    text = "export * from './s'; export {p as q} from './f'; export {local}; export const k = 1;\nexport async function go() {}"
    return tree(s, {"m.js": text}).select(imports.exported_column(F.col("text")).alias("names"))


# resolution

EDGES = "src string, dst string, line long, conditional boolean, dynamic boolean, via_barrel boolean"


def resolved(s: SparkSession, files: dict[str, str], **kw) -> DataFrame:
    f = tree(s, files)
    return resolve.build_edges(f, imports.scan(f), **kw)


APP = {
    "main.py": "from app import core\nimport app.util\nimport requests\n", "app/__init__.py": "", "app/core.py": "from . import util\nfrom .sub.leaf import leaf\n",
    "app/util.py": "if 1:\n    from app import core\n", "app/sub/__init__.py": "from ..core import x\n", "app/sub/leaf.py": "import importlib\nimportlib.import_module('app.util')\n",
}


@expect(
    "resolve_python",
    EDGES,
    [
        ("main.py", "app/core.py", 1, False, False, False), ("main.py", "app/util.py", 2, False, False, False), ("app/core.py", "app/util.py", 1, False, False, False),
        ("app/core.py", "app/sub/leaf.py", 2, False, False, False), ("app/util.py", "app/core.py", 2, True, False, False), ("app/sub/__init__.py", "app/core.py", 1, False, False, False),
        ("app/sub/leaf.py", "app/util.py", 2, False, True, False),
    ],
)
def _(s):
    return resolved(s, APP)[0]


@expect("resolve_leftovers", "src string, raw string, reason string", [("main.py", "requests", "external_or_bare"), ("app/sub/leaf.py", "importlib", "external_or_bare")])
def _(s):
    return resolved(s, APP)[1]


MONOREPO = {
    "packages/a/src/index.ts": "export * from './impl'; export {two} from './two';", "packages/a/src/impl.ts": "export const one = 1;", "packages/a/src/two.ts": "export const two = 2;",
    "packages/b/src/use.ts": "import {one} from '@x/a'; import {lib} from '~/lib'; import('./lazy'); import 'left-pad'; import './gone';",
    "packages/b/src/lib.ts": "export const lib = 1;", "packages/b/src/lazy/index.ts": "",
}


@expect(
    "resolve_javascript",
    "src string, dst string, via_barrel boolean",
    [
        ("a/src/index.ts", "a/src/impl.ts", False), ("a/src/index.ts", "a/src/two.ts", False), ("b/src/use.ts", "a/src/index.ts", False), ("b/src/use.ts", "a/src/impl.ts", True),
        ("b/src/use.ts", "b/src/lib.ts", False), ("b/src/use.ts", "b/src/lazy/index.ts", False),
    ],
)
def _(s):
    aliases = table(s, "pattern string, target string", [("~/*", "packages/b/src/*")])
    packages = table(s, "name string, dir string, main string, exports map<string,string>", [("@x/a", "packages/a", None, {".": "src/index.ts"})])
    exports = table(s, "rel string, name string", [(r, n) for r, t in MONOREPO.items() for n in imports.exported(t)])
    e = resolved(s, MONOREPO, aliases=aliases, packages=packages, exports=exports)[0]
    short = lambda c: F.regexp_replace(c, "^packages/", "").alias(c)
    return e.select(short("src"), short("dst"), "via_barrel")


@expect(
    "resolve_rust",
    "src string, dst string",
    [
        ("src/lib.rs", "src/a.rs"), ("src/lib.rs", "src/b/mod.rs"), ("src/a.rs", "src/b/mod.rs"), ("src/a.rs", "src/b/c.rs"), ("src/b/mod.rs", "src/b/c.rs"),
        ("src/b/c.rs", "src/b/mod.rs"), ("tests/t.rs", "src/a.rs"),
    ],
)
def _(s):
    files = {
        "src/lib.rs": "mod a; mod b;", "src/a.rs": "use crate::b::Thing; use super::b::c::deep;", "src/b/mod.rs": "pub mod c; use std::fmt;",
        "src/b/c.rs": "use self::gone::X; use super::Thing;", "tests/t.rs": "use my_crate::a::go;",
    }
    return resolved(s, files, crates=table(s, "name string, dir string", [("my-crate", "")]))[0]


BAKERY = {
    "bakery/src/lib.rs": "mod oven; mod tray; pub use oven::{Bread, Crumb as Dust}; pub use tray::*; use oven::Ash;", "bakery/src/oven.rs": "pub struct Bread; pub struct Crumb; pub struct Ash;",
    "bakery/src/tray.rs": "pub fn fill() {} fn scrub() {}", "bakery/src/cook.rs": "use crate::Ash;", "a/src/main.rs": "use bakery::Dust; use bakery::Ash;",
    "b/src/main.rs": "use bakery::*; fn main() { fill(); scrub(); jar.Bread; }", "c/src/main.rs": "fn main() { bakery::Bread::bake(); bakery::gone::f(); }",
}


@expect(
    "resolve_rust_reexports",
    "src string, dst string, via_barrel boolean",
    [
        ("lib", "oven", False), ("lib", "tray", False), ("cook", "lib", False), ("cook", "oven", True), ("a", "lib", False), ("a", "oven", True), ("b", "lib", False), ("b", "tray", True),
        ("c", "oven", True),
    ],
)
def _(s):
    e = resolved(s, BAKERY, crates=table(s, "name string, dir string", [("bakery", "bakery")]))[0]
    short = lambda c: F.regexp_replace(F.regexp_replace(c, "/src/main.rs$", ""), "^bakery/src/(.*)\\.rs$", "$1").alias(c)
    return e.select(short("src"), short("dst"), "via_barrel")


@expect(
    "rust_exports",
    "kind string, name string, path string, public boolean",
    [
        ("use", "b", "a::b", True), ("use", "a", "a", True), ("use", "d", "a::c", True), ("glob", "", "a::e", True), ("def", "h", None, True), ("def", "K", None, False), ("def", "l", None, True),
    ],
)
def _(s):
    text = "pub use a::{b, self, c as d, e::*}; use f::g as _; pub(crate) const fn h() {} const _: u8 = 0; static mut K: u8 = 1; mod m { pub fn no() {} } extern crate x; pub unsafe extern \"C\" fn l() {}"
    return tree(s, {"m.rs": text}).select(F.explode(symbols.exports_column(F.col("text"))).alias("e")).select("e.*")


@expect("bare_names", "names string", [("a|c|f|fn",)])
def _(s):
    return tree(s, {"m.rs": "fn f() { a.b(c::d, 1.5e3, \"q\", 'x'); } // z"}).select(symbols.bare_column(F.col("text")).alias("names"))


@expect("resolve_by_name", "src string, dst string", [("g/main.go", "g/util.go"), ("c/a.c", "c/b.h"), ("j/A.java", "j/B.java"), ("s/A.cs", "s/B.cs")])
def _(s):
    files = {
        "g/main.go": 'import "x/util"', "g/util.go": "", "c/a.c": '#include "b.h"', "c/b.h": "", "j/A.java": "import p.B;", "j/B.java": "", "s/A.cs": "using N.B;", "s/B.cs": "",
        "x/readme.md": "import y",
    }
    return resolved(s, files)[0]


@expect("follow_barrels", "src string, name string, dst string, via_barrel boolean", [("u.ts", "one", "impl.ts", True), ("u.ts", "two", "deep.ts", True), ("u.ts", "own", "index.ts", False)])
def _(s):
    e = table(s, "src string, seq int, dst string, name string", [("u.ts", 0, "index.ts", n) for n in ("one", "two", "own")])
    again = table(s, "rel string, pos int, name string, target string", [("index.ts", 0, None, "impl.ts"), ("index.ts", 1, "two", "mid.ts"), ("mid.ts", 0, None, "deep.ts")])
    exports = table(s, "rel string, name string", [("impl.ts", "one"), ("impl.ts", "two"), ("deep.ts", "two"), ("index.ts", "own")])
    return resolve.follow_barrels(e, again, exports)


# text and path functions


@expect("line_of", "id long, line long", [(1, 2), (2, 1), (3, 1), (4, 1), (5, 3)])
def _(s):
    rows = [(1, "x\nuse crate::m::n;\nn();\n", ["crate::m::n", "n()"]), (2, "a b\nb", ["b", "zz"]), (3, "a", ["missing"]), (4, "", ["", "q"]), (5, "a\r\nb\r\nc d", ["d", ""])]
    return table(s, "id long, text string, needles array<string>", rows).select("id", T.line_of(F.col("text"), F.col("needles")).alias("line"))


@expect("normalize_path", "raw string, path string", [("a/./b/../c", "a/c"), ("../x", "x"), ("a//b/", "a/b"), ("./", ""), ("a/../../b", "b")])
def _(s):
    return table(s, "raw string", [(x,) for x in ("a/./b/../c", "../x", "a//b/", "./", "a/../../b")]).select("raw", T.normalize_path(F.col("raw")).alias("path"))


@expect("match_star", "raw string, star string, fixed string", [("@x/core/util", "core/util", None), ("@x/", "", None), ("@y/z", None, None), ("lib", None, "")])
def _(s):
    d = table(s, "raw string", [("@x/core/util",), ("@x/",), ("@y/z",), ("lib",)])
    return d.select("raw", T.match_star(F.col("raw"), "@x/*").alias("star"), T.match_star(F.col("raw"), "lib").alias("fixed"))


@expect("glob_forms", "path string, crossing boolean, inside boolean, question boolean, deep boolean", [("src/a.py", True, True, False, True), ("src/x/b.py", True, False, False, True), ("src/.py", True, True, False, True), ("src/ab.py", True, True, True, True), ("lib/a.py", False, False, False, False)])
def _(s):
    d = table(s, "path string", [(x,) for x in ("src/a.py", "src/x/b.py", "src/.py", "src/ab.py", "lib/a.py")])
    hit = lambda p, c, n: F.col("path").rlike(T.glob_regex(p, c)).alias(n)
    return d.select("path", hit("src/*.py", True, "crossing"), hit("src/*.py", False, "inside"), hit("src/??.py", False, "question"), hit("src/**", False, "deep"))


@expect("format_ranges", "id long, text string", [(1, "3, 5-8"), (2, ""), (3, "1-2")])
def _(s):
    d = table(s, "id long, r array<struct<start:int,end:int>>", [(1, [(3, 3), (5, 8)]), (2, []), (3, [(1, 2)])])
    return d.select("id", T.format_ranges(F.col("r")).alias("text"))


@expect("split_symbols", "raw string, names string", [("b, a\nb", "a|b"), ("", ""), (" , \n", "")])
def _(s):
    return table(s, "raw string", [("b, a\nb",), ("",), (" , \n",)]).select("raw", T.split_symbols(F.col("raw")).alias("names"))


@expect("has_word", "raw string, found boolean", [("call go now", True), ("gopher", False), ("a.go()", True), ("_go", False), ("ago go", True)])
def _(s):
    return table(s, "raw string", [("call go now",), ("gopher",), ("a.go()",), ("_go",), ("ago go",)]).select("raw", T.has_word(F.col("raw"), "go").alias("found"))


@expect("stamp_key", "raw string, key long", [("2024-03-01 00:01:00", (2024 * 366 + 3 * 31 + 1) * 86400 + 60), ("2024-02-29 23:59:00", (2024 * 366 + 2 * 31 + 29) * 86400 + 86340)])
def _(s):
    d = table(s, "raw string", [("2024-03-01 00:01:00",), ("2024-02-29 23:59:00",)])
    return d.select("raw", T.stamp_key(F.col("raw").cast("timestamp_ntz")).alias("key"))


RANGES = "id long, ranges string"


@expect("changed_ranges_cases", RANGES, [(1, "2, 6"), (2, "2"), (3, ""), (4, "2"), (5, "3"), (6, "1"), (7, ""), (8, "1-2")])
def _(s):
    rows = [
        (1, "1\n2\n3\n4\n5\n", "1\nx\n3\n4\n5\n6\n"), (2, "1\n2\n3\n", "1\n3\n"), (3, "1\r\n2\r\n", "1\n2\n"), (4, "a\nb\n", "a\nb"), (5, "a\fb\r\nc d\r\ne\r\n", "a\fb\r\nc d\r\nx\r\n"),
        (6, "", "a\n"), (7, "a\n", ""), (8, "p\nq\n", "r\ns\n"),
    ]
    d = table(s, "id long, old string, new string", rows)
    return d.select("id", T.format_ranges(drift.ranges_column(F.col("old"), F.col("new"))).alias("ranges"))


@expect("since_baseline", "file string, ranges string", [("a", "2"), ("b", "1-3"), ("c", "")])
def _(s):
    live = table(s, "file string, text string", [("a", "x\nz\n"), ("b", "1\n2\n3"), ("c", "")])
    d = drift.since_baseline(live, table(s, "file string, text string", [("a", "x\ny\n")]))
    return d.select("file", T.format_ranges(F.col("changed_lines")).alias("ranges"))


# state documents


@expect("parse_journal", "stamp string, action string, file string, reason string", [("2024-01-02 03:04:05", "change", "a.py", "because"), ("2024-01-02 03:05:05", "deletion", "b.py", "gone"), ("2024-01-03 00:00:00", "record-change", "c.py", "new form")])
def _(s):
    text = "## 2024-01-02 03:04:05 - change\n\nFile: `a.py`\nReason: because\n\n## 2024-01-02 03:05:05 - deletion\nFile: b.py\nReason: gone\n\n## [2024-01-03 00:00:00] record-change\n**File:** c.py\n**Reason:** new form\n\n"
    return journal.parse(table(s, "text string", [(text,)]))


@expect("journal_new_entries", "action string, file string", [("c", "a"), ("b", "y")])
def _(s):
    old = [("2024-01-01 10:00:00", "c", "x", "r"), ("2024-01-01 09:00:00", "b", "y", "r"), ("2024-01-01 10:05:00", "n", "z", "r")]
    new = [("2024-01-01 10:02:00", "c", "x", "r"), ("2024-01-01 10:02:00", "c", "a", "r"), ("2024-01-01 10:02:00", "c", "a", "r"), ("2024-01-01 10:02:00", "b", "y", "r"), ("2024-01-01 10:02:00", "n", "z", "r")]
    at = lambda rows: table(s, "stamp string, action string, file string, reason string", rows).withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))
    return journal.new_entries(at(old), at(new))


@expect("pending_lines", "file string, message string", [("a.py", "first: yes"), ("b c.py", "old form"), ("d.py", "older")])
def _(s):
    lines = ["# Pending Updates", "", "- a.py: first: yes", "- b c.py — old form", "- d.py - older", "- a.py: second", pending.EMPTY_NOTE]
    return pending.parse(table(s, "pos long, value string", list(enumerate(lines))))


@expect("pending_queue", "pos long, value string", [(0, "# Pending Updates"), (1, ""), (2, "- a: one"), (3, "- c: three")])
def _(s):
    rows = lambda *r: table(s, "file string, message string", list(r))
    d = pending.append(rows(("a", "one"), ("b", "two")), rows(("a", "again"), ("c", "three")))
    return pending.document(pending.remove(d, table(s, "file string", [("b",)])))


@expect("git_status", "path string, deleted boolean", [("a.py", False), ("b.py", True), ("old.py", True), ("new.py", False), ("sp ace.py", False)])
def _(s):
    return artifacts.git_status(table(s, "value string", [(" M a.py",), (" D b.py",), ("R  old.py -> new.py",), ('?? "sp ace.py"',), ("",)]))


@expect("git_name_status", "path string, deleted boolean", [("a.py", False), ("b.py", True), ("o.py", True), ("n.py", False)])
def _(s):
    return artifacts.git_name_status(table(s, "value string", [("M\ta.py",), ("D\tb.py",), ("R090\to.py\tn.py",)]))


CHANGES = [("src/a.py", False), ("src/b.py", True), ("c.py", False), ("c.py.wiki.md", False), ("journal/x.md", False), ("file_health.md", False)]
KEYS = [("src/", "moved", 0), ("src/b.py", "dropped", 1), ("*.rs", "none", 2), ("sr", "no slash", 3)]


@expect("plan_changes", "file string, deleted boolean, why string", [("src/a.py", False, "moved"), ("src/b.py", True, "dropped"), ("c.py", False, None)])
def _(s):
    return journal.plan_changes(table(s, "file string, deleted boolean", CHANGES), table(s, "key string, why string, pos int", KEYS))


@expect("plan_changes_only", "file string, deleted boolean, why string", [("src/a.py", False, "moved"), ("src/b.py", True, "dropped")])
def _(s):
    return journal.plan_changes(table(s, "file string, deleted boolean", CHANGES), table(s, "key string, why string, pos int", KEYS), "rest", ["src/"])


@expect("unused_reasons", "key string", [("*.rs",), ("sr",)])
def _(s):
    return journal.unused_reasons(table(s, "file string, deleted boolean", CHANGES), table(s, "key string, why string, pos int", KEYS))


# health

VERDICTS = [
    ("new.py", ["go", "stop"], "`go` only", [], "w1", ""), ("gone.py", ["go"], "`go` and `was`", ["go", "was"], "w2", "w1"), ("same.py", ["go", "more"], "`go` `more`", ["go"], "w1", "w1"),
    ("bare.py", ["go"], None, ["x"], None, "w1"), ("m.go", None, "text", [], "w1", ""),
]


def verdicts(s: SparkSession) -> DataFrame:
    d = table(s, "file string, symbols array<string>, wiki string, old_symbols array<string>, wiki_hash string, old_wiki_hash string", VERDICTS)
    return health.wiki_verdict(d.withColumn("source_hash", F.lit("sha256:new")))


@expect(
    "wiki_verdict",
    "file string, issues string, warning string",
    [
        ("new.py", "undocumented_new_symbols: stop", "no_symbol_baseline"), ("gone.py", "wiki_mentions_removed_symbols: was", None), ("same.py", "wiki_not_updated_for_api_change", None),
        ("bare.py", "", None), ("m.go", "", None),
    ],
)
def _(s):
    return verdicts(s)


ROW = "file string, status string, reason string, verification string, source_hash string, public_symbols array<string>, wiki_hash string"


def health_rows(s: SparkSession) -> DataFrame:
    rows = [(f, "Yellow", "Initial stub", "", "sha256:old", [], "") for f in ("new.py", "gone.py", "same.py", "bare.py", "m.go", "other.py")]
    return table(s, ROW, rows)


@expect(
    "mark_green",
    "file string, status string, reason string, verification string, source_hash string, public_symbols string, wiki_hash string",
    [
        ("new.py", "Yellow", "Initial stub", "", "sha256:old", "", ""), ("gone.py", "Yellow", "Initial stub", "", "sha256:old", "", ""), ("same.py", "Yellow", "Initial stub", "", "sha256:old", "", ""),
        ("bare.py", "Green", "no wiki", "no_wiki", "sha256:new", "go", ""), ("m.go", "Green", "mark-green", "unchecked", "sha256:new", "", "w1"), ("other.py", "Yellow", "Initial stub", "", "sha256:old", "", ""),
    ],
)
def _(s):
    return health.mark_green(health_rows(s), verdicts(s))


@expect("mark_green_forced", "file string, verification string", [("new.py", "forced"), ("gone.py", "forced"), ("same.py", "forced"), ("bare.py", "no_wiki"), ("m.go", "unchecked"), ("other.py", "")])
def _(s):
    return health.mark_green(health_rows(s), verdicts(s), True, "checked by hand")


@expect("record_change", "file string, status string, reason string, verification string", [("a", "Yellow", "edit", "verified"), ("b", "Red", "gone", "deleted"), ("c", "Yellow", "new", None), ("d", "Green", "marked green", "verified")])
def _(s):
    h = table(s, ROW, [(f, "Green", "marked green", "verified", "sha256:x", [], "") for f in ("a", "b", "d")])
    return health.record_change(h, table(s, "file string, deleted boolean, why string", [("a", False, "edit"), ("b", True, "gone"), ("c", False, "new")]))


@expect("heal_stubs", "file string, status string, verification string", [("a", "Green", "verified"), ("b", "Yellow", ""), ("c", "Yellow", "")])
def _(s):
    h = table(s, ROW, [(f, "Yellow", r, "", "", [], "") for f, r in (("a", health.STUB), ("b", health.STUB), ("c", "other"))])
    return health.heal_stubs(h, table(s, "file string, text string", [("a", "x" * 350), ("b", " " * 400 + "x"), ("c", "x" * 350)]))


@expect("healable", "file string, n_wiki long", [("a", 350)])
def _(s):
    h = table(s, ROW, [(f, "Yellow", r, "", "", [], "") for f, r in (("a", health.STUB), ("b", health.STUB), ("c", "other"))])
    return health.healable(h, table(s, "file string, text string", [("a", " " + "x" * 350), ("b", "x" * 349), ("c", "x" * 350)]))


@expect(
    "check_changes_watched",
    "file string, status string, reason string, journal boolean",
    [("gone", "Red", "missing on disk (check-changes)", True), ("moved", "Yellow", "content changed since last mark-green", True), ("again", "Yellow", "content changed since last mark-green", False), ("extra", "Red", "missing on disk (check-changes)", True)],
)
def _(s):
    rows = [("gone", "Green", "", "", "sha256:1", [], ""), ("moved", "Green", "", "", "", [], ""), ("again", "Yellow", health.CHANGED, "", "sha256:1", [], ""), ("same", "Green", "", "", "sha256:1", [], "")]
    kind = "rel string, hash string"
    live = table(s, kind, [("moved", "sha256:2"), ("again", "sha256:2"), ("same", "sha256:1"), ("there", "sha256:9")])
    indexed = table(s, kind, [("moved", "sha256:1")])
    return health.check_changes(table(s, ROW, rows), live, indexed, table(s, "file string", [("extra",), ("there",), ("same",)]))


@expect("stale_wikis", "file string", [("a",), ("c",)])
def _(s):
    h = table(s, ROW, [("a", "Green", "ok", "", "sha256:1", [], ""), ("b", "Green", "ok", "", "sha256:2", [], ""), ("c", "Yellow", "content changed since", "", "", [], ""), ("d", "Yellow", "content changed", "", "", [], "")])
    return health.stale_wikis(h, table(s, "file string", [("a",), ("b",), ("c",)]), table(s, "rel string, hash string", [("a", "sha256:9"), ("b", "sha256:2"), ("c", "sha256:3")]))


@expect("seed_source_hashes", "file string, outcome string, hash string", [("a", "seeded", "sha256:1"), ("b", "has_hash", None), ("c", "not_green", None), ("d", "missing", None)])
def _(s):
    h = table(s, ROW, [("a", "🟢 Green", "", "", "", [], ""), ("b", "Green", "", "", "sha256:7", [], ""), ("c", "Red", "", "", "", [], ""), ("d", "Green", "", "", None, [], ""), ("zz/e", "Green", "", "", "", [], "")])
    live = table(s, "rel string, hash string", [("a", "sha256:1"), ("b", "sha256:2"), ("zz/e", "sha256:3")])
    d = health.seed_source_hashes(h, live)
    return d.filter("file <> 'zz/e'")


@expect("seed_source_hashes_under", "file string, outcome string, hash string", [("zz/e", "seeded", "sha256:3")])
def _(s):
    h = table(s, ROW, [("zz/e", "Green", "", "", "sha256:0", [], ""), ("zzz", "Green", "", "", "", [], "")])
    return health.seed_source_hashes(h, table(s, "rel string, hash string", [("zz/e", "sha256:3")]), True, "zz/")


@expect("find_wiki", "file string, path string", [("src/a.py", "src/a.py.wiki.md"), ("src/b.py", "docs/b.md"), ("c.md", "docs/c.md")])
def _(s):
    paths = ["src/a.py.wiki.md", "src/a.md", "docs/a.md", "docs/b.md", "wiki/b.md", "c.md", "docs/c.md"]
    return wiki.find_wikis(table(s, "rel string", [("src/a.py",), ("src/b.py",), ("c.md",), ("d.py",)]), table(s, "rel string, text string", [(p, "t") for p in paths]))


# graph replies, overlays, snapshots, scope

SMALL = [("a", "b", 3, False, False, False), ("a", "c", 4, True, False, False), ("b", "c", 5, False, True, False), ("c", "a", 6, False, False, True)]


def small(s: SparkSession) -> DataFrame:
    return table(s, EDGES, SMALL)


@expect(
    "resolution_notes",
    "file string, raw string, line long, reason string, confidence double",
    [("a", "os", 0, "external_or_bare", 0.0), ("a", "c", 4, "conditional_guard", 0.55), ("b", "c", 5, "dynamic_literal", 0.4), ("c", "a", 6, "via_barrel", 0.7)],
)
def _(s):
    d = graph.notes(small(s), table(s, "src string, raw string, reason string", [("a", "os", "external_or_bare")]))
    return d.fillna(0, ["line", "confidence"])


@expect("actionable_edges", "file string, path string, confidence double, reason string", [("a", "c", 0.55, "conditional_guard")])
def _(s):
    return graph.actionable(small(s))


@expect("edge_names", "src string, dst string, names string", [("a", "b", "x"), ("b", "a", "")])
def _(s):
    rows = [("a", "b", 1, 9, False, False, False, []), ("a", "b", 2, 1, False, False, False, ["x"]), ("a", "b", 3, 1, False, False, False, ["y"]), ("b", "a", 4, 2, False, False, False, [])]
    return graph.merge_edges(table(s, "src string, dst string, seq long, line long, conditional boolean, dynamic boolean, via_barrel boolean, names array<string>", rows))


@expect("cycle_members", "file string, n long", [("b", 2), ("a", 1), ("c", 1), ("d", 1)])
def _(s):
    return graph.cycle_members(table(s, "files array<string>", [(["a", "b"],), (["b", "c", "d"],)]))


@expect("trimmed_cycles", "files string, files_truncated boolean", [("a|b", False), ("b|c", True)])
def _(s):
    return caps.trim_files(table(s, "files array<string>", [(["a", "b"],), (["b", "c", "d"],)]), 2)


@expect("changed_names", "id long, names string", [(1, "f|g|h"), (2, "*"), (3, ""), (4, "f")])
def _(s):
    d = table(s, "id long, old array<string>, new array<string>", [(1, ["f 1", "f 2", "g 1"], ["f 1", "g 2", "h 1"]), (2, ["* x"], []), (3, ["a 1"], ["a 1"]), (4, ["f 1", "f 1"], ["f 1"])])
    return d.select("id", graph.changed_names(F.col("old"), F.col("new")).alias("names"))


@expect("index_consistency", "file string, problem string", [("b", "index_disagrees"), ("c", "not_in_index")])
def _(s):
    return overlay.index_consistency(small(s), table(s, "rel string, dsts array<string>", [("a", ["c", "b"]), ("b", []), ("x", [])]))


@expect("adopt_unchanged", "file string, status string", [("a", "Red"), ("b", "Green")])
def _(s):
    same = overlay.unchanged(table(s, "rel string, hash string", [("a", "1"), ("b", "2"), ("c", "3")]), table(s, "rel string, hash string", [("a", "1"), ("b", "2"), ("c", "9"), ("d", "4")]))
    rows = lambda *r: table(s, "file string, status string", list(r))
    return overlay.adopt_unchanged(rows(("a", "Red")), rows(("a", "Green"), ("b", "Green"), ("c", "Green")), same)


@expect("line_counts", "rel string, n_lines long", [("same", 7), ("moved", 2), ("new", 1)])
def _(s):
    kind = "rel string, size long, mtime_us long"
    stat, cache = table(s, kind, [("same", 1, 1), ("moved", 1, 2), ("new", 1, 1)]), table(s, kind + ", n_lines long", [("same", 1, 1, 7), ("moved", 1, 1, 9), ("gone", 1, 1, 9)])
    return files.line_counts(stat, cache, table(s, "rel string, text string", [("same", "not read"), ("moved", "a\nb"), ("new", "c\n")]))


@expect("git_vouched", "rel string, oid string", [("a", "01"), ("c", "03")])
def _(s):
    index = table(s, "rel string, size long, mtime_s long, mtime_ns long, oid string, racy boolean", [("a", 5, 10, 7000, "01", False), ("b", 5, 10, 7000, "02", False), ("c", 5, 10, 0, "03", False), ("d", 5, 10, 0, "04", True), ("e", 6, 10, 0, "05", False)])
    return gitindex.vouched(index, table(s, "rel string, size long, mtime_us long", [("a", 5, 10_000_007), ("b", 5, 10_000_008), ("c", 5, 10_999_999), ("d", 5, 10_000_000), ("e", 5, 10_000_000)]))


@expect("caps", "raw string, n string", [("none", "7"), ("0", "all"), ("1", "1"), ("x", "7"), ("3 ", "3"), ("-2", "7"), ("", "7")])
def _(s):
    return table(s, "raw string, n string", [(v, str(caps.cap(None if v == "none" else v, 7) or "all")) for v in ("none", "0", "1", "x", "3 ", "-2", "")])


@expect("plan_update", "rel string, state string", [("same", "skip"), ("longer", "hash"), ("later", "hash"), ("fresh", "new")])
def _(s):
    kind = "rel string, size long, mtime_us long"
    return snapshot.plan_update(table(s, kind, [("same", 1, 1), ("longer", 2, 1), ("later", 1, 2), ("fresh", 1, 1)]), table(s, kind, [("same", 1, 1), ("longer", 1, 1), ("later", 1, 1), ("gone", 1, 1)]))


@expect("in_scope", "rel string, inside boolean", [("src/a.py", True), ("src/a.txt", False), ("lib/a.py", False), ("src/node_modules/x.js", False), ("src/gen-1/x.rs", False), ("srcs/a.py", False)])
def _(s):
    sc = scope.resolve_scope([], ["src", "none"], {"src", "lib"}, ["gen-*"])
    d = table(s, "rel string", [(x,) for x in ("src/a.py", "src/a.txt", "lib/a.py", "src/node_modules/x.js", "src/gen-1/x.rs", "srcs/a.py")])
    return d.select("rel", scope.in_scope(F.col("rel"), sc).alias("inside"))


@expect("path_list", "pos long, path string", [(0, "src/app"), (1, "lib")])
def _(s):
    return table(s, "pos int, path string", list(enumerate(scope.path_list("# all\n./src/app  # main\n.\n\nlib/ more\n"))))


@expect("file_arguments", "raw string, rel string", [("/r/p/p/a.py", "p/a.py"), ("././a\\b.py", "a/b.py"), ("a.py", "a.py")])
def _(s):
    return table(s, "raw string, rel string", [(x, scope.rel_arg("/r/p", x)) for x in ("/r/p/p/a.py", "././a\\b.py", "a.py")])


@expect("ts_aliases", "pattern string, target string", [("~/*", "web/src/*"), ("s", "web/src/one")])
def _(s):
    config = {"web/tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["./*", "x/*"], "s": "one",}} }'}
    return table(s, "pattern string, target string", projects.ts_aliases(config))


@expect("cargo_crates", "name string, dir string", [("ab", "c/a")])
def _(s):
    config = {"Cargo.toml": '[workspace]\nmembers = ["c/*"]\nexclude = ["c/old*"]', "c/a/Cargo.toml": '[package]\nname = "a-b"\n[lib]\nname = "ab"', "c/old1/Cargo.toml": '[package]\nname = "o"'}
    return table(s, "name string, dir string", projects.crates(config))


@expect("reason_lines", "key string, why string", [("a.py", "b=c"), ("src/", "moved")])
def _(s):
    return table(s, "key string, why string", journal.reason_lines("# c\na.py=b=c\n\n junk \nsrc/=moved"))
