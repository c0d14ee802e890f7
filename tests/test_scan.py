"""Scanners, symbol extractors and resolvers on small source trees."""

from relatrix.operators.resolve import build_edges
from relatrix.scan import imports as I
from relatrix.scan import symbols as S


def refs(f, text):
    return [(r.spec, r.names, r.kind, r.conditional) for r in f(text)]


def test_python_forms():
    text = '''import os, app.core as c
from . import (a,
    b as c)
from ..x.y import z  # import no
"""import hidden"""
s = "from q import w"
if True:
    import late
from __future__ import annotations
import_module("plug.one")
'''
    got = refs(I.scan_python, text)
    assert ("os", (), "Import", False) in got and ("app.core", (), "Import", False) in got
    assert (".", ("a", "b"), "Import", False) in got and ("..x.y", ("z",), "Import", False) in got
    assert ("late", (), "Import", True) in got and ("plug.one", (), "Dynamic", False) in got
    assert len(got) == 6


def test_js_forms():
    text = """// import 'no'
import './side'; import D, {a, b as c} from "./m"; import * as N from './n';
const r = /import 'x'/; const t = `import 'y' ${require('./in')} `;
export * from './star'; export {p as q, r} from './from'; export {local}; export const k = 1;
export async function go() {} const m = import('./dyn'); x.import('no')
"""
    got = refs(I.scan_js, text)
    assert got == [
        ("./side", (), "Import", False),
        ("./m", ("a", "c"), "Import", False),
        ("./n", (), "Import", False),
        ("./in", (), "Dynamic", False),
        ("./star", (), "ExportStar", False),
        ("./from", ("q", "r"), "ExportFrom", False),
        ("./dyn", (), "Dynamic", False),
    ]
    assert I.exported(text) == ["local", "k", "go"]


def test_rust_forms():
    text = """mod a; mod inner { use super::x::Y; mod deep; }
use crate::{b::{self, C as D}, e::*}; // use no::no;
/* mod z; */ fn f<'a>(s: &'a str) { let c = 'x'; helper::run(); Type::new(); let r = r#"use q::w;"#; }
"""
    got = [(r.spec, r.names, r.kind, r.inline_depth) for r in I.scan_rust(text)]
    assert ("mod:a", (), "Import", 0) in got and ("mod:inner::deep", (), "Import", 1) in got
    assert ("super::x::Y", ("Y",), "Import", 1) in got
    assert ("crate::b", ("b",), "Import", 0) in got and ("crate::b::C", ("D",), "Import", 0) in got
    assert ("crate::e::*", (), "Import", 0) in got and ("helper::run", (), "PathExpr", 0) in got
    assert len(got) == 7


def test_other_languages():
    assert [r.spec for r in I.scan_go('import (\n "fmt"\n m "x/y" // "no"\n)\nimport "z"')] == ["fmt", "x/y", "z"]
    assert [r.spec for r in I.scan_c('#include "a.h"\n// #include "no.h"\n# include <b.h>\n')] == ["a.h", "b.h"]
    assert [r.spec for r in I.scan_java("import a.B;\nimport static c.D.e;\n/* import no.X; */ import f.*;")] == ["a.B", "c.D.e", "f.*"]
    assert [r.spec for r in I.scan_csharp("using A.B;\nusing static C.D;\nusing X = Y.Z;\nusing (var q = 1) {}")] == ["A.B"]


def test_symbols():
    assert S.python_symbols("def a(): pass\nclass _B: pass\nasync def c(): pass\n  def no(): pass\n") == ["a", "c"]
    assert S.python_symbols("__all__ = ['x', ('no',)]\n__all__ += [\"y\"]\ndef z(): pass") == ["x", "y"]
    assert S.js_symbols("export default function f() {}\nexport {a as b, _c};\nexport const d = 1; const e = 2") == ["b", "d", "f"]
    rust = "pub struct A; struct B; impl A { pub fn m(&self) {} fn n(&self) {} } impl B { pub fn h() {} } pub(crate) fn r() {} pub use x::{Y, Z as W}; pub async fn go() {}"
    assert S.rust_symbols(rust) == ["A", "W", "Y", "go", "m"]


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "rel string, text string")


def edge_set(spark, files, **kw):
    f = tree(spark, files)
    edges, left = build_edges(f, I.scan(f), **kw)
    return {(r.src, r.dst) for r in edges.collect()}, edges, left


def test_python_app(spark):
    got, edges, left = edge_set(
        spark,
        {
            "main.py": "from app import core\nimport app.util\nimport requests\n",
            "app/__init__.py": "",
            "app/core.py": "from . import util\nfrom .sub.leaf import leaf\n",
            "app/util.py": "if 1:\n    from app import core\n",
            "app/sub/__init__.py": "from ..core import x\n",
            "app/sub/leaf.py": "import importlib\nimportlib.import_module('app.util')\n",
        },
    )
    assert got == {
        ("main.py", "app/core.py"), ("main.py", "app/util.py"), ("app/core.py", "app/util.py"), ("app/core.py", "app/sub/leaf.py"),
        ("app/util.py", "app/core.py"), ("app/sub/__init__.py", "app/core.py"), ("app/sub/leaf.py", "app/util.py"),
    }
    flags = {(r.src, r.dst): (r.conditional, r.dynamic, r.line) for r in edges.collect()}
    assert flags["app/util.py", "app/core.py"] == (True, False, 2)
    assert flags["app/sub/leaf.py", "app/util.py"] == (False, True, 2)
    assert {(r.src, r.raw) for r in left.collect()} == {("main.py", "requests"), ("app/sub/leaf.py", "importlib")}


def test_js_monorepo(spark):
    files = {
        "packages/a/src/index.ts": "export * from './impl'; export {two} from './two';",
        "packages/a/src/impl.ts": "export const one = 1;",
        "packages/a/src/two.ts": "export const two = 2;",
        "packages/b/src/use.ts": "import {one} from '@x/a'; import {lib} from '~/lib'; import('./lazy'); import 'left-pad'; import './gone';",
        "packages/b/src/lib.ts": "export const lib = 1;",
        "packages/b/src/lazy/index.ts": "",
    }
    f = tree(spark, files)
    aliases = spark.createDataFrame([("~/*", "packages/b/src/*")], "pattern string, target string")
    packages = spark.createDataFrame([("@x/a", "packages/a", None, {".": "src/index.ts"})], "name string, dir string, main string, exports map<string,string>")
    exports = spark.createDataFrame([(r, n) for r, t in files.items() for n in I.exported(t)], "rel string, name string")
    got, edges, left = edge_set(spark, files, aliases=aliases, packages=packages, exports=exports)
    a, b = "packages/a/src/", "packages/b/src/"
    assert got == {
        (a + "index.ts", a + "impl.ts"), (a + "index.ts", a + "two.ts"), (b + "use.ts", a + "index.ts"), (b + "use.ts", a + "impl.ts"),
        (b + "use.ts", b + "lib.ts"), (b + "use.ts", b + "lazy/index.ts"),
    }
    assert {r.dst for r in edges.filter("via_barrel").collect()} == {a + "impl.ts"}
    assert {(r.raw, r.reason) for r in left.collect()} == {("left-pad", "external_or_bare"), ("./gone", "unresolved_relative")}


def test_rust_crate(spark):
    got, _, _ = edge_set(
        spark,
        {
            "src/lib.rs": "mod a; mod b;",
            "src/a.rs": "use crate::b::Thing; use super::b::c::deep;",
            "src/b/mod.rs": "pub mod c; use std::fmt;",
            "src/b/c.rs": "use self::gone::X; use super::Thing;",
            "tests/t.rs": "use my_crate::a::go;",
        },
        crates=spark.createDataFrame([("my-crate", "")], "name string, dir string"),
    )
    assert got == {
        ("src/lib.rs", "src/a.rs"), ("src/lib.rs", "src/b/mod.rs"), ("src/a.rs", "src/b/mod.rs"), ("src/a.rs", "src/b/c.rs"),
        ("src/b/mod.rs", "src/b/c.rs"), ("src/b/c.rs", "src/b/mod.rs"), ("tests/t.rs", "src/a.rs"),
    }


OVEN = "pub struct Bread; impl Bread { pub fn bake() {} }"
#: case -> (files of a crate named like the case, the importer's text, what it depends on: file -> through a re-export).
REEXPORTS = {
    "named": ({"lib": "mod oven; pub use oven::Bread;", "oven": OVEN}, "use named::Bread;", {"lib": False, "oven": True}),
    "alias": ({"lib": "mod oven; pub use oven::{Crumb, Bread as Loaf};", "oven": OVEN}, "use alias::Loaf;", {"lib": False, "oven": True}),
    "nested": ({"lib": "mod a; pub use a::Bun;", "a": "mod b; pub use b::*;", "a/b": "pub enum Bun {}"}, "use nested::Bun;", {"lib": False, "a/b": True}),
    "direct": ({"lib": "pub mod oven; pub use oven::Bread;", "oven": OVEN}, "use direct::oven::Bread;", {"oven": False}),
    "opened": (
        {"lib": "mod oven; mod tray; pub use oven::Bread; pub use tray::*;", "oven": OVEN, "tray": "pub struct Tray; pub fn fill() -> Tray { Tray } fn scrub() {}"},
        "use opened::*; fn main() { let t: Tray = fill(); Bread; }", {"lib": False, "oven": True, "tray": True},
    ),
    "unused": ({"lib": "mod tray; pub use tray::*;", "tray": "pub fn fill() {} fn scrub() {}"}, "use unused::*; fn scrub() {} fn main() { scrub(); jar.fill; }", {"lib": False}),
    "past": ({"lib": "mod oven; pub use oven::Bread;", "oven": OVEN}, "fn main() { past::Bread::bake(); past::gone::x(); }", {"oven": True}),
    "shut": ({"lib": "mod oven; use oven::Bread;", "oven": OVEN}, "use shut::Bread;", {"lib": False}),
    "made": ({"lib": "mod mold; pub use mold::Cast;", "mold": "cast!(Cast);"}, "use made::Cast;", {"lib": False, "mold": True}),
    "moved": ({"lib": "#[path = \"x/y.rs\"] mod oven; pub use oven::Bread;", "x/y": OVEN}, "use moved::Bread;", {"lib": False}),
    "twice": ({"lib": "mod hot; mod iced; #[cfg(a)] pub use hot::Pie; #[cfg(b)] pub use iced::Pie;", "hot": "pub struct Pie;", "iced": "pub struct Pie;"}, "use twice::Pie;", {"lib": False, "hot": True}),
    "inline": ({"lib": "mod oven; pub mod menu { pub use crate::oven::Bread; }", "oven": OVEN}, "use inline::menu::Bread;", {}),
    "foreign": ({"lib": "pub use std::rc::Rc;"}, "use foreign::Rc;", {"lib": False}),
}


def test_rust_reexports(spark):
    files = {f"{case}/src/{k}.rs": t for case, (own, _, _) in REEXPORTS.items() for k, t in own.items()} | {f"{case}_user/src/main.rs": t for case, (_, t, _) in REEXPORTS.items()}
    files |= {"home/src/lib.rs": "mod oven; mod cook; pub(crate) use oven::Bread; use oven::Flour;", "home/src/oven.rs": "pub(crate) struct Bread; pub struct Flour;", "home/src/cook.rs": "use crate::Bread; use crate::Flour;"}
    crates = spark.createDataFrame([(case, case) for case in (*REEXPORTS, "home")], "name string, dir string")
    got = {}
    for r in edge_set(spark, files, crates=crates)[1].collect():
        got.setdefault(r.src, {})[r.dst] = r.via_barrel
    for case, (_, _, want) in REEXPORTS.items():
        assert got.get(f"{case}_user/src/main.rs", {}) == {f"{case}/src/{k}.rs": v for k, v in want.items()}, case
    assert got["home/src/cook.rs"] == {"home/src/lib.rs": False, "home/src/oven.rs": True}  # inside a crate nothing is private


def test_rust_walks_end_after_four_steps(spark):
    """Boxes in boxes, each passing on what the next one holds: the toy is in the fourth, the note in the sixth."""
    boxes = ["oak", "pine", "ash", "elm", "fir", "yew"]
    files = {"src/lib.rs": "mod oak; pub use oak::{Toy, Note};", "tests/toy.rs": "use boxes::Toy;", "tests/note.rs": "use boxes::Note;"}
    for i, box in enumerate(boxes):
        held = {3: "pub struct Toy;", 5: "pub struct Note;"}.get(i, "")
        passed = [n for n, at in (("Toy", 3), ("Note", 5)) if i < at]
        inner = f"mod {boxes[i + 1]}; " + " ".join(f"pub use {boxes[i + 1]}::{n};" for n in passed) if passed else ""
        files[f"src/{'/'.join(boxes[: i + 1])}.rs"] = f"{inner} {held}"
    edges = edge_set(spark, files, crates=spark.createDataFrame([("boxes", "")], "name string, dir string"))[1]
    got = {(r.src, r.dst): r.via_barrel for r in edges.filter("src LIKE 'tests/%'").collect()}
    assert got == {("tests/toy.rs", "src/lib.rs"): False, ("tests/toy.rs", "src/oak/pine/ash/elm.rs"): True, ("tests/note.rs", "src/lib.rs"): False}


def test_rust_modules_that_globs_bring_in(spark):
    files = {"src/lib.rs": "mod view; mod eye; mod hand;", "src/view.rs": "pub const WIDE: u8 = 1;", "src/eye.rs": "use super::*; fn f() { view::open(); gone::x(); }", "src/hand.rs": "use crate::eye::*; fn g() { view::shut(); }"}
    assert {("src/eye.rs", "src/view.rs"), ("src/hand.rs", "src/view.rs")} <= edge_set(spark, files)[0]


def test_rust_exports():
    text = "pub use a::{b, self, c as d, e::*}; use f::g as _; pub(crate) const fn h() {} const _: u8 = 0; static mut K: u8 = 1; mod m { pub fn no() {} } extern crate x; pub unsafe extern \"C\" fn l() {}"
    assert S.rust_exports(text) == [("use", "b", "a::b", True), ("use", "a", "a", True), ("use", "d", "a::c", True), ("glob", "", "a::e", True), ("def", "h", None, True), ("def", "K", None, False), ("def", "l", None, True)]
    assert S.bare_names("fn f() { a.b(c::d, 1.5e3, \"q\", 'x'); } // z") == ["a", "c", "f", "fn"]


def test_one_pair_per_language(spark):
    got, _, _ = edge_set(
        spark,
        {
            "g/main.go": 'import "x/util"', "g/util.go": "", "c/a.c": '#include "b.h"', "c/b.h": "", "j/A.java": "import p.B;", "j/B.java": "",
            "s/A.cs": "using N.B;", "s/B.cs": "", "x/readme.md": "import y",
        },
    )
    assert got == {("g/main.go", "g/util.go"), ("c/a.c", "c/b.h"), ("j/A.java", "j/B.java"), ("s/A.cs", "s/B.cs")}


def test_traps_give_no_edges(spark):
    got, _, _ = edge_set(spark, {"a.py": '"""\nimport b\n"""\n# import b\ns = \'import b\'\n', "b.py": "", "c.js": "// import './d'\nconst r = /from '.\\/d'/", "d.js": ""})
    assert got == set()


def test_failing_scanner_is_a_warning(spark):
    f = tree(spark, {"a.py": "x", "b.py": "import a"})

    def broken(text):
        if text == "x":
            raise ValueError("no")
        return I.scan_python(text)

    rows = {r.src: (r.spec, r.warning) for r in I.scan(f, {"python": broken}).collect()}
    assert rows == {"a.py": (None, "ValueError: no"), "b.py": ("a", None)}
