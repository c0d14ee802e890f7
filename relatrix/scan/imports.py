"""Import scanners: one text -> reference rows, by language. A registry lets users add a language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .lexing import js_tokens, mask_python, rust_tokens, strip_c_comments


class Ref(NamedTuple):
    spec: str
    names: tuple[str, ...] = ()
    kind: str = "Import"  # Import, ExportFrom, ExportStar, Dynamic, PathExpr
    conditional: bool = False
    inline_depth: int = 0


#: Suffixes by language.
SUFFIXES = {
    "python": ("py",),
    "javascript": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"),
    "rust": ("rs",),
    "go": ("go",),
    "c": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh"),
    "csharp": ("cs",),
    "java": ("java",),
}


def language_column(rel: Column) -> Column:
    suffix = F.lower(F.regexp_extract(rel, r"\.([A-Za-z]+)$", 1))
    out = F.when(F.lit(False), "")
    for name, ends in SUFFIXES.items():
        out = out.when(suffix.isin(*ends), name)
    return out.otherwise("none")


PY_DYNAMIC = re.compile(r"\b(?:import_module|__import__)\(\s*[rRuUbB]?(['\"])([A-Za-z0-9_.]+)\1")
PY_STATEMENT = re.compile(r"^([ \t]*)(import|from)[ \t]+", re.M)


def scan_python(text: str) -> list[Ref]:
    """import and from statements, parenthesised ones joined; an indented one is conditional; __future__ is dropped;
    the literal of import_module(..) or __import__(..) is dynamic."""
    clear = mask_python(text)
    found: list[tuple[int, Ref]] = []
    for m in PY_STATEMENT.finditer(clear):
        at, depth = m.end(), 0
        while at < len(clear) and (depth or clear[at] not in "\n;"):
            depth += (clear[at] == "(") - (clear[at] == ")")
            at += 1
        body, inside = clear[m.end() : at], bool(m[1])
        name = lambda p: p.strip().split()[0] if p.strip() else ""
        if m[2] == "import":
            found += [(m.start(), Ref(n, conditional=inside)) for p in body.split(",") if (n := name(p)) and n != "__future__"]
        elif parts := re.match(r"(\.*[ \t]*[\w.]*)\s+import\b(.*)", body, re.S):
            spec = re.sub(r"\s", "", parts[1])
            names = tuple(n for p in parts[2].replace("(", " ").replace(")", " ").split(",") if (n := name(p)))
            if spec and spec != "__future__":
                found.append((m.start(), Ref(spec, names, conditional=inside)))
    for m in PY_DYNAMIC.finditer(text):
        if clear[m.start()] != " ":
            found.append((m.start(), Ref(m[2], kind="Dynamic")))
    return [r for _, r in sorted(found, key=lambda x: x[0])]


def braces(tokens: list, at: int) -> tuple[tuple[str, ...], int]:
    """Names of a brace list that opens at `at`, the right-hand side of `as`; and the place after it."""
    names, last = [], ""
    at += 1
    while at < len(tokens) and tokens[at][1] != "}":
        kind, text = tokens[at]
        if kind == "word" and text not in ("as", "type"):
            last = text
        elif text == "," and last:
            names.append(last)
            last = ""
        at += 1
    if last:
        names.append(last)
    return tuple(names), at + 1


DECLARES = {"const", "let", "var", "function", "class", "interface", "type", "enum"}


def read_js(text: str) -> tuple[list[Ref], list[str]]:
    """References and the local names a module exports."""
    t = js_tokens(text)
    word = lambda i: t[i][1] if 0 <= i < len(t) and t[i][0] == "word" else ""
    op = lambda i: t[i][1] if 0 <= i < len(t) and t[i][0] == "op" else ""
    lit = lambda i: t[i][1] if 0 <= i < len(t) and t[i][0] == "str" else None
    refs, local = [], []
    for i, (kind, w) in enumerate(t):
        if kind != "word" or op(i - 1) == ".":
            continue
        if w in ("import", "require") and op(i + 1) == "(":
            if (s := lit(i + 2)) is not None:
                refs.append(Ref(s, kind="Dynamic"))
        elif w == "import":
            if (s := lit(i + 1)) is not None:
                refs.append(Ref(s))
                continue
            names: list[str] = []
            j = i + 1
            while j < len(t) and word(j) != "from" and op(j) not in (";", "=", "("):
                if op(j) == "{":
                    got, j = braces(t, j)
                    names += got
                else:
                    j += 1
            if word(j) == "from" and (s := lit(j + 1)) is not None:
                refs.append(Ref(s, tuple(names)))
        elif w == "export":
            j = i + 1 + (word(i + 1) == "type" and op(i + 2) in ("{", "*"))
            if op(j) == "*":
                k = j + 1 if word(j + 1) != "as" else j + 3
                if word(k) == "from" and (s := lit(k + 1)) is not None:
                    refs.append(Ref(s, kind="ExportStar"))
            elif op(j) == "{":
                got, k = braces(t, j)
                if word(k) == "from" and (s := lit(k + 1)) is not None:
                    refs.append(Ref(s, got, "ExportFrom"))
                else:
                    local += got[:1]
            else:
                while word(j) in ("default", "async", "declare", "abstract"):
                    j += 1
                if word(j) in DECLARES:
                    j += 1 + (op(j + 1) == "*")
                    if word(j):
                        local.append(word(j))
    return refs, local


def scan_js(text: str) -> list[Ref]:
    return read_js(text)[0]


def use_tree(t: list, at: int) -> tuple[list[tuple[list[str], str]], int]:
    """Flattened (path, bound name) of the use tree at `at`; a glob's bound name is `*`."""
    path: list[str] = []
    while at < len(t):
        kind, text = t[at]
        if kind == "word" and text == "as":
            return [(path, t[at + 1][1] if at + 1 < len(t) else "_")], at + 2
        if kind == "word":
            path.append(text)
        elif text == "*":
            return [(path, "*")], at + 1
        elif text == "{":
            out, at = [], at + 1
            while at < len(t) and t[at][1] != "}":
                if t[at][1] == ",":
                    at += 1
                    continue
                got, at = use_tree(t, at)
                out += [(path + p, n) for p, n in got]
            return [(p[:-1], (p[-2] if n == "self" and len(p) > 1 else n)) if p and p[-1] == "self" and len(p) > 1 else (p, n) for p, n in out], at + 1
        elif text != "::":
            break
        at += 1
    return ([(path, path[-1])] if path else []), at


def scan_rust(text: str) -> list[Ref]:
    """mod items, use trees and path expressions with a lower-case head. `spec` of a module is mod: and the inline
    modules around it; a reference is listed once for each inline depth and kind."""
    t = rust_tokens(text)
    frames: list[tuple[str, int]] = []
    depth, i, out = 0, 0, []
    while i < len(t):
        kind, w = t[i]
        after = t[i + 1] if i + 1 < len(t) else ("", "")
        if w == "{":
            depth += 1
        elif w == "}":
            depth -= 1
            while frames and frames[-1][1] > depth:
                frames.pop()
        elif w == "mod" and kind == "word" and after[0] == "word":
            ends = t[i + 2][1] if i + 2 < len(t) else ""
            if ends == ";":
                out.append(Ref("mod:" + "::".join([*[f for f, _ in frames], after[1]]), inline_depth=len(frames)))
            elif ends == "{":
                depth += 1
                frames.append((after[1], depth))
            i += 2
        elif w == "use" and kind == "word" and (after[0] == "word" or after[1] in ("::", "{")):
            got, i = use_tree(t, i + 1)
            for path, name in got:
                if path:
                    glob = name == "*"
                    out.append(Ref("::".join(path) + ("::*" if glob else ""), () if glob else (name,), inline_depth=len(frames)))
            continue
        elif kind == "word" and after[1] == "::" and (w[0].islower() or w[0] == "_") and (i == 0 or t[i - 1][1] != "::"):
            path = [w]
            while i + 2 < len(t) and t[i + 1][1] == "::" and t[i + 2][0] == "word":
                path.append(t[i + 2][1])
                i += 2
            if len(path) > 1:
                out.append(Ref("::".join(path), kind="PathExpr", inline_depth=len(frames)))
        i += 1
    return list({(r.inline_depth, r.kind, r.spec): r for r in reversed(out)}.values())[::-1]


def scan_go(text: str) -> list[Ref]:
    """Single imports and import blocks; an alias is ignored."""
    clear = strip_c_comments(text)
    out = []
    for m in re.finditer(r"^\s*import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", clear, re.M):
        out += [Ref(s) for s in (re.findall(r"\"([^\"]+)\"", m[1]) if m[1] is not None else [m[2]])]
    return out


def scan_c(text: str) -> list[Ref]:
    return [Ref(a or b) for a, b in re.findall(r"^[ \t]*#[ \t]*include[ \t]*(?:\"([^\"\n]+)\"|<([^>\n]+)>)", strip_c_comments(text), re.M)]


def scan_java(text: str) -> list[Ref]:
    return [Ref(s) for s in re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", strip_c_comments(text), re.M)]


def scan_csharp(text: str) -> list[Ref]:
    """using directives, but static ones, aliases and using statements."""
    return [Ref(s) for s in re.findall(r"^\s*using\s+(?!static\b)([A-Za-z_][\w.]*)\s*;", strip_c_comments(text), re.M)]


SCANNERS: dict[str, Callable[[str], list[Ref]]] = {
    "python": scan_python, "javascript": scan_js, "rust": scan_rust, "go": scan_go, "c": scan_c, "java": scan_java, "csharp": scan_csharp,
}
IMPORTS = "src string, seq int, spec string, names array<string>, kind string, conditional boolean, inline_depth int, line long, warning string"


def first_line(text: str, ref: Ref) -> int:
    """The line of the first of the reference's names, its spec or the spec's last part; 1 if none is in the text."""
    spec = ref.spec.removeprefix("mod:")
    at = min((i for n in (*ref.names, spec, spec.rpartition("::")[2]) if n and (i := text.find(n)) >= 0), default=0)
    return text.count("\n", 0, at) + 1


def scan(files: DataFrame, scanners: dict[str, Callable[[str], list[Ref]]] | None = None) -> DataFrame:
    """(rel, text) -> imports, each with its line. A scanner that fails gives one row with the warning and no spec, and other files go on."""
    prepare(files.sparkSession)
    table = scanners or SCANNERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel, text, lang in zip(b["rel"], b["text"], b["language"]):
                try:
                    found = enumerate(table[lang](text or ""))
                    rows += [(rel, n, r.spec, list(r.names), r.kind, r.conditional, r.inline_depth, first_line(text or "", r), None) for n, r in found]
                except Exception as e:  # one bad file must not end the run
                    rows.append((rel, 0, None, [], None, False, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["src", "seq", "spec", "names", "kind", "conditional", "inline_depth", "line", "warning"])

    d = files.select("rel", "text", language_column(F.col("rel")).alias("language")).filter(F.col("language").isin(*table))
    return d.mapInPandas(run, IMPORTS)


def exported(text: str) -> list[str]:
    """Local names that a JavaScript module exports."""
    return read_js(text)[1]


def _exported(text: pd.Series) -> pd.Series:
    return text.map(exported)


def exported_column(text: Column) -> Column:
    return F.pandas_udf(_exported, "array<string>")(text)


__all__ = ["SCANNERS", "SUFFIXES", "Ref", "exported", "exported_column", "language_column", "scan"]
