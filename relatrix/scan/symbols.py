"""Public symbols of a source text, by language."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .imports import braces
from .lexing import js_tokens, mask_python, rust_tokens

PY_ALL = re.compile(r"^__all__\s*(?::[^=\n]+)?(\+?=)\s*([\[(])", re.M)
PY_TOP = re.compile(r"^(?:async[ \t]+def|def|class)[ \t]+([A-Za-z]\w*)", re.M)


def python_symbols(text: str) -> list[str]:
    """__all__ if it is a literal (= replaces, += extends; strings at bracket depth 1), else top-level def and class."""
    clear = mask_python(text)
    names: set[str] | None = None
    for m in PY_ALL.finditer(clear):
        depth, at = 1, m.end()
        found = set()
        while at < len(text) and depth:
            if clear[at] in "[(":
                depth += 1
            elif clear[at] in "])":
                depth -= 1
            elif clear[at] == " " and text[at] in "'\"" and depth == 1:
                end = text.find(text[at], at + 1)
                if end < 0:
                    break
                found.add(text[at + 1 : end])
                at = end
            at += 1
        names = (names or set()) | found if m[1] == "+=" else found
    return sorted(names if names is not None else set(PY_TOP.findall(clear)))


JS_KINDS = {"const", "let", "var", "function", "class", "interface", "type", "enum", "namespace"}


def js_symbols(text: str) -> list[str]:
    """Exported names: after a declaration's kind, and the right-hand names of brace lists."""
    t = js_tokens(text)
    word = lambda i: t[i][1] if i < len(t) and t[i][0] == "word" else ""
    out: set[str] = set()
    for i, (kind, w) in enumerate(t):
        if kind != "word" or w != "export" or (i and t[i - 1][1] == "."):
            continue
        j = i + 1
        if j < len(t) and t[j][1] == "{":
            out |= set(braces(t, j)[0])
            continue
        while word(j) in ("default", "declare", "abstract", "async"):
            j += 1
        if word(j) in JS_KINDS:
            j += 1
            if j < len(t) and t[j][1] == "*":
                j += 1
            out.add(word(j))
    return sorted(n for n in out if n and n != "default" and not n.startswith("_"))


RUST_KINDS = {"fn", "struct", "enum", "trait", "mod", "type", "static", "const", "union"}
RUST_BEFORE = {"async", "unsafe", "extern", "default", "const"}


def rust_symbols(text: str) -> list[str]:
    """Unrestricted pub items, names bound by pub use, and pub methods of types that are public or declared elsewhere."""
    from .imports import use_tree

    t = rust_tokens(text)
    word = lambda i: t[i][1] if 0 <= i < len(t) and t[i][0] == "word" else ""
    declared = {word(i + 1): word(i - 1) == "pub" for i, (k, w) in enumerate(t) if k == "word" and w in ("struct", "enum", "trait", "union")}
    out: set[str] = set()
    depth, blocks, i = 0, [], 0  # blocks: (depth, counts) of impl bodies
    while i < len(t):
        kind, w = t[i]
        if w == "{":
            depth += 1
        elif w == "}":
            depth -= 1
            while blocks and blocks[-1][0] > depth:
                blocks.pop()
        elif kind == "word" and w == "impl" and word(i - 1) not in ("fn",) and depth == (blocks[-1][0] if blocks else 0):
            j, angle, names, of_trait = i + 1, 0, [], False
            while j < len(t) and t[j][1] not in "{;":
                angle += (t[j][1] == "<") - (t[j][1] == ">")
                if not angle and word(j) == "for":
                    names, of_trait = [], True
                elif not angle and t[j][0] == "word" and word(j) != "where":
                    names.append(word(j))
                elif word(j) == "where":
                    break
                j += 1
            while j < len(t) and t[j][1] not in "{;":
                j += 1
            if j < len(t) and t[j][1] == "{":
                depth += 1
                kind_name = names[-1] if names else ""
                blocks.append((depth, declared.get(kind_name, True), of_trait))
            i = j + 1
            continue
        in_impl = bool(blocks) and blocks[-1][0] == depth
        open_here = depth == 0 or (in_impl and blocks[-1][1])
        if kind == "word" and open_here:
            if w == "pub" and not (i + 1 < len(t) and t[i + 1][1] == "("):
                j = i + 1
                if word(j) == "use" and depth == 0:
                    got, i = use_tree(t, j + 1)
                    out |= {n for _, n in got if n not in ("*", "_")}
                    continue
                while word(j) in RUST_BEFORE and word(j + 1) in RUST_KINDS | RUST_BEFORE:
                    j += 1
                if word(j) in RUST_KINDS:
                    out.add(word(j + 1) if word(j + 1) != "mut" else word(j + 2))
            elif in_impl and blocks[-1][2] and w in ("fn", "type", "const") and word(i - 1) != "pub":
                out.add(word(i + 1))
        i += 1
    return sorted(n for n in out if n)


ITEM_WORDS = {"fn", "struct", "enum", "union", "trait", "type", "static"}


def rust_exports(text: str) -> list[tuple[str, str, str | None, bool]]:
    """(kind, name, path, public) of a file's own top level, in order: `def` of items, `use` of each name that a use
    item binds, `glob` of its globs. Modules are found by their path and so are not listed."""
    from .imports import use_tree

    t = rust_tokens(text)
    word = lambda i: t[i][1] if i < len(t) and t[i][0] == "word" else ""
    out: list[tuple[str, str, str | None, bool]] = []
    depth = i = 0
    while i < len(t):
        kind, w = t[i]
        if kind == "op":
            depth += (w in "{([") - (w in "})]")
        elif depth == 0:
            at, public = i, w == "pub"
            if public:
                at += 1
                if at < len(t) and t[at][1] == "(":
                    while at < len(t) and t[at][1] != ")":
                        at += 1
                    at += 1
            if word(at) == "use":
                got, i = use_tree(t, at + 1)
                out += [("glob", "", "::".join(p), public) if n == "*" else ("use", n, "::".join(p), public) for p, n in got if p and n != "_"]
                continue
            while word(at) in ("async", "unsafe") or (word(at) == "extern" and word(at + 1) == "fn") or (word(at) == "const" and word(at + 1) in ("fn", "unsafe", "async", "extern")):
                at += 1
            if word(at) == "const" or word(at) in ITEM_WORDS:
                at += 2 if word(at) == "static" and word(at + 1) == "mut" else 1
                if word(at) not in ("", "_"):
                    out.append(("def", word(at), None, public))
                    i = at
        i += 1
    return out


def bare_names(text: str) -> list[str]:
    """Identifiers that stand on their own: not after a dot or a path separator."""
    t = rust_tokens(text)
    return sorted({w for i, (kind, w) in enumerate(t) if kind == "word" and not (i and t[i - 1][1] in (".", "::"))})


def _exports(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "name": n, "path": p, "public": b} for k, n, p, b in rust_exports(t or "")] for t in text])


def exports_column(text: Column) -> Column:
    """rust_exports() as an array of structs."""
    return F.pandas_udf(_exports, "array<struct<kind:string,name:string,path:string,public:boolean>>")(text)


def _bare(text: pd.Series) -> pd.Series:
    return pd.Series([bare_names(t or "") for t in text])


def bare_column(text: Column) -> Column:
    return F.pandas_udf(_bare, "array<string>")(text)


EXTRACTORS = {"py": python_symbols, "pyi": python_symbols, **dict.fromkeys(("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"), js_symbols), "rs": rust_symbols}


def _symbols(rel: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([f(x or "") if (f := EXTRACTORS.get(r.rpartition(".")[2].lower())) else None for r, x in zip(rel, text)])


def symbols_column(rel: Column, text: Column) -> Column:
    """array of names; null where the language has no extractor."""
    return F.pandas_udf(_symbols, "array<string>")(rel, text)
