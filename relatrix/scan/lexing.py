"""Shared lexing: texts with comments and strings blanked, and token lists."""

from __future__ import annotations

import re

PY_TEXT = re.compile(
    r"#[^\n]*|[rRfFbBuU]{0,2}(?P<q>\"\"\"|'''|\"|')(?P<body>(?:\\.|(?!(?P=q))[^\\])*)(?:(?P=q)|\Z)",
    re.S,
)
C_TEXT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask_python(text: str) -> str:
    """Comments and strings as blanks, line feeds kept. A quote inside a word is a string's start only with a prefix."""
    return PY_TEXT.sub(lambda m: blank(m[0]), text)


def strip_c_comments(text: str) -> str:
    """Without // and /* */ outside quotes; line feeds stay."""
    return C_TEXT.sub(lambda m: blank(m[0]) if m[0][0] == "/" else m[0], text)


Token = tuple[str, str]
JS_PART = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<word>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<op>.)", re.S)
JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^\n")


def js_tokens(text: str) -> list[Token]:
    """(kind, text): word, num, str (without quotes), op. The code inside template holes is part of the list."""
    out: list[Token] = []
    at, holes, depth = 0, [], 0

    def template(i: int) -> int:
        """From inside a template on: the place after its end or after a hole's opening."""
        nonlocal depth
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                holes.append(depth)
                depth = 0
                return i + 2
            else:
                i += 1
        return i

    while at < len(text):
        c = text[at]
        if c == "`":
            at = template(at + 1)
            continue
        if c == "/" and (not out or out[-1][0] == "op" and out[-1][1] in BEFORE_REGEX) and (m := JS_REGEX.match(text, at)):
            out.append(("num", m[0]))
            at = m.end()
            continue
        m = JS_PART.match(text, at)
        at = m.end()
        if m["str"]:
            out.append(("str", m["str"][1:-1]))
        elif kind := m.lastgroup:
            if kind == "op":
                if c == "{":
                    depth += 1
                elif c == "}":
                    if holes and depth == 0:
                        depth = holes.pop()
                        at = template(at)
                        continue
                    depth -= 1
            out.append((kind, m[0]))
    return out


RUST_PART = re.compile(
    r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<str>[bc]?r(?P<h>#*)\".*?\"(?P=h)|[bc]?\"(?:\\.|[^\"\\])*\")|(?P<chr>b?'(?:\\[^']+|[^'\\])')|(?P<life>'\w+)"
    r"|(?P<word>(?:r#)?[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<op>::|=>|->|.)",
    re.S,
)


def rust_tokens(text: str) -> list[Token]:
    """word and op tokens; comments, strings, characters and lifetimes are dropped."""
    return [(k, m[0].removeprefix("r#")) for m in RUST_PART.finditer(text) if (k := m.lastgroup) in ("word", "op")]
