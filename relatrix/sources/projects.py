"""Project configuration files: path aliases, workspace packages, crates. Read once on the driver; a few rows each."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import glob_regex
from ..scan.lexing import C_TEXT, blank


def strip_json_comments(text: str) -> str:
    """JSON with // and /* */ comments and trailing commas as plain JSON; quoted text is left alone."""
    clear = C_TEXT.sub(lambda m: blank(m[0]) if m[0][0] == "/" else m[0], text)
    return re.sub(r",(\s*[}\]])", r"\1", clear)


def ts_aliases(configs: dict[str, str]) -> list[tuple[str, str]]:
    """{path of a tsconfig: text} -> (pattern, target): the first replacement of each pattern, from its base folder."""
    out = []
    for path, text in sorted(configs.items()):
        options = json.loads(strip_json_comments(text)).get("compilerOptions", {})
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), options.get("baseUrl", ".")))
        for pattern, targets in options.get("paths", {}).items():
            targets = [targets] if isinstance(targets, str) else targets
            if targets:
                out.append((pattern, posixpath.normpath(posixpath.join(base, targets[0])).removeprefix("./")))
    return out


def _flat(exports, key: str = ".") -> dict[str, str]:
    """An exports field as {subpath: file}; of conditions the first that leads to a file counts."""
    if isinstance(exports, str):
        return {key: exports}
    if not isinstance(exports, dict):
        return {}
    if any(k.startswith(".") for k in exports):
        out: dict[str, str] = {}
        for k, v in exports.items():
            out |= _flat(v, k)
        return out
    for v in exports.values():
        if got := _flat(v, key):
            return got
    return {}


def packages(manifests: dict[str, str]) -> list[tuple[str, str, str | None, dict[str, str]]]:
    """{path of a package.json: text} -> (name, dir, main, exports)."""
    out = []
    for path, text in sorted(manifests.items()):
        d = json.loads(text)
        if d.get("name"):
            clean = {k: v.removeprefix("./") for k, v in _flat(d.get("exports", {})).items()}
            main = d.get("main") or d.get("module")
            out.append((d["name"], posixpath.dirname(path), main and main.removeprefix("./"), clean))
    return out


def crates(manifests: dict[str, str]) -> list[tuple[str, str]]:
    """{path of a Cargo.toml: text} -> (name, dir): library names win over package names; workspace excludes drop out.
    In workspace globs `*` stays inside a folder."""
    parsed = {posixpath.dirname(p): tomllib.loads(t) for p, t in manifests.items()}
    gone = []
    for at, d in parsed.items():
        gone += [glob_regex(posixpath.join(at, x), star_crosses=False) for x in d.get("workspace", {}).get("exclude", [])]
    out = []
    for at, d in sorted(parsed.items()):
        name = d.get("lib", {}).get("name") or d.get("package", {}).get("name")
        if name and not any(re.match(g, at) for g in gone):
            out.append((name.replace("_", "-"), at))
    return out


def tables(spark: SparkSession, tsconfigs: dict[str, str], package_files: dict[str, str], cargo_files: dict[str, str]) -> dict[str, DataFrame | None]:
    """Arguments for the resolvers."""
    a, p, c = ts_aliases(tsconfigs), packages(package_files), crates(cargo_files)
    return {
        "aliases": spark.createDataFrame(a, "pattern string, target string") if a else None,
        "packages": spark.createDataFrame(p, "name string, dir string, main string, exports map<string,string>") if p else None,
        "crates": spark.createDataFrame(c, "name string, dir string") if c else None,
    }
