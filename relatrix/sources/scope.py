"""Scope: which source files belong to a project, and the file source itself."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, glob_regex, physical_lines, under_prefix
from ..scan.imports import SUFFIXES
from ..session import prepare
from .control import Files

#: Contents of an Arrow batch and of a partition, about.
READ_BYTES, PART_BYTES = 8 << 20, 64 << 20
#: Directory names that are never walked.
EXCLUDED = (
    ".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "target",
    ".idea", ".vscode", ".tox",
)


@dataclass
class Scope:
    prefixes: list[str] = field(default_factory=list)
    missing_dirs: list[str] = field(default_factory=list)
    full_tree: bool = True
    container: bool = False
    excludes: tuple[str, ...] = EXCLUDED
    children: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.container and not self.missing_dirs


def path_list(text: str) -> list[str]:
    """First token of each line, `#` comments and a bare `.` dropped."""
    out = []
    for line in text.splitlines():
        token = line.split("#")[0].split()
        if token and (p := token[0].replace("\\", "/").removeprefix("./").strip("/")) not in ("", "."):
            out.append(p)
    return out


def resolve_scope(map_paths: list[str], monitored: list[str], present: set[str], excludes: list[str] = (), child_projects: int = 0) -> Scope:
    """Map roots, else monitored directories, else the whole tree; `present` are the directories that exist."""
    wanted = map_paths or monitored
    there = [p for p in wanted if p in present]
    return Scope(there, [p for p in wanted if p not in present], not wanted, child_projects >= 3 and not wanted, (*EXCLUDED, *excludes))


def exclude_list(text: str) -> list[str]:
    """Names and globs of an exclude document, one a line; `name/*` excludes the name."""
    lines = [x.split()[0] for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    return [x for p in lines for x in dict.fromkeys((p.removesuffix("/*"), p)) if x]


def detect(spark: SparkSession, root: str, state: str = "") -> Scope:
    """The scope of a project folder: map_paths.txt, else the folders of monitored_paths.txt, else the whole tree, without
    what exclude_patterns.txt names (these documents in `root`/`state`). A folder with three projects or more below it
    is a container and not walked."""
    files = Files(spark, root)
    docs = Files(spark, f"{root.rstrip('/')}/{state}" if state else root)
    marks = (".git", "file_health.json", f"{state or '.relatrix'}")
    below = [s.getPath() for s in files.fs.listStatus(files.root) if s.isDirectory() and not s.getPath().getName().startswith(".")]
    path = files.jvm.org.apache.hadoop.fs.Path
    children = sorted(p.getName() for p in below if any(files.fs.exists(path(p, m)) for m in marks))
    read = lambda name: docs.read(name) or ""
    wanted, monitored = path_list(read("map_paths.txt")), path_list(read("monitored_paths.txt"))
    monitored = [p for p in monitored if not files.fs.exists(files.at(p)) or files.fs.getFileStatus(files.at(p)).isDirectory()]
    present = {p for p in {*wanted, *monitored} if files.fs.exists(files.at(p))}
    scope = resolve_scope(wanted, monitored, present, exclude_list(read("exclude_patterns.txt")))
    scope.container, scope.children = len(children) >= 3, children[:8]
    scope.full_tree = scope.full_tree and not scope.container
    return scope


def is_source(rel: Column) -> Column:
    ends = "|".join(x for v in SUFFIXES.values() for x in v)
    return F.lower(rel).rlike(rf"\.({ends})$")


def _like(regex: str):
    return lambda p: p.rlike(regex)


def excluded(rel: Column, excludes: tuple[str, ...]) -> Column:
    """Any segment is an excluded name or matches an excluded glob (`*`, `?`; brackets have no class meaning)."""
    exact = [e for e in excludes if not re.search(r"[*?\[]", e)]
    out = F.exists(F.split(rel, "/"), lambda p: p.isin(*exact)) if exact else F.lit(False)
    for g in (glob_regex(e) for e in excludes if re.search(r"[*?\[]", e)):
        out = out | (F.size(F.filter(F.split(rel, "/"), _like(g))) > 0)
    return out


def in_scope(rel: Column, scope: Scope) -> Column:
    inside = F.lit(scope.full_tree)
    for p in scope.prefixes:
        inside = inside | under_prefix(rel, p)
    return inside & is_source(rel) & ~excluded(rel, scope.excludes)


def open_tree(root: str):
    """The file system of a folder and its path there: a local or mounted one, or any store that Arrow reads by its URI.

    Spark's own file sources leave out empty files and names like `__init__.py`, so the tree is walked here.
    """
    if "://" not in root:
        return pafs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))
    fs, base = pafs.FileSystem.from_uri(root)
    return fs, base.rstrip("/")


def walk(root: str, scope: Scope, keep: Callable[[str], bool]) -> list[tuple[str, int, int]]:
    """(path below the root, size, modification time in microseconds) of the files that `keep` accepts, in order. Excluded
    folders are not entered."""
    fs, base = open_tree(root)
    exact = {e for e in scope.excludes if not re.search(r"[*?\[]", e)}
    globs = [re.compile(glob_regex(e)) for e in scope.excludes if re.search(r"[*?\[]", e)]
    dropped = lambda name: name in exact or any(g.match(name) for g in globs)
    starts = [base] if scope.full_tree else [f"{base}/{p}" for p in scope.prefixes if not any(map(dropped, p.split("/")))]
    found, waiting = {}, [s for s in starts]
    while waiting:
        for f in fs.get_file_info(pafs.FileSelector(waiting.pop(), allow_not_found=True)):
            rel = f.path[len(base) + 1 :]
            if dropped(f.base_name):
                continue
            if f.type == pafs.FileType.Directory:
                waiting.append(f.path)
            elif f.type == pafs.FileType.File and keep(rel):
                found[rel] = (f.size, (f.mtime_ns or 0) // 1000)
    return [(rel, *found[rel]) for rel in sorted(found)]


def _read(root: str):
    """Contents of (rel, size, mtime_us) rows; a file that is gone by now has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_tree(root)
        for b in batches:
            held, rows = 0, []
            for i, rel in enumerate(b.column(0).to_pylist()):
                try:
                    with fs.open_input_stream(f"{base}/{rel}") as f:
                        rows.append((i, f.read()))
                except FileNotFoundError:
                    continue
                held += len(rows[-1][1])
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array([r[0] for r in rows])).columns, pa.array([r[1] for r in rows], pa.binary())], [*b.schema.names, "content"])
                    held, rows = 0, []
            if rows:
                yield pa.RecordBatch.from_arrays([*b.take(pa.array([r[0] for r in rows])).columns, pa.array([r[1] for r in rows], pa.binary())], [*b.schema.names, "content"])

    return run


def tree_files(spark: SparkSession, root: str, rows: list[tuple[str, int, int]], contents: bool = True) -> DataFrame:
    """The listed files as rel, size, mtime_us and, with `contents`, content, read by the executors."""
    prepare(spark)
    schema = "rel string, size long, mtime_us long"
    d = spark.createDataFrame(rows, schema)
    if not contents:
        return d
    parts = max(1, min(len(rows), sum(r[1] for r in rows) // PART_BYTES + 1, 10_000))
    return d.repartition(parts).mapInArrow(_read(root), schema + ", content binary")


def texts(d: DataFrame) -> DataFrame:
    """tree_files() with text, hash, n_lines, dirty: invalid UTF-8 is read with replacement characters and marked."""
    text = F.col("content").cast("string")
    d = d.withColumn("dirty", ~F.is_valid_utf8(text)).withColumn("text", F.make_valid_utf8(text))
    return d.select("rel", "size", "mtime_us", "text", content_hash(F.col("text")).alias("hash"), physical_lines(F.col("text")).alias("n_lines"), "dirty")


def source_files(spark: SparkSession, root: str, scope: Scope | None = None, contents: bool = True, only: list[str] | None = None) -> DataFrame:
    """Source files under `root` (or those of `only`): rel, size, mtime_us, and with `contents` text, hash, n_lines, dirty.

    The tree is listed on the driver, one small row a file, and read on the executors, which must see it under the same
    path or URI. Without `contents` the plan never reads a file.
    """
    scope = scope or Scope()
    ends = tuple("." + x for v in SUFFIXES.values() for x in v)
    if only is None:
        rows = walk(root, scope, lambda rel: rel.lower().endswith(ends))
    else:
        fs, base = open_tree(root)
        info = fs.get_file_info([f"{base}/{p}" for p in only])
        rows = [(p, f.size, (f.mtime_ns or 0) // 1000) for p, f in zip(only, info) if f.type == pafs.FileType.File]
    d = tree_files(spark, root, rows, contents)
    return texts(d) if contents else d


def rel_arg(root: str, file: str) -> str:
    """A file argument as a path relative to the root: absolute paths below it, backslashes and leading `./` are read."""
    if os.path.isabs(file):
        for r, f in ((root, file), (os.path.realpath(root), os.path.realpath(file))):
            if f.startswith(r.rstrip("/") + "/"):
                return f[len(r.rstrip("/")) + 1 :]
    file = file.replace("\\", "/")
    while file.startswith("./"):
        file = file[2:]
    return file
