"""References to files as joins: ordered candidates meet the file list, the first hit wins.

Every resolver takes imports (src, seq, spec, names, kind, conditional, inline_depth) and files (rel) and returns
(src, seq, dst). What finds no file is left out; `unresolved` and `external` name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_of, normalize_path
from ..scan.imports import language_column
from ..session import stored
from .graph import merge_edges
from .rust import rust_edges, targets

#: Suffixes tried after a bare JavaScript path, in order.
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts")


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def beside(src: Column, path: Column) -> Column:
    """`path` relative to the file `src`, normalised."""
    return normalize_path(F.concat_ws("/", dirname(src), path))


def first_hit(refs: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """(src, seq, dst): the file of the first candidate that exists and is not the file itself."""
    d = refs.select("src", "seq", F.posexplode(candidates).alias("pos", "rel")).join(files.select("rel").distinct(), "rel")
    d = d.filter("rel <> src")
    return d.groupBy("src", "seq").agg(F.min_by("rel", "pos").alias("dst"))


def js_forms(path: Column) -> Column:
    """The path itself, with each suffix, and as a folder's index."""
    return F.array(path, *[F.concat(path, F.lit(s)) for s in JS_SUFFIXES], *[F.concat(path, F.lit("/index" + s)) for s in JS_SUFFIXES])


def resolve_js(refs: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Relative specs; then path aliases (pattern, target, each with one `*` at most; the longest pattern that hits
    wins); then workspace packages (name, dir, main, exports map of subpath to file)."""
    relative = refs.filter(F.col("spec").startswith("."))
    out = first_hit(relative, js_forms(beside(F.col("src"), F.col("spec"))), files)
    bare = refs.filter(~F.col("spec").startswith("."))
    if aliases is not None:
        a = aliases.select("pattern", "target", F.split_part("pattern", F.lit("*"), F.lit(1)).alias("pre"), F.split_part("pattern", F.lit("*"), F.lit(2)).alias("post"))
        star = F.instr("pattern", "*") > 0
        fits = F.when(star, F.col("spec").startswith(F.col("pre")) & F.col("spec").endswith(F.col("post")) & (F.length("spec") >= F.length("pre") + F.length("post"))).otherwise(
            F.col("spec") == F.col("pattern")
        )
        # The alias table is one project's configuration.
        d = bare.join(a, fits)
        middle = F.substring(F.col("spec"), F.length("pre") + 1, F.length("spec") - F.length("pre") - F.length("post"))
        d = d.withColumn("path", normalize_path(F.when(star, F.replace("target", F.lit("*"), middle)).otherwise(F.col("target"))))
        hit = d.select("src", "seq", F.length("pattern").alias("len"), F.posexplode(js_forms(F.col("path"))).alias("pos", "rel")).join(files.select("rel").distinct(), "rel")
        hit = hit.filter("rel <> src").groupBy("src", "seq").agg(F.min_by("rel", F.struct(-F.col("len"), "pos")).alias("dst"))
        out = out.union(hit)
        bare = bare.join(hit, ["src", "seq"], "left_anti")
    if packages is not None:
        d = bare.join(packages, (F.col("spec") == F.col("name")) | F.col("spec").startswith(F.concat("name", F.lit("/"))))
        sub = F.concat(F.lit("."), F.substring(F.col("spec"), F.length("name") + 1, F.length("spec")))
        listed = F.coalesce(F.try_element_at("exports", sub), F.when(sub == ".", F.coalesce("main", F.lit("index"))).otherwise(F.substring(sub, F.lit(3), F.length(sub))))
        at = normalize_path(F.concat_ws("/", "dir", listed))
        under = normalize_path(F.concat_ws("/", "dir", F.lit("src"), F.when(sub == ".", F.lit("index")).otherwise(F.substring(sub, F.lit(3), F.length(sub)))))
        d = d.withColumn("forms", F.concat(js_forms(at), js_forms(under)))
        out = out.union(first_hit(d, F.col("forms"), files))
    return out


def resolve_python(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Absolute specs from the importing file's package top, the project and src/; relative ones from its folder. The
    submodules that a `from` names replace the package when all of them are files. files may hold unmapped ones."""
    level = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    parts = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    here = F.split(dirname(F.col("src")), "/")
    up = F.array_join(F.slice(here, 1, F.greatest(F.size(here) - level + 1, F.lit(0))), "/")
    inits = files.filter(basename(F.col("rel")) == "__init__.py").select(dirname(F.col("rel")).alias("dir"), F.lit(True).alias("package")).distinct()
    # The package top: the folder above the highest unbroken run of __init__.py folders.
    ancestors = refs.select("src").distinct().withColumn("dirs", F.split(dirname(F.col("src")), "/"))
    ancestors = ancestors.select("src", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda i: F.array_join(F.slice("dirs", 1, i), "/"))).alias("depth", "dir"))
    ancestors = ancestors.join(inits, "dir", "left")
    top = ancestors.groupBy("src").agg(F.max(F.when(F.col("package").isNull(), F.struct("depth", "dir"))).alias("m")).select("src", F.coalesce("m.dir", F.lit("")).alias("top"))
    d = refs.join(top, "src", "left").withColumn("up", F.when(level > 0, up)).withColumn("parts", parts)
    roots = F.when(level > 0, F.array("up")).otherwise(F.array(F.coalesce("top", F.lit("")), F.lit(""), F.lit("src")))

    def forms(names: Column | None = None) -> Column:
        base = lambda r: normalize_path(F.concat_ws("/", r, "parts", *([names] if names is not None else [])))
        return F.flatten(F.transform(roots, lambda r: F.transform(F.array(*map(F.lit, (".py", "/__init__.py", ".pyi"))), lambda e: F.concat(base(r), e))))

    whole = first_hit(d, forms(), files)
    named = d.filter((F.size("names") > 0) & (F.element_at("names", 1) != "*")).withColumn("n_names", F.size("names"))
    each = named.select("src", "seq", "n_names", "up", "parts", "top", "spec", F.posexplode("names").alias("which", "one"))
    each = each.select("src", "seq", "n_names", "which", F.posexplode(forms(F.col("one"))).alias("pos", "rel")).join(files.select("rel").distinct(), "rel").filter("rel <> src")
    each = each.groupBy("src", "seq", "n_names", "which").agg(F.min_by("rel", "pos").alias("dst"))
    full = each.groupBy("src", "seq").agg(F.count("*").alias("n"), F.first("n_names").alias("n_names"), F.collect_set("dst").alias("dsts")).filter("n = n_names")
    subs = full.select("src", "seq", F.explode("dsts").alias("dst"))
    return whole.join(full, ["src", "seq"], "left_anti").unionByName(subs)


def by_basename(refs: DataFrame, name: Column, files: DataFrame) -> DataFrame:
    """The smallest path with that base name."""
    f = files.select("rel", basename(F.col("rel")).alias("name")).groupBy("name").agg(F.min("rel").alias("dst"))
    return refs.select("src", "seq", name.alias("name")).join(f, "name").filter("dst <> src").select("src", "seq", "dst")


def resolve_go(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Relative: the file itself, else the first file of the folder; otherwise the first file named after the tail."""
    relative = refs.filter(F.col("spec").startswith("."))
    at = beside(F.col("src"), F.col("spec"))
    exact = first_hit(relative, F.array(F.concat(at, F.lit(".go")), at), files)
    folder = files.filter(F.col("rel").endswith(".go")).groupBy(dirname(F.col("rel")).alias("dir")).agg(F.min("rel").alias("dst"))
    rest = relative.join(exact, ["src", "seq"], "left_anti").withColumn("dir", at).join(folder, "dir").filter("dst <> src").select("src", "seq", "dst")
    tail = F.concat(F.element_at(F.split("spec", "/"), -1), F.lit(".go"))
    return exact.unionByName(rest).unionByName(by_basename(refs.filter(~F.col("spec").startswith(".")), tail, files))


def resolve_c(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Beside the file, then include/, inc/, src/, then the first file of that base name."""
    places = [beside(F.col("src"), F.col("spec")), *[normalize_path(F.concat(F.lit(p), "spec")) for p in ("include/", "inc/", "src/")]]
    near = first_hit(refs, F.array(*places), files)
    return near.unionByName(by_basename(refs.join(near, ["src", "seq"], "left_anti"), basename(F.col("spec")), files))


def resolve_dotted(refs: DataFrame, files: DataFrame, suffix: str) -> DataFrame:
    """Java and C#: the first file named after the last dotted part; `.*` resolves to nothing."""
    return by_basename(refs.filter(~F.col("spec").endswith(".*")), F.concat(F.element_at(F.split("spec", r"\."), -1), F.lit(suffix)), files)


def resolve_rust(refs: DataFrame, files: DataFrame, crates: DataFrame | None = None) -> DataFrame:
    """The file that each module path reaches; see rust.targets() and, for re-exports, rust.rust_edges()."""
    rs = files.filter(F.col("rel").endswith(".rs")).select("rel").distinct()
    return targets(refs, rs, crates).filter("dst <> src").select("src", "seq", "dst")


def follow_barrels(edges: DataFrame, reexports: DataFrame, exports: DataFrame, depth: int = 8) -> DataFrame:
    """Follow names through re-exporting modules to the file that defines them.

    edges (src, seq, dst, name); reexports (rel, pos, name, target; a null name is `export *`); exports (rel, name).
    A local export stops the walk, else the first named re-export, else the stars in order; after `depth` steps the
    file it stands on is the answer. Returns edges with dst moved and via_barrel set where it moved.
    """
    local = exports.select(F.col("rel").alias("at"), "name", F.lit(True).alias("own")).distinct()
    wide = edges.select("src", "seq", "name", F.col("dst").alias("start"), F.col("dst").alias("at"), F.lit("").alias("rank"))
    done = None
    for step in range(depth + 1):
        d = stored(wide.join(local, ["at", "name"], "left"))
        if step and not d.limit(1).count():
            break
        stop = d.filter("own").drop("own")
        done = stop if done is None else done.unionByName(stop)
        if step == depth:
            done = done.unionByName(d.filter("own IS NULL").drop("own").withColumn("rank", F.concat("rank", F.lit("~"))))
            break
        r = reexports.select(F.col("rel").alias("at"), "pos", F.col("name").alias("as_name"), "target")
        d = d.filter("own IS NULL").drop("own").join(r, "at").filter((F.col("as_name") == F.col("name")) | F.col("as_name").isNull())
        # Named re-exports come before stars, each in file order.
        key = F.concat(F.when(F.col("as_name").isNull(), "s").otherwise("n"), F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit("/"))
        wide = d.select("src", "seq", "name", "start", F.col("target").alias("at"), F.concat("rank", key).alias("rank"))
    best = done.groupBy("src", "seq", "name").agg(F.min_by("at", "rank").alias("to"))
    out = edges.join(best, ["src", "seq", "name"], "left")
    return out.select("src", "seq", "name", F.coalesce("to", "dst").alias("dst"), (F.coalesce(F.col("to") != F.col("dst"), F.lit(False))).alias("via_barrel"))


def build_edges(files: DataFrame, imports: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None, crates: DataFrame | None = None, exports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rel, text) and scanned imports -> (edges, leftovers).

    Edges carry line, names, conditional, dynamic, via_barrel, merged per (src, dst). Leftovers are (src, raw, reason):
    external_or_bare, unresolved_relative, dynamic_literal; unresolved Rust paths are not reported. Lines come from the
    scan; only Rust files are read again, for their re-exports.
    """
    r = imports.filter("spec IS NOT NULL").withColumn("language", language_column(F.col("src")))
    of = lambda lang: r.filter(F.col("language") == lang)
    hits = resolve_python(of("python"), files)
    for d in (
        resolve_js(of("javascript"), files, aliases, packages), resolve_go(of("go"), files), resolve_c(of("c"), files),
        resolve_dotted(of("java"), files, ".java"), resolve_dotted(of("csharp"), files, ".cs"),
    ):
        hits = hits.unionByName(d)
    rust, brought = rust_edges(of("rust"), files, crates)
    hits = stored(hits.withColumn("via_barrel", F.lit(False)).unionByName(rust.select("src", "seq", "dst", "via_barrel")))
    d = hits.join(r, ["src", "seq"])
    if exports is not None:
        star = d.filter("kind IN ('ExportFrom', 'ExportStar')")
        flat = star.select(F.col("src").alias("rel"), F.col("seq").alias("pos"), F.explode_outer("names").alias("name"), F.col("dst").alias("target"))
        named = d.filter((F.size("names") > 0) & (F.col("language") == "javascript")).select("src", "seq", "dst", F.explode("names").alias("name"))
        moved = follow_barrels(named, flat, exports).filter("via_barrel").select("src", "seq", F.col("dst").alias("to"), F.array("name").alias("via_names")).distinct()
        extra = d.join(moved, ["src", "seq"]).filter("to <> src").select(*[F.col("to").alias("dst") if c == "dst" else F.lit(True).alias(c) if c == "via_barrel" else F.col("via_names").alias(c) if c == "names" else F.col(c) for c in d.columns])
        d = d.unionByName(extra)
    text = files.select(F.col("rel").alias("src"), "text")
    d = d.withColumn("dynamic", F.col("kind") == "Dynamic")
    # Names that globs bring in come after all references of a file.
    used = brought.join(text, "src").select("src", "dst", F.lit(1 << 30).alias("seq"), line_of(F.col("text"), [F.col("name")]).alias("line"), F.array("name").alias("names"), F.lit(False).alias("conditional"), F.lit(False).alias("dynamic"), F.lit(True).alias("via_barrel"))
    d = d.select(*used.columns).unionByName(used)
    edges = merge_edges(d.select("src", "dst", "seq", "line", "names", "conditional", "dynamic", "via_barrel"))
    left = r.join(hits, ["src", "seq"], "left_anti").filter("language <> 'rust'")
    reason = F.when(F.col("kind") == "Dynamic", "dynamic_literal").when(F.col("spec").startswith("."), "unresolved_relative").otherwise("external_or_bare")
    return edges, left.select("src", F.col("spec").alias("raw"), reason.alias("reason")).distinct()
