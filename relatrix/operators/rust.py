"""Rust paths as joins: module walks, re-exports followed to the defining file, names that a glob brings in.

A path is walked module by module from a start folder; what is left names an item of the module reached. Re-exports are
followed for up to HOPS steps, each one join of all open lookups with the modules' tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scan.symbols import bare_column, exports_column
from ..session import stored

HOPS = 4
#: Heads that name no module a glob could bring in.
NO_HEADS = ("crate", "self", "super", "std", "core", "alloc")
ROOTS = ("lib.rs", "main.rs")
NONE = "array<string>"


def _dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _below(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(folder, F.lit("")), name)


def own_folder(rel: Column) -> Column:
    """Where a file's child modules lie."""
    stem = F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"\.rs$", "")
    return F.when(stem.isin("lib", "main", "mod"), _dirname(rel)).otherwise(_below(_dirname(rel), stem))


def crate_roots(rs: DataFrame) -> DataFrame:
    """(rel, root, root_file): the nearest folder at or above each file that holds a lib.rs or main.rs."""
    roots = rs.filter(F.element_at(F.split("rel", "/"), -1).isin(*ROOTS)).groupBy(_dirname(F.col("rel")).alias("root")).agg(F.min("rel").alias("root_file"))
    ups = F.split(_dirname(F.col("rel")), "/")
    lines = rs.select("rel", F.explode(F.transform(F.sequence(F.lit(0), F.size(ups)), lambda i: F.array_join(F.slice(ups, 1, i), "/"))).alias("root"))
    return lines.join(roots, "root").groupBy("rel").agg(F.max_by(F.struct("root", "root_file"), F.length("root")).alias("m")).select("rel", "m.root", "m.root_file")


def targets(refs: DataFrame, rs: DataFrame, crates: DataFrame | None = None) -> DataFrame:
    """(src, seq, spec, inline_depth) -> (src, seq, dst, name, past_type), for the paths that lead to a file.

    `crate`, `self`, `super` (which first leave inline modules), a child module, or another crate by name set the start.
    name is the item looked up in dst, if the path goes on past its modules: the last segment, or before more segments
    one written like a type (past_type where no module came before it). `mod:` specs name a file below their module.
    """
    roots = crate_roots(rs)
    d = refs.select("src", "seq", "spec", "inline_depth").join(roots.toDF("src", "root", "root_file"), "src", "left")
    is_mod = F.col("spec").startswith("mod:")
    path = F.filter(F.split(F.regexp_replace("spec", "^mod:", ""), "::"), lambda p: ~F.trim(p).isin("", "*"))
    d = d.withColumn("is_mod", is_mod).withColumn("path", F.transform(path, lambda p: F.trim(p))).withColumn("head", F.get("path", F.lit(0)))
    if crates is None:
        d = d.withColumn("other", F.lit(None).cast("string"))
    else:
        c = crates.select(F.replace("name", F.lit("-"), F.lit("_")).alias("head"), _below(F.col("dir"), F.lit("src")).alias("other")).dropDuplicates(["head"])
        d = d.join(c, "head", "left")
    own = F.split(own_folder(F.col("src")), "/")
    lead = F.when(F.col("head") == "self", 1).otherwise(0)
    rest = F.slice("path", lead + 1, F.size("path"))
    others = F.filter(F.transform(rest, lambda p, i: F.when(p != "super", i)), lambda i: i.isNotNull())
    supers = F.coalesce(F.get(others, F.lit(0)), F.size(rest))
    climb = supers - F.col("inline_depth")
    enough = (climb >= 0) & (climb <= F.size(F.filter(own, lambda p: p != "")))
    relative = F.array_join(F.slice(own, 1, F.greatest(F.size(own) - F.greatest(climb, F.lit(0)), F.lit(0))), "/")
    foreign = F.col("other").isNotNull() & (F.col("head") != "crate")
    start = F.when(F.col("is_mod"), F.array_join(own, "/")).when(F.col("head") == "crate", F.coalesce("root", F.lit("src"))).when(foreign, F.col("other")).when(enough, relative)
    parts = F.when(F.col("is_mod"), F.col("path")).when((F.col("head") == "crate") | foreign, F.slice("path", 2, F.size("path"))).otherwise(F.slice("path", lead + supers + 1, F.size("path")))
    d = d.withColumn("start", start).withColumn("parts", F.filter(parts, lambda p: p != "self")).withColumn("bare", ~F.col("is_mod") & (F.col("head") != "crate") & ~foreign & (lead + supers == 0))
    d = d.filter("start IS NOT NULL").withColumn("crate_root", F.when(F.col("head") == "crate", F.col("root_file")).when(foreign, F.lit("")))
    d = d.select("src", "seq", "is_mod", "start", "parts", "bare", "crate_root")

    # The modules along the path: as many leading segments as are files.
    files = rs.select(F.col("rel").alias("file")).distinct()
    ways = F.transform("parts", lambda p, i: _below(F.col("start"), F.array_join(F.slice("parts", 1, i + 1), "/")))
    each = d.select("src", "seq", F.posexplode(ways).alias("i", "at"))
    each = each.select("src", "seq", "i", F.posexplode(F.array(F.concat("at", F.lit(".rs")), F.concat("at", F.lit("/mod.rs")))).alias("form", "file")).join(files, "file")
    each = each.groupBy("src", "seq", "i").agg(F.min_by("file", "form").alias("file"))
    met = each.groupBy("src", "seq").agg(F.array_sort(F.collect_list(F.struct("i", "file"))).alias("met"))
    d = d.join(met, ["src", "seq"], "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<i:int,file:string>>")))
    whole = F.try_element_at("met", F.lit(-1))["file"]
    mods = d.filter("is_mod").filter(F.try_element_at("met", F.lit(-1))["i"] == F.size("parts") - 1).select("src", "seq", whole.alias("dst"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("past_type"))
    d = d.filter("NOT is_mod").withColumn("met", F.filter("met", lambda m, j: m["i"] == j)).withColumn("k", F.size("met")).filter("k > 0 OR NOT bare")
    d = d.withColumn("found", whole).withColumn("name", F.get("parts", F.col("k"))).withColumn("left", F.size("parts") - F.col("k"))
    typed = F.col("name").rlike("^[A-Z]")
    d = d.filter((F.col("k") > 0) | (F.col("left") <= 1) | typed)
    # The file of a folder itself, for what is looked up in it.
    at = F.when(F.col("k") > 0, _below(F.col("start"), F.array_join(F.slice("parts", 1, F.col("k")), "/"))).otherwise(F.col("start"))
    d = d.withColumn("at", at)
    forms = [F.when(F.col("k") == 0, F.coalesce(F.nullif("crate_root", F.lit("")), _below(F.col("at"), F.lit("lib.rs"))))]
    forms = F.array(*forms, *[_below(F.col("at"), F.lit(n)) for n in ("mod.rs", "lib.rs", "main.rs")], F.concat("at", F.lit(".rs")))
    forms = F.when(F.col("k") == 0, F.when(F.col("crate_root").isNull(), F.slice(forms, 2, 9)).otherwise(forms)).otherwise(F.slice(forms, 2, 9))
    direct = (F.col("k") > 0) & ((F.col("left") == 0) | ((F.col("left") > 1) & ~typed))
    asked = d.filter(~direct).select("src", "seq", F.posexplode(forms).alias("form", "file")).join(files, "file").groupBy("src", "seq").agg(F.min_by("file", "form").alias("module"))
    d = d.join(asked, ["src", "seq"], "left")
    out = d.select("src", "seq", F.coalesce(F.when(~direct, F.col("module")), "found").alias("dst"), "name", ((F.col("k") == 0) & (F.col("left") > 1)).alias("past_type"))
    return out.filter("dst IS NOT NULL").unionByName(mods)


def module_tables(files: DataFrame, rs: DataFrame, crates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rel, text) -> items (at, name, public), uses (at, pos, name, public, file, inner), globs (at, pos, public, target)."""
    d = stored(files.join(rs, "rel", "left_semi").select("rel", F.posexplode(exports_column(F.coalesce("text", F.lit("")))).alias("pos", "e")).select("rel", "pos", "e.*"))
    items = d.filter("kind = 'def'").groupBy(F.col("rel").alias("at"), "name").agg(F.min_by("public", "pos").alias("public"))
    named = d.filter("kind <> 'def'")
    led = targets(named.select(F.col("rel").alias("src"), F.col("pos").alias("seq"), F.col("path").alias("spec"), F.lit(0).alias("inline_depth")), rs, crates)
    led = stored(led.select(F.col("src").alias("rel"), F.col("seq").alias("pos"), F.col("dst").alias("file"), F.col("name").alias("inner")))
    d = named.join(led, ["rel", "pos"], "left")
    uses = d.filter("kind = 'use'").select(F.col("rel").alias("at"), "pos", "name", "public", "file", "inner")
    globs = d.filter("kind = 'glob' AND file IS NOT NULL AND inner IS NULL AND file <> rel").select(F.col("rel").alias("at"), "pos", "public", F.col("file").alias("target"))
    return items, uses, globs


def definers(lookups: DataFrame, items: DataFrame, uses: DataFrame, globs: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, at, name, private) -> (id, def): the file that defines each name as seen from the module `at`.

    An item of the module ends a lookup; then its first use item of that name, which leads to another module's item, and
    to that module itself if there is none; then its globs in order, whose modules show only public names. Items and
    uses without pub count where `private`. A lookup that is open after `hops` steps has no answer.
    """
    d = lookups.select("id", "at", "name", "private", F.lit("").alias("rank"), F.lit(None).cast("string").alias("back"), F.lit(None).cast("string").alias("outer"))
    ends: DataFrame | None = None
    own = items.withColumnRenamed("public", "item_public")
    first = uses.select("at", "name", "pos", F.col("public").alias("use_public"), "file", "inner")
    for step in range(hops + 1):
        d = d.join(own, ["at", "name"], "left")
        done = d.filter("item_public IS NOT NULL").select("id", "rank", "back", "outer", F.when(F.col("item_public") | F.col("private"), F.col("at")).alias("def"))
        d = d.filter("item_public IS NULL").drop("item_public")
        seen = d.join(first, ["at", "name"], "left").filter("use_public IS NULL OR use_public OR private OR pos IS NOT NULL")
        pick = F.min_by(F.struct("file", "inner"), F.when(F.col("use_public") | F.col("private"), F.col("pos")))
        seen = stored(seen.groupBy("id", "at", "name", "private", "rank", "back", "outer").agg(pick.alias("u")))
        led = seen.filter("u IS NOT NULL")
        goes_on = (F.col("u.inner").isNotNull()) & (F.col("u.file") != F.col("at"))
        stop = led.filter(F.col("u.file").isNull() | ~goes_on).select("id", "rank", "back", "outer", F.when(F.col("u.inner").isNull(), F.col("u.file")).alias("def"))
        on = led.filter(F.col("u.file").isNotNull() & goes_on).select("id", F.col("u.file").alias("at"), F.col("u.inner").alias("name"), F.lit(True).alias("private"), "rank", F.col("u.file").alias("back"), "outer")
        rest = seen.filter("u IS NULL").join(globs.withColumnRenamed("public", "glob_public"), "at", "left")
        open_ = F.col("target").isNotNull() & (F.col("glob_public") | F.col("private"))
        key = F.concat("rank", F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit("/"))
        into = rest.filter(open_).select("id", F.col("target").alias("at"), "name", F.lit(False).alias("private"), key.alias("rank"), F.lit(None).cast("string").alias("back"), F.coalesce("back", "outer").alias("outer"))
        shut = rest.groupBy("id", "at", "rank", "back", "outer").agg(F.bool_or(open_).alias("any")).filter("NOT any OR any IS NULL").select("id", "rank", "back", "outer", F.lit(None).cast("string").alias("def"))
        now = done.union(stop).union(shut).withColumn("deep", F.lit(False))
        d = stored(on.union(into))
        if step == hops:
            now = now.unionByName(d.select("id", "rank", F.lit(None).cast("string").alias("back"), F.lit(None).cast("string").alias("outer"), F.lit(None).cast("string").alias("def"), F.lit(True).alias("deep")))
        ends = now if ends is None else ends.unionByName(now)
        if not d.limit(1).count():
            break
    hit = F.when(~F.col("deep"), F.coalesce("def", "back"))
    best = ends.withColumn("hit", hit).groupBy("id").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("best"), F.bool_or("deep").alias("deep"), F.max("outer").alias("outer"))
    return best.select("id", F.coalesce("best", F.when(~F.col("deep"), F.col("outer"))).alias("def")).filter("def IS NOT NULL")


def rust_edges(refs: DataFrame, files: DataFrame, crates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Imports and (rel, text) -> (src, seq, dst, name, via_barrel) of the references, and (src, dst, name) of names that
    a glob import brings in and the file uses: an edge each to the defining file, unless a direct one is there."""
    if not refs.limit(1).count():
        empty = files.sparkSession.createDataFrame
        return empty([], "src string, seq int, dst string, name string, via_barrel boolean"), empty([], "src string, dst string, name string")
    rs = stored(files.filter(F.lower("rel").endswith(".rs")).select("rel").distinct())
    roots = crate_roots(rs).select("rel", "root")
    hits = stored(targets(refs, rs, crates).filter("dst <> src"))
    items, uses, globs = module_tables(files, rs, crates)

    def with_privacy(d: DataFrame, module: str) -> DataFrame:
        """private: both files have the same crate root."""
        d = d.join(roots.toDF("src", "r1"), "src", "left").join(roots.toDF(module, "r2"), module, "left")
        return d.withColumn("private", F.col("r1").eqNullSafe(F.col("r2"))).drop("r1", "r2")

    asked = with_privacy(hits.filter("name IS NOT NULL"), "dst")
    asked = asked.select(F.struct("src", "seq").alias("id"), F.col("dst").alias("at"), "name", "private")
    found = stored(definers(asked, items, uses, globs)).select("id.src", "id.seq", "def")
    d = hits.join(found, ["src", "seq"], "left")
    moved = F.col("past_type") & F.col("def").isNotNull()
    plain = d.select("src", "seq", F.when(moved, F.col("def")).otherwise(F.col("dst")).alias("dst"), "name", (moved & (F.col("def") != F.col("dst"))).alias("via_barrel"))
    plain = stored(plain.filter("dst <> src"))
    direct = plain.select("src", "dst").distinct()
    extra = d.filter("NOT past_type AND def IS NOT NULL AND def <> dst AND def <> src").select("src", "seq", F.col("def").alias("dst"), "name", F.lit(True).alias("via_barrel"))
    extra = extra.join(direct, ["src", "dst"], "left_anti").select(*plain.columns)

    # Paths whose head is no module here, but one that a glob brings in: the globs' modules are asked, then theirs.
    starts = stored(targets(refs.filter(F.col("spec").endswith("::*")), rs, crates))
    lost = refs.filter("kind = 'PathExpr'").join(hits, ["src", "seq"], "left_anti").withColumn("head", F.split_part("spec", F.lit("::"), F.lit(1))).filter(~F.col("head").isin(*NO_HEADS))
    bound = refs.filter((F.col("kind") == "Import") & ~F.col("spec").startswith("mod:")).select("src", F.element_at(F.split("spec", "::"), -1).alias("head")).distinct()
    lost = lost.join(bound, ["src", "head"], "left_anti")
    if not starts.limit(1).count():
        return plain.unionByName(extra), files.sparkSession.createDataFrame([], "src string, dst string, name string")
    open_ = stored(lost.join(starts.select("src", F.col("dst").alias("at"), F.col("seq").alias("order")), "src").select(F.struct("src", "seq").alias("id"), "head", "spec", "at", "order"))
    led = refs.filter((F.col("kind") == "Import") & ~F.col("spec").startswith("mod:") & ~F.col("spec").endswith("::*")).join(hits.select("src", "seq"), ["src", "seq"], "left_semi")
    led = led.select(F.col("src").alias("at"), F.element_at(F.split("spec", "::"), -1).alias("head"), "seq", "spec", "inline_depth")
    led = led.groupBy("at", "head").agg(F.min_by(F.struct("spec", "inline_depth"), "seq").alias("by"))
    answers: DataFrame | None = None
    for _ in range(HOPS):
        if not open_.limit(1).count():
            break
        tries = open_.join(led, ["at", "head"], "left").withColumn("tail", F.substring(F.col("spec"), F.length("head") + 1, F.length("spec")))
        ways = F.array(F.struct(F.lit(0).alias("way"), F.col("spec").alias("spec2"), F.lit(0).alias("depth2")), F.struct(F.lit(1).alias("way"), F.concat(F.col("by.spec"), "tail").alias("spec2"), F.col("by.inline_depth").alias("depth2")))
        tries = stored(tries.select("id", "order", "at", F.explode(ways).alias("w")).select("id", "order", "at", "w.*").filter("spec2 IS NOT NULL"))
        asks = tries.select(F.col("at").alias("src"), F.struct("id", "order", "way").alias("seq"), F.col("spec2").alias("spec"), F.col("depth2").alias("inline_depth"))
        got = targets(asks, rs, crates).select("seq.id", "seq.order", "seq.way", "dst").groupBy("id").agg(F.min_by("dst", F.struct("order", "way")).alias("dst"))
        got = stored(got)
        answers = got if answers is None else answers.unionByName(got)
        onward = open_.join(got, "id", "left_anti").join(starts.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("seq").alias("n")), "at")
        open_ = stored(onward.select("id", "head", "spec", F.col("next").alias("at"), (F.col("order") * 1000 + F.col("n")).alias("order")).dropDuplicates(["id", "at"]))
    if answers is not None:
        reached = answers.select("id.src", "id.seq", "dst").filter("dst <> src").join(direct, ["src", "dst"], "left_anti")
        extra = extra.unionByName(reached.select("src", "seq", "dst", F.lit(None).cast("string").alias("name"), F.lit(True).alias("via_barrel")))
    extra = stored(extra)
    every = plain.unionByName(extra)

    # Names used on their own in a file with glob imports.
    opened = with_privacy(starts.filter("name IS NULL AND dst <> src").select("src", F.col("dst").alias("module")).distinct(), "module")
    known = items.select("name").union(uses.select("name")).distinct()
    words = files.join(opened.select(F.col("src").alias("rel")).distinct(), "rel", "left_semi").select(F.col("rel").alias("src"), F.explode(bare_column(F.coalesce("text", F.lit("")))).alias("name"))
    words = words.join(known, "name", "left_semi").join(opened, "src")
    found = definers(words.select(F.struct("src", "module", "name").alias("id"), F.col("module").alias("at"), "name", "private"), items, uses, globs)
    brought = found.select("id.src", "id.module", "id.name", F.col("def").alias("dst")).filter("dst <> module AND dst <> src")
    return every, brought.join(every.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", "name").distinct()
