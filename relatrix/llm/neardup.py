"""Near-duplicate classes: weighted DartMinHash signatures, banded candidates, exact similarity, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, prepare, stored
from .components import connected_components
from .dartminhash import bands, elements, forget_words, shingles, signatures, weighted
from .memory import give_back
from .token_counts import byte_batches

BATCH_BYTES = 1 << 20
SMALL = 8
#: Comparisons of different classes for each listed shingle above which hubs are tried once more.
DENSE = 20
EPS = 1e-9


def sketch(docs: DataFrame, text_col: str, id_col: str, size: int, coordinates: int, rows: int, weights: str) -> DataFrame:
    """(k, tk, m, bands): the id, the text's MD5, the total weight of its shingles, and its band hashes (none for a
    text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, BATCH_BYTES):
            n = b.num_rows
            items, owner, times = weighted(*shingles(b.column(0).to_pylist(), size), weights)
            total = np.bincount(owner, times, n).astype(np.int64)
            keys = np.zeros((n, coordinates // rows), np.int64)
            heavy = np.zeros(n, bool)
            heavy[owner[times > 1]] = True
            for some, w in ((~heavy, None), (heavy, times.astype(np.float64))):
                at = some[owner]
                if at.any():
                    keys[some] = bands(signatures(items[at], None if w is None else w[at], owner[at], n, coordinates)[some], rows)
            got = pa.array([k if t else [] for k, t in zip(keys, total)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(total), got], ["k", "tk", "m", "bands"])
        forget_words()
        give_back()

    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(text.alias("t"), F.col(id_col).alias("k"), F.md5(text).alias("tk"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, tk string, m long, bands array<long>")


def element_sets(texts: DataFrame, size: int, weights: str) -> DataFrame:
    """(node, t) -> (node, items): sorted 64-bit hashes of the shingles; the n-th occurrence of a shingle is an element
    of its own, so that the Jaccard similarity of two sets is the weighted one of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, BATCH_BYTES):
            items, owner = elements(*shingles(b.column(0).to_pylist(), size), weights)
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(items.view(np.int64)))], ["node", "items"])
        forget_words()
        give_back()

    return texts.select("t", "node").mapInArrow(run, "node long, items array<long>")


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct elements."""
    if not len(x) or not len(y):
        return 0.0
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    n = int((y[i] == x).sum())
    return n / (len(x) + len(y) - n)


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, s). Each pair moves one of its two sets; the other is met where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, i), (y, j) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in b.columns[2:])
            s = [similarity(x[i[r] : i[r + 1]], y[j[r] : j[r + 1]]) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["a", "b", "s"])
        give_back()

    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    full = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return full.select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long, s double")


def ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def alike(threshold: float, m1, m2, most=None) -> Column:
    """Whether two sets of these sizes with `most` common elements at most can be similar enough."""
    m1, m2 = F.col(m1), F.col(m2)
    ok = F.least(m1, m2) >= threshold * F.greatest(m1, m2) - EPS
    return ok if most is None else ok & (most >= threshold / (1 + threshold) * (m1 + m2) - EPS)


def rare_prefixes(sets: DataFrame, crowd: DataFrame, threshold: float) -> DataFrame:
    """(node, m, u, rare): of each text of `crowd` its size, the number of its elements that no other of these texts
    has, and the rarest of the others, rarest first.

    Two sets with a similarity of `threshold` or more have a common element among the rarest m - ceil(threshold * m) + 1
    of each. Those of one text only come first and lead nowhere; a text with more of them than that is not listed: it
    can be linked to none of `crowd`.
    """
    each = sets.join(crowd.hint("merge"), "node").select("node", F.size("items").cast("long").alias("m"), F.explode("items").alias("h"))
    met = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    known = each.join(met.hint("merge"), "h").groupBy("node").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("e"))
    known = known.withColumn("u", F.col("m") - F.size("e"))
    room = F.col("m") - F.ceil(threshold * F.col("m") - EPS) + 1 - F.col("u")
    return known.filter(room > 0).select("node", "m", "u", F.slice("e.h", F.lit(1), room.cast("int")).alias("rare"))


def join_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (of nodes with an edge) after further links."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    e = stored(links.select("a", "b").join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("la", "a").alias("ca"), F.coalesce("lb", "b").alias("cb")))
    top = connected_components(e.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    own = labels.union(e.select("a", "ca")).union(e.select("b", "cb")).distinct()
    out = stored(own.join(top.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    discard(e, top, labels)
    return out


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    threshold: float = 0.8,
    size: int = 5,
    coordinates: int = 110,
    rows: int = 5,
    weights: str = "count",
    carry_key: bool = False,
) -> DataFrame:
    """One row per input row: the id, class_id (smallest id of its class), class_size, representative.

    Two texts are linked when the weighted Jaccard similarity of their five-word shingles is `threshold` or more; a
    shingle weighs as often as it occurs (once with weights="set"). Classes are the connected components. Equal texts
    are one class at once, whatever their number. A text of fewer than five words is one shingle; texts without words
    (null, empty, blank) are linked only to equal ones, null counting as empty. A null id is in the class of its text;
    one row of a class, with the smallest id, is its representative. An empty table gives no rows; other columns are
    ignored.

    Distinct texts are hashed into 22 bands of 5 of the 110 coordinates: at similarity 0.8 the chance to share none is
    2e-4, at 0.85 3e-6. A band key shared by up to 8 texts gives all its pairs. In a larger one every text is compared
    with the key's most central text, the one with the smallest share of shingles found in no other text of large keys.
    What is in one class then is compared no further. Of the other pairs those are compared that have one of their
    rarest shingles in common and could by its place in both reach the threshold (prefix and position bounds are
    exact); a shingle with very many of them gets hubs first, once more. So no group is expanded into all its pairs and
    no link is given up.
    """
    prepare(docs.sparkSession)
    base = stored(sketch(docs, text_col, id_col, size, coordinates, rows, weights).withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "uid")).alias("first")
    nodes = stored(base.groupBy("tk").agg(F.min("uid").alias("node"), first, F.count("*").alias("copies"), F.first("m").alias("m"), F.first("bands").alias("bands")))
    flat = nodes.select("node", "m", F.explode("bands").alias("key"))
    shared = flat.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(flat.join(shared.hint("merge"), "key"))
    wanted = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "tk", F.col("first.k").alias("rk"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("rk")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("t"), F.md5(text).alias("tk"), name(id_col)).join(wanted.select("node", "tk", name("rk")).hint("merge"), ["tk", "rk"])
    sets = stored(element_sets(texts, size, weights).dropDuplicates(["node"]))

    few = members.filter(F.col("n") <= SMALL)
    left, right = few.select("key", F.col("node").alias("a"), F.col("m").alias("ma")), few.select("key", F.col("node").alias("b"), F.col("m").alias("mb"))
    pairs = left.join(right.hint("merge"), "key").filter((F.col("a") < F.col("b")) & alike(threshold, "ma", "mb")).select("a", "b")
    crowd = members.filter(F.col("n") > SMALL)
    crowded = bool(crowd.limit(1).count())
    if crowded:
        rare = stored(rare_prefixes(sets, crowd.select("node").distinct(), threshold))
        able = crowd.select("key", "node").join(rare.select("node", "m", "u").hint("merge"), "node")
        hub = F.min(F.struct((F.col("u") / F.col("m")).alias("own"), F.xxhash64("node"), F.col("node").alias("hub"), F.col("m").alias("mh"), F.col("u").alias("uh"))).alias("h")
        stars = able.join(able.groupBy("key").agg(hub).select("key", "h.hub", "h.mh", "h.uh").hint("merge"), "key").filter("node <> hub")
        stars = stars.filter(alike(threshold, "m", "mh", F.least(F.col("m") - F.col("u"), F.col("mh") - F.col("uh"))))
        pairs = pairs.union(stars.select(*ordered(F.col("node"), F.col("hub"))))
    measured = stored(measure(pairs.distinct(), sets))
    labels = connected_components(measured.filter(F.col("s") >= threshold))

    if crowded:
        listed = stored(rare.select("node", "m", "u", F.posexplode("rare").alias("i", "h")).select("h", "node", "m", (F.col("m") - F.col("u") - F.col("i")).alias("left")))
        entries, turn, gained, last = listed.count(), 0, 1.0, False
        rounds = [rare, listed, measured]
        while not last:
            named = listed.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")
            sums = named.groupBy("h", "class").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("classes"))
            mixed = stored(named.join(sums.filter("classes > 1").hint("merge"), "h"))
            # Each shingle of n texts, c of them in each class, holds (n^2 - sum of c^2) / 2 pairs: as a sum over its rows.
            work = mixed.agg(F.sum((F.col("n") - F.col("q") / F.col("n")) / 2)).first()[0] or 0.0
            last = work <= DENSE * entries or gained < 0.01
            one = mixed.select("h", F.col("node").alias("a"), F.col("m").alias("ma"), F.col("left").alias("fa"), F.col("class").alias("ca"))
            if last:
                two = mixed.select("h", F.col("node").alias("b"), F.col("m").alias("mb"), F.col("left").alias("fb"), F.col("class").alias("cb"))
                both = one.join(two.hint("merge"), "h").filter("a < b AND ca <> cb")
            else:
                pick = F.min(F.struct(-F.col("left") / F.col("m"), F.xxhash64("node", F.lit(turn)), F.col("node").alias("b"), F.col("m").alias("mb"), F.col("left").alias("fb"), F.col("class").alias("cb")))
                both = one.join(mixed.groupBy("h").agg(pick.alias("p")).select("h", "p.b", "p.mb", "p.fb", "p.cb").hint("merge"), "h").filter("ca <> cb")
            # `left`: how many elements follow from this one on, in order of rarity; no more can be common.
            both = both.filter(alike(threshold, "ma", "mb", F.least("fa", "fb"))).select(*ordered(F.col("a"), F.col("b"))).distinct()
            found = stored(measure(both.join(measured.hint("merge"), ["a", "b"], "left_anti"), sets))
            links = found.filter(F.col("s") >= threshold)
            n = links.count()
            if n:
                labels = join_classes(labels, links)
            rounds.append(found)
            if not last:
                measured = measured.union(found)
            discard(mixed)
            turn, gained = turn + 1, n / max(1, entries)
        discard(*rounds)

    # Only texts with a link need their class looked up; every other one is a class with its copies.
    linked = nodes.select("node", "first", "copies").join(labels.hint("merge"), "node")
    per = linked.groupBy("label").agg(F.min("first").alias("lead"), F.sum("copies").alias("class_size"))
    linked = stored(linked.select("node", "label").join(per.hint("merge"), "label").select("node", "lead", "class_size"))
    discard(members, sets, measured, labels)
    named = nodes.select("tk", "node", "first", "copies").join(linked.hint("merge"), "node", "left")
    named = named.select("tk", F.coalesce("lead", "first").alias("lead"), F.coalesce("class_size", "copies").alias("class_size"))
    out = base.select("k", "tk", "uid").join(named.hint("merge"), "tk")
    return out.select(F.col("k").alias(id_col), F.col("lead.k").alias("class_id"), "class_size", (F.col("uid") == F.col("lead.uid")).alias("representative"), *([F.col("tk").alias("text_key")] if carry_key else []))


def representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that represent their near-duplicate class, one for each class, with all their columns."""
    classes = near_duplicates(docs, text_col, id_col, carry_key=True, **options).filter("representative")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lead = classes.select(key(id_col).alias("lead_id"), F.col("text_key").alias("lead_text"))
    d = docs.select(F.struct("*").alias("row"), key(id_col).alias("lead_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("lead_text"))
    # Rows equal in id and text are told apart no further: one of them stays.
    return d.join(lead, ["lead_id", "lead_text"], "left_semi").dropDuplicates(["lead_id", "lead_text"]).select("row.*")
