"""Katz backoff scoring: Good-Turing discounted bigrams over a smoothed unigram model, exactly normalised.

Texts become blocks of token numbers. Counts are gathered in partitioned tables: the words' by the leading bits of a
64-bit hash, the word pairs' by their context (a context with a large share of all tokens is spread over every
partition by its second word). A block asks each partition for what its own texts need, as packed arrays of distinct
words or pairs, and evaluates its texts on the answers. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, prepare

TOP = 5  # counts beyond are not discounted
BLOCK_TOKENS = 2_600_000
PART_ENTRIES = 1_500_000
LEAST_BITS = 6
MEMORY = 1_000_000
END = xxhash.xxh64_intdigest(b"")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def tokens_of(text: str) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and of the end."""
    words = text.encode("utf-8", "replace").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(x.astype(np.uint64))
    n = 1
    while n < 8 and len(x) and int(x.max()) >> (8 * n):
        n *= 2
    y = x.astype({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[n])
    planes = y.view(np.uint8).reshape(-1, n).T
    return bytes([n]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    n = b[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    y = np.ascontiguousarray(raw.reshape(n, -1).T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[n]).ravel()
    return y.astype(np.int64)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit hashes by their differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b).view(np.uint64), dtype=np.uint64)


def blocks_of(docs: DataFrame, text_col: str, id_col: str, modulus: int, held: int) -> DataFrame:
    """Block rows: ids, remainders, lengths, token numbers into the block's sorted word hashes, training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        keys: list = []
        kept: list[np.ndarray] = []
        out_flags: list[bool] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal at, keys, kept, out_flags, size
            lengths = np.array([len(x) for x in kept])
            words, numbers = np.unique(np.concatenate(kept), return_inverse=True)
            train = np.repeat(~np.array(out_flags, bool), lengths)
            counts = np.bincount(numbers[train], minlength=len(words))
            row = [at, keys, out_flags, pack(lengths), pack(numbers), pack_sorted(words), pack(counts), int(train.sum()), len(words)]
            at += 1
            keys, kept, out_flags, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        names = ["block", "keys", "held", "lengths", "numbers", "words", "counts", "n_train", "n_words"]
        types: list = []
        for b in batches:
            types = [pa.int64(), pa.list_(b.schema.field(1).type), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            for t, k, h in zip(*(c.to_pylist() for c in b.columns)):
                x = tokens_of(t)
                keys.append(k)
                kept.append(x)
                out_flags.append(h)
                size += len(x)
                if size >= BLOCK_TOKENS:
                    yield flush()
        if kept:
            yield flush()

    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).alias("k"), (F.crc32(text_id) % modulus == held).alias("h"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(
        run, f"block long, keys array<{kind}>, held array<boolean>, lengths binary, numbers binary, words binary, counts binary, n_train long, n_words long"
    )


def part_of(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def ask_words(bits: int):
    """A block's words and training counts, by partition: runs of its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw, counts in zip(*(c.to_pylist() for c in b.columns)):
                words, counts = unpack_sorted(raw), unpack(counts)
                cuts = np.searchsorted(part_of(words, bits), np.arange((1 << bits) + 1))
                rows = [(p, block, pack_sorted(words[i:j]), pack(counts[i:j])) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["part", "block", "words", "counts"])

    return run


def count_words(bits: int):
    """One partition's word table: global counts and numbers, the frequent words first, for every block that asked."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blocks = table.column("block").to_pylist()
        asked = [unpack_sorted(w) for w in table.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpack(c) for c in table.column("counts").to_pylist()]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        number = (rank << bits) | part
        ends = np.cumsum([len(a) for a in asked])
        parts = np.split(at, ends[:-1])
        known = int((counts > 0).sum())
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "part": pa.array([part] * len(blocks), pa.int64()),
                "count": pa.array([pack(counts[i]) for i in parts], pa.binary()),
                "number": pa.array([pack(number[i]) for i in parts], pa.binary()),
                "known": pa.array([known] * len(blocks), pa.int64()),
            }
        )

    return run


def joined(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of a block's words, in the order of their hashes."""
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column("count").to_pylist(), answers.column("number").to_pylist()))
    return np.concatenate([unpack(r[1]) for r in rows]), np.concatenate([unpack(r[2]) for r in rows])


def mixed(x: np.ndarray) -> np.ndarray:
    y = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return y ^ (y >> np.uint64(29))


class Pairs:
    """A block's distinct (context, word) pairs, ordered by partition, context and word; the end opens each text."""

    def __init__(self, block: dict, count: np.ndarray, number: np.ndarray, bits: int, hot_from: float):
        self.lengths, w = unpack(block["lengths"]), unpack(block["numbers"])
        starts = np.cumsum(self.lengths) - self.lengths
        ctx = np.empty_like(w)
        ctx[1:] = w[:-1]
        ctx[starts] = w[-1]  # every text ends with the end
        self.word, self.context = w, ctx
        n = len(count)
        pair, self.at = np.unique(ctx * n + w, return_inverse=True)
        self.held = np.array(block["held"], bool)
        trained = np.repeat(~self.held, self.lengths)
        times = np.bincount(self.at[trained], minlength=len(pair))
        c, x = pair // n, pair % n
        hot = count[c] >= hot_from
        shift = np.uint64(64 - bits)
        part = np.where(hot, mixed(number[x]) >> shift, mixed(number[c]) >> shift).astype(np.int64)
        order = np.lexsort((number[x], number[c], part))
        place = np.empty(len(pair), np.int64)
        place[order] = np.arange(len(pair))
        self.at = place[self.at]
        self.c, self.x, self.part, self.times, self.hot = c[order], x[order], part[order], times[order], hot[order]
        self.cuts = np.searchsorted(self.part, np.arange((1 << bits) + 1))


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


PAIR_FIELDS = [("part", pa.int64()), ("block", pa.int64()), ("contexts", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("times", pa.binary()), ("counts", pa.binary()), ("hot", pa.binary())]


def ask_pairs(bits: int, hot_from: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row, (count, number) = block.to_pylist()[0], joined(answers)
        p = Pairs(row, count, number, bits, hot_from)
        out: list[tuple] = []
        for part, (i, j) in enumerate(zip(p.cuts, p.cuts[1:])):
            if j > i:
                c = number[p.c[i:j]]
                first = runs_of(c)
                out.append((part, row["block"], pack(c[first]), pack(np.diff(np.append(first, j - i))), pack(number[p.x[i:j]]), pack(p.times[i:j]), pack(count[p.x[i:j]]), pack(p.hot[i:j][first])))
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(PAIR_FIELDS)})

    return run


ANSWER_FIELDS = [("block", pa.int64()), ("part", pa.int64()), ("seen", pa.binary()), ("ones", pa.binary()), ("mass", pa.binary()), ("totals", pa.list_(pa.int64())), ("hot_contexts", pa.list_(pa.int64())), ("hot_stats", pa.list_(pa.list_(pa.int64())))]


def count_pairs(table: pa.Table) -> pa.Table:
    """One partition's pair table. For every block that asked: each pair's global count, and for each of its contexts
    the number of followers by count 1..5 and the mass of followers under the unigram model (sums of count + 1)."""
    part = table.column("part")[0].as_py()
    blocks = table.column("block").to_pylist()
    ctx_of, word, times, count, hot = [], [], [], [], []
    for c, r, w, t, n, h in zip(*(table.column(x).to_pylist() for x in ("contexts", "runs", "words", "times", "counts", "hot"))):
        c, r, h = unpack(c), unpack(r), unpack(h)
        ctx_of.append(np.repeat(c, r))
        hot.append(np.repeat(h, r))
        word.append(unpack(w))
        times.append(unpack(t))
        count.append(unpack(n))
    sizes = [len(x) for x in word]
    c, w = np.concatenate(ctx_of), np.concatenate(word)
    order = np.lexsort((w, c))
    new = np.empty(len(c), bool)
    sc, sw = c[order], w[order]
    new[0] = True
    new[1:] = (sc[1:] != sc[:-1]) | (sw[1:] != sw[:-1])
    first = np.flatnonzero(new)
    at = np.empty(len(c), np.int64)
    at[order] = np.cumsum(new) - 1
    total = np.bincount(at, np.concatenate(times), len(first)).astype(np.int64)
    uc, un, uh = sc[first], np.concatenate(count)[order][first], np.concatenate(hot)[order][first]
    ctx_first = runs_of(uc)
    which = np.cumsum(np.isin(np.arange(len(uc)), ctx_first)) - 1
    seen = total > 0
    ones = np.zeros((len(ctx_first), TOP), np.int64)
    for r in range(1, TOP + 1):
        ones[:, r - 1] = np.bincount(which[total == r], minlength=len(ctx_first))
    mass = np.zeros(len(ctx_first), np.int64)
    np.add.at(mass, which[seen], un[seen] + 1)
    totals = [int((total == r).sum()) for r in range(1, TOP + 2)]
    is_hot = np.flatnonzero(uh[ctx_first] > 0)
    hot_ids = uc[ctx_first][is_hot].tolist()
    hot_rows = np.concatenate([ones[is_hot], mass[is_hot][:, None]], 1).tolist()
    rows = []
    for i, (block, part_at) in enumerate(zip(blocks, np.split(at, np.cumsum(sizes)[:-1]))):
        own = which[part_at]
        own = own[runs_of(own)]
        rows.append((block, part, pack(total[part_at]), pack(ones[own].ravel()), pack(mass[own]), *((totals, hot_ids, hot_rows) if i == 0 else ([], [], []))))
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(ANSWER_FIELDS)})


def discounts(n: list[int]) -> np.ndarray:
    """Katz's Good-Turing factors for counts 1..5 from the numbers of pairs seen 1..6 times; a count whose factor is
    not between 0 and 1 loses a half instead. Index 0 is unused, the last is 1: no discount."""
    d = np.ones(TOP + 2)
    common = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
    for r in range(1, TOP + 1):
        d[r] = (r - 0.5) / r
        if n[r - 1] and common < 1:
            x = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    return d


def evaluate(bits: int, hot_from: float, n: int, v: int, d: np.ndarray, hot: dict[int, list[int]], names: list[str], key_type: pa.DataType):
    z = float(n + v + 1)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        one, two = answers.filter(pc.is_valid(answers.column("count"))), answers.filter(pc.is_valid(answers.column("seen")))
        count, number = joined(one)
        p = Pairs(row, count, number, bits, hot_from)
        seen = np.zeros(len(p.c), np.int64)
        loss, free = np.zeros(len(p.c)), np.ones(len(p.c))
        weight = np.append(np.arange(1, TOP + 1) * (1 - d[1 : TOP + 1]), 0.0)
        for part, s, o, m in zip(*(two.column(x).to_pylist() for x in ("part", "seen", "ones", "mass"))):
            i, j = p.cuts[part], p.cuts[part + 1]
            seen[i:j] = unpack(s)
            first = runs_of(p.c[i:j])
            ones, mass = unpack(o).reshape(-1, TOP), unpack(m)
            for k in np.flatnonzero(p.hot[i:j][first]):
                whole = hot[int(number[p.c[i + first[k]]])]
                ones[k], mass[k] = whole[:TOP], whole[TOP]
            width = np.diff(np.append(first, j - i))
            loss[i:j] = np.repeat(ones @ weight[:TOP], width)
            free[i:j] = np.repeat((z - mass) / z, width)
        base = (count + 1) / z
        below = base[p.x]
        total = count[p.c].astype(float)
        # A context whose followers are all beyond the discounted counts gives up one count instead.
        extra = np.where(loss <= 0, 1.0, 0.0)
        left = np.where(loss <= 0, 1.0, loss)
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = d[np.minimum(seen, TOP + 1)] * seen / (total + extra)
            back = left / (total + extra) / free * below
        prob = np.where(total == 0, below, np.where(seen > 0, direct, back))
        owner = np.repeat(np.arange(len(p.lengths)), p.lengths)
        add = lambda x: np.bincount(owner, x, len(p.lengths))
        cols = [
            pa.array(row["keys"], key_type),
            pa.array(row["held"], pa.bool_()),
            pa.array(p.lengths, pa.int64()),
            pa.array(add((count[p.word] > 0).astype(float)).astype(np.int64), pa.int64()),
            pa.array([n] * len(p.lengths), pa.int64()),
            pa.array(add(np.log10(base)[p.word]), pa.float64()),
            pa.array(add(np.log10(prob)[p.at]), pa.float64()),
        ]
        return pa.Table.from_arrays(cols, names)

    return run


def katz_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per input row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32 of the id as text, modulo `modulus`, is not `held`. Tokens: the words, A-Z in lower
    case, then one end; the end also stands before the first word. The unigram model is (c + 1) / (N + V + 1), which
    leaves one share for all unknown words. A pair seen c times after a context seen C times has d(c) * c / C, d from
    Good-Turing counts of counts up to 5; all else after that context has the unigram model's shares of what is left,
    divided by the mass of the words not seen there, so every context's probabilities sum to 1. A context never seen
    has the unigram model.

    Null and empty texts are one end. Repeated rows count each time; a null id counts as empty text for the remainder;
    without training rows every word is unknown; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    key_type = docs.select(F.col(id_col).alias("k")).schema["k"].dataType
    blocks = cut(blocks_of(docs, text_col, id_col, modulus, held))
    n, entries = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, entries / PART_ENTRIES)))))
    asked = blocks.select("block", "words", "counts").mapInArrow(ask_words(bits), "part long, block long, words binary, counts binary")
    words = cut(asked.groupBy("part").applyInArrow(count_words(bits), "block long, part long, count binary, number binary, known long"))
    v = words.groupBy("part").agg(F.first("known").alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    pair_bits = bits + 1
    hot_from = max(1000.0, n / (4 << pair_bits))
    texts = blocks.select("block", "keys", "held", "lengths", "numbers")
    pairs = texts.groupBy("block").cogroup(words.drop("known").groupBy("block")).applyInArrow(
        ask_pairs(pair_bits, hot_from), "part long, block long, contexts binary, runs binary, words binary, times binary, counts binary, hot binary"
    )
    answers = cut(
        pairs.groupBy("part").applyInArrow(
            count_pairs, "block long, part long, seen binary, ones binary, mass binary, totals array<long>, hot_contexts array<long>, hot_stats array<array<long>>"
        )
    )
    sums = answers.filter(F.size("totals") > 0).agg(*[F.coalesce(F.sum(F.col("totals")[r]), F.lit(0)) for r in range(TOP + 1)]).first()
    # At most 4 * 2 ** pair_bits contexts are hot: each has that share of all tokens.
    spread = answers.select(F.explode(F.arrays_zip("hot_contexts", "hot_stats")).alias("h")).groupBy(F.col("h.hot_contexts").alias("c"))
    hot = {r[0]: list(r[1:]) for r in spread.agg(*[F.sum(F.col("h.hot_stats")[i]) for i in range(TOP + 1)]).collect()}
    one = words.select("block", "part", "count", "number", F.lit(None).cast("binary").alias("seen"), F.lit(None).cast("binary").alias("ones"), F.lit(None).cast("binary").alias("mass"))
    two = answers.select("block", "part", F.lit(None).cast("binary").alias("count"), F.lit(None).cast("binary").alias("number"), "seen", "ones", "mass")
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    from pyspark.sql.pandas.types import to_arrow_type

    run = evaluate(pair_bits, hot_from, n, v, discounts(list(sums)), hot, names, to_arrow_type(key_type))
    kinds = f"`{id_col}` {key_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(one.union(two).groupBy("block")).applyInArrow(run, kinds)
