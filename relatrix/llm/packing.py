"""Cost-balanced packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .memory import give_back
from .token_counts import byte_batches
from .wordtokens import tokenizer_path, worker_tokens

END = (1).to_bytes(4, "little")
BATCH_BYTES = 4 << 20


def place(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Sequences of (document, start, length) for documents shorter than `size`; the number of full ones comes first.

    Documents go in descending order to the cheapest of all open sequences with room, where a piece of n tokens costs
    linear * n + quadratic * n * n. Those that no sequence can hold whole are cut to fill what is left. The
    tokens beyond the last full sequence are laid out as sequences whose lengths are powers of two: no padding.
    """
    total = sum(lengths)
    n = total // size
    cost = lambda k: linear * k + quadratic * k * k
    room, spent, held = [size] * n, [0.0] * n, [[] for _ in range(n)]
    # Heaps of (spent, sequence) by the room left, and over them a tree whose nodes hold the least of their rooms.
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
    none = (math.inf, -1)
    leaves = 1 << size.bit_length()
    least = [none] * (2 * leaves)

    def settle(r: int) -> None:
        i = leaves + r
        least[i] = heaps[r][0] if heaps[r] else none
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    def cheapest(k: int) -> int:
        best, i, end = none, leaves + k, 2 * leaves
        while i < end:
            if i & 1:
                best = min(best, least[i])
                i += 1
            i, end = i >> 1, end >> 1
        return best[1]

    heaps[size] = [(0.0, s) for s in range(n)]
    settle(size)
    rest: list[tuple[int, int, int]] = []

    def put(s: int, piece: tuple[int, int, int]) -> None:
        held[s].append(piece)
        room[s] -= piece[2]
        spent[s] += cost(piece[2])

    for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = lengths[d]
        to = cheapest(k)
        if to < 0:
            rest.append((d, 0, k))
            continue
        heapq.heappop(heaps[room[to]])
        settle(room[to])
        put(to, (d, 0, k))
        if room[to]:
            heapq.heappush(heaps[room[to]], (spent[to], to))
            settle(room[to])
    spare = [s for _, s in sorted(x for h in heaps for x in h)]
    tail: list[tuple[int, int, int]] = []
    for d, at, k in rest:
        while k and spare:
            s = spare[0]
            take = min(k, room[s])
            put(s, (d, at, take))
            at, k = at + take, k - take
            if not room[s]:
                spare.pop(0)
        if k:
            tail.append((d, at, k))
    left = total - n * size
    for bit in reversed(range(size.bit_length())):
        want = 1 << bit
        if not left & want:
            continue
        held.append([])
        while want:
            d, at, k = tail.pop(0)
            take = min(k, want)
            held[-1].append((d, at, take))
            want -= take
            if take < k:
                tail.insert(0, (d, at + take, k - take))
    return held, n


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    size: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    pool_tokens: int = 4_000_000,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document's ids (its tokens, then id 1), with the sequence and offset that hold it.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, and with `keep_ids`
    the ids themselves as little-endian binary. A null or empty text is the single id 1. Repeated rows are packed
    each on its own; a null id stays null; other columns are ignored; an empty table gives no rows.

    A document's whole multiples of `size` are full sequences of their own. Remainders are packed within bounded
    pools of each input partition, so there is no shuffle, no hot key, and a task that runs again on the same
    partition gives the same sequences.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(path)
        sequence = TaskContext.get().partitionId() << 40
        pool: list[tuple[object, bytes, int]] = []  # id, ids, start of the remainder
        pooled = 0
        names = ["k", *(x.split()[0] for x in PIECES.split(", ")), "ids"][: 9 if keep_ids else 8]
        key_type: pa.DataType | None = None

        def flush() -> pa.RecordBatch:
            nonlocal sequence, pool, pooled
            cols: list[list] = [[] for _ in names]

            def emit(key, ids, at, k, offset, whole):
                part = ids[4 * at : 4 * (at + k)]
                row = (key, at, k, zlib.crc32(part), len(ids) // 4, sequence, offset, whole, part)
                for c, v in zip(cols, row):
                    c.append(v)

            for key, ids, start in pool:
                for at in range(0, start, size):
                    emit(key, ids, at, size, 0, size)
                    sequence += 1
            short = [x for x in pool if len(x[1]) // 4 > x[2]]
            held, _ = place([len(x[1]) // 4 - x[2] for x in short], size, linear, quadratic)
            for pieces in held:
                offset, whole = 0, sum(p[2] for p in pieces)
                for d, at, k in pieces:
                    key, ids, start = short[d]
                    emit(key, ids, start + at, k, offset, whole)
                    offset += k
                sequence += 1
            pool, pooled = [], 0
            kinds = [key_type, *[pa.int64()] * 7, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for b in byte_batches(batches, BATCH_BYTES):
            key_type = b.schema.field(1).type
            for text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = (tokens.ids(text) if text else b"") + END
                n = len(ids) // 4
                pool.append((key, ids, n - n % size))
                pooled += n
                if pooled >= pool_tokens:
                    yield flush()
        if pool:
            yield flush()
        give_back()

    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("k"))
    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(run, f"k {kind}, {PIECES}" + (", ids binary" if keep_ids else ""))
    return out.withColumnRenamed("k", id_col)
