"""Quality classifier: generalised additive model with pairwise interactions, scored by table additions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .labelled import text_remainder, training_rows

FEATURES = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "distinct_pairs", "upper", "digits", "stops", "shouts",
    "symbols", "pipes", "non_ascii", "lines_per_word", "repeated_lines", "mean_line", "compressed", "ends_well",
)
UPPER, DIGITS, STOPS, SHOUTS, SYMBOLS, PIPES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&<>@^~=_\\", b"|"
ASCII = bytes(range(128))


def features(text: str) -> list[float]:
    """Fixed-length description of a whole text; all zeros for an empty one."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, size = len(words), len(raw)
    if n == 0:
        return [0.0] * len(FEATURES)
    share = lambda marks: (size - len(raw.translate(None, marks))) / size
    lines = [x for x in text.split("\n") if x]
    ends = sum(1 for x in lines if x.rstrip()[-1:] in ".!?:;\"'”»)")
    return [
        float(np.log1p(size)), float(np.log1p(n)), len(text) / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / max(1, n - 1),
        share(UPPER), share(DIGITS), share(STOPS), share(SHOUTS), share(SYMBOLS), share(PIPES), len(raw.translate(None, ASCII)) / size,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(size / max(1, len(lines)))), len(zlib.compress(raw, 1)) / size, ends / max(1, len(lines)),
    ]


def step(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: per bin, the Newton value of its leaf after best splits."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    edges = [0, len(g)]
    for _ in range(leaves - 1):
        best, at = 1e-9, -1
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                v = gain(a, m) + gain(m, b) - gain(a, b)
                i = int(np.argmax(v))
                if v[i] > best:
                    best, at = v[i], int(m[i])
        if at < 0:
            break
        edges = sorted([*edges, at])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def box_step(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A depth-two tree over two binned features: the split of the first for which one split of the second on either
    side gains most."""
    best, out = -1.0, np.zeros_like(g)
    for r in range(1, len(g)):
        sides = [step(g[part].sum(0), h[part].sum(0), 2, ridge) for part in (slice(None, r), slice(r, None))]
        # A leaf of value v gains v * (its gradient).
        gain = float((sides[0] * g[:r].sum(0)).sum() + (sides[1] * g[r:].sum(0)).sum())
        if gain > best:
            best = gain
            out[:r], out[r:] = sides
    return out


@dataclass
class AdditiveModel:
    """score = sigmoid(intercept + one table per feature at its bin + one table per pair at both bins)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, t in self.pairs:
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 64, coarse: int = 8, pairs: int = 8, leaves: int = 3, ridge: float = 4.0) -> AdditiveModel:
    """Cyclic boosting: every round gives each feature in turn one shallow tree's step, so that no feature takes all;
    then the `pairs` pairs with the largest residual gain are boosted the same way over coarse bins."""
    model = AdditiveModel()
    if len(y) == 0:
        return model
    prior = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(prior / (1 - prior)))
    cut = lambda n, f: np.unique(np.quantile(x[:, f], np.arange(1, n) / n))
    d = x.shape[1]
    model.edges, model.coarse = [cut(bins, f) for f in range(d)], [cut(coarse, f) for f in range(d)]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(d):
            g, h = slopes()
            n = len(model.tables[f])
            move = rate * step(np.bincount(at[f], g, n), np.bincount(at[f], h, n), leaves, ridge)
            model.tables[f] += move
            total += move[at[f]]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]
    g, h = slopes()

    def gain(i: int, j: int) -> float:
        cell, n = low[i] * sizes[j] + low[j], sizes[i] * sizes[j]
        return float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + ridge)).sum())

    chosen = sorted(((gain(i, j), i, j) for i in range(d) for j in range(i)), reverse=True)[:pairs]
    boxes = {(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in chosen}
    for _ in range(rounds // 4):
        for (i, j), box in boxes.items():
            g, h = slopes()
            cell, n = low[i] * sizes[j] + low[j], sizes[i] * sizes[j]
            gs, hs = np.bincount(cell, g, n).reshape(box.shape), np.bincount(cell, h, n).reshape(box.shape)
            move = box_step(gs, hs, ridge)
            box += rate * move
            total += rate * move[low[i], low[j]]
    model.pairs = [(i, j, t) for (i, j), t in boxes.items()]
    return model


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per input row: the id, held_out, score, predicted. Null and empty texts score as all-zero features;
    repeated rows are scored each; only the text counts. One narrow stage."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(model.probability(x), pa.float64())], ["k", "score"])

    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("k"))
    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, score double")
    return out.select(F.col("k").alias(id_col), (text_remainder("k", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> DataFrame:
    """Fit on at most about `max_rows` labelled rows outside the held-out fifth, then score every row of `docs`.

    The driver gets the sample's features only: 17 numbers a row.
    """
    prepare(docs.sparkSession)
    names = {k: v for k, v in options.items() if k in ("text_col", "id_col")}
    train = training_rows(docs, labels, "quality", max_rows, **names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = train.select("t", "y").mapInArrow(measure, "x array<double>, y int").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    return score(docs, fit(x, (got["y"].to_numpy() > 0).astype(float)), **options)
