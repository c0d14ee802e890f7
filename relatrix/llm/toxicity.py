"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .labelled import text_remainder, training_rows

EULER = 0.5772156649015329
#: Marks that may end or open a word; a token is the lower-case word without them.
MARKS = ".,;:!?\"'()[]«»“”¡¿…*"


def tokens_of(text: str) -> list[str]:
    return [w.strip(MARKS) for w in text.lower().split()]


def segments(scores: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time.

    `scores` are the (position, score) of the tokens that have a score of their own, ascending; each token between
    two of them scores `gap` (negative). A new candidate joins all since the nearest earlier one with a smaller left
    sum when it ends higher. Each candidate keeps a link to that earlier one, which later searches follow; where there
    is none, all earlier candidates are final and leave the list.
    """
    done: list[tuple[int, int, float]] = []
    open_: list[tuple[int, int, float, float, int]] = []  # first, last, left sum, right sum, link
    total, at = 0.0, None
    for position, score in scores:
        if at is not None:
            total += gap * (position - at - 1)
        at = position
        low = total
        total += score
        if score <= 0:
            continue
        first, high = position, total
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= low:
                j = open_[j][4]
            if j < 0:
                done += [(a, b, r - l) for a, b, l, r, _ in open_]
                open_ = [(first, position, low, high, -1)]
                break
            if open_[j][3] >= high:
                open_.append((first, position, low, high, j))
                break
            first, low = open_[j][0], open_[j][2]
            del open_[j:]
    return done + [(a, b, r - l) for a, b, l, r, _ in open_]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]  # tokens whose score differs from `gap`
    gap: float
    rate: float  # Karlin-Altschul lambda
    log_k: float
    slope: float
    offset: float
    alpha: float = 0.05

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int, float]], float]:
        """Significant segments and the document's aggregate: the sum of their normalised scores."""
        get = self.weights.get
        own = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        kept, sum_score = [], 0.0
        size = math.log(max(len(words), 1))
        for a, b, s in segments(own, self.gap):
            normal = self.rate * s - self.log_k - size
            if -math.expm1(-math.exp(min(-normal, 50.0))) <= self.alpha:
                kept.append((a, b, s))
                sum_score += normal
        return kept, sum_score

    def probability(self, aggregate: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(aggregate) + self.offset))))


def log_odds(toxic: Counter, clean: Counter, prior: float = 500.0, z: float = 2.0, gap: float = -0.5, most: float = 8.0) -> dict[str, float]:
    """Token scores from document counts: log-odds with a Dirichlet prior (`prior` in proportion to the pooled counts,
    and a half for each token), moved `z` standard deviations towards 0, plus `gap`. Tokens within a quarter of 0
    after that are left out: they score `gap`."""
    n1, n0 = sum(toxic.values()), sum(clean.values())
    pooled = n1 + n0
    out = {}
    for w in toxic.keys() | clean.keys():
        y1, y0 = toxic[w], clean[w]
        if y1 + y0 < 3 or not w:
            continue
        a = prior * (y1 + y0) / pooled + 0.5
        delta = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        sure = abs(delta) - z * math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if sure > 0.25:
            out[w] = min(most, sure) + gap if delta > 0 else max(-most, -sure) + gap
    return out


def positive_root(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive rate at which the mean of exp(rate * score) over clean tokens is 1; the scores' mean is negative."""
    if not (values > 0).any():
        return 1.0
    f = lambda r: float((shares * np.exp(r * values)).sum()) - 1
    low, high = 0.0, 0.05
    while f(high) < 0 and high < 20:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit by damped Newton steps with a small ridge."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit(train: DataFrame) -> ToxicityModel:
    """From training_rows(): two thirds give token counts, the rest the calibration. Texts stay on the executors;
    the driver gets the counts of tokens met three times or more and one number a document, bounded by the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c[y > 0].update(set(tokens_of(t)))
        words = list(c[0].keys() | c[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([c[0][w] for w in words], pa.int64()), pa.array([c[1][w] for w in words], pa.int64())], ["w", "n0", "n1"])

    first = train.filter("u < 0.67").select("t", "y")
    counts = first.mapInArrow(count, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = counts.filter("n0 + n1 >= 3").collect()
    clean, toxic = Counter({r.w: r.n0 for r in rows if r.n0}), Counter({r.w: r.n1 for r in rows if r.n1})
    gap = -0.5
    weights = log_odds(toxic, clean, gap=gap) if toxic and clean else {}
    n = max(1, sum(clean.values()))
    values = np.array([*(weights.values()), gap])
    shares = np.array([clean[w] / n for w in weights])
    shares = np.append(shares, max(0.0, 1 - shares.sum()))
    rate = positive_root(values, shares)
    # Gumbel location from the clean documents' best segments; then a logistic map of the aggregate.
    best = ToxicityModel(weights, gap, rate, -1e9, 0.0, 0.0, alpha=1.1)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(w := tokens_of(t)), max((s[2] for s in best.scan(w)[0]), default=0.0)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["n", "s"])

    tops = train.filter("u >= 0.67 AND y = 0").select("t").mapInArrow(top, "n long, s double").filter("n > 0").toPandas()
    log_k = float((rate * tops["s"] - np.log(tops["n"])).mean() - EULER) if len(tops) else 0.0
    shaped = ToxicityModel(weights, gap, rate, log_k, 0.0, 0.0)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shaped.scan(tokens_of(t))[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.float64())], ["y", "x"])

    seen = train.filter("u >= 0.67").select("t", "y").mapInArrow(aggregate, "y int, x double").toPandas()
    if len(seen) == 0:
        return ToxicityModel(weights, gap, rate, log_k, 1.0, -3.0)
    slope, offset = logistic(np.log1p(seen["x"].to_numpy()), (seen["y"] > 0).to_numpy().astype(float))
    return ToxicityModel(weights, gap, rate, log_k, slope, offset)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """One row per input row: the id, held_out, score, predicted, passages (first word, end word, score).

    Null and empty texts have no passage and the score of that. Only the text counts; repeated rows are scored each;
    other columns are ignored, or carried as the struct `row`. One narrow stage; the model's tokens are bounded by the
    training sample. A text none of whose tokens has a positive score has no segment, so its segments are not looked for.
    """
    prepare(docs.sparkSession)
    positive = frozenset(w for w, s in model.weights.items() if s > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = model.probability(0.0)
        for b in batches:
            probs, spans = [], []
            for t in b.column(0).to_pylist():
                p, found = none, []
                words = tokens_of(t) if t else []
                if not positive.isdisjoint(words):
                    kept, x = model.scan(words)
                    if kept:
                        p = model.probability(x)
                        found = [{"first": a, "end": e + 1, "score": s} for a, e, s in kept]
                probs.append(p)
                spans.append(found)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(probs, pa.float64()), pa.array(spans, kind)], [*b.schema.names[1:], "score", "passages"])

    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("k"), *([F.struct("*").alias("row")] if carry else []))
    kept = [c for c in src.schema.fields if c.name != "t"]
    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in kept)
    out = src.mapInArrow(run, schema + ", score double, passages array<struct<first:bigint,end:bigint,score:double>>")
    return out.select(
        *(["row"] if carry else []),
        F.col("k").alias(id_col),
        (text_remainder("k", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> DataFrame:
    """Fit on at most about `max_rows` labelled rows outside the held-out fifth, then score every row of `docs`."""
    prepare(docs.sparkSession)
    names = {k: v for k, v in options.items() if k in ("text_col", "id_col")}
    return score(docs, fit(training_rows(docs, labels, "toxic", max_rows, **names)), **options)
