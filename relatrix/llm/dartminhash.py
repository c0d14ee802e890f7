"""DartMinHash: weighted signatures from hashed darts (numpy, many texts at a time).

Every element owns a Poisson process of darts over its weight axis and a rank axis, drawn from hashes of the element
alone; each dart also carries one of k coordinates. A text sees the darts below its elements' weights and keeps, for
each coordinate, the one of lowest rank. Two texts keep the same dart with a chance equal to their weighted Jaccard
similarity. Cells of the plane are visited by ascending rank, so a text of any size looks at about k ln k + 2 k darts
besides one cell per element.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MEMORY = 200_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words (some 25 MB; very long ones are not)."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = WordHashes()


def forget_words() -> None:
    """Empty the memory of word hashes at a task's end: its worker may go on with other work."""
    _words.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    x = x + M1
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): all windows of `size` words of every text; a shorter text with words is one window."""
    found = [WORDS.findall(t) for t in texts]
    counts = np.array([len(w) for w in found], np.int64)
    total = int(counts.sum())
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(found)), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if total >= size:
        n = total - size + 1
        out = h[:n].copy()
        for i in range(1, size):
            out = out * M2 + h[i : i + n]
        inside = owner[:n] == owner[size - 1 :]
        out, owner_out = mix(out[inside]), owner[:n][inside]
    else:
        out, owner_out = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(short):
        ones = [mix(np.array([sum(pow(int(M2), len(found[i]) - 1 - j, 1 << 64) * _words[w] for j, w in enumerate(found[i])) % (1 << 64)], np.uint64))[0] for i in short]
        out, owner_out = np.concatenate([out, np.array(ones, np.uint64)]), np.concatenate([owner_out, short])
    return out, owner_out


def _sorted(items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ordered by owner and item (as signed numbers), and which of them are the first of their kind."""
    order = np.lexsort((items.view(np.int64), owner))
    items, owner = items[order], owner[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    return items, owner, new


def weighted(items: np.ndarray, owner: np.ndarray, weights: str = "count") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (item, owner) by owner, with the number of times each occurs (1 with weights="set")."""
    items, owner, new = _sorted(items, owner)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(items))) if weights == "count" else np.ones(len(at), np.int64)
    return items[at], owner[at], times


def elements(items: np.ndarray, owner: np.ndarray, weights: str = "count") -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements by owner, ascending as signed numbers: each item and, with weights="count", one more element
    for every further occurrence in its text."""
    items, owner, new = _sorted(items, owner)
    at = np.flatnonzero(new)
    if weights != "count":
        return items[at], owner[at]
    if len(at) == len(items):
        return items, owner
    nth = np.arange(len(items)) - np.repeat(at, np.diff(np.append(at, len(items))))
    again = nth > 0
    items[again] = mix(items[again] ^ mix(nth[again].astype(np.uint64)))
    items, owner, new = _sorted(items, owner)
    return items[new], owner[new]


def _steps(area: float) -> np.ndarray:
    """P(Poisson(area) <= i) for i = 0, 1, ...; area is 1 at most."""
    terms = [np.exp(-area)]
    for i in range(1, 16):
        terms.append(terms[-1] * area / i)
    return np.cumsum(terms)


def _darts(elements, weights, owner, reach, k):
    """(cell of owner and coordinate, rank, dart id) of the darts with rank <= reach[owner] under each weight.

    Weight cells are [0, 1), [1, 2), [2, 4), ...; rank cells are [0, 1/8), [1/8, 1/2), [1/2, 2), ... A cell larger
    than 1 is cut along its rank into parts of area 1 at most. All of that is fixed; only which parts are visited
    depends on the text. weights None: all are 1.
    """
    out = []
    top = 1.0 if weights is None else float(weights.max())
    low_w, span_w, v = 0.0, 1.0, 0
    while low_w < top:
        e, x, o = elements, weights, owner
        if weights is not None:
            inside = weights > low_w
            e, x, o = elements[inside], weights[inside], owner[inside]
        low_r, high_r, c = 0.0, 1.0 / 8, 0
        while len(e):
            parts = max(1, int(np.ceil(span_w * (high_r - low_r))))
            dr = (high_r - low_r) / parts
            for p in range(parts):
                r0 = low_r + dr * p
                near = reach[o] > r0
                if not near.all():
                    e, o = e[near], o[near]
                    x = x if x is None else x[near]
                if len(e) == 0:
                    break
                seed = mix(e ^ np.uint64(v << 40 | c << 20 | p))
                steps = _steps(span_w * dr)
                u = unit(seed)
                some = np.flatnonzero(u >= steps[0])
                if len(some) == 0:
                    continue
                n = np.searchsorted(steps, u[some], side="right")
                at = np.repeat(some, n)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                d = mix(seed[at] + M1 * (nth + 1).astype(np.uint64))
                r = r0 + dr * unit(mix(d ^ M3))
                ok = r <= reach[o[at]]
                if x is not None and not (x >= low_w + span_w).all():
                    ok &= low_w + span_w * unit(mix(d ^ M2)) < x[at]
                d, at, r = d[ok], at[ok], r[ok]
                out.append((o[at] * k + (d % np.uint64(k)).astype(np.int64), r, d))
            low_r, high_r, c = high_r, high_r * 4, c + 1
        low_w, span_w, v = low_w + span_w, max(low_w + span_w, 1.0), v + 1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64))


def signatures(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """One row of k dart ids for each of `texts` texts; zeros where a text owns no element.

    `owner` ascends. An element may be listed twice with weights None: its darts are the same.
    """
    sig = np.zeros((texts, k), np.uint64)
    factor = k * np.log(k) + 2 * k
    while len(elements):
        ids, own = np.unique(owner, return_inverse=True)
        reach = factor / np.bincount(own, weights, len(ids))
        cell, r, d = _darts(elements, weights, own, reach, k)
        best = np.full(len(ids) * k, np.inf)
        np.minimum.at(best, cell, r)
        part = np.zeros(len(ids) * k, np.uint64)
        lowest = r == best[cell]
        part[cell[lowest]] = d[lowest]
        done = np.isfinite(best).reshape(-1, k).all(1)
        sig[ids[done]] = part.reshape(-1, k)[done]
        again = ~done[own]
        elements, owner, weights = elements[again], owner[again], weights if weights is None else weights[again]
        factor *= 2
    return sig


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of consecutive groups of `rows` coordinates, each with its position."""
    n, k = sig.shape
    out = np.empty((n, k // rows), np.uint64)
    for b in range(k // rows):
        h = np.full(n, np.uint64(b + 1))
        for c in range(b * rows, (b + 1) * rows):
            h = mix(h ^ sig[:, c])
        out[:, b] = h
    return out.view(np.int64)
