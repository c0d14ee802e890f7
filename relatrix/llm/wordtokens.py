"""Token ids of whole texts with a public tokenizer file, one library call per distinct word.

The tokenizer drops white space and never merges across it, and none of its normalisation steps looks past an
ASCII blank. A text may therefore be cut at every blank, tab, line feed or carriage return without changing its
ids. Words repeat, so each worker remembers the ids of the words it has met; the memory is emptied at a fixed size.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import json
import re
from functools import cache

import numpy as np

DEFAULT_FILE = "word_bpe_49k.json"
CACHE_WORDS = 900_000
_LONG = 64
#: Words of Latin-1 letters, then stops at most: one or two pieces for the pre-tokenizer, whatever stands around them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_loaded: dict[str, "WordTokens"] = {}


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(path: str):
    """The library's tokenizer for a file, without truncation and padding; one per worker process."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    return lib


@cache
def parts_at_blanks(path: str) -> bool:
    """Whether a text may be cut at its blanks: the file's pre-tokenizer keeps only what its pattern finds, that is no
    blank, and no added token has a blank or takes those around it."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [j.get("pre_tokenizer") or {}]
    drops = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps)
    plain = all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in j.get("added_tokens", []))
    lib = library(path)
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    return drops and plain and all(ids(f"a{x}b") == ids("a") + ids("b") for x in (" ", "\n", "\t ", "\r\n"))


class WordTokens:
    """ids(text) gives little-endian unsigned 32-bit ids; the library's own result for the whole text."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        if not parts_at_blanks(path):
            raise ValueError(f"{path} does not drop blanks: its texts cannot be encoded word by word")
        self.lib = library(path)
        ends = np.zeros(self.lib.get_vocab_size(), bool)
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        for piece, i in self.lib.get_vocab(with_added_tokens=False).items():
            ends[i] = bool(suffix) and piece.endswith(suffix)
        self.ends = ends if ends.any() else None
        self.cache_words = cache_words
        self.cache: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word. A plain word has those of its lower-case letters, then those of its stops. Letters
        not met yet go to the library as one text, which is parted after the ids that end a piece; if these are not
        one for each, and for all other words, every word is a text of its own."""
        out: dict[str, bytes] = {}
        if self.ends is not None:
            cache = self.cache
            plain = [(m[0], m[1].lower(), m[2]) for m in map(_PLAIN.fullmatch, words) if m]
            stems = [x for x in {p[1] for p in plain} if x not in cache and len(x) <= _LONG]
            if stems:
                ids = np.array(self.lib.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(stems):
                    raw, at = ids.tobytes(), 0
                    for x, end in zip(stems, ((last + 1) * 4).tolist()):
                        cache[x] = raw[at:end]
                        at = end
            for w, stem, stops in plain:
                if (v := cache.get(stem)) is not None:
                    if stops and stops not in cache:
                        cache[stops] = np.array(self.lib.encode(stops, add_special_tokens=False).ids, "<u4").tobytes()
                    out[w] = v + cache[stops]
            words = [w for w in words if w not in out]
        got = self.lib.encode_batch_fast(words, add_special_tokens=False)
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, got))
        return out

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            pass
        if len(cache) > self.cache_words:
            cache.clear()
            cache[""] = b""
        fresh = [w for w in dict.fromkeys(words) if w not in cache]
        got = self.learn(fresh)
        if len(max(fresh, key=len)) <= _LONG:
            cache.update(got)
            return b"".join(map(cache.__getitem__, words))
        cache.update((w, v) for w, v in got.items() if len(w) <= _LONG)
        return b"".join([v if (v := cache.get(w)) is not None else got[w] for w in words])


def worker_tokens(path: str) -> WordTokens:
    """One instance per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
