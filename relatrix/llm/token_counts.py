"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .wordtokens import library, parts_at_blanks, tokenizer_path

BATCH_BYTES = 512 << 10
#: A text longer than this is encoded in pieces of about so many characters.
PIECE = 32 << 10
BLANK = re.compile(r"[ \t\n\r]")


def byte_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes; a longer row is a batch of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(0)), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            yield b.slice(at, end - at)


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """`text` in pieces that end before a blank, of `limit` characters at most unless a single word is longer."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(c, at + 1, at + limit) for c in " \t\n\r")
        if end < 0:
            m = BLANK.search(text, at + limit)
            end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def token_counts(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, limit: int = 2048
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each; a null id stays null. Any other
    column of `docs` is ignored, whatever its name. Whole texts are counted: texts go to the library in batches of
    about 512 kB, and only the lengths come back. With a tokenizer that drops blanks and merges nothing across them a
    long text is split at blanks over as many batches as it fills; with any other it is encoded whole. One narrow
    stage, no shuffle.
    """
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, split = library(path), parts_at_blanks(path)

        def lengths(parts: list[str]) -> list[int]:
            return [len(e) for e in lib.encode_batch_fast(parts, add_special_tokens=False)]

        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            parts: list[str] = []
            owner: list[int] = []
            held = 0
            for row, t in enumerate(b.column(0).to_pylist()):
                for part in (pieces(t) if split else [t]) if t else []:
                    parts.append(part)
                    owner.append(row)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        np.add.at(n, owner, lengths(parts))
                        parts, owner, held = [], [], 0
            if parts:
                np.add.at(n, owner, lengths(parts))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(n)], ["k", "n_bytes", "n_tokens"])

    src = docs.select(
        F.col(text_col).alias("t"), F.col(id_col).alias("k"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
