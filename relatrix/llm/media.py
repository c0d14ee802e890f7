"""GIF media columns: text payloads stored as timed gray frames, and GIF columns read into frames and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from . import gif
from .token_counts import byte_batches

WIDTH = 64
ROWS = 4096
DELAY_CS = 10
BINS = 16
BATCH_BYTES = 4 << 20
FRAME = "struct<at_ms:bigint,delay_ms:bigint,disposal:int,left:int,top:int,width:int,height:int,red:array<bigint>,green:array<bigint>,blue:array<bigint>>"
FRAME_TYPE = pa.struct(
    [("at_ms", pa.int64()), ("delay_ms", pa.int64()), *((n, pa.int32()) for n in ("disposal", "left", "top", "width", "height")), *((n, pa.list_(pa.int64())) for n in ("red", "green", "blue"))]
)


def store_payload(payload: bytes) -> bytes:
    """A GIF of 64 columns whose gray samples are the payload, 4,096 rows a frame; its length is a multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [gif.Frame(rows[i : i + ROWS], delay_cs=DELAY_CS, disposal=1) for i in range(0, len(rows), ROWS)]
    return gif.encode(frames, WIDTH, min(len(rows), ROWS))


def store_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id, n_bytes, media. The text's UTF-8 bytes (null: none), then zeros up to a positive
    multiple of 64, as the samples of a GIF. Repeated rows give equal media; other columns are ignored."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, BATCH_BYTES):
            media = [store_payload(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH, b"\0")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(media, pa.binary())], ["k", "n_bytes", "media"])

    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    src = docs.select(raw.alias("t"), F.col(id_col).alias("k"), F.octet_length(raw).cast("long").alias("n_bytes"))
    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, n_bytes long, media binary")
    return out.withColumnRenamed("k", id_col)


def read_one(data: bytes) -> tuple[list[dict], bytes]:
    """Frames with time, place and a 16-bin histogram of each colour of the visible canvas; the red samples of each
    frame's box."""
    width, height, shared, frames = gif.decode(data)
    out, samples, at = [], [], 0
    for f, canvas in zip(frames, gif.shown(width, height, shared, frames)):
        h, w = f.pixels.shape
        seen = canvas[canvas[..., 3] > 0]
        red, green, blue = (np.bincount(seen[:, c] >> 4, minlength=BINS).tolist() for c in range(3))
        place = dict(left=f.left, top=f.top, width=w, height=h)
        out.append(dict(at_ms=at, delay_ms=10 * f.delay_cs, disposal=f.disposal, **place, red=red, green=green, blue=blue))
        samples.append(canvas[f.top : f.top + h, f.left : f.left + w, 0].tobytes())
        at += 10 * f.delay_cs
    return out, b"".join(samples)


def read_gifs(rows: DataFrame, media_col: str = "media", samples: bool = False) -> DataFrame:
    """`rows` with the columns frames (timed, with colour histograms), media_error and, on demand, samples.

    A null medium has null frames and no error; what is no whole GIF has null frames and the reason. An input column
    of one of these names is replaced.
    """
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, BATCH_BYTES):
            frames, errors, raw = [], [], []
            for data in b.column(0).to_pylist():
                f = e = s = None
                if data is not None:
                    try:
                        f, s = read_one(data)
                    except (ValueError, IndexError) as x:
                        e = str(x) or "broken"
                frames.append(f)
                errors.append(e)
                raw.append(s if samples else None)
            new = [pa.array(frames, pa.list_(FRAME_TYPE)), pa.array(errors, pa.string()), *([pa.array(raw, pa.binary())] if samples else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names)

    made = {"frames": f"array<{FRAME}>", "media_error": "string", **({"samples": "binary"} if samples else {})}
    kept = [f for f in rows.schema.fields if f.name not in made and f.name != media_col]
    src = rows.select(F.col(media_col).alias("c0"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept, 1)])
    names = [*src.columns, *made]
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields] + [f"{k} {v}" for k, v in made.items()])
    return src.mapInArrow(run, ddl).toDF(media_col, *[f.name for f in kept], *made)


def payload_digest(docs: DataFrame) -> DataFrame:
    """The op8 rows: texts stored as GIF, read back, and described."""
    d = read_gifs(store_texts(docs), samples=True)
    size = F.octet_length("samples")
    bins = lambda f: F.concat(f["red"], f["green"], f["blue"])
    hist = F.transform("frames", lambda f: F.array_join(F.transform(bins(f), lambda n: n.cast("string")), ","))
    return d.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("rgb16:"), F.array_join(hist, ";")).alias("feature"),
    )
