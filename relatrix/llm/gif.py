"""GIF files: LZW code streams, palettes, disposal, transparency, frame times."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

FULL = 4096
#: Fixed values of the format: the passes of an interlaced image as (first row, step).
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))
_BASE: dict[int, list[bytes]] = {}
_WIDTHS: dict[int, np.ndarray] = {}


def code_widths(m: int) -> np.ndarray:
    """Bits of the j-th code after a clear code: the table has clear + 2 + j - 1 entries when it is read."""
    if m not in _WIDTHS:
        n = (1 << m) + 1 + np.arange(FULL + 2)
        _WIDTHS[m] = np.minimum(12, np.maximum(m + 1, np.floor(np.log2(n)).astype(np.int64) + 1))
    return _WIDTHS[m]


def lzw_encode(data: bytes, m: int = 8) -> bytes:
    """The code stream of `data` (values below 2 ** m): a clear code first and whenever the table is full."""
    clear = 1 << m
    widths = code_widths(m)
    most = FULL - clear - 2  # entries that a table can gain
    codes: list[int] = []
    runs: list[int] = []  # codes between clear codes
    known: dict[int, int] = {}
    get, add = known.get, codes.append
    free = clear + 2
    begun = 0
    if data:
        w = data[0]
        for b in memoryview(data)[1:]:
            k = w << 8 | b
            n = get(k)
            if n is None:
                add(w)
                known[k] = free
                free += 1
                w = b
                if free == FULL:
                    runs.append(len(codes) - begun)
                    begun = len(codes)
                    known.clear()
                    free = clear + 2
            else:
                w = n
        add(w)
    runs.append(len(codes) - begun)
    flat = np.array(codes, np.uint32)
    parts, bits, at = [np.array([clear], np.uint32)], [np.array([m + 1])], 0
    for i, n in enumerate(runs):
        last = i == len(runs) - 1
        parts += [flat[at : at + n], np.array([clear + 1 if last else clear], np.uint32)]
        bits.append(widths[: n + 1])
        at += n
    assert most > 0
    values, sizes = np.concatenate(parts), np.concatenate(bits)
    place = np.arange(12)
    grid = ((values[:, None] >> place) & 1).astype(np.uint8)
    return np.packbits(grid[place < sizes[:, None]], bitorder="little").tobytes()


def _expand(codes: list[int], m: int, out: list[bytes]) -> None:
    """The strings of the codes between two clear codes."""
    if m not in _BASE:
        _BASE[m] = [bytes((i,)) for i in range(1 << m)] + [b"", b""]
    table = _BASE[m].copy()
    add, put = table.append, out.append
    room = FULL - len(table)
    prev = table[codes[0]]
    put(prev)
    for c in codes[1 : room + 1]:
        try:
            e = table[c]
        except IndexError:
            if c != len(table):
                raise ValueError("LZW code beyond the table") from None
            e = prev + prev[:1]
        add(prev + e[:1])
        put(e)
        prev = e
    for c in codes[room + 1 :]:  # the table is full until a clear code comes
        put(table[c])


def lzw_decode(stream: bytes, m: int) -> bytes:
    """The values of a code stream; it may end without an end code, and a full table may be kept on."""
    clear, end = 1 << m, (1 << m) + 1
    widths = code_widths(m)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total = 8 * len(stream)
    out: list[bytes] = []
    at = 0

    def read(sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        ends = start + np.cumsum(sizes)
        ends = ends[ends <= total]
        o = ends - sizes[: len(ends)]
        i = o >> 3
        return ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (o & 7).astype(np.uint32)) & ((1 << sizes[: len(ends)]) - 1).astype(np.uint32), ends

    while at + m < total:
        held: list[np.ndarray] = []
        sizes, stop = widths, -1
        while True:
            # No more codes are unpacked than the rest of the stream can hold.
            got, ends = read(sizes[: (total - at) // (m + 1) + 1], at)
            marks = np.flatnonzero((got == clear) | (got == end))
            if len(marks):
                held.append(got[: marks[0]])
                stop, at = int(got[marks[0]]), int(ends[marks[0]])
                break
            held.append(got)
            if len(got) < len(sizes):
                at = total
                break
            at, sizes = int(ends[-1]), np.full(FULL, 12, np.int64)
        codes = np.concatenate(held).tolist()
        if codes:
            _expand(codes, m, out)
        if stop == end:
            break
    return b"".join(out)


@dataclass
class Frame:
    """One stored image: palette indices (rows x columns) and how it is shown."""

    pixels: np.ndarray
    left: int = 0
    top: int = 0
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None  # its own colours, n x 3
    interlaced: bool = False


GRAY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _table_bits(palette: np.ndarray) -> int:
    return max(0, int(np.ceil(np.log2(max(2, len(palette))))) - 1)


def _table(palette: np.ndarray) -> bytes:
    return palette.astype(np.uint8).tobytes().ljust(3 << (_table_bits(palette) + 1), b"\0")


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray = GRAY, m: int = 8) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | _table_bits(palette), 0, 0), _table(palette)]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay_cs, f.transparent or 0) + b"\0")
        h, w = f.pixels.shape
        own = 0 if f.palette is None else 0x80 | _table_bits(f.palette)
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, own | (0x40 if f.interlaced else 0)))
        if f.palette is not None:
            out.append(_table(f.palette))
        rows = f.pixels
        if f.interlaced:
            rows = np.concatenate([rows[a::s] for a, s in INTERLACE])
        out.append(bytes([m]))
        codes = lzw_encode(np.ascontiguousarray(rows, np.uint8).tobytes(), m)
        out += [bytes([len(c := codes[i : i + 255])]) + c for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> tuple[int, int, np.ndarray | None, list[Frame]]:
    """(width, height, global palette, frames). ValueError for what is no GIF or ends inside an image."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("the file ends inside a block")
            n = data[at]
            if n == 0:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    frames: list[Frame] = []
    show = (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1 : at + 2]
            body, at = blocks(at + 2)
            if label == b"\xf9" and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                show = (delay, bits >> 2 & 7, index if bits & 1 else None)
        elif data[at] == 0x2C:
            if at + 11 > len(data):
                raise ValueError("the file ends inside an image")
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = None
            if bits & 0x80:
                n = 2 << (bits & 7)
                own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            m = data[at]
            if not 1 <= m <= 8:
                raise ValueError("bad LZW code size")
            stream, at = blocks(at + 1)
            got = np.frombuffer(lzw_decode(stream, m), np.uint8)[: w * h]
            if len(got) < w * h:
                raise ValueError("the image has too few pixels")
            rows = got.reshape(h, w)
            if bits & 0x40:
                plain = np.empty_like(rows)
                i = 0
                for a, s in INTERLACE:
                    n = len(range(a, h, s))
                    plain[a::s] = rows[i : i + n]
                    i += n
                rows = plain
            frames.append(Frame(rows, left, top, *show, own, bool(bits & 0x40)))
            show = (0, 0, None)
        else:
            raise ValueError("unknown block")
    return width, height, shared, frames


def shown(width: int, height: int, shared: np.ndarray | None, frames: list[Frame]):
    """The canvas (rows x columns x RGBA) after each frame, by the disposal and transparency rules."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        kept = canvas.copy() if f.disposal == 3 else None
        colours = f.palette if f.palette is not None else shared if shared is not None else GRAY
        h, w = f.pixels.shape
        box = canvas[f.top : f.top + h, f.left : f.left + w]
        px = f.pixels[: box.shape[0], : box.shape[1]]
        lut = np.zeros((256, 4), np.uint8)
        lut[: len(colours), :3] = colours
        lut[:, 3] = 255
        if f.transparent is None:
            box[:] = lut[px]
        else:
            drawn = px != f.transparent
            box[drawn] = lut[px[drawn]]
        yield canvas
        if f.disposal == 2:
            box[:] = 0
        elif kept is not None:
            canvas = kept
