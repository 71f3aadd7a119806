"""GIF columns: LZW code streams, palettes, disposal, transparency and timed frames.

``decode`` reads any GIF 87a/89a; ``encode_payload`` stores bytes losslessly as the
8-bit samples of an animation with a grey palette. ``frame_table`` gives one row per
frame with its time and a colour histogram of the picture shown at that time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.staging import staged

WIDTH = 192
FRAME_ROWS = 64
DELAY = 4
MAX_CODES = 4096
#: Histogram cells for each colour channel.
CELLS = 4
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int | None


# --- LZW -----------------------------------------------------------------------


@lru_cache
def _widths(low: int) -> np.ndarray:
    """Bits of the codes after a clear code: one more when the next entry needs it.

    A reader has added no entry after the first code and one after each later code;
    codes have 12 bits at most, and all after the listed ones have 12.
    """
    entries = (1 << low) + 2 + np.maximum(np.arange(MAX_CODES) - 1, 0)
    return np.minimum(np.ceil(np.log2(entries + 1)).astype(np.int64), 12).clip(low + 1)


_BITS = np.arange(12)


def lzw_encode(data: bytes, low: int = 8) -> bytes:
    """Code stream of ``data`` with a clear code at its start and whenever the table is full."""
    clear = 1 << low
    runs: list[list[int]] = [[]]
    rest = iter(data)
    prefix = next(rest, None)
    while prefix is not None:
        table: dict[int, int] = {}
        find, add, free = table.get, runs[-1].append, clear + 2
        for byte in rest:
            longer = find(prefix << 8 | byte)
            if longer is not None:
                prefix = longer
                continue
            add(prefix)
            table[prefix << 8 | byte] = free
            free += 1
            prefix = byte
            if free == MAX_CODES:  # this byte opens the next run
                runs.append([])
                break
        else:
            add(prefix)
            prefix = None
    return _packed(runs, low)


def _packed(runs: list[list[int]], low: int) -> bytes:
    """Codes of all runs, least bit first, each run behind a clear code, then the end code."""
    codes, widths = [1 << low], [np.array([low + 1])]
    for i, run in enumerate(runs):
        codes += run
        codes.append((1 << low) + (i == len(runs) - 1))
        widths.append(_widths(low)[: len(run) + 1])
    inside = np.concatenate(widths)[:, None] > _BITS
    bits = (np.array(codes, np.uint16)[:, None] >> _BITS.astype(np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits[inside], bitorder="little").tobytes()


def lzw_decode(stream: bytes, low: int) -> bytes:
    """Bytes of a code stream; stops at the end code or the end of the data."""
    clear, end = 1 << low, (1 << low) + 1
    bits = np.unpackbits(np.frombuffer(stream + b"\0\0", np.uint8), bitorder="little")
    total = 8 * len(stream)
    schedule = _widths(low)
    ends = np.cumsum(schedule)
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = 0
    while at + low + 1 <= total:
        count = int(np.searchsorted(ends, total - at, "right"))
        width = schedule[:count]
        if count == MAX_CODES:
            width = np.concatenate([width, np.full((total - at - int(ends[-1])) // 12, 12)])
        start = at + np.cumsum(width) - width
        part = bits[start[:, None] + _BITS] & (width[:, None] > _BITS)
        codes = (part.astype(np.uint16) << _BITS.astype(np.uint16)).sum(axis=1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        _expand(codes[:stop].tolist(), single, out)
        if stop == len(codes) or codes[stop] == end:
            break
        at = int(start[stop] + width[stop])
    return b"".join(out)


def _expand(codes: list[int], single: list[bytes], out: list[bytes]) -> None:
    """Appends the strings of one run of codes, growing its table from ``single``."""
    if not codes:
        return
    table = single.copy()
    grow, put = table.append, out.append
    last = table[codes[0]]
    put(last)
    room = MAX_CODES - len(table)
    free = len(table)
    for code in codes[1 : room + 1]:
        entry = table[code] if code < free else last + last[:1]
        grow(last + entry[:1])
        free += 1
        put(entry)
        last = entry
    out.extend(map(table.__getitem__, codes[room + 1 :]))


# --- files ---------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    """Data cut into length-prefixed sub-blocks with a terminator."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _word(n: int) -> bytes:
    return n.to_bytes(2, "little")


def encode(width: int, height: int, frames: list[Frame]) -> bytes:
    """A GIF 89a file; every frame carries its own 256-entry palette unless it is grey."""
    parts = [b"GIF89a", _word(width), _word(height), b"\xf7\0\0", GREY.tobytes()]
    for f in frames:
        rows, columns = f.samples.shape
        own = f.palette is not GREY and not np.array_equal(f.palette, GREY)
        flags = f.disposal << 2 | (f.transparent is not None)
        parts += [b"\x21\xf9\x04", bytes([flags]), _word(f.delay), bytes([f.transparent or 0, 0])]
        parts += [b"\x2c", _word(f.left), _word(f.top), _word(columns), _word(rows), b"\x87" if own else b"\0"]
        parts += [f.palette.astype(np.uint8).tobytes()] * own
        parts += [b"\x08", _blocks(lzw_encode(f.samples.astype(np.uint8).tobytes()))]
    return b"".join([*parts, b"\x3b"])


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("the GIF ends early")
        self.at += n
        return part

    def word(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray:
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        table[:n] = np.frombuffer(self.take(3 * n), np.uint8).reshape(n, 3)
        return table


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """(width, height, frames) of a GIF; interlaced rows are put in order."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = r.word(), r.word(), r.take(1)[0]
    r.take(2)
    common = r.palette(flags) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while (kind := r.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = r.take(1)[0], r.blocks()
            if label == 0xF9:
                delay, disposal = int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
        elif kind == b"\x2c":
            left, top, columns, rows, flags = r.word(), r.word(), r.word(), r.word(), r.take(1)[0]
            palette = r.palette(flags) if flags & 0x80 else common
            low = r.take(1)[0]
            raw = lzw_decode(r.blocks(), low)
            samples = np.zeros(rows * columns, np.uint8)
            got = np.frombuffer(raw, np.uint8)[: rows * columns]
            samples[: len(got)] = got
            samples = samples.reshape(rows, columns)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown GIF block")
    return width, height, frames


def shown(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGB picture on screen during each frame.

    A frame covers its place except for transparent samples. Afterwards it stays
    (disposal 0 and 1), its place is blanked (2), or the picture before it returns (3).
    """
    screen = np.zeros((height, width, 3), np.uint8)
    for f in frames:
        rows, columns = max(0, min(f.samples.shape[0], height - f.top)), max(0, min(f.samples.shape[1], width - f.left))
        place = (slice(f.top, f.top + rows), slice(f.left, f.left + columns))
        samples = f.samples[:rows, :columns]
        before = screen.copy() if f.disposal == 3 else None
        if f.transparent is None:
            screen[place] = f.palette[samples]
        else:
            solid = samples != f.transparent
            screen[place][solid] = f.palette[samples[solid]]
        yield screen
        if f.disposal == 2:
            screen[place] = 0
        elif before is not None:
            screen = before


def histogram(picture: np.ndarray) -> np.ndarray:
    """Pixel counts in CELLS x CELLS x CELLS cells of the RGB cube."""
    cell = picture // np.uint8(256 // CELLS)
    return np.bincount(((cell[..., 0] * CELLS + cell[..., 1]) * CELLS + cell[..., 2]).ravel(), minlength=CELLS**3)


# --- payloads ------------------------------------------------------------------


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8 with blanks up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" ")


def encode_payload(payload: bytes) -> bytes:
    """The payload as rows of WIDTH samples, FRAME_ROWS rows a frame, grey palette."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, rows[i : i + FRAME_ROWS], GREY, DELAY, 2, None) for i in range(0, len(rows), FRAME_ROWS)]
    return encode(WIDTH, min(len(rows), FRAME_ROWS), frames)


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text as a GIF, written to the shared folder."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                made = [padded(t) for t in part.column(1).to_pylist()]
                media = pa.array([encode_payload(p) for _, p in made], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), media], names=[key, "n_bytes", "media"])

    return staged(docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, n_bytes long, media binary"))


def frame_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per frame: key, frame, starts_cs, delay_cs, width, height, samples, histogram.

    ``samples`` are the frame's own decoded samples, ``histogram`` counts the colours of
    the picture shown during the frame (CELLS^3 cells). Times are hundredths of a second.
    A null or damaged file stops the job rather than lose rows.
    """
    kind = dict(media.dtypes)[key]
    names = [key, "frame", "starts_cs", "delay_cs", "width", "height", "samples", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                source, rows = [], []
                for d, data in enumerate(part.column(1).to_pylist()):
                    width, height, frames = decode(data)
                    starts = 0
                    for k, (f, picture) in enumerate(zip(frames, shown(width, height, frames), strict=True)):
                        source.append(d)
                        rows.append((k, starts, f.delay, width, height, f.samples.tobytes(), histogram(picture)))
                        starts += f.delay
                kinds = [pa.int32()] * 5 + [pa.binary(), pa.list_(pa.int64())]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=names
                )

    schema = f"{key} {kind}, frame int, starts_cs int, delay_cs int, width int, height int, samples binary, histogram array<long>"
    return media.select(key, "media").mapInArrow(run, schema)


def media_digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per stored text: its payload, read back from the GIF, and its features.

    ``feature`` is frames : total time : pixels shown per histogram cell, for the cells
    that any grey value falls into. Equal files give equal rows. Null and empty texts
    are 192 blanks. Rows that repeat a key stay rows of their own.
    """
    kind = dict(media.dtypes)[key]
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(data: bytes) -> tuple:
        width, height, frames = decode(data)
        payload = b"".join(f.samples.tobytes() for f in frames)
        total = sum(histogram(p) for p in shown(width, height, frames))
        grey = [int(total[(c * CELLS + c) * CELLS + c]) for c in range(CELLS)]
        feature = f"{len(frames)}:{sum(f.delay for f in frames)}:" + ",".join(map(str, grey))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                columns = list(zip(*map(digest, part.column(2).to_pylist()), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=names
                )

    schema = f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)
