"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k], and each of its bins takes exactly k pieces. A
worker keeps one open bin per class, so bins fill independently of all others and
memory is a few counters. As documents may be cut, a document gives whole sequences
first, then pieces of exactly capacity // k for the largest class that fits, until
less than capacity / ``FINE`` is left; only that tail wastes space in its class.

The bins a worker leaves open at its end are merged, whole, in groups of workers.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.staging import staged, tidy

CAPACITY = 1024
FINE = 16
#: Workers whose open bins are merged together; at most about 80 bins each.
MERGED_WORKERS = 64
TOKENIZER = "byte_bpe_50k.json"
# Fixed value: how this byte-level vocabulary cuts texts into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Longer runs of white space go to the tokenizers library, as the pattern backtracks over them.
LONG_BLANK = 20_000
_long_blank = re.compile(rf"\s{{{LONG_BLANK}}}")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shown_bytes() -> dict[str, int]:
    """The visible character by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    Reads a byte-level BPE file of the tokenizers library, whose ids are merge ranks,
    into a tiktoken encoding: the same ids in a fraction of the time. With ``special``
    the file's added tokens have their own ids wherever their strings stand in a text,
    as that library has by default; without, those strings are ordinary text. Texts with
    a run of ``LONG_BLANK`` characters of white space are encoded by that library itself.
    A file whose texts are not cut by the usual byte-level pattern is refused.
    """

    def __init__(self, path: str, special: bool = False):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        cutter = content.get("pre_tokenizer") or {}
        if cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True) or cutter.get("add_prefix_space") or content.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.path, self.special, self.library = path, special, None
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=added if special else {})

    def _slowly(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = not self.special
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(text) >= LONG_BLANK and _long_blank.search(text):
            return self._slowly(text)
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()


def piece_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    lengths = [capacity] * (total // capacity)
    left = total % capacity
    while left:
        k = -(-capacity // left)
        lengths.append(capacity // k if k <= FINE else left)
        left -= lengths[-1]
    return lengths


def _pieces(path: str, capacity: int, key: str, end: int, with_ids: bool):
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "worker", "bin", "offset", "places", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = Encoder(path, special=True), TaskContext.get().partitionId()
        closing = np.array([end], "<u4").tobytes()
        open_bins: dict[int, list[int]] = {}
        bins = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows, source = [], []
                for d, text in enumerate(part.column(1).to_pylist()):
                    ids = encode(text or "") + closing
                    total, start = len(ids) // 4, 0
                    for n in piece_lengths(total, capacity):
                        k = capacity // n
                        now = open_bins.get(k)
                        if now is None:
                            now = open_bins[k] = [bins, 0, 0]
                            bins += 1
                        mine = ids[4 * start : 4 * (start + n)]
                        rows.append((start, n, zlib.crc32(mine), total, worker, now[0], now[1], k, *[np.frombuffer(mine, "<u4").astype(np.int32)] * with_ids))
                        source.append(d)
                        now[1] += n
                        now[2] += 1
                        if now[2] == k:
                            del open_bins[k]
                        start += n
                columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
                types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
                values = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source, pa.int64())), *values], names=names)

    return run


def _merge(capacity: int):
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        """First fit, largest first: each open bin goes whole behind the others of its host."""
        bins = bins.sort_values(["used", "worker", "bin"], ascending=[False, True, True], ignore_index=True)
        free = np.full(len(bins), capacity)
        host, base = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
        first: list[int] = []
        for i, used in enumerate(bins["used"]):
            at = int(np.argmax(free >= used))
            if at == len(first):
                first.append(i)
            host[i], base[i] = first[at], capacity - free[at]
            free[at] -= used
        return pd.DataFrame(
            {"worker": bins["worker"], "bin": bins["bin"], "host_worker": bins["worker"].to_numpy()[host], "host_bin": bins["bin"].to_numpy()[host], "base": base}
        )

    return run


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text, with those of the file's added tokens
    where it names them, and then the id ``end``. ``start`` counts
    its ids before the piece, ``offset`` the ids before the piece in its sequence.
    ``with_ids`` adds the piece's ids.

    Defined cases: null and empty texts are the closing id alone. Texts of any length
    are read whole, long runs of white space too. Rows that repeat a
    key, null keys included, are documents of their own. Other columns are not
    carried. An empty table gives no pieces.

    Scale: texts are read once and never shuffled; later steps see one narrow row per
    piece. Only open bins, some dozens for each worker, are regrouped. Pieces are
    written before bins are counted, so a retried task meets the same bins.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, worker long, bin long, offset long, places long" + ", ids array<int>" * with_ids
    run = _pieces(path or tokenizer_path(), capacity, key, end, with_ids)
    pieces = staged(docs.select(key, F.col(text).alias("text")).mapInArrow(tidy(run), schema))
    left_open = (
        pieces.groupBy("worker", "bin", "places").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n")).where("n < places")
    )
    group = (F.col("worker") / MERGED_WORKERS).cast("long").alias("group")
    merged = left_open.groupBy(group).applyInPandas(_merge(capacity), "worker long, bin long, host_worker long, host_bin long, base long")
    return pieces.join(merged, ["worker", "bin"], "left").select(
        key,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.coalesce("host_worker", "worker") * (1 << 32) + F.coalesce("host_bin", "bin")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        *["ids"] * with_ids,
    )
