"""Vectorised 64-bit hashes of words and word shingles.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D) of
the UTF-8 text after lowering A-Z. A word's hash is a polynomial over its bytes in
arithmetic modulo 2**64, taken for all words at once from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK_BYTES = 1 << 22
#: Texts hashed together; the tables of powers that a worker keeps are 16 times as large.
HASHED_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]
    return values


_VALUE = _byte_values()
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: White space and every other ASCII byte that is no letter or digit.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        have = _powers[which] = np.multiply.accumulate(steps)
    return have[:n]


def word_hashes(texts: Sequence[str | None], apart: np.ndarray = WHITE) -> Iterator[np.ndarray]:
    """Word hashes of each text in order; an empty array for a null text.

    ``apart`` marks the bytes between words; it must include the line feed.
    Texts are hashed in blocks of about ``HASHED_BYTES``, so memory stays bounded
    however many texts a batch holds.
    """
    block: list[bytes] = []
    held = 0
    for text in texts:
        block.append((text or "").encode("utf-8", "replace"))
        held += len(block[-1]) + 1
        if held >= HASHED_BYTES:
            yield from _hash_block(block, apart)
            block, held = [], 0
    if block:
        yield from _hash_block(block, apart)


def _hash_block(block: list[bytes], apart: np.ndarray) -> Iterator[np.ndarray]:
    *_, hashes, cuts = cut_words(block, apart)
    low = 0
    for high in cuts:
        yield hashes[low:high]
        low = high


def cut_words(block: list[bytes], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, word hashes, words up to the end of each text)."""
    data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    n = len(data)
    space = apart[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * _power("inverse", _INVERSE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("base", _BASE, n)[starts])
    edges = np.cumsum([len(x) + 1 for x in block])
    return data, starts, ends, hashes, np.searchsorted(starts, edges)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words form one run."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    scale = odd_numbers(11 * size + width, width)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * scale[k]
    return np.unique(mix(total))
