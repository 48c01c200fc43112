"""Words of whole texts as numpy arrays, without a Python object per word.

A word is a run of bytes other than the space and 0x09-0x0D, as in the pattern
``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses those bytes inside a letter. Each word
becomes one 64-bit hash, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 2 * SLICE_BYTES:  # tables for one huge text are not kept
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, one after the other.

    Text ``d`` has the words ``offsets[d]`` to ``offsets[d + 1]``; word ``w`` is
    ``data[starts[w]:ends[w]]``.
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[at[0] : at[-1]] if held is not None and len(texts) else np.empty(0, np.uint8)
    return data, at - at[0]


def words_of(texts: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """All words of the texts.

    ``lower`` maps A-Z to a-z first; ``plain`` does so too and reads ASCII
    punctuation as spaces.
    """
    if not len(texts):
        none = np.empty(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(1, dtype=np.int64), np.empty(0, np.uint8))
    data, at = text_bytes(texts)
    if lower or plain:
        data = (_PLAIN if plain else _LOWER)[data]
    n = len(data)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts):
        sums = np.add.reduceat(_VALUE[data] * _power(_BASE, n)[:n], starts)
        hashes = mix(sums * _power(_INVERSE, n)[starts])
    else:
        hashes = np.empty(0, dtype=np.uint64)
    return Words(hashes, starts, ends, np.searchsorted(starts, at), data)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    if not len(texts):
        return
    at = text_bytes(texts)[1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def window_hashes(hashes: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every run of ``size`` consecutive words (crossing texts as well)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    # Doubling: runs of 1, 2, 4, ... words put together to the wanted length.
    mult = lambda k: np.uint64(pow(base, k, 2**64))
    runs, length, out, done = hashes, 1, None, 0
    left = size
    while left:
        if left & 1:
            part = runs[done : done + n]
            out = part.copy() if out is None else out * mult(length) + part
            done += length
        left >>= 1
        if left:
            runs = runs[: len(runs) - length] * mult(length) + runs[length:]
            length *= 2
    return mix(out)


def inside_text(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which of the runs of ``size`` words stay inside one text."""
    total = int(offsets[-1])
    n = max(0, total - size + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return ends[:n] - np.arange(n) >= size
