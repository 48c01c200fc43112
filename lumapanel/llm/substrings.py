"""Removing repeated passages, exactly, by difference-cover anchors.

A passage is a run of ``WINDOW`` words. Words at positions (inside their text)
whose remainder modulo ``PERIOD`` lies in the cover begin an anchor of
``ANCHOR`` words. The cover holds every difference modulo the period, so of two
equal passages, wherever they stand, some pair of anchors is aligned inside both:
passages away from shared anchors needn't be looked at. Around shared anchors
the whole windows are compared, by a 128-bit hash.

Texts are saved once in bounded files. Only hashes are shuffled, each at most
once per file, and what is repeated comes back to the file it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import per_chunk, per_file, read_chunk, save_chunks
from .token_files import ragged
from .words import Words, inside_text, slices, window_hashes, words_of

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)  # a perfect difference set
SECOND_BASE = 0xC2B2AE3D27D4EB4F


def check_cover(window: int, period: int, cover: tuple[int, ...]) -> int:
    """The anchor length that fits; raises unless the cover holds every difference."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover lacks a difference")
    if window < period:
        raise ValueError("the window is shorter than the period")
    return window - period + 1


def _parts(path: str) -> Iterator[tuple[pa.Array, Words]]:
    for batch in read_chunk(path, ["doc_id", "text"]):
        for low, high in slices(batch["text"]):
            part = batch.slice(low, high - low)
            yield part["doc_id"], words_of(part["text"])


def _anchors(w: Words, window: int, period: int, cover: tuple[int, ...], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that have a whole window."""
    n = np.diff(w.offsets)
    place = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], n)
    chosen = np.isin(np.arange(period), cover)[place % period] & np.repeat(n >= window, n)
    runs = window_hashes(w.hashes, size)
    at = np.flatnonzero(chosen[: len(runs)] & inside_text(w.offsets, size))
    return at, runs[at]


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, and 2 for those that occur more than once, else 1."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.minimum(np.diff(np.append(first, len(order))), 2)


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(chunk, *keys) of the keys that occur twice or more, in one file or several.

    A key has at most one row per file.
    """
    total = F.sum("n").over(Window.partitionBy(*keys))
    return rows.withColumn("_total", total).filter("_total > 1").select("chunk", *keys)


def _member(sorted_keys: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Which (first, second) pairs are among the sorted pairs."""
    first, second = sorted_keys
    out = np.zeros(len(keys[0]), bool)
    if not len(first):
        return out
    at = np.searchsorted(first, keys[0])
    live = np.arange(len(at))
    while len(live):  # one step, but for first halves that several pairs have
        live = live[(at[live] < len(first))]
        live = live[first[at[live]] == keys[0][live]]
        out[live] |= second[at[live]] == keys[1][live]
        live = live[~out[live]]
        at[live] += 1
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of (doc_id, text).

    Each word inside a run of ``window`` words that also starts anywhere else in
    the table (the same text included) is removed; runs are judged on the input.
    ``kept`` is the other words joined by one space. Null, empty and short texts
    lose nothing; of repeated rows every one loses its repeated passages.
    """
    size = check_cover(window, period, cover)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = save_chunks(rows, "texts")

    def anchors(chunk: int, path: str) -> Iterator[pa.RecordBatch]:
        found = [_anchors(w, window, period, cover, size)[1] for _, w in _parts(path)]
        (key,), n = _counted(np.concatenate(found)) if found else ((np.empty(0, np.uint64),), np.empty(0, np.int64))
        for low in range(0, len(key), 1 << 16):
            part = key[low : low + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(part), chunk), "key": part, "n": n[low : low + (1 << 16)]})

    shared = _shared(per_file(files, anchors, "chunk long, key long, n long"), ["key"])

    def windows(chunk: int, path: str, got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, found = np.sort(got["key"].view(np.uint64)), [[], []]
        if not len(keys):
            return
        for _, w in _parts(path):
            at, runs = _anchors(w, window, period, cover, size)
            where = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            marks = np.zeros(len(w.hashes) + period + 1, np.int64)
            marks[at[keys[where] == runs] + 1] = 1
            before = np.cumsum(marks)
            fits = inside_text(w.offsets, window)
            start = np.flatnonzero(fits & (before[period : period + len(fits)] > before[: len(fits)]))
            found[0].append(window_hashes(w.hashes, window)[start])
            found[1].append(window_hashes(w.hashes, window, SECOND_BASE)[start])
        pair, n = _counted(*(np.concatenate(f) for f in found))
        for low in range(0, len(n), 1 << 16):
            cut = slice(low, low + (1 << 16))
            part = [p[cut].view(np.int64) for p in pair]
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(part[0]), chunk), "k1": part[0], "k2": part[1], "n": n[cut]})

    repeated = _shared(per_chunk(files, shared, windows, "chunk long, k1 long, k2 long, n long"), ["k1", "k2"])

    def cut(chunk: int, path: str, got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((got["k2"].view(np.uint64), got["k1"].view(np.uint64)))
        known = [got["k1"].view(np.uint64)[order], got["k2"].view(np.uint64)[order]]
        for ids, w in _parts(path):
            pairs = [window_hashes(w.hashes, window), window_hashes(w.hashes, window, SECOND_BASE)]
            start = np.flatnonzero(inside_text(w.offsets, window) & _member(known, pairs)) if len(pairs[0]) else np.empty(0, np.int64)
            change = np.zeros(len(w.hashes) + 1, np.int64)
            change[start] += 1
            np.subtract.at(change, start + window, 1)
            gone = np.cumsum(change)[:-1] > 0
            yield _kept(ids, w, gone)

    return per_chunk(files, repeated, cut, "doc_id long, n_words long, n_removed long, kept string")


def _kept(ids: pa.Array, w: Words, gone: np.ndarray) -> pa.RecordBatch:
    """The other words of each text joined by one space."""
    stay = np.flatnonzero(~gone)
    lengths = (w.ends - w.starts)[stay]
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    out[ragged(ends - lengths - 1, lengths)] = w.data[ragged(w.starts[stay], lengths)]
    first = np.searchsorted(stay, w.offsets)
    bounds = np.concatenate([[0], ends])[first]
    texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    n = np.diff(w.offsets)
    return pa.RecordBatch.from_pydict(
        {"doc_id": ids, "n_words": n, "n_removed": n - np.diff(first), "kept": pa.array(texts, pa.binary()).cast(pa.string())}
    )
