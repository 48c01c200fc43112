"""Benchmark decontamination: rare n-gram seeds, then local alignment of words.

Test items are a stated query set: they are taken in blocks of bounded size, and
each block meets all documents in one pass without a shuffle. A first pass counts
in how many documents each n-gram of the block occurs. Every n-gram that some
document holds is a seed: a rarer neighbour may come from another document, so
leaving out the more frequent one would lose copies whose unchanged runs are no
longer than ``NGRAM`` words. Where a seed hits, the item is aligned with the
document's words around it (Smith-Waterman).

Words are lower case, and ASCII punctuation separates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices, window_hashes, words_of

NGRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 200_000
MIN_SCORE = 0.5
CELLS = 1 << 19
SLICE = 1 << 20  # bytes of text whose words are held at once
_TABLE_BITS = 20


@dataclass
class Items:
    """One block of test items: ids, word hashes and the hashes of all their n-grams."""

    ids: list
    words: list[np.ndarray]

    def grams(self) -> list[np.ndarray]:
        return [window_hashes(w, NGRAM) for w in self.words]


def item_blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of about ``limit`` words; items under ``NGRAM`` words (also null ones) can't be told from chance and are left out."""
    ids, held, size = [], [], 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        hashes = words_of(pa.array([row["text"]], pa.string()), plain=True).hashes
        if len(hashes) < NGRAM:
            continue
        ids.append(row["item_id"])
        held.append(hashes)
        size += len(hashes)
        if size >= limit:
            yield Items(ids, held)
            ids, held, size = [], [], 0
    if ids:
        yield Items(ids, held)


def _inside(w: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts whose run of words stays in one text, and that text."""
    text = np.searchsorted(w.offsets, at, side="right") - 1
    ok = at + size <= w.offsets[text + 1]
    return at[ok], text[ok]


class Lookup:
    """Membership in a sorted set of hashes, with a small table in front."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[keys & np.uint64((1 << _TABLE_BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are in the set, and which key each one is."""
        at = np.flatnonzero(self.table[hashes & np.uint64((1 << _TABLE_BITS) - 1)])
        key = np.searchsorted(self.keys, hashes[at])
        hit = self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[at]
        return at[hit], key[hit]


def document_counts(docs: DataFrame, block: Items) -> np.ndarray:
    """For each distinct n-gram of the block (sorted), the number of documents that hold it."""
    keys = np.unique(np.concatenate(block.grams()))
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        total = np.zeros(len(look.keys), np.int64)
        for batch in batches:
            for low, high in slices(batch["text"], SLICE):
                w = words_of(batch["text"].slice(low, high - low), plain=True)
                at, key = look.find(window_hashes(w.hashes, NGRAM))
                start, text = _inside(w, at, NGRAM)
                pair = np.unique(text * len(look.keys) + key[np.isin(at, start)])
                total += np.bincount(pair % len(look.keys), minlength=len(look.keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"key": seen, "n": total[seen]})

    out = np.zeros(len(keys), np.int64)
    sums = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for row in sums.toLocalIterator():  # one row per n-gram of the block
        out[row["key"]] = row["n"]
    return out


class Matcher:
    """Seeds of one block, and the alignment."""

    def __init__(self, block: Items, counts: np.ndarray):
        grams = block.grams()
        keys = np.unique(np.concatenate(grams))
        seeds, owner, place = [], [], []
        for k, g in enumerate(grams):
            chosen = np.flatnonzero(counts[np.searchsorted(keys, g)])
            seeds.append(g[chosen])
            owner.append(np.full(len(chosen), k))
            place.append(chosen)
        seeds, owner, place = map(np.concatenate, (seeds, owner, place))
        order = np.argsort(seeds, kind="stable")
        self.owner, self.place = owner[order], place[order]
        unique, first = np.unique(seeds[order], return_index=True)
        self.bounds = np.append(first, len(seeds))
        self.look = Lookup(unique)
        self.ids, self.words = block.ids, block.words

    def matches(self, texts: pa.Array, min_score: float = MIN_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score, end) of each text and item whose alignment reaches ``min_score``.

        The score is the alignment's over that of a whole exact copy; ``end`` is
        the word after it.
        """
        found = []
        for low, high in slices(texts, SLICE):
            w = words_of(texts.slice(low, high - low), plain=True)
            at, key = self.look.find(window_hashes(w.hashes, NGRAM))
            start, text = _inside(w, at, NGRAM)
            if not len(start):
                continue
            key = key[np.isin(at, start)]
            n = self.bounds[key + 1] - self.bounds[key]
            spot = np.repeat(self.bounds[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item, diagonal, text = self.owner[spot], np.repeat(start, n) - self.place[spot], np.repeat(text, n)
            order = np.lexsort((diagonal, item, text))
            item, diagonal, text = item[order], diagonal[order], text[order]
            length = np.array([len(x) for x in self.words])[item]
            pad = 8 + length // 4
            fresh = np.ones(len(item), bool)
            fresh[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (np.diff(diagonal) > length[1:] + 2 * pad[1:])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(item)) - 1
            left = np.maximum(w.offsets[text[first]], diagonal[first] - pad[first])
            right = np.minimum(w.offsets[text[first] + 1], diagonal[last] + length[first] + pad[first])
            score, end = self._align(w.hashes, item[first], left, right)
            good = score >= min_score
            found.append((text[first][good] + low, item[first][good], score[good], (end - w.offsets[text[first]])[good]))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0), none
        text, item, score, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, -score, item, text))
        text, item, score, end = text[order], item[order], score[order], end[order]
        best = np.ones(len(text), bool)
        best[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return text[best], item[best], score[best], end[best]

    def _align(self, hashes: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best local score and its end for each (item, range of words), many at a time."""
        score, end = np.zeros(len(item)), left.copy()
        length = np.array([len(self.words[k]) for k in item])
        order = np.lexsort((right - left, length))
        low = 0
        while low < len(order):
            high, wide = low, 0
            while high < len(order) and max(wide, right[order[high]] - left[order[high]]) * (high - low + 1) <= CELLS:
                wide = max(wide, right[order[high]] - left[order[high]])
                high += 1
            high = max(high, low + 1)
            part = order[low:high]
            wide = int((right[part] - left[part]).max())
            column = np.arange(wide)
            inside = column < (right[part] - left[part])[:, None]
            region = np.where(inside, hashes[np.minimum(left[part][:, None] + column, len(hashes) - 1)], np.uint64(0))
            rows = np.zeros((int(length[part].max()), len(part)), np.uint64)
            for j, k in enumerate(item[part]):
                rows[: len(self.words[k]), j] = self.words[k]
            slope = GAP * np.arange(wide, dtype=np.int32)
            above = np.zeros((len(part), wide), np.int32)
            best, where = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for i in range(len(rows)):
                step = np.where(inside & (region == rows[i][:, None]), np.int32(MATCH), np.int32(MISMATCH))
                step[:, 1:] += above[:, :-1]
                cell = np.maximum(np.maximum(step, above + GAP), 0)
                cell = np.maximum.accumulate(cell - slope, axis=1) + slope  # gaps along the row
                cell[i >= length[part]] = 0
                top = cell.argmax(axis=1)
                value = cell[np.arange(len(part)), top]
                better = value > best
                best[better], where[better] = value[better], top[better] + 1
                above = cell
            score[part] = best / (MATCH * length[part])
            end[part] = left[part] + where
            low = high
        return score, end


def matchers(docs: DataFrame, items: DataFrame) -> Iterator[Matcher]:
    """A matcher per block of items, with the n-grams counted over all of ``docs``."""
    for block in item_blocks(items):
        yield Matcher(block, document_counts(docs, block))


def find_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, end_word) for every document and item aligned with ``min_score`` or more.

    The best alignment of a document with an item counts. A repeated document row
    gives its rows again, a repeated item too. Null and empty texts match nothing;
    without items or documents there are no rows.
    """
    docs = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    for matcher in matchers(docs, items):
        out = out.unionByName(_leaks_of(docs, matcher, min_score))
    return out


def _leaks_of(docs: DataFrame, matcher: Matcher, min_score: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([-1 if k is None else k for k in shared.value.ids], np.int64)
        null = np.array([k is None for k in shared.value.ids])
        for batch in batches:
            text, item, score, end = shared.value.matches(batch["text"], min_score)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].take(pa.array(text)).cast(pa.int64()),
                    "item_id": pa.array(ids[item], mask=null[item]),
                    "score": pa.array(score, pa.float64()),
                    "end_word": pa.array(end, pa.int64()),
                }
            )

    return docs.mapInArrow(find, "doc_id long, item_id long, score double, end_word long")


def contaminated(matcher: Matcher, spark, min_score: float = MIN_SCORE):
    """A column function from a text to whether some item of the block matches it."""
    shared = spark.sparkContext.broadcast(matcher)

    @F.arrow_udf("boolean")
    def flag(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        out[shared.value.matches(texts, min_score)[0]] = True
        return pa.array(out)

    return flag


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that no item matches, with all their columns."""
    kept = docs
    for matcher in matchers(docs.select(F.col(text).alias("text")), items):
        flag = contaminated(matcher, docs.sparkSession, min_score)
        kept = kept.filter(~flag(F.col(text)))
    return kept
