"""Collocations counted in quotient filters.

A phrase of two or three words is packed as one number from its words' numbers,
and an invertible permutation (a Feistel network over two halves) spreads these
numbers evenly. The leading bits of the result are the quotient, which says where
the phrase lies, and all other bits are stored as the remainder, so a filter is a
compact table of counters that loses nothing: quotient and remainder give the
phrase back. A filter is sorted by (quotient, remainder). Each file of texts
fills one; filters of several files merge like sorted lists, shard by shard, a
shard being a range of quotients.

Only words that are frequent enough for a phrase to be one have numbers, so
phrases of rare words are never counted; all other counts are exact. The texts
are written once in bounded files; what crosses the shuffle are the distinct
words of a file, their numbers, and its filters.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import saved
from .store import per_chunk, per_file, read_chunk, save_texts
from .token_files import ragged
from .words import mix, slices, text_bytes

FILE_BYTES = 12 << 20
LONGEST = 3
SHARD_PHRASES, LEAST_SHARDS = 4 << 20, 64  # phrases of the whole corpus to a shard

_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: ends a piece
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- words -------------------------------------------------------------------


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in lower case (A-Z), and the number of the piece each stands in."""
    data, at = text_bytes(texts)
    data = _LOWER[data]
    kind = _KIND[data]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.cumsum(kind == 2)
    piece = breaks[starts] + np.searchsorted(at, starts, side="right") if len(starts) else np.empty(0, np.int64)
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = data[ragged(starts, lengths)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
    return words, piece


def _by_lang(path: str) -> Iterator[tuple[str, pa.Array]]:
    """The texts of a file, slice by slice and one language after the other in each."""
    for batch in read_chunk(path, ["lang", "text"]):
        for low, high in slices(batch["text"]):
            part = batch.slice(low, high - low)
            langs = part["lang"].dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, part["text"].take(pa.array(np.flatnonzero(code == k)))


@dataclass
class FileWords:
    """The distinct (lang, word) of a file in the order they are met, their counts, and the running text as numbers of these."""

    langs: list[str]
    words: list[pa.Array]
    counts: np.ndarray
    tokens: np.ndarray
    pieces: np.ndarray


def file_words(path: str) -> FileWords:
    """Deterministic for a file, so a number means the same word whenever the file is read."""
    tables: dict[str, pa.DictionaryArray | list] = {}
    for lang, texts in _by_lang(path):
        words, piece = split_words(texts)
        tables.setdefault(lang, []).append((words, piece))
    langs, dictionaries, tokens, pieces, base, first_piece = [], [], [], [], 0, 0
    for lang, parts in tables.items():
        coded = pa.chunked_array([w for w, _ in parts], pa.large_binary()).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        for _, piece in parts:
            pieces.append(piece + first_piece)
            first_piece += int(piece[-1]) + 1 if len(piece) else 0
        langs += [lang] * len(coded.dictionary)
        dictionaries.append(coded.dictionary)
        tokens.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + base)
        base += len(coded.dictionary)
    tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
    return FileWords(langs, dictionaries, np.bincount(tokens, minlength=base), tokens, np.concatenate(pieces) if pieces else np.empty(0, np.int64))


def _word_rows(chunk: int, path: str) -> Iterator[pa.RecordBatch]:
    """(chunk, place, lang, word, n) of the distinct words of a file."""
    held = file_words(path)
    at = 0
    for words in held.words:
        for low in range(0, len(words), 1 << 15):
            part = words.slice(low, 1 << 15)
            to = at + len(part)
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": np.full(len(part), chunk),
                    "place": np.arange(at, to),
                    "lang": pa.array(held.langs[at:to], pa.string()),
                    "word": part.cast(pa.large_string()).cast(pa.string()),
                    "n": held.counts[at:to],
                }
            )
            at = to


# --- packing -----------------------------------------------------------------


@dataclass(frozen=True)
class Packing:
    """Phrases of numbers below 2**bits - 1 as permuted numbers of two halves of ``half`` bits each.

    Word k is packed as k + 1 and the missing third word of a pair as 0, so pairs
    and triples never meet.
    """

    bits: int

    @property
    def half(self) -> int:
        return (LONGEST * self.bits + 1) // 2

    def check(self) -> None:
        if self.half > 63:
            raise ValueError("more than 2**42 frequent words")

    def _turn(self, x: np.ndarray, key: int) -> np.ndarray:
        return mix(x + np.uint64(key)) >> np.uint64(64 - self.half)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The halves of each phrase after the permutation; words 1, 2 and 3 from the left."""
        a, b, c = (w.astype(np.uint64) for w in words)
        bits, half = self.bits, self.half
        # The lower half takes the third word and the low bits of the second one.
        low_bits = half - bits
        low = c | ((b & np.uint64((1 << low_bits) - 1)) << np.uint64(bits))
        high = (b >> np.uint64(low_bits)) | (a << np.uint64(bits - low_bits))
        for key in range(4):
            high, low = low, high ^ self._turn(low, key)
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        for key in reversed(range(4)):
            high, low = low ^ self._turn(high, key), high
        bits, low_bits = self.bits, self.half - self.bits
        mask = np.uint64((1 << bits) - 1)
        b = (low >> np.uint64(bits)) | ((high << np.uint64(low_bits)) & mask)
        return [(high >> np.uint64(bits - low_bits)).astype(np.int64), b.astype(np.int64), (low & mask).astype(np.int64)]


@dataclass
class QuotientFilter:
    """Sorted counters: permuted phrases as (high, low) halves and their counts."""

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int) -> QuotientFilter:
        """Sort and add up equal phrases; ``counts`` None: one each."""
        if 2 * half <= 64:
            key = (high << np.uint64(half)) | low
            if counts is None:
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, counts = key[order], counts[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(first)
            high, low = key[start] >> np.uint64(half), key[start] & np.uint64((1 << half) - 1)
        else:
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            counts = None if counts is None else counts[order]
            first = np.ones(len(high), bool)
            first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            start = np.flatnonzero(first)
            high, low = high[start], low[start]
        n = len(order) if counts is not None or 2 * half > 64 else len(key)
        sums = np.diff(np.append(start, n)) if counts is None else (np.add.reduceat(counts, start) if len(start) else counts)
        return QuotientFilter(high, low, sums.astype(np.int64))

    def shard_cuts(self, shard_bits: int, half: int) -> np.ndarray:
        """Where each shard, a range of quotients, begins."""
        marks = np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(half - shard_bits)
        return np.append(np.searchsorted(self.high, marks), len(self.high))

    def packed(self, low: int, high: int, half: int) -> bytes:
        """Entries ``low`` to ``high - 1``: entries per quotient, remainders and counts.

        The quotients are about as many as the entries, counted from the first one;
        a remainder is the lower bits of the high half and the whole low half.
        """
        n = high - low
        tops, rests, counts = self.high[low:high], self.low[low:high], self.counts[low:high]
        span = int(tops[-1] - tops[0]) + 1
        shift = max(0, span.bit_length() - n.bit_length())
        base = int(tops[0]) >> shift
        quotient = (tops >> np.uint64(shift)).astype(np.int64) - base
        runs = np.bincount(quotient).astype(np.uint32)
        wide = -(-shift // 8)
        parts = [_narrow(runs), _bytes(tops & np.uint64((1 << shift) - 1), wide), _bytes(rests, -(-half // 8)), _narrow(counts)]
        return struct.pack("<QQIIIII", base, n, shift, len(runs), *(len(p) for p in parts[:3])) + b"".join(parts)

    @staticmethod
    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base, n, shift, n_runs, *sizes = struct.unpack_from("<QQIIIII", data)
        at = struct.calcsize("<QQIIIII")
        pieces = []
        for size in (*sizes, len(data) - at - sum(sizes)):
            pieces.append(data[at : at + size])
            at += size
        quotient = np.repeat(np.arange(n_runs, dtype=np.uint64) + np.uint64(base), _widened(pieces[0]))
        return (quotient << np.uint64(shift)) | _numbers(pieces[1], n), _numbers(pieces[2], n), _widened(pieces[3])


def _narrow(values: np.ndarray) -> bytes:
    """A byte per value; values from 255 on follow in full."""
    large = values >= 255
    return struct.pack("<Q", len(values)) + np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u8").tobytes()


def _widened(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", -1, 8 + n).astype(np.int64)
    return out


def _bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _merge(batches: Iterator[pa.RecordBatch], packing: Packing, least: int) -> Iterator[pa.RecordBatch]:
    """Per shard the merged filter's phrases with ``least`` occurrences or more, as word numbers (third: -1 for pairs)."""
    shard, held = None, []

    def merged() -> Iterator[pa.RecordBatch]:
        parts = [QuotientFilter.unpacked(d) for d in held]
        whole = QuotientFilter.of(*(np.concatenate(p) for p in zip(*parts, strict=True)), packing.half)
        often = whole.counts >= least
        words = packing.unpack(whole.high[often], whole.low[often])
        yield pa.RecordBatch.from_pydict({"w1": words[0] - 1, "w2": words[1] - 1, "w3": words[2] - 1, "a": whole.counts[often]})

    for batch in batches:
        for at, data in zip(batch["shard"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if shard is not None and at != shard:
                yield from merged()
                held = []
            shard = at
            held.append(data)
    if held:
        yield from merged()


# --- jobs --------------------------------------------------------------------


@dataclass
class Counts:
    """``words`` (id, lang, word, f), ``phrases`` (w1, w2, w3, a; w3 -1 for pairs), ``totals`` (lang, n)."""

    words: DataFrame
    phrases: DataFrame
    totals: DataFrame


def count_phrases(docs: DataFrame, least: int, file_bytes: int = FILE_BYTES, packing: Packing | None = None) -> Counts:
    """Exact counts of the words and phrases of (lang, text) with ``least`` occurrences or more."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    files = save_texts(rows, "texts", file_bytes)
    met = saved(per_file(files, _word_rows, "chunk long, place long, lang string, word string, n long"), "words")
    every = saved(met.groupBy("lang", "word").agg(F.sum("n").alias("f")).select("lang", "word", "f"), "counts")
    totals = saved(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = saved(numbered(every.filter(F.col("f") >= least), [], ["lang", "word"], "id"), "dictionary")
    size = words.count()
    total = int(totals.agg(F.sum("n")).first()[0] or 0)
    packing = packing or Packing(max(1, int(size + 1).bit_length()))
    packing.check()
    shards = max(LEAST_SHARDS, 1 << max(0, (2 * total // SHARD_PHRASES)).bit_length())
    shard_bits = min(shards.bit_length() - 1, packing.half)
    known = met.join(words, ["lang", "word"]).select("chunk", "place", "id")

    def fill(chunk: int, path: str, got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = file_words(path)
        number = np.zeros(len(held.counts), np.int64)
        number[got["place"]] = got["id"] + 1
        word, piece = number[held.tokens], held.pieces
        pair = np.flatnonzero((piece[1:] == piece[:-1]) & (word[1:] > 0) & (word[:-1] > 0))
        triple = pair[:-1][np.diff(pair) == 1] if len(pair) else pair
        none = np.zeros(len(pair), np.int64)
        parts = [packing.pack([word[pair], word[pair + 1], none]), packing.pack([word[triple], word[triple + 1], word[triple + 2]])]
        filled = QuotientFilter.of(*(np.concatenate(p) for p in zip(*parts, strict=True)), None, packing.half)
        cuts = filled.shard_cuts(shard_bits, packing.half)
        some = np.flatnonzero(np.diff(cuts))
        for low in range(0, len(some), 16):
            part = some[low : low + 16]
            data = [filled.packed(int(cuts[k]), int(cuts[k + 1]), packing.half) for k in part]
            yield pa.RecordBatch.from_pydict({"shard": part.astype(np.int64), "data": pa.array(data, pa.binary())})

    filters = per_chunk(files, known, fill, "shard long, data binary")
    dealt = filters.repartition(1 << shard_bits, "shard").sortWithinPartitions("shard")
    phrases = dealt.mapInArrow(lambda batches: _merge(batches, packing, least), "w1 long, w2 long, w3 long, a long")
    return Counts(words, saved(phrases, "phrases"), totals)


def score_phrases(counts: Counts, scale: int = 1_000_000) -> DataFrame:
    """(lang, phrase, w1, w2, w3, a, l, r, score): each phrase with its lowest-scoring cut.

    The score is floor(scale * a * a / (l * r)) in whole numbers of up to 38 digits;
    equal scores go to the earlier cut.
    """
    words, pairs = counts.words.select("id", "f"), counts.phrases.filter("w3 < 0")

    def looked_up(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(words.select(F.col("id").alias(key), F.col("f").alias(name)), key)

    two = looked_up(looked_up(pairs, "w1", "_f1"), "w2", "_f2")
    three = looked_up(looked_up(counts.phrases.filter("w3 >= 0"), "w1", "_f1"), "w3", "_f3")
    # Both pairs of a phrase of three words are at least as frequent, so they are there.
    three = three.join(pairs.select("w1", "w2", F.col("a").alias("_f12")), ["w1", "w2"])
    three = three.join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("_f23")), ["w2", "w3"])

    def score(left: str, right: str) -> str:
        whole = [f"CAST({c} AS DECIMAL(15, 0))" for c in ("a", left, right)]
        return f"(CAST({scale} AS DECIMAL(8, 0)) * ({whole[0]} * {whole[0]})) DIV ({whole[1]} * {whole[2]})"

    fields = ["w1", "w2", "w3", "a"]
    two = two.select(*fields, F.col("_f1").alias("l"), F.col("_f2").alias("r"), F.expr(score("_f1", "_f2")).alias("score"))
    cuts = [F.struct(F.expr(score(x, y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "_f1", "_f23"), (2, "_f12", "_f3"))]
    three = three.select(*fields, F.array_min(F.array(*cuts)).alias("s")).select(*fields, "s.l", "s.r", "s.score")
    return two.unionByName(three)


def mine(docs: DataFrame, least: int = 10, most: int = 2000, share: int = 50, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two and three words.

    ``a`` counts a phrase inside pieces between punctuation, overlaps included,
    ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` the language's
    words. Phrases inside a longer candidate that has at least ``share`` percent
    of their count are dropped. A null language is ``und``, a null text empty;
    repeated rows count as often as they are there; no texts give no rows.
    """
    counts = count_phrases(docs, least, **settings)
    longer = counts.phrases.filter("w3 >= 0")
    inside = longer.select("w1", "w2", "a").union(longer.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("_longer"))
    scored = score_phrases(counts).join(inside.withColumn("w3", F.lit(-1).cast("long")), ["w1", "w2", "w3"], "left")
    kept = scored.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    for k in (1, 2, 3):
        names = counts.words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"_t{k}"), *([F.col("lang")] if k == 1 else []))
        kept = kept.join(names, f"w{k}", "left" if k == 3 else "inner")
    kept = kept.select("lang", F.concat_ws(" ", "_t1", "_t2", "_t3").alias("phrase"), "a", "l", "r", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return first.join(counts.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
