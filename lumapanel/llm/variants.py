"""Spelling variants by dynamic programming over sorted word lists.

Two words are near if they differ by one inserted, deleted or replaced code
point. A word is compared with a sorted list from its first letter on: the row of
the edit matrix for a prefix is computed once for the whole range of words that
share the prefix (their neighbours' common prefixes, LCPs, say how far the rows
hold), and a range whose row already exceeds one edit is skipped. Rows are kept
in a band; the partner is never the shorter word, so the band is the main
diagonal and the one below it.

Lists: with m the shorter length, a pair agrees in its first m // 2 letters or
in its last m - m // 2, so words meet in the list of their first or of their last
letters. A list longer than ``LIST_WORDS`` is cut again in the same way: at a
place between its shared letters, pairs whose first difference lies behind the
place agree up to it, the others agree after it. Each pair belongs to one list
by the place of its first difference, and no list grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .token_files import ragged

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIST_WORDS, LIST_LETTERS = 4096, 64  # a list of longer open letters holds fewer words
CELLS = 1 << 21  # code points compared at once
QUERIES = 1 << 14  # words that walk their lists together


def letter_runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): each maximal run of letters of at least ``least`` of them, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def count_words(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of the words of (word) with at least that many code points and occurrences, saved."""
    long = words.filter(F.length("word") >= min_length)
    return saved(long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "vocabulary")


# --- lists -------------------------------------------------------------------


def _spec(m: Column, head: Column, tail: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), head.cast("int").alias("head"), tail.cast("int").alias("tail"))


def _in_lists(words: DataFrame, specs: Column) -> DataFrame:
    """(word, n, m, head, tail, list, mid): a row for each list of a word.

    ``list`` names the list by m and the shared letters, ``mid`` is what lies between them.
    """
    rows = words.select("word", "n", F.explode(specs).alias("s")).select("word", "n", "s.*")
    size = F.length("word")
    first, last = F.substr("word", F.lit(1), F.col("head")), F.substr("word", size - F.col("tail") + 1)
    name = F.concat_ws(":", "m", "head", first, last)
    return rows.withColumns({"list": name, "mid": F.substr("word", F.col("head") + 1, size - F.col("head") - F.col("tail"))})


def _lists(vocabulary: DataFrame, min_length: int, most: int) -> DataFrame:
    """Every word in its lists, long lists cut until they have ``most`` words or one open letter."""
    size = F.length("word")

    def both(m: Column) -> list[Column]:
        half = F.floor(m / 2)
        return [_spec(m, half, F.lit(0)), _spec(m, F.lit(0), m - half)]

    ends = F.filter(F.array(*both(size), *both(size - 1)), lambda s: s["m"] >= min_length)
    open_lists, done = _in_lists(vocabulary, ends), None
    while True:
        free = F.col("m") - F.col("head") - F.col("tail")
        counts = open_lists.groupBy("list").agg(F.count(F.lit(1)).alias("_n"), F.max(free).alias("_free"))
        size = F.col("_n") * F.greatest(F.lit(1), F.col("_free") / LIST_LETTERS)
        long = saved(counts.filter((size > most) & (F.col("_free") > 1)).select("list"), "long-lists")
        if long.isEmpty():
            return open_lists if done is None else done.unionByName(open_lists)
        short = open_lists.join(long, "list", "left_anti")
        done = short if done is None else done.unionByName(short)
        place = F.col("head") + F.ceil(free / 2)
        halves = F.array(_spec(F.col("m"), place, F.col("tail")), _spec(F.col("m"), F.col("head"), F.col("m") - place))
        # Each round halves the open letters, so there are few rounds.
        open_lists = _in_lists(saved(open_lists.join(long, "list", "left_semi").select("word", "n", halves.alias("halves")), "cut-lists"), F.col("halves"))


# --- one list after the other ------------------------------------------------


def near_pairs(codes: np.ndarray, size: np.ndarray, group: np.ndarray, short: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of neighbours in sorted lists, x of the shorter length.

    ``codes`` holds the words' open letters in rows, ``size`` their number,
    ``group`` the list (the rows are sorted by list and letters), ``short`` which
    words have the list's shorter length. In a ``closed`` list letters follow
    that all words share; a partner that only adds a letter before those belongs
    to another list. Pairs of equal length come in both directions.
    """
    n, width = codes.shape
    same = np.zeros(n, bool)
    same[1:] = group[1:] == group[:-1]
    # Common prefix of each word with its predecessor; -1 begins a list.
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        differ = codes[1:] != codes[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(n - 1, np.int64)
        lcp[1:] = np.where(same[1:], np.minimum(np.minimum(first, size[1:]), size[:-1]), -1)
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], n)
    of_list = np.cumsum(~same) - 1
    left, right = [], []
    asked = np.flatnonzero(short)
    for low in range(0, len(asked), QUERIES):
        x = asked[low : low + QUERIES]
        lo, hi = begin[of_list[x]], end[of_list[x]]
        main, below = np.zeros(len(x), np.int8), np.full(len(x), 2, np.int8)
        for depth in range(width + 1):
            if not len(x):
                break
            # A word that ends here stands first in its range.
            ends = size[lo] == depth
            full = size[x]
            hit = ends & (((full == depth) & (main == 1)) | ((full == depth - 1) & (below == 1)))
            if hit.any():
                a, b = x[hit], lo[hit]
                keep = np.ones(len(a), bool)
                grown = np.flatnonzero(closed[a] & (size[b] > size[a]))
                if len(grown):
                    differ = codes[a[grown]] != codes[b[grown]]
                    keep[grown] = differ.argmax(axis=1) < size[a[grown]]
                left.append(a[keep])
                right.append(b[keep])
            lo = lo + ends
            live = lo < hi
            x, lo, hi, main, below = x[live], lo[live], hi[live], main[live], below[live]
            if not len(x) or depth == width:
                break
            # Ranges that share one letter more: they begin where a neighbour's common prefix ends here.
            starts = np.flatnonzero(lcp <= depth)
            at, to = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
            parent = np.repeat(np.arange(len(x)), to - at)
            pick = ragged(at, to - at)
            child = starts[pick]
            after = np.minimum(np.append(starts[1:], n)[pick], hi[parent])
            x = x[parent]
            letter = codes[child, depth]
            here = np.where(depth < size[x], codes[x, depth], -1)
            before = np.where((depth > 0) & (depth <= size[x]), codes[x, depth - 1], -1)
            m0, m1 = main[parent], below[parent]
            new_below = np.minimum(m1 + (letter != before), m0 + 1)
            new_main = np.minimum(m0 + (letter != here), new_below + 1)
            fits = np.minimum(new_main, new_below) <= 1
            x, lo, hi = x[fits], child[fits], after[fits]
            main, below = np.minimum(new_main[fits], 2).astype(np.int8), np.minimum(new_below[fits], 2).astype(np.int8)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _neighbours(words: list[str], n: np.ndarray, mids: list[str], group: np.ndarray, m: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, form_n, form): per word and list its number of near words and the best of them."""
    size = np.fromiter(map(len, mids), np.int64, len(mids))
    flat = np.frombuffer("".join(mids).encode("utf-32-le"), np.uint32).astype(np.int32)
    codes = np.full((len(mids), int(size.max(initial=0))), -2, np.int32)
    codes[np.repeat(np.arange(len(mids)), size), ragged(np.zeros(len(mids), np.int64), size)] = flat
    length = np.fromiter(map(len, words), np.int64, len(words))
    x, y = near_pairs(codes, size, group, length == m, tail > 0)
    uneven = length[x] != length[y]
    x, y = np.concatenate([x, y[uneven]]), np.concatenate([y, x[uneven]])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    counts = np.diff(np.append(first, len(x)))
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array([words[k] for k in x[first]], pa.string()),
            "n_near": counts,
            "form_n": n[y[first]],
            "form": pa.array([words[k] for k in y[first]], pa.string()),
        }
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists, some together up to about ``CELLS`` code points."""
    fields = ("mid", "word", "n", "m", "tail")
    held: list[list] = [[] for _ in fields]
    numbers, name, widest = [], None, 0

    def flush() -> pa.RecordBatch:
        nonlocal numbers, widest
        mids, words, n, m, tail = held
        out = _neighbours(words, np.array(n, np.int64), mids, np.array(numbers), np.array(m), np.array(tail))
        for h in held:
            h.clear()
        numbers, widest = [], 0
        return out

    for batch in batches:
        for of, *row in zip(*(batch[c].to_pylist() for c in ("list", *fields)), strict=True):
            if of != name and len(numbers) * widest > CELLS:
                yield flush()
            numbers.append(numbers[-1] + (of != name) if numbers else 0)
            for h, v in zip(held, row, strict=True):
                h.append(v)
            name, widest = of, max(widest, len(row[0]))
    if numbers:
        yield flush()


def near_words(vocabulary: DataFrame, min_length: int, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of every word of (word, n) that has near words.

    ``form`` is the near word of largest n, the smallest in code-point order of
    several. Words must be distinct, not null and have at least ``min_length``
    code points, 2 or more.
    """
    if min_length < 2:
        raise ValueError("words need two letters at least")
    rows = _lists(vocabulary, min_length, list_words).select("list", "mid", "word", "n", "m", "tail")
    parts = rows.repartition("list").sortWithinPartitions("list", "mid")
    found = parts.mapInArrow(_scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("turned"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.turned")).alias("form_n"), F.col("b.form").alias("form")
    )


def group_variants(vocabulary: DataFrame, min_length: int, ratio: int = 10, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a saved (word, n).

    ``form`` is the near word of largest n where that is at least ``ratio`` times
    the word's n, ``root`` the last of the forms that follow one another, the word
    itself if it has none. An empty vocabulary gives no rows.
    """
    near = near_words(vocabulary, min_length, list_words)
    led = F.col("form_n") >= F.col("n") * ratio
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n"),
    )
    words = saved(words, "forms")
    # n grows by the ratio with every form, so a chain is short; each round doubles the steps taken.
    top = words.agg(F.max("n")).first()[0] or 1
    steps = 0
    while ratio**steps <= top:
        steps += 1
    hops = words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hops = saved(hops.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return words.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
