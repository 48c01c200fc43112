"""Text quality by histogram gradient-boosted trees over document statistics.

Every text becomes one row of numbers (lengths, shares of kinds of characters,
repetition of words and lines, and so on), computed by numpy over Arrow buffers,
many texts at once. The trees are grown on the numbers of a bounded sample of
labelled texts, cut into at most ``BINS`` bins by quantiles: each level sums
gradients and curvatures per (node, statistic, bin) and splits where the gain is
largest. The finished trees lie in flat arrays, in which all texts of a batch
walk down all trees together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .words import inside_text, mix, slices, text_bytes, window_hashes, words_of

# Bound of the fitting sample; everything else covers all rows and whole texts.
MAX_FIT_ROWS = 20_000
BINS, TREES, DEPTH, RATE = 64, 150, 4, 0.1
RIDGE, LEAST_CURVATURE, LEAST_GAIN = 1.0, 1.0, 1e-3

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "bytes_per_word", "word_length_spread", "longest_word", "one_letter_words", "words_per_line",
    "line_length_spread", "longest_line", "letters", "upper", "digits", "spaces", "symbols", "brackets", "sentence_ends", "commas", "bars", "marks_doubled",
    "far_bytes", "controls", "capitalised", "all_upper", "without_letters", "ending_in_symbol", "lines_ending_sentence", "distinct_words",
    "top_word", "distinct_pairs", "distinct_lines", "repeated_line_bytes", "byte_entropy",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _FAR, _END, _COMMA, _BAR, _BRACKET, _SYMBOL, _CONTROL = range(11)
_KIND = np.full(256, _SYMBOL, np.uint8)
for _kind, _chars in (
    (_CONTROL, [*range(32), 127]), (_SPACE, [9, 10, 11, 12, 13, 32]), (_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)),
    (_FAR, range(128, 256)), (_END, b".!?"), (_COMMA, b",;:'\"-"), (_BAR, b"|\\/_="), (_BRACKET, b"()[]{}<>"),
):
    _KIND[list(_chars)] = _kind
_VALUE = np.random.default_rng(23).integers(1, 2**63, 256, dtype=np.uint64)
_ODD, _TAIL = np.zeros(11, bool), np.zeros(11, bool)
_ODD[[_SYMBOL, _END, _COMMA, _BAR]] = True
_TAIL[[_SYMBOL, _BAR, _BRACKET]] = True


def _per_text(starts: np.ndarray, values: np.ndarray, ufunc=np.add) -> np.ndarray:
    """``values`` reduced between the offsets; 0 for empty stretches."""
    out = np.zeros(len(starts) - 1)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, starts[full])
    return out


def _spread(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(starts), 1)
    mean = _per_text(starts, values) / n
    return np.sqrt(np.maximum(_per_text(starts, values.astype(float) ** 2) / n - mean**2, 0))


def _repeats(owner: np.ndarray, keys: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct keys, occurrences of the most frequent one, weight of all occurrences but the first."""
    bits = np.uint64(max(1, n.bit_length()))
    both = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits)  # sorted by text, then by key
    order = None if weight is None else np.argsort(both, kind="stable")
    both = np.sort(both) if order is None else both[order]
    who = (both >> (np.uint64(64) - bits)).astype(np.int64)
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    start = np.flatnonzero(first)
    times = np.diff(np.append(start, len(both)))
    ends = np.searchsorted(who[start], np.arange(n + 1))
    again = np.bincount(who[~first], None if order is None else weight[order][~first], minlength=n)
    return np.diff(ends).astype(float), _per_text(ends, times, np.maximum), again.astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` per text; a null text is empty, and an empty one has zeros only."""
    rows = [np.zeros((0, len(STATISTICS)))]
    for low, high in slices(texts):
        rows.append(_statistics(texts.slice(low, high - low)))
    return np.concatenate(rows)


def _statistics(texts: pa.Array) -> np.ndarray:
    data, at = text_bytes(texts)
    n, size = len(texts), np.diff(at)
    total = np.maximum(size, 1)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    kind = _KIND[data]
    histogram = np.bincount(owner.astype(np.int64) * 256 + data, minlength=n * 256).reshape(n, 256)
    share = histogram @ (_KIND[:, None] == np.arange(11)).astype(float) / total[:, None]
    p = histogram / total[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    odd = _ODD[kind]
    doubled = np.zeros(len(data), bool)
    doubled[1:] = odd[1:] & (data[1:] == data[:-1]) & (owner[1:] == owner[:-1])

    w = words_of(texts)
    words, of_word, length = np.diff(w.offsets), w.text_of_word(), w.ends - w.starts
    some = np.maximum(words, 1)
    upper, lower, far = (np.diff(np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])[np.stack([w.starts, w.ends])], axis=0)[0] for k in (_UPPER, _LOWER, _FAR))
    head = kind[w.starts] == _UPPER
    tail = _TAIL[kind[w.ends - 1]] if len(w.ends) else head
    rate = lambda mask: np.bincount(of_word[mask], minlength=n) / some
    distinct, top, _ = _repeats(of_word, w.hashes, n)
    pairs, inside = window_hashes(w.hashes, 2), inside_text(w.offsets, 2)
    pair_owner = of_word[: len(pairs)][inside]
    distinct_pairs, _, _ = _repeats(pair_owner, pairs[inside], n)

    # Every line ends with a line feed or with its text.
    feeds = data == 10
    feeds[at[1:][size > 0] - 1] = True
    cuts = np.flatnonzero(feeds) + 1
    begins = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    line_size = cuts - begins
    line_owner = owner[begins] if len(begins) else begins
    line_at = np.searchsorted(line_owner, np.arange(n + 1))
    lines = np.diff(line_at)
    line_hash = mix(np.add.reduceat(_VALUE[data] * _places(begins, line_size), begins)) if len(begins) else begins.astype(np.uint64)
    unique_lines, _, line_again = _repeats(line_owner, line_hash, n, line_size)
    # The last character of a line that is no space.
    solid = np.flatnonzero(kind != _SPACE)
    last = np.append(solid, -1)[np.searchsorted(solid, cuts) - 1]
    closes = (last >= begins) & (kind[np.maximum(last, 0)] == _END) if len(cuts) else np.zeros(0, bool)
    some_lines = np.maximum(lines, 1)

    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), size / some, _spread(w.offsets, length), _per_text(w.offsets, length, np.maximum), rate(length == 1),
        words / some_lines, _spread(line_at, line_size), _per_text(line_at, line_size, np.maximum), share[:, _UPPER] + share[:, _LOWER], share[:, _UPPER],
        share[:, _DIGIT], share[:, _SPACE], share[:, _SYMBOL], share[:, _BRACKET], share[:, _END], share[:, _COMMA], share[:, _BAR],
        np.bincount(owner[doubled], minlength=n) / total, share[:, _FAR], share[:, _CONTROL], rate(head & (lower + far > 0)),
        rate((upper > 1) & (lower == 0)), rate(upper + lower + far == 0), rate(tail),
        np.bincount(line_owner[closes], minlength=n) / some_lines, distinct / some, top / some, distinct_pairs / np.maximum(words - 1, 1),
        unique_lines / some_lines, line_again / total, entropy,
    ]
    return np.where(size[:, None] > 0, np.stack(columns, axis=1), 0.0)


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An odd multiplier for each place in its line."""
    place = np.arange(int(sizes.sum()), dtype=np.uint64) - np.repeat(begins.astype(np.uint64), sizes)
    return (place * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# --- trees -------------------------------------------------------------------


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points to itself, so every text walks ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds per row of statistics."""
        out = np.full(len(x), self.start)
        for low in range(0, len(x), 4096):
            part = x[low : low + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[low : low + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -60, 60)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each column: quantiles, or the middles between all its values if they are few."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) <= bins:
            out.append((values[1:] + values[:-1]) / 2)
        else:
            out.append(np.unique(np.quantile(column, np.arange(1, bins) / bins)))
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boost logistic loss; deterministic. Without one of the classes every text scores the prior."""
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(prior / (1 - prior)))
    nodes: list[list] = [[], [], [], [], []]  # feature, threshold, left, right, value
    roots: list[int] = []
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    n, width = x.shape
    columns = np.arange(width)
    margin = np.full(n, start)

    def add(feature: int, threshold: float, value: float) -> int:
        k = len(nodes[0])
        for held, v in zip(nodes, (feature, threshold, k, k, value), strict=True):
            held.append(v)
        return k

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, p * (1 - p)
        root = add(0, np.inf, 0.0)
        roots.append(root)
        level, at = [root], np.zeros(n, np.int64)  # open nodes, and each row's place among them (-1: in a leaf)
        step = np.zeros(n)
        for deep in range(depth + 1):
            live = np.flatnonzero(at >= 0)
            cell = (at[live, None] * width + columns) * bins + binned[live]
            shape = (len(level), width, bins)
            g = np.bincount(cell.ravel(), np.repeat(gradient[live], width), int(np.prod(shape))).reshape(shape)
            h = np.bincount(cell.ravel(), np.repeat(curvature[live], width), int(np.prod(shape))).reshape(shape)
            whole_g, whole_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
            left_g, left_h = g.cumsum(axis=2)[..., :-1], h.cumsum(axis=2)[..., :-1]
            right_g, right_h = whole_g[:, None, None] - left_g, whole_h[:, None, None] - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (whole_g**2 / (whole_h + RIDGE))[:, None, None]
            gain[(left_h < LEAST_CURVATURE) | (right_h < LEAST_CURVATURE)] = -1.0
            best = gain.reshape(len(level), -1).argmax(axis=1)
            value = rate * whole_g / (whole_h + RIDGE)
            onward, place = [], np.full((len(level), 2), -1)
            split_on, split_at = np.zeros(len(level), np.int64), np.full(len(level), bins)
            for k, node in enumerate(level):
                feature, cut = divmod(int(best[k]), bins - 1)
                if deep == depth or gain[k, feature, cut] <= LEAST_GAIN:
                    nodes[4][node] = float(value[k])
                    continue
                nodes[0][node], nodes[1][node] = feature, float(edges[feature][cut])
                nodes[2][node], nodes[3][node] = add(0, np.inf, 0.0), add(0, np.inf, 0.0)
                place[k] = len(onward), len(onward) + 1
                onward += [nodes[2][node], nodes[3][node]]
                split_on[k], split_at[k] = feature, cut
            own = at[live]
            step[live] = value[own]
            side = (binned[live, split_on[own]] > split_at[own]).astype(np.int64)
            at[live] = place[own, side]
            level = onward
            if not level:
                break
        margin += step
    kinds = (np.int64, float, np.int64, np.int64, float)
    arrays = [np.array(v, k) for v, k in zip(nodes, kinds, strict=True)]
    return Forest(np.array(roots, np.int64), *arrays, start, depth)


# --- jobs --------------------------------------------------------------------


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32(doc_id as text) modulo ``folds`` is ``fold``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def _with_statistics(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and each text's statistics as an array."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), lists], names=[*keep, "x"])

    return df.select(*keep, "text").mapInArrow(run, f"{fields}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS, **settings) -> Forest:
    """Fit on at most ``max_rows`` labelled ids of (doc_id, text), those with the smallest hashes.

    Rows of the held-out fold, unlabelled rows and null texts aren't used. Several
    labels of one id: the lowest. Several rows of one id: the one with the
    smallest statistics. Only statistics come to the driver, ``max_rows`` rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.min(label) > 0).cast("int").alias("_y"))
    chosen = saved(known.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(max_rows), "labelled")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(chosen, F.col("doc_id") == F.col("_id"))
    one = _with_statistics(rows, "_id", "_y").groupBy("_id").agg(F.min("x").alias("x"), F.first("_y").alias("y"))
    fitted = saved(one.select("_id", "x", F.col("y").cast("double").alias("y")), "statistics").orderBy("_id").toArrow()
    x = fitted["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if len(fitted) else np.zeros((0, len(STATISTICS)))
    return fit(x, fitted["y"].to_numpy() if len(fitted) else np.zeros(0), **settings)


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text), from its whole text alone.

    ``score`` is the probability of label 1. A null text is empty; repeated rows
    score alike; without labels of both kinds every text has the same score.
    """
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.value.probability(statistics(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score)], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
