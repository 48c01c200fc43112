"""Toxic texts by a support vector machine on a gapped subsequence kernel.

The kernel of two words is the normalised inner product of their subsequences of
three to five letters, word ends included, with at most two letters left out;
each letter left out costs a factor ``DECAY``. So an insult with an inserted
letter stays near the insult. A Nystroem map on landmark words makes the machine
linear, and a linear machine on landmarks is one weight per subsequence (hashed to
``FEATURES`` numbers): scoring a word needs no kernel evaluation. A text scores as
its worst word.

Words are read in lower case, ``0 1 3 4 5 7 @ $`` as letters, other characters
than letters dropped (``i.d.i.o.t`` is ``idiot``); letters outside a-z share a few
codes; three or more letters that stand alone are read together.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved

DECAY = 0.7
GAP = 2
OTHERS = 12  # codes of the letters outside a-z
LETTERS = 29 + OTHERS  # 0 unused, a-z, the word's start and its end, the others
PATTERNS = [
    (offsets, DECAY ** (offsets[-1] - size + 1))
    for size in (3, 4, 5)
    for offsets in [(0, *rest) for rest in combinations(range(1, size + GAP), size - 1)]
]
FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS
CACHE_WORDS = 250_000  # some 50 MB of a worker

# Bounds of the fitting sample; everything else covers all rows.
MAX_TOXIC, MAX_CLEAN, MAX_FIT_CHARS = 1500, 2500, 100_000
MAX_WORDS, LANDMARKS = 10_000, 256
FALSE_ALARM = 10  # about the clean texts there are to a toxic one
LIFT = 4  # times as often in toxic texts as in clean ones

_READ = str.maketrans("013457@$", "oieastas")
_CODE = np.zeros(128, np.int64)
_CODE[97:123] = np.arange(1, 27)
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")


def tokens(text: str | None) -> set[str]:
    """Distinct white-space tokens of a text, and its letters that stand alone read together."""
    if not text:
        return set()
    found = set(text.split())
    found.update("".join(m.split()) for m in _SPACED.findall(text))
    return found


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the words with their end marks, and the word of each."""
    joined = "\n" + unicodedata.normalize("NFKC", "\n".join(words)).lower().translate(_READ) + "\n"
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    far = 29 + ((point * 2654435761) >> 13) % OTHERS
    mark = (point < 0xAA) | ((point > 0xAA) & (point < 0xC0) & (point != 0xB5) & (point != 0xBA)) | ((point >= 0x2000) & (point < 0x2070))
    code = np.where(point < 128, _CODE[np.minimum(point, 127)], np.where(mark, 0, far))
    breaks = point == 10
    kept = (code > 0) | breaks
    code, breaks = code[kept], breaks[kept]
    # Each line break becomes the end of a word and the start of the next.
    at = np.arange(len(code)) + np.cumsum(breaks) - breaks
    codes = np.full(len(code) + int(breaks.sum()), 27, np.int64)
    codes[at] = np.where(breaks, 28, code)
    word = np.repeat(np.arange(-1, int(breaks.sum())), np.diff(np.concatenate([[0], at[breaks] + 1, [len(codes)]])))
    inside = (word >= 0) & (word < len(words))
    return codes[inside], word[inside]


def subsequences(codes: np.ndarray, word: np.ndarray):
    """For each pattern: the words, feature numbers and weight of its occurrences."""
    codes = codes.astype(np.uint64)
    for offsets, weight in PATTERNS:
        n = len(codes) - offsets[-1]
        if n <= 0:
            continue
        ok = np.flatnonzero(word[:n] == word[offsets[-1] :])
        number = np.full(len(ok), len(offsets), np.uint64)
        for o in offsets:
            number = number * np.uint64(LETTERS) + codes[ok + o]
        yield word[ok], ((number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), weight


@dataclass
class Machine:
    """Weights of the subsequences, and the line from a text's worst word to a probability."""

    weights: np.ndarray
    slope: float
    shift: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Decision value per word; -1 for words without three letters and marks."""
        if not words:
            return np.empty(0)
        codes, word = letters(words)
        total, norm = np.zeros(len(words)), np.zeros(len(words))
        for at, number, weight in subsequences(codes, word):
            total += np.bincount(at, self.weights[number], len(words)) * weight
            norm += np.bincount(at, minlength=len(words)) * weight**2
        return np.where(norm > 0, total / np.sqrt(np.maximum(norm, 1e-12)), -1.0)

    def worst(self, bags: list[set[str]], cache: dict[str, float]) -> np.ndarray:
        fresh = list({w for bag in bags for w in bag if w not in cache})
        cache.update(zip(fresh, self.word_scores(fresh).tolist(), strict=True))
        return np.array([max(map(cache.__getitem__, bag), default=-1.0) for bag in bags])

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


def _kernel_map(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel of words and landmarks; the landmarks' feature numbers and normalised features."""
    n = len(landmarks)
    rows, numbers, values, norms = [], [], [], np.zeros(n)
    for at, number, weight in subsequences(*letters(landmarks)):
        rows.append(at)
        numbers.append(number)
        values.append(np.full(len(at), weight))
        norms += np.bincount(at, minlength=n) * weight**2
    rows, numbers, values = map(np.concatenate, (rows, numbers, values))
    used, column = np.unique(numbers, return_inverse=True)
    dense = np.zeros((len(used) + 1, n), np.float32)
    np.add.at(dense, (column, rows), values / np.sqrt(norms[rows]))
    place = np.full(FEATURES, len(used), np.int64)
    place[used] = np.arange(len(used))
    kernel = np.zeros((len(words), n))
    for low in range(0, len(words), 1000):
        part = words[low : low + 1000]
        total, norm = np.zeros((len(part), n), np.float32), np.zeros(len(part))
        for at, number, weight in subsequences(*letters(part)):
            col = place[number]
            hit = col < len(used)
            if hit.any():
                starts = np.flatnonzero(np.diff(at[hit], prepend=-1))
                total[at[hit][starts]] += np.add.reduceat(dense[col[hit]], starts) * weight
            norm += np.bincount(at, minlength=len(part)) * weight**2
        kernel[low : low + len(part)] = total / np.sqrt(np.maximum(norm, 1e-12))[:, None]
    return kernel, used, dense[:-1]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps on the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Bags:
    """The distinct tokens of labelled texts as numbers of their sorted common vocabulary; no text is held."""

    words: pa.Array
    ids: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(tokens: pa.Array) -> Bags:
        """From one list of tokens per text."""
        flat = tokens.flatten()
        words = flat.unique().sort() if len(flat) else flat
        ids = pc.index_in(flat, words).to_numpy(zero_copy_only=False).astype(np.int32) if len(flat) else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return Bags(words, ids, offsets)

    def bag(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]

    def counts(self, some: list[int]) -> np.ndarray:
        """In how many of some texts each word is."""
        return sum((np.bincount(self.bag(k), minlength=len(self.words)) for k in some), np.zeros(len(self.words), np.int64))

    def names(self, ids: np.ndarray) -> list[str]:
        return self.words.take(pa.array(ids, pa.int64())).to_pylist()

    def scores(self, machine: Machine) -> np.ndarray:
        parts = [machine.word_scores(self.words.slice(low, 1 << 15).to_pylist()) for low in range(0, len(self.words), 1 << 15)]
        return np.concatenate(parts) if parts else np.empty(0)

    def worst(self, value: np.ndarray, some: list[int]) -> np.ndarray:
        return np.array([value[self.bag(k)].max(initial=-1.0) for k in some])


def distinct_bags(bags: Bags, some: list[int]) -> list[int]:
    """Some texts without near copies, whose shared words would all look like evidence.

    A text goes if half of its 16 tokens with the smallest hashes are among those
    of one earlier text.
    """
    crc = np.array([zlib.crc32(w.as_buffer()) for w in bags.words.cast(pa.binary())], np.int64)
    owners: dict[int, list[int]] = {}
    kept = []
    for text in some:
        ids = bags.bag(text)
        marks = ids[np.lexsort((ids, crc[ids]))[:16]].tolist()
        shared = Counter(k for w in marks for k in owners.get(w, ()))
        if not shared or max(shared.values()) * 2 < len(marks):
            for w in marks:
                owners.setdefault(w, []).append(len(kept))
            kept.append(text)
    return kept


def fit(toxic: list[set[str]], clean: list[set[str]], seed: int = 11, rounds: int = 3) -> Machine:
    """Fit on the token sets of labelled texts."""
    lists = pa.array([sorted(bag) for bag in [*toxic, *clean]], pa.list_(pa.string()))
    return fit_bags(Bags.of(lists), np.arange(len(lists)) < len(toxic), seed, rounds)


def fit_bags(bags: Bags, is_toxic: np.ndarray, seed: int = 11, rounds: int = 3) -> Machine:
    """Fit on the tokens of labelled texts.

    Which words make a text toxic isn't labelled: words of toxic texts alone are
    the first suspects; in each round every toxic text puts forward its worst
    word, suspects that score as clean are let go, and the clean words that score
    highest are added to the others. A fifth of the texts is kept for the line to
    probabilities. Without one of the classes every text scores 0. Equal words
    go by code points.
    """
    rng = np.random.default_rng(seed)
    if is_toxic.all() or not is_toxic.any():
        return Machine(np.zeros(FEATURES, np.float32), 0.0, -60.0)
    toxic = distinct_bags(bags, rng.permutation(np.flatnonzero(is_toxic)).tolist())
    clean = rng.permutation(np.flatnonzero(~is_toxic)).tolist()
    cut_t, cut_c = max(1, len(toxic) * 4 // 5), max(1, len(clean) * 4 // 5)
    toxic_fit, clean_fit = toxic[:cut_t], clean[:cut_c]
    counts, seen = bags.counts(toxic_fit), bags.counts(clean_fit)
    lifted = (counts > 0) & (counts * (len(clean_fit) / len(toxic_fit)) >= LIFT * seen)
    # So often in toxic texts that hardly a word would be by chance.
    share, spread = len(toxic_fit) / (len(toxic_fit) + len(clean_fit)), np.bincount(counts + seen)
    for least in range(2, len(toxic_fit) + 2):
        if spread[least:].sum() * share**least < 0.5:
            break
    falling = np.argsort(-counts, kind="stable")
    suspects = falling[(lifted & (counts >= least))[falling]][: MAX_WORDS // 4]
    if not len(suspects):
        suspects = falling[lifted[falling]][: MAX_WORDS // 4]
    if not len(suspects):
        suspects = np.flatnonzero(counts)
    positive = {w: float(n) for w, n in zip(bags.names(suspects), counts[suspects], strict=True)}
    common = np.argsort(-seen, kind="stable")[: MAX_WORDS // 4]
    common = common[(seen[common] > 0) & ~lifted[common]]
    others = np.setdiff1d(np.flatnonzero((seen > 0) & ~lifted), common)
    negative = dict.fromkeys(bags.names(np.concatenate([common, rng.permutation(others)[: MAX_WORDS // 4]])), 1.0)
    machine = value = None
    for turn in range(rounds):
        pos = sorted(positive, key=lambda w: (-positive[w], w))[: MAX_WORDS // 2]
        # Insults spelt with a letter too many must stay on their side.
        for w in pos[: MAX_WORDS // 10]:
            for k in rng.integers(1, len(w), 1) if len(w) > 4 else ():
                positive.setdefault(w[:k] + chr(97 + rng.integers(26)) + w[k:], positive[w] / 6)
        pos = sorted(positive, key=lambda w: (-positive[w], w))[: MAX_WORDS // 2]
        neg = list(negative)
        marks = pos[: LANDMARKS // 2] + [neg[i] for i in rng.permutation(len(neg))[: LANDMARKS - min(len(pos), LANDMARKS // 2)]]
        kernel, used, dense = _kernel_map(pos + neg, marks)
        own = _kernel_map(marks, marks)[0]
        level, vector = np.linalg.eigh((own + own.T) / 2)
        keep = level > 1e-6
        root = vector[:, keep] / np.sqrt(level[keep])
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[[positive[w] for w in pos], [negative[w] for w in neg]]
        cost = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum()) * len(neg) * 2
        beta, shift = _svm(kernel @ root, y, cost)
        weights = np.zeros(FEATURES)
        weights[used] = dense @ (root @ beta)
        machine = Machine(weights.astype(np.float32), 1.0, shift)
        value = bags.scores(machine)
        if turn < rounds - 1:
            # Copies of one text share all their words; those that look like no insult go.
            place = pc.index_in(pa.array(list(positive), pa.string()), bags.words).to_pylist()
            positive = {w: n for (w, n), k in zip(positive.items(), place, strict=True) if k is not None and value[k] > 0}
            witness: Counter[int] = Counter()
            for text in toxic_fit:
                ids = np.sort(bags.bag(text))
                ids = ids[lifted[ids]] if lifted[ids].any() else ids
                if len(ids):
                    witness[int(ids[value[ids].argmax()])] += 1
            for w, n in zip(bags.names(np.array(list(witness), np.int64)), witness.values(), strict=True):
                positive[w] = positive.get(w, 0.0) + n
            calm = np.flatnonzero((seen > 0) & ~lifted)
            hard = calm[np.argsort(-value[calm], kind="stable")[: MAX_WORDS // 8]]
            negative |= dict.fromkeys(bags.names(hard), 2.0)
            for w in positive:
                negative.pop(w, None)
    t = bags.worst(value, toxic[cut_t:] or toxic)
    c = bags.worst(value, clean)  # a fifth of them unseen; all, as false alarms are rare
    return _calibrate(machine, t, c)


def _calibrate(machine: Machine, toxic: np.ndarray, clean: np.ndarray) -> Machine:
    """Logistic line through the worst-word values, targets drawn in as Platt does; its middle at the best cut."""
    x = np.r_[toxic, clean]
    y = np.r_[np.full(len(toxic), (len(toxic) + 1) / (len(toxic) + 2)), np.full(len(clean), 1 / (len(clean) + 2))]
    design, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    # The half-way point lies where misses and false alarms, each of which counts FALSE_ALARM times, are fewest,
    # in the middle of the widest gap between values.
    slope, x = max(float(w[0]), 1e-3), np.unique(x)
    cuts, gaps = (x[1:] + x[:-1]) / 2, np.diff(x)
    if not len(cuts):
        return Machine(machine.weights, slope, -slope * float(x[0]))
    gain = (toxic[:, None] > cuts).mean(axis=0) - FALSE_ALARM * (clean[:, None] > cuts).mean(axis=0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return Machine(machine.weights, slope, -slope * float(cuts[best[gaps[best].argmax()]]))


# --- jobs --------------------------------------------------------------------


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32(doc_id as text) modulo ``folds`` is ``fold``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Machine:
    """Fit on at most ``max_toxic`` + ``max_clean`` labelled rows of (doc_id, text), chosen by a hash of the id.

    Rows of the held-out fold, unlabelled rows, null and over-long texts
    (``MAX_FIT_CHARS``) aren't used for fitting. Several labels of one id: toxic
    if any is; several rows of one: the smallest text. One task fits on this bounded
    sample; only the machine's weights come to the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).alias("_toxic"))
    draw = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20))
    kinds = [known.filter(kind).orderBy(draw, "_id").limit(most) for kind, most in ((F.col("_toxic"), max_toxic), (~F.col("_toxic"), max_clean))]
    chosen = saved(kinds[0].unionByName(kinds[1]), "labelled")
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= MAX_FIT_CHARS)
    rows = usable.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("toxic"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([sorted(tokens(t)) for t in batch["text"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["toxic"], words], names=["_id", "toxic", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    split_rows = saved(rows.mapInArrow(split, f"_id {kind}, toxic boolean, words array<string>"), "labelled-tokens")

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        lists = pa.concat_arrays([b["words"].cast(pa.list_(pa.string())) for b in rows]) if rows else pa.array([], pa.list_(pa.string()))
        toxic = np.array([t for b in rows for t in b["toxic"].to_pylist()], bool)
        machine = fit_bags(Bags.of(lists), toxic)
        yield pa.RecordBatch.from_pydict({"weights": [machine.weights.tobytes()], "slope": [machine.slope], "shift": [machine.shift]})

    one = split_rows.repartition(1).sortWithinPartitions("_id").mapInArrow(fit_all, "weights binary, slope double, shift double")
    fitted = one.first()
    if fitted is None:  # no row, no task
        return fit([], [])
    return Machine(np.frombuffer(fitted["weights"], np.float32), fitted["slope"], fitted["shift"])


def scorer(machine: Machine, spark):
    """A column function from a text to its score in [0, 1]; null and empty texts score as a text without words."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        machine, out = shared.value, np.empty(len(texts))
        cache = machine.__dict__.setdefault("cache", {})  # goes with the machine
        values = texts.tolist()
        for low in range(0, len(values), 256):
            if len(cache) > CACHE_WORDS:
                cache.clear()
            out[low : low + 256] = machine.probability(machine.worst([tokens(t) for t in values[low : low + 256]], cache))
        return pd.Series(out)

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text), from its text alone."""
    score = scorer(train(docs, labels), docs.sparkSession)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
