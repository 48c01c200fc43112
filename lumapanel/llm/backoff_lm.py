"""Scoring texts with a smoothed n-gram model as a weighted backoff automaton.

Counts of words, pairs and triples are exact, cover all training texts and stay
distributed: each file of texts gets back the counts of what its own texts hold.
A pair or triple has an arc from ``MIN_COUNT`` occurrences on, whatever the
corpus holds. Each file walks its own part of the automaton: a state is a
history; its arcs carry interpolated probabilities with absolute discounting, and
its failure arc leads, at the price of the mass that is left (summed over the
whole corpus), to the history without its oldest word. The last state falls back
to the add-one distribution of single words. Each state's probabilities sum to
one.

Pairs and triples go by 64-bit hashes. A file deals its distinct ones, packed, to
slots by the hash; a slot sums the files' values and answers in the same order,
so no key travels back.

Tokens: words in lower case (A-Z), then one end per text, counted as a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .store import attempt_name, located, new_folder, open_output, per_chunk, per_file
from .words import SLICE_BYTES, mix, slices, words_of

END = np.uint64(0x1D8AF066E4A9B3C7)  # stands for the end among the words' hashes
START = np.uint64(0x7C15F39CC0605CED)  # and for the start of a text in pairs and triples
DISCOUNT, PARTS = 0.75, 4  # discounted counts are whole numbers of a PARTS-th
MIN_COUNT = 2
STRETCH, ORDER = 2048, 3  # tokens of a long text walked in one go; words of the longest arcs
FILE_BYTES = 8 << 20  # of text that a task holds as tokens, pairs and triples
WORDS = ".words"  # beside a token file: the hashes of its words
SLOT_TOKENS, LEAST_SLOTS = 1 << 22, 64
PAIR, TRIPLE, WORD_MASS, PAIR_MASS, WORD = range(5)

_JOIN = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32(doc_id as text) modulo ``folds`` is ``fold``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def with_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some texts as hashes, each text's end included, and their offsets."""
    w = words_of(texts, lower=True)
    n = np.diff(w.offsets)
    out = np.full(len(w.hashes) + len(n), END, np.uint64)
    out[np.arange(len(w.hashes)) + np.repeat(np.arange(len(n)), n)] = w.hashes
    return out, w.offsets + np.arange(len(n) + 1)


def _write(path: str, table: pa.Table, numbers: str) -> None:
    """A table whose column ``numbers`` is packed byte by byte."""
    with open_output(path) as out:
        pq.write_table(table, out, compression="zstd", use_dictionary=False, column_encoding={numbers: "BYTE_STREAM_SPLIT"})


def save_tokens(rows: DataFrame, size: int = FILE_BYTES) -> DataFrame:
    """Write (doc_id, text, held) as token files of about ``size`` bytes of text each; returns (chunk, path), saved.

    A file holds a row's tokens as numbers of its own sorted words, whose hashes
    lie beside it, so texts are split into words once, whatever the number of
    passes. Tasks write their rows as they come; nothing is shuffled.
    """
    folder = new_folder(rows.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = 0, 0, []

        def close() -> pa.RecordBatch:
            path = attempt_name(folder, f"-{number}.parquet")
            words, word = np.unique(np.concatenate([t for _, t, _ in parts]), return_inverse=True)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, o in parts]))])
            table = pa.Table.from_batches([part for part, _, _ in parts]).append_column(
                "word", pa.LargeListArray.from_arrays(offsets, pa.array(word.astype(np.uint32)))
            )
            _write(path, table, "word.list.element")
            _write(path + WORDS, pa.table({"word": words}), "word")
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for low, high in slices(batch["text"], min(size, SLICE_BYTES)):
                part = batch.slice(low, high - low)
                parts.append((part.select(["doc_id", "held"]), *with_ends(part["text"])))
                held += part["text"].nbytes
                if held >= size:
                    yield close()
                    number, held, parts = number + 1, 0, []
        if parts:
            yield close()

    written = saved(rows.select("doc_id", "held", "text").mapInArrow(write, "path string"), "token-files")
    return written.select(F.xxhash64("path").alias("chunk"), "path")


def word_counts(files: DataFrame) -> DataFrame:
    """(chunk, key, c, first): for each word of a file its count over all training texts; ``first`` in one file."""

    def count(chunk: int, path: str) -> Iterator[pa.RecordBatch]:
        tokens = read_tokens(path)
        keys = tokens.words
        n = np.bincount(tokens.word[np.repeat(tokens.used, np.diff(tokens.offsets))], minlength=len(keys))
        for low in range(0, len(keys), 1 << 16):
            cut = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(keys[cut]), chunk), "key": keys[cut].view(np.int64), "n": n[cut]})

    same = Window.partitionBy("key")  # one row per file at most
    rows = per_file(files, count, "chunk long, key long, n long")
    return rows.select("chunk", "key", F.sum("n").over(same).alias("c"), (F.min("chunk").over(same) == F.col("chunk")).alias("first"))


@dataclass
class Tokens:
    """The tokens of some texts: ``word`` numbers the sorted hashes ``words``; text ``d`` goes from ``offsets[d]``."""

    words: np.ndarray
    word: np.ndarray
    offsets: np.ndarray
    used: np.ndarray  # which texts are learnt from
    rows: pa.Table  # their other columns


def read_tokens(uri: str) -> Tokens:
    fs, path = located(uri)
    with fs.open_input_file(path + WORDS) as file:
        words = pq.ParquetFile(file).read()["word"].to_numpy()
    with fs.open_input_file(path) as file:
        table = pq.ParquetFile(file).read()
    word = np.concatenate([c.flatten().to_numpy() for c in table["word"].chunks]).astype(np.int64)
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in table["word"].chunks])
    used = ~table["held"].combine_chunks().to_numpy(zero_copy_only=False)
    return Tokens(words, word, np.concatenate([[0], np.cumsum(lengths)]), used, table.select(["doc_id", "held"]))


@dataclass
class Automaton:
    """Histories, arcs and failure arcs.

    ``words`` are the hashes of the words, sorted; a word's number is its
    place there. State 0 is the empty history, 1 + k the history of word k, and
    ``1 + len(words)`` the start of a text; longer histories follow. Arc keys are
    state * len(words) + word.
    """

    words: np.ndarray
    word_p: np.ndarray
    back: np.ndarray  # log10 weight of each state's failure arc
    fail: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    arc_p: np.ndarray = field(default_factory=lambda: np.empty(0))
    target: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def start(self) -> int:
        return 1 + len(self.words)

    def step(self, state: np.ndarray, word: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of one word each, and the states after it."""
        total, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        live, state = np.arange(len(state)), state.copy()
        while len(live):
            key = state * len(self.words) + word[live]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = (self.keys[at] == key) & (word[live] >= 0) if len(self.keys) else np.zeros(len(live), bool)
            total[live[hit]] += self.arc_p[at[hit]]
            after[live[hit]] = self.target[at[hit]]
            bottom = ~hit & (state == 0)
            total[live[bottom]] += base[live[bottom]]
            after[live[bottom]] = word[live[bottom]] + 1  # -1, an unmodelled word, leads to the empty history
            on = ~hit & ~bottom
            live, state = live[on], state[on]
            total[live] += self.back[state]
            state = self.fail[state]
        return total, after

    def scores(self, word: np.ndarray, base: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log10 probability of each text: all texts walk from left to right together, carrying their states.

        A long text walks in stretches of ``STRETCH`` tokens. The state after
        ``ORDER - 1`` tokens is the same from any state before them, so a stretch
        first takes that many steps from the empty history, unscored.
        """
        length = np.diff(offsets)
        pieces = np.maximum(1, -(-length // STRETCH))
        text = np.repeat(np.arange(len(length)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][text] + number * STRETCH
        size = np.minimum(STRETCH, offsets[1:][text] - begin)
        state, later = np.full(len(text), self.start), np.flatnonzero(number)
        state[later] = 0
        for back in range(ORDER - 1, 0, -1):
            at = begin[later] - back
            state[later] = self.step(state[later], word[at], base[at])[1]
        order = np.argsort(-size, kind="stable")
        first, falling, state = begin[order], -size[order], state[order]
        total = np.zeros(len(order))
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(falling, -t, side="left"))
            at = first[:n] + t
            p, state[:n] = self.step(state[:n], word[at], base[at])
            total[:n] += p
        return np.bincount(text[order], total, len(length))


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * _JOIN + word)


class Texts:
    """The tokens of some texts, their distinct words and pairs, and of these the training counts.

    Pairs are arc keys as in ``Automaton``, sorted: state * len(words) + word.
    """

    def __init__(self, tokens: Tokens):
        offsets = tokens.offsets
        self.offsets, self.used = offsets, np.repeat(tokens.used, np.diff(offsets))
        self.words, self.word = tokens.words, tokens.word
        n = len(self.words)
        self.begin = np.zeros(len(self.word), bool)
        self.begin[offsets[:-1]] = True
        state = np.concatenate([[0], self.word[:-1] + 1])
        state[self.begin] = n + 1
        self.pairs, self.pair = np.unique(state * n + self.word, return_inverse=True)
        self.pair_n = np.bincount(self.pair[self.used], minlength=len(self.pairs))

    def history_keys(self) -> np.ndarray:
        """Keys of the histories of one word: the words, then the start."""
        return mix(np.append(self.words, START))

    def pair_keys(self) -> np.ndarray:
        return _joined(np.append(self.words, START)[self.pairs // len(self.words) - 1], self.words[self.pairs % len(self.words)])

    def keep(self, counts: np.ndarray, least: float) -> None:
        """Take the whole corpus's counts of the pairs, and go on with those of ``least`` or more.

        A triple counts no more than either of its pairs, so only triples of two such pairs are looked at.
        """
        keys = self.pair_keys()
        self.kept = np.flatnonzero((counts >= least) & (counts > 0))
        place = np.full(len(self.pairs), -1)
        place[self.kept] = np.arange(len(self.kept))
        at, keys = place[self.pair], keys[self.kept]
        second = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0) & ~self.begin[1:]) + 1
        n = len(self.words)
        self.triples, which = np.unique(at[second - 1] * n + self.word[second], return_inverse=True)
        self.inner = np.empty(len(self.triples), np.int64)  # the pair that a triple ends with
        self.inner[which] = at[second]
        self.triple_n = np.bincount(which[self.used[second]], minlength=len(self.triples))
        self.pairs, self.pair_c, self.kept_keys = self.pairs[self.kept], counts[self.kept], keys
        self.triple_keys = _joined(keys[self.triples // n], self.words[self.triples % n])

    def word_mass(self, own: np.ndarray) -> np.ndarray:
        """Discounted counts, in parts, of the pairs ``own`` after each history of one word."""
        return _mass(self.pairs[own] // len(self.words) - 1, self.pair_c[own], len(self.words) + 1)

    def pair_mass(self, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The same of the triples ``own`` after each kept pair."""
        return _mass(self.triples[own] // len(self.words), counts[own], len(self.pairs))


def _mass(history: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, history, (PARTS * counts - PARTS * DISCOUNT).astype(np.int64))
    return out


def assemble(texts: Texts, word_c: np.ndarray, tokens: tuple[int, int, int], word_mass: np.ndarray, pair_mass: np.ndarray, triple_c: np.ndarray, least: float) -> Automaton:
    """The automaton of what some texts hold; ``tokens``: training tokens, distinct ones and texts of the whole corpus."""
    total, distinct, ends = tokens
    n = len(texts.words)
    history, last = texts.pairs // n - 1, texts.pairs % n
    after = np.concatenate([word_c, [ends], texts.pair_c])  # count of each history's followers
    mass = np.concatenate([word_mass, pair_mass])
    left = np.ones(len(after))
    full = after > 0
    left[full] = np.maximum(PARTS * after[full] - mass[full], PARTS * 1e-12) / (PARTS * after[full])
    word_p = (word_c + 1) / (total + distinct + 1)
    pair_p = np.maximum(texts.pair_c - DISCOUNT, 0) / after[history] + left[history] * word_p[last]
    real = np.flatnonzero((triple_c >= least) & (triple_c > 0))
    before, inner = texts.triples[real] // n, texts.inner[real]
    triple_p = np.maximum(triple_c[real] - DISCOUNT, 0) / texts.pair_c[before] + left[n + 1 + before] * pair_p[inner]
    states = n + 2 + np.arange(len(texts.pairs))
    # States of pairs follow all states of words, so the keys are sorted.
    return Automaton(
        texts.words,
        np.log10(word_p),
        np.log10(np.append(1.0, left)),
        np.concatenate([np.zeros(n + 2, np.int64), last + 1]),
        np.concatenate([texts.pairs, texts.triples[real] + (n + 2) * n]),
        np.log10(np.concatenate([pair_p, triple_p])),
        np.concatenate([states, states[inner]]),
    )


def _packed(values: np.ndarray) -> bytes:
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes() if len(values) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


ASKED = "chunk long, slot long, kind long, keys binary, data binary"
ANSWER = "chunk long, slot long, kind long, data binary"


def _ask(chunk: int, kind: int, keys: np.ndarray, values: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    """Keys and values of a file, dealt to slots by ranges of the keys."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    width = 2**64 // slots + 1
    cuts = np.append(np.searchsorted(keys, np.array([k * width for k in range(slots)], np.uint64)), len(keys))
    slot = np.flatnonzero(np.diff(cuts))
    for low in range(0, len(slot), 16):
        some = slot[low : low + 16]
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": np.full(len(some), chunk),
                "slot": some,
                "kind": np.full(len(some), kind),
                "keys": pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()),
                "data": pa.array([_packed(values[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()),
            }
        )


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key the sum over all files, times two, plus one in the one file that owns the key."""
    at, held = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        keys = [np.frombuffer(k, np.uint64) for _, k, _ in held]
        values = np.concatenate([_unpacked(d, len(k)) for (_, _, d), k in zip(held, keys, strict=True)])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = every[order[1:]] != every[order[:-1]]
        start = np.flatnonzero(fresh)
        sums = np.add.reduceat(values[order], start)
        values[order] = 2 * np.repeat(sums, np.diff(np.append(start, len(order)))) + fresh
        cuts = np.cumsum([0, *map(len, keys)])
        for low in range(0, len(held), 16):
            some = range(low, min(low + 16, len(held)))
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": np.array([held[k][0] for k in some]),
                    "slot": np.full(len(some), at[0]),
                    "kind": np.full(len(some), at[1]),
                    "data": pa.array([_packed(values[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()),
                }
            )

    for batch in batches:
        for chunk, slot, kind, keys, data in zip(*(batch[c].to_pylist() for c in ("chunk", "slot", "kind", "keys", "data")), strict=True):
            if at is not None and at != (slot, kind):
                yield from answer()
                held = []
            at = (slot, kind)
            held.append((chunk, keys, data))
    if held:
        yield from answer()


def _answers(asked: DataFrame, slots: int) -> DataFrame:
    dealt = asked.repartition(slots, "slot").sortWithinPartitions("slot", "kind")
    return saved(dealt.mapInArrow(_sum, ANSWER), "sums")


def _word_rows(chunk: int, path: str, got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The words of a file and their counts, packed."""
    data = np.stack([got["key"], got["c"]], axis=1)
    parts = [data[low : low + (1 << 16)].tobytes() for low in range(0, len(data), 1 << 16)]
    none = np.zeros(len(parts), np.int64)
    yield pa.RecordBatch.from_pydict({"chunk": none + chunk, "slot": none, "kind": none + WORD, "data": pa.array(parts, pa.binary())})


def _with_answers(files: DataFrame, answers: list[DataFrame], fn, schema: str) -> DataFrame:
    """Run ``fn(chunk, path, got)`` for every file with the answers to what it asked, by kind."""
    rows = files.select("chunk", F.lit(-1).cast("long").alias("slot"), F.lit(-1).cast("long").alias("kind"), F.encode("path", "UTF-8").alias("data"))
    for part in answers:
        rows = rows.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path, got = None, "", {}
        for batch in batches:
            for chunk, kind, data in zip(*(batch[c].to_pylist() for c in ("chunk", "kind", "data")), strict=True):
                if chunk != at:
                    if at is not None:
                        yield from fn(at, path, got)
                    at, got = chunk, {}
                if kind < 0:
                    path = data.decode()
                else:
                    got.setdefault(kind, []).append(data)
        if at is not None:
            yield from fn(at, path, got)

    return rows.repartition(max(1, files.count()), "chunk").sortWithinPartitions("chunk", "kind", "slot").mapInArrow(run, schema)


def _replies(keys: np.ndarray, data: list[bytes], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, in the order of ``keys``, and which of them the file owns."""
    order = np.argsort(keys)
    width = 2**64 // slots + 1
    cuts = np.append(np.searchsorted(keys[order], np.array([k * width for k in range(slots)], np.uint64)), len(keys))
    out = np.empty(len(keys), np.int64)
    if len(keys):
        sizes = np.diff(cuts)
        out[order] = np.concatenate([_unpacked(d, n) for d, n in zip(data, sizes[sizes > 0], strict=True)])
    return out >> 1, (out & 1).astype(bool)


def score_documents(docs: DataFrame, is_held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text).

    The model learns from the rows that aren't held out. ``base_score`` adds up
    the add-one word probabilities, ``score`` the automaton's. A null text is
    empty and has only its end; repeated rows count and score as often as they
    are there; without training rows every probability is 1.
    """
    held = held_out(F.col("doc_id")) if is_held_out is None else is_held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    files = save_tokens(rows)
    counts = saved(word_counts(files), "words")
    facts = counts.filter("first").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = int(facts["n"] or 0), int(facts["v"])
    ends = int(counts.filter(F.col("first") & (F.col("key") == int(END.view(np.int64)))).agg(F.sum("c")).first()[0] or 0)
    slots = max(LEAST_SLOTS, total // SLOT_TOKENS)

    def with_pairs(path: str, got: dict[int, list[bytes]]) -> tuple[Texts, pa.Table, np.ndarray]:
        tokens = read_tokens(path)
        texts = Texts(tokens)
        sums, own = _replies(texts.pair_keys(), got[PAIR], slots)
        texts.keep(sums, MIN_COUNT)
        return texts, tokens.rows, own[texts.kept]

    def ask_pairs(chunk: int, path: str) -> Iterator[pa.RecordBatch]:
        texts = Texts(read_tokens(path))
        yield from _ask(chunk, PAIR, texts.pair_keys(), texts.pair_n, slots)

    def ask_triples(chunk: int, path: str, got: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        texts, _, own = with_pairs(path, got)
        yield from _ask(chunk, TRIPLE, texts.triple_keys, texts.triple_n, slots)
        yield from _ask(chunk, WORD_MASS, texts.history_keys(), texts.word_mass(np.flatnonzero(own)), slots)

    def ask_masses(chunk: int, path: str, got: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        texts, _, _ = with_pairs(path, got)
        sums, own = _replies(texts.triple_keys, got.get(TRIPLE, []), slots)
        yield from _ask(chunk, PAIR_MASS, texts.kept_keys, texts.pair_mass(sums, np.flatnonzero(own & (sums >= MIN_COUNT))), slots)

    def score(chunk: int, path: str, got: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        texts, rows, _ = with_pairs(path, got)
        pairs = np.frombuffer(b"".join(got[WORD]), np.int64).reshape(-1, 2)
        word_c = pairs[np.argsort(pairs[:, 0].copy().view(np.uint64)), 1]  # a file's words are all counted
        triple_c, _ = _replies(texts.triple_keys, got.get(TRIPLE, []), slots)
        word_mass, _ = _replies(texts.history_keys(), got[WORD_MASS], slots)
        pair_mass, _ = _replies(texts.kept_keys, got.get(PAIR_MASS, []), slots)
        model = assemble(texts, word_c, (total, distinct, ends), word_mass, pair_mass, triple_c, MIN_COUNT)
        base, offsets = model.word_p[texts.word], texts.offsets
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows["doc_id"].combine_chunks(),
                "held_out": rows["held"].combine_chunks(),
                "n_tokens": np.diff(offsets),
                "n_known": np.add.reduceat((word_c[texts.word] > 0).astype(np.int64), offsets[:-1]),
                "train_tokens": np.full(len(offsets) - 1, total),
                "base_score": np.add.reduceat(base, offsets[:-1]),
                "score": model.scores(texts.word, base, offsets),
            }
        )

    pair_sums = _answers(per_file(files, ask_pairs, ASKED), slots)
    triple_sums = _answers(_with_answers(files, [pair_sums], ask_triples, ASKED), slots)
    of_triples = triple_sums.filter(F.col("kind") == TRIPLE)
    masses = _answers(_with_answers(files, [pair_sums, of_triples], ask_masses, ASKED), slots)
    words = per_chunk(files, counts.select("chunk", "key", "c"), _word_rows, ANSWER)
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(files, [pair_sums, triple_sums, masses, words], score, fields)
