"""Token ids in grammar-compressed binary files (Re-Pair), with random access.

Each file starts from the ids of some documents, replaces frequent neighbouring
pairs by new symbols again and again, and holds the rules with the lengths of
their expansions, the shortened sequence, and where each document begins in it.
No pair crosses the end of a document, so one document is decoded by reading its
own symbols.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .store import attempt_name, located, new_folder, open_output
from .words import slices, text_bytes

MAGIC = b"REPAIR01"
# New symbols per pass. With a 50k vocabulary they use up the 16-bit symbols; more rules need 32 bits and make larger files.
ROUND_RULES = (2500,) * 6
FILE_TOKENS = 2 << 20
CACHE_UNITS = 1_000_000
CACHE_IDS = 8_000_000


# --- encoding ----------------------------------------------------------------


# Kinds of bytes: letter, digit, punctuation, apostrophe, space, other white space, any other character, what may be white space.
# The last two begin letters of two bytes (U+00C0 to U+017F without two signs, U+0400 to U+047F) and what may be white space.
_L, _D, _P, _Q, _S, _W, _V, _U, _LETTER, _WIDE = range(10)
_KIND = np.full(256, _V, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _L
_KIND[48:58] = _D
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _P
_KIND[39] = _Q
_KIND[32] = _S
_KIND[9:14] = _W
_KIND[28:32] = _U
_KIND[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = _LETTER
_KIND[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _WIDE
_KIND_TABLE = _KIND.tobytes()
_WHITE = np.isin(np.arange(8), [_S, _W, _U])
# Whether tokens always end between two kinds, at 8 * the first + the second; what follows white space is looked at apart.
_ENDS = np.zeros((32, 8), np.uint8)
_ENDS[np.ix_([_L, _D, _P, _Q, _V], [_S, _W])] = 1
_ENDS[np.ix_([_L, _D], [_P, _Q])] = 1
_ENDS[[_L, _D, _P, _P, _Q], [_D, _L, _L, _D, _D]] = 1
_ENDS_TABLE = _ENDS.tobytes()


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND_TABLE)), np.uint8)
    lead = np.flatnonzero(kind >= _LETTER)
    if not len(lead):
        return kind
    letter = kind[lead] == _LETTER
    lead, wide = lead[letter], lead[~letter]
    sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))
    kind[lead] = kind[lead + 1] = np.where(sign, _V, _L)
    if len(wide):
        a, b, c = data[wide], data[wide + 1], data[np.minimum(wide + 2, len(data) - 1)]
        two = (a == 0xC2) & (b <= 0xA0)
        three = ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB))
        three |= (a == 0xE2) & (((b == 0x80) & ((c < 0x90) | ((c >= 0xA8) & (c < 0xB0)))) | ((b == 0x81) & ((c == 0x9F) | (c == 0xA0))))
        kind[wide] = np.where(two | three, _U, _V)
        kind[wide[two | three] + 1] = _U
        kind[wide[three] + 2] = _U
    return kind


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the units of some texts begin: at places where the byte-level pattern ends a token whatever stands around.

    It never joins a letter, digit or sign with one of another kind that follows
    (an apostrophe and letters apart), nor anything with white space that
    follows. White space of one character other than a space stands alone;
    longer white space stays with what follows it, a space too.
    """
    if not len(data):
        return np.empty(0, np.int64)
    kind = kinds(data)
    cut = np.zeros(len(data), bool)
    cut[1:] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_ENDS_TABLE), bool)
    lone = np.flatnonzero(kind[1:-1] == _W) + 1
    lone = lone[~_WHITE[kind[lone - 1]] & ~_WHITE[kind[lone + 1]]]
    cut[lone + 1] = True
    starts = at[:-1]
    cut[starts[starts < at[1:]]] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct unit once.

    Units are words, numbers, signs and white space of the byte-level pattern,
    cut out by ``unit_starts`` and told apart by Arrow, so the ids of a text are
    those of its units. A unit that is surely one piece of the pattern goes to
    the library as such a piece, others as texts. With another pattern, model
    or a normalizer every text is encoded whole.
    """

    _piece = re.compile(
        rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5\xd0\xd1][\x80-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)|[\t\n\x0b\x0c]"
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of added tokens are tokens wherever they stand, so texts that hold one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        model = made["model"]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.whole = not (known and plain) or any(made[k] for k in ("normalizer", "truncation", "padding"))
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = None
        # A letter of the vocabulary is a byte of the text.
        vocabulary = self.tokenizer.get_vocab()
        self.spans = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.spans[list(vocabulary.values())] = [len(token) for token in vocabulary]
        # Bytes that print are their own letters, the others have the rest of the letters in order.
        letters = set(ByteLevel.alphabet())
        rest = iter(sorted(letters - set(map(chr, range(256)))))
        self.letters = {b: chr(b) if chr(b) in letters else next(rest) for b in range(256)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.filled = np.empty(1 << 20, np.uint32), 0
        self.at, self.units = np.zeros(1 << 17, np.int64), 0

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new units and remember them."""
        plain, odd = [], []
        for unit in fresh:
            (plain if self._piece.fullmatch(unit) else odd).append(unit)
        for low in range(0, len(plain), 4096):
            part = plain[low : low + 4096]
            # No piece holds a carriage return, so one call spells all of them in the letters of the vocabulary.
            spelled = b"\r".join(part).decode("latin-1").translate(self.letters).split("\u010d")
            if len(spelled) != len(part):
                raise AssertionError("pieces ran together")
            ids = np.array(self.pieces.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            reach = np.cumsum(self.spans[ids])
            ends = np.cumsum([len(unit) for unit in part])
            last = np.searchsorted(reach, ends)
            if reach[-1] != ends[-1] or not np.array_equal(reach[last], ends):
                raise AssertionError("tokens don't spell the pieces")
            self._keep(part, ids, last + 1)
        for unit in odd:
            ids = np.array(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids, np.uint32)
            self._keep([unit], ids, np.array([len(ids)]))

    def _keep(self, units: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.units + len(units) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.known.update(zip(units, range(self.units, self.units + len(units)), strict=True))
        self.at[self.units + 1 : self.units + 1 + len(units)] = ends + self.filled
        self.filled += len(ids)
        self.units += len(units)

    def _apart(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded whole."""
        apart = np.full(len(texts), self.whole)
        for a in self.added:
            apart |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        return apart

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; a null text has none."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        texts = texts.fill_null("")
        apart = self._apart(texts)
        if apart.any():
            plain, sizes = self.encode_units(texts.filter(pa.array(~apart)))
            ends = iter(np.split(plain, np.cumsum(sizes))[:-1])
            every = [
                np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32) if whole else next(ends)
                for text, whole in zip(texts, apart.tolist(), strict=True)
            ]
            return np.concatenate(every), np.array([len(ids) for ids in every])
        return self.encode_units(texts)

    def encode_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.units > CACHE_UNITS or self.filled > CACHE_IDS:
            self.clear()
        data, at = text_bytes(texts)
        starts = unit_starts(data, at)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            fresh = [distinct[k] for k in new]
            self._learn(fresh)
            codes[new] = [self.known[u] for u in fresh]
        codes = codes[units.indices.to_numpy()]
        first = self.at[codes]
        lengths = self.at[codes + 1] - first
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ragged(first, lengths)], np.diff(ends[np.searchsorted(starts, at)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    steps[0] = starts[0]
    steps[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


# --- grammar -----------------------------------------------------------------


def repair(ids: np.ndarray, end_id: int, first_symbol: int, rounds: tuple[int, ...] = ROUND_RULES) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): in each pass the most frequent pairs become new symbols, until no pair occurs four times.

    Pairs are first counted by a hash, then those of the fullest cells exactly.
    Occurrences that overlap are taken from the left. No pair holds ``end_id``.
    """
    seq, rules, symbol = ids.astype(np.uint32), [], first_symbol
    short = first_symbol + sum(rounds) <= 1 << 16
    kind, half, factor, drop = (np.uint32, 16, 0x9E3779B1, 11) if short else (np.uint64, 32, 0x9E3779B97F4A7C15, 43)
    for most in rounds:
        if len(seq) < 2:
            break
        pair = (seq[:-1].astype(kind) << kind(half)) | seq[1:].astype(kind)
        cell = ((pair * kind(factor)) >> kind(drop)).astype(np.int64)
        ends = np.flatnonzero(seq == end_id)
        bound = np.unique(np.concatenate([ends[ends < len(pair)], ends[ends > 0] - 1]))
        counts = np.bincount(cell, minlength=1 << 21)
        np.subtract.at(counts, cell[bound], 1)
        # The count that as many cells as there are rules reach.
        reached = np.cumsum(np.bincount(counts)[::-1])[::-1]
        least = max(4, int(np.searchsorted(-reached, -most, side="right")) - 1)
        full = (counts >= least)[cell]
        full[bound] = False
        spots = np.flatnonzero(full)
        if not len(spots):
            break
        found, which, n = np.unique(pair[spots], return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")[:most]
        order = order[n[order] >= 4]
        if not len(order):
            break
        place = np.full(len(found), -1, np.int64)
        place[order] = np.arange(len(order))
        taken = place[which] >= 0
        spots, which = spots[taken], place[which[taken]]
        fresh = np.ones(len(spots), bool)
        fresh[1:] = np.diff(spots) > 1
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
        even = (np.arange(len(spots)) - run_start) % 2 == 0
        spots, which = spots[even], which[even]
        seq[spots] = (symbol + which).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[spots + 1] = False
        seq = seq[keep]
        chosen = found[order]
        rules.append(np.stack([chosen >> kind(half), chosen & kind((1 << half) - 1)], axis=1).astype(np.uint32))
        symbol += len(order)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Number of ids each rule stands for."""
    lengths = np.ones(len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (lengths[a - first_symbol] if a >= first_symbol else 1) + (lengths[b - first_symbol] if b >= first_symbol else 1)
    return lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules written out: the ids, and where each rule's ids begin."""
    at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    flat = np.empty(at[-1], np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        p = at[k]
        for s in (a, b):
            if s >= first_symbol:
                n = lengths[s - first_symbol]
                flat[p : p + n] = flat[at[s - first_symbol] : at[s - first_symbol] + n]
                p += n
            else:
                flat[p] = s
                p += 1
    return flat, at[:-1]


def file_bytes(ids: np.ndarray, doc_lengths: np.ndarray, doc_ids: list, end_id: int, first_symbol: int) -> bytes:
    """The file of some documents' ids; ``doc_lengths`` counts the end id of each."""
    seq, rules = repair(ids, end_id, first_symbol)
    lengths = rule_lengths(rules, first_symbol)
    high = first_symbol + len(rules)
    width = np.uint16 if high <= 1 << 16 else np.uint32
    expanded = np.ones(len(seq), np.int64)
    new = seq >= first_symbol
    expanded[new] = lengths[seq[new] - first_symbol]
    ends = np.concatenate([[0], np.cumsum(expanded)])
    tokens = np.concatenate([[0], np.cumsum(doc_lengths)]).astype(np.int64)
    symbols = np.searchsorted(ends, tokens).astype(np.int64)
    if not np.array_equal(ends[symbols], tokens):
        raise AssertionError("a rule crosses the end of a document")
    present = np.array([d is not None for d in doc_ids], np.uint8)
    plain = np.array([d or 0 for d in doc_ids], np.int64)
    head = struct.pack("<8sIIQQQI", MAGIC, first_symbol, len(rules), len(doc_ids), len(seq), len(ids), np.dtype(width).itemsize)
    parts = [rules.astype("<u4"), lengths.astype("<u4"), plain.astype("<i8"), present, symbols.astype("<i8"), tokens.astype("<i8"), seq.astype(np.dtype(width).newbyteorder("<"))]
    return head + b"".join(p.tobytes() for p in parts)


HEAD = struct.calcsize("<8sIIQQQI")


class TokenFile:
    """Random access to one file: the rules and the document table are read once, symbols by range."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic, self.first, n_rules, self.n_docs, self.n_symbols, self.n_ids, self.width = struct.unpack("<8sIIQQQI", file.read(HEAD))
        if magic != MAGIC:
            raise ValueError("not a token file")
        take = lambda kind, n: np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)
        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        ids, present = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        self.symbols, self.tokens = take("<i8", self.n_docs + 1), take("<i8", self.n_docs + 1)
        self.body = file.tell()
        flat, at = expansions(rules, self.lengths, self.first)
        self.flat = np.concatenate([np.arange(self.first, dtype=np.uint32), flat])
        self.at = np.concatenate([np.arange(self.first), at + self.first])
        self.size = np.concatenate([np.ones(self.first, np.int64), self.lengths])

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids of the documents ``low`` to ``high - 1``."""
        a, b = int(self.symbols[low]), int(self.symbols[high])
        self.file.seek(self.body + a * self.width)
        seq = np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}").astype(np.int64)
        return self.flat[ragged(self.at[seq], self.size[seq])]


# --- jobs --------------------------------------------------------------------

_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder per worker process, with the pieces it has met."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order, nulls first, into files; returns the saved list of files.

    Rows are range-partitioned by doc_id, rows of one id by their place in the
    input; a task starts a new file after ``file_tokens`` ids. A null text has
    only the end id. Columns: part, file, path, docs, ids, bytes.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("_row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = attempt_name(folder, f"-{number}.tok")
            ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            names = [d for h in held for d in h[2]]
            data = file_bytes(ids, lengths, names, end_id, vocabulary)
            with open_output(path) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "file": [number], "path": [path], "docs": [len(names)], "ids": [len(ids)], "bytes": [len(data)]}
            )

        for batch in batches:
            for low, high in slices(batch["text"], 4 << 20):
                piece = batch.slice(low, high - low)
                ids, n = enc.encode(piece["text"])
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n, names = n + 1, piece["doc_id"].to_pylist()
                ends = np.cumsum(n)
                first = begin = 0
                while first < len(n):
                    # The document that fills the file is its last.
                    last = min(int(np.searchsorted(ends, begin + file_tokens - size)) + 1, len(n))
                    held.append((out[begin : ends[last - 1]], n[first:last], names[first:last]))
                    size += int(ends[last - 1]) - begin
                    first, begin = last, int(ends[last - 1])
                    if size >= file_tokens:
                        yield flush()
                        held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return saved(ranged.mapInArrow(write, "part long, file long, path string, docs long, ids long, bytes long"), "token-files")


def read_token_files(files: DataFrame, batch_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it; only the list of files
    passes the window.
    """
    line = Window.orderBy("part", "file")
    placed = files.withColumn("first", F.sum("ids").over(line) - F.col("ids")).select("path", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                fs, name = located(path)
                with fs.open_input_file(name) as file:
                    held = TokenFile(file)
                    low = 0
                    while low < held.n_docs:
                        high = max(low + 1, int(np.searchsorted(held.tokens, held.tokens[low] + batch_tokens, side="right")) - 1)
                        ids, at = held.ids(low, high), held.tokens[low : high + 1] - held.tokens[low]
                        crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(held.doc_ids[low:high], pa.int64()),
                                "start": held.tokens[low:high] + first,
                                "n_tokens": np.diff(at),
                                "ids_crc32": pa.array(crcs, pa.int64()),
                            }
                        )
                        low = high

    wide = placed.repartition(max(1, files.count()), "path")
    return wide.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()
