"""Similarity join on word shingles by chosen paths.

A text is its set of five-word shingles (the whole text, if it has one to four
words). Texts with the same shingles are one *representative*. Each
representative gets a sketch of ``TOKENS`` min-hash tokens; two sets share a
token with the probability of their Jaccard similarity. A run lets every set
choose few tokens by a hash, sets that chose the same token meet in a bucket, and
a large bucket is split again by further chosen tokens. Small buckets are
compared by brute force, on the sketches. Several runs make it unlikely that a
pair at the threshold never meets.

Sets that meet and look alike form candidate groups. Inside these every pair is
compared exactly, in blocks, so all links of a group are counted whichever
bucket found the group. Pairs are never emitted; blocks return the links of each
text and a spanning star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import saved
from .components import components
from .words import mix, slices, window_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 128
SLICE = 1 << 20  # bytes of text whose shingles are held at once
RUNS = 10  # a pair at the threshold shares one chosen token per run on average: it is missed with e**-10
DEPTH = 3
BUCKET = 256
CENTRES = 16
BLOCK = 384
SLACK = 0.14  # four standard deviations of the sketch's estimate at the threshold

_MULT = np.random.default_rng(1).integers(0, 2**32, TOKENS, dtype=np.uint32) | np.uint32(1)
_FLIP = np.random.default_rng(2).integers(0, 2**32, TOKENS, dtype=np.uint32)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, one after the other, and the offsets of each text."""
    w = words_of(texts)
    n = np.diff(w.offsets)
    runs = window_hashes(w.hashes, SHINGLE)
    count = np.maximum(n - SHINGLE + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offsets[-1], np.uint64)
    long = n >= SHINGLE
    start = np.repeat(w.offsets[:-1][long], count[long])
    inner = np.arange(len(start)) - np.repeat(np.concatenate([[0], np.cumsum(count[long])[:-1]]), count[long])
    place = np.repeat(offsets[:-1][long], count[long]) + inner
    out[place] = runs[start + inner] if len(start) else 0
    for k in np.flatnonzero((n > 0) & ~long):
        part = w.hashes[w.offsets[k] : w.offsets[k + 1]]
        out[offsets[k]] = window_hashes(part, len(part))[0] ^ np.uint64(len(part))
    return out, offsets


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and sketch per text; texts without words are left out."""
    for batch in batches:
        for low, high in slices(batch["text"], SLICE):
            hashes, offsets = shingle_hashes(batch["text"].slice(low, high - low))
            full = np.flatnonzero(np.diff(offsets))
            if not len(full):
                continue
            starts = offsets[full]
            x = (hashes >> np.uint64(32)).astype(np.uint32)
            sketch = np.stack([np.minimum.reduceat((x ^ f) * m, starts) for f, m in zip(_FLIP, _MULT, strict=True)], axis=1)
            data = np.ascontiguousarray(sketch).tobytes()
            width = 4 * TOKENS
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": batch["uid"].take(pa.array(full + low)),
                    "f1": pa.array(np.add.reduceat(mix(hashes), starts).view(np.int64)),
                    "f2": pa.array(np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).view(np.int64)),
                    "size": pa.array(np.diff(offsets)[full]),
                    "sketch": pa.array([data[k * width : (k + 1) * width] for k in range(len(full))], pa.binary()),
                }
            )


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _picks(paths: np.ndarray, tokens: np.ndarray, expected: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: each row chooses tokens by a hash of its path and the token."""
    spot = mix(np.arange(TOKENS, dtype=np.uint64) + np.uint64(1))
    token = mix(tokens.astype(np.uint64) ^ spot[None, :])
    drawn = mix(token ^ mix(paths)[:, None])
    row, at = np.nonzero(drawn < np.uint64(int(expected / (THRESHOLD * TOKENS) * 2.0**64)))
    return row, drawn[row, at]


def _first_picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            tokens = _sketches(part["sketch"])
            for run in range(RUNS):
                row, path = _picks(np.full(len(tokens), run, np.uint64), tokens, 1.0)
                yield pa.RecordBatch.from_pydict({"path": path.view(np.int64), "rep": part["rep"].take(pa.array(row))})


def _more_picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            row, path = _picks(part["path"].to_numpy().view(np.uint64), _sketches(part["sketch"]), 1.0)
            yield pa.RecordBatch.from_pydict({"path": path.view(np.int64), "rep": part["rep"].take(pa.array(row))})


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut so that no group of equal keys is split, with the groups' bounds. Groups must be bounded."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        bounds = _bounds(batch, keys)
        rest = batch.slice(int(bounds[-2]))
        if len(bounds) > 2:
            yield batch.slice(0, int(bounds[-2])), bounds[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        v = batch[k].to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), batch.num_rows)


def star(n: int, linked: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each of n things the first of its component."""
    root = np.arange(n)
    for i, others in linked:
        group = np.unique(root[np.append(others, i)])
        if len(group) > 1:
            root[np.isin(root, group)] = group[0]
    return root


def _stars(tokens: np.ndarray) -> np.ndarray:
    """For each sketch the first of its set of sketches that look alike, directly or by way of others."""
    n = len(tokens)
    return star(n, ((i, i + np.flatnonzero((tokens[i:] == tokens[i]).mean(axis=1) >= THRESHOLD - SLACK)) for i in range(n - 1)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force over small buckets: a star per set of sketches that look alike."""
    for batch, bounds in whole_groups(batches, ["path"]):
        tokens, reps = _sketches(batch["sketch"]), batch["rep"].to_numpy()
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            root = _stars(tokens[low:high])
            joined = np.flatnonzero(root != np.arange(high - low))
            a.append(reps[low:high][root[joined]])
            b.append(reps[low:high][joined])
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})


def _compare_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of a large bucket with the bucket's centres: stars, and the members that no centre's star holds."""
    for batch, bounds in whole_groups(batches, ["path", "block"]):
        tokens, reps, path = _sketches(batch["sketch"]), batch["rep"].to_numpy(), batch["path"].to_numpy()
        centre = batch["centre"].to_numpy(zero_copy_only=False)
        out = [[], [], []]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            root = _stars(tokens[low:high])
            near = np.isin(root, root[centre[low:high]])
            kept = np.flatnonzero((root != np.arange(high - low)) | ~near)
            out[0].append(reps[low:high][root[kept]])
            out[1].append(reps[low:high][kept])
            out[2].append(np.where(near[kept], 0, path[low]))
        far = np.concatenate(out[2])
        yield pa.RecordBatch.from_pydict(
            {"a": np.concatenate(out[0]), "b": np.concatenate(out[1]), "far": pa.array(far, mask=far == 0)}
        )


LINKS = "a long, b long"


def _by_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _buckets(picks: DataFrame) -> DataFrame:
    """(path, n) of the buckets of two or more, one for each set of members."""
    sets = picks.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("least"))
    return sets.filter("n > 1").groupBy("n", "x", "least").agg(F.min("path").alias("path")).select(F.col("path").alias("_path"), "n")


def _in_blocks(large: DataFrame, sketch: DataFrame) -> DataFrame:
    """Large buckets (path, rep, n) dealt to blocks of about ``BUCKET`` members, each with all centres of its bucket.

    Centres are about ``CENTRES`` members drawn by a hash; members of a set that
    looks alike and isn't small are tied together by them across the blocks.
    """
    blocks = F.ceil(F.col("n") / BUCKET).cast("long")
    drawn = F.pmod(F.xxhash64("path", "rep"), F.lit(1 << 30)) < (F.lit(CENTRES * (1 << 30)) / F.col("n"))
    own = F.pmod(F.xxhash64("rep", "path"), blocks)
    dealt = large.select("path", "rep", F.explode(F.when(drawn, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own))).alias("block"), drawn.alias("centre"))
    return dealt.join(sketch, F.col("rep") == F.col("_rep")).select("path", "block", "rep", "centre", "sketch")


def candidate_links(reps: DataFrame) -> DataFrame:
    """Star links (a, b) among representatives (rep, sketch) that met in a bucket and look alike.

    A large bucket is compared in blocks first. If some members look like no
    centre, the whole bucket is split by further tokens, and where that leaves
    large buckets again, the members that look like no centre are split once
    more; what is left at ``DEPTH`` is compared block against block.
    """
    sketch = reps.select(F.col("rep").alias("_rep"), "sketch")
    picks = saved(reps.select("rep", "sketch").mapInArrow(_first_picks, "path long, rep long"), "picks")
    links = []
    for depth in range(1, DEPTH + 1):
        kept = saved(_buckets(picks), "buckets")
        met = saved(picks.join(kept, F.col("path") == F.col("_path")).select("path", "rep", "n"), "met")
        small = met.filter(F.col("n") <= BUCKET).join(sketch, F.col("rep") == F.col("_rep")).select("path", "rep", "sketch")
        links.append(saved(_by_block(small, ["path"]).mapInArrow(_compare, LINKS).distinct(), "links"))
        large = met.filter(F.col("n") > BUCKET)
        if large.isEmpty():
            break
        blocks = _by_block(_in_blocks(large, sketch), ["path", "block"])
        found = saved(blocks.mapInArrow(_compare_block, LINKS + ", far long"), "blocks")
        links.append(found.filter("a != b").select("a", "b").distinct())
        far = saved(found.filter("far is not null").select(F.col("far").alias("path"), F.col("b").alias("rep")).distinct(), "far")
        if far.isEmpty():
            break
        if depth == DEPTH:
            links.append(_compare_in_blocks(far, sketch))
            break
        if depth == 1:  # the whole bucket is split
            open_ = far.select(F.col("path").alias("_path")).distinct()
            again = large.join(open_, F.col("path") == F.col("_path"), "left_semi")
        else:  # the others have met their like: in this bucket, its blocks and the other runs
            again = far
        again = again.join(sketch, F.col("rep") == F.col("_rep"))
        picks = saved(again.select("path", "rep", "sketch").mapInArrow(_more_picks, "path long, rep long"), "picks")
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return every


def block_pairs(rows: DataFrame, group: str, order: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks of its group that its block belongs to: adds ``_own``, ``_i``, ``_j``."""
    placed = numbered(rows.select(group, order), [group], [order], "_k").withColumn("_own", F.floor(F.col("_k") / block))
    most = placed.groupBy(F.col(group).alias("_g")).agg(F.max("_own").alias("_last"))
    wide = placed.join(most, F.col(group) == F.col("_g")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return wide.select(group, order, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))


def _compare_in_blocks(far: DataFrame, sketch: DataFrame) -> DataFrame:
    """Members (path, rep) that are still in large buckets and like no centre, block against block."""
    pairs = block_pairs(far, "path", "rep", BUCKET // 2).join(sketch, F.col("rep") == F.col("_rep"))
    rows = pairs.select(F.xxhash64("path", "_i", "_j").alias("path"), "rep", "sketch")
    return _by_block(rows, ["path"]).mapInArrow(_compare, LINKS)


# --- exact comparison --------------------------------------------------------


def jaccard_matrix(texts: pa.Array) -> np.ndarray:
    """Exact similarity of all pairs of a block's texts."""
    n = len(texts)
    parts = []
    for low, high in slices(texts, SLICE):
        hashes, offsets = shingle_hashes(texts.slice(low, high - low))
        parts += [np.unique(hashes[offsets[k] : offsets[k + 1]]) for k in range(high - low)]
    sizes = np.array([len(p) for p in parts], np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    change = np.ones(len(hashes), bool)
    change[1:] = hashes[1:] != hashes[:-1]
    column = np.cumsum(change) - 1
    held = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    owner, column = owner[held], column[held]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((n, n))
    for low in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.divide(common, union, out=np.zeros((n, n)), where=union > 0)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, ["root", "_i", "_j"]):
            columns = {c: batch[c].to_numpy() for c in ("rep", "copies", "_own", "_i", "_j")}
            out = [[], [], []]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                part = {c: v[low:high] for c, v in columns.items()}
                linked = jaccard_matrix(batch["text"].slice(low, high - low)) >= threshold
                np.fill_diagonal(linked, False)
                if part["_i"][0] != part["_j"][0]:
                    linked &= part["_own"][:, None] != part["_own"][None, :]  # pairs of one block are another group's
                root = star(high - low, ((i, np.flatnonzero(linked[i])) for i in np.flatnonzero(linked.any(axis=1))))
                hit = np.flatnonzero(linked.any(axis=1))
                out[0].append(part["rep"][hit])
                out[1].append(part["rep"][root[hit]])
                out[2].append((linked @ part["copies"])[hit])
            yield pa.RecordBatch.from_pydict(
                {"a": np.concatenate(out[0]), "b": np.concatenate(out[1]), "links": np.concatenate(out[2]).astype(np.int64)}
            )

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(uid, root, links) for every row of (uid, text): its class, and how many other rows are similar.

    ``uid`` must be unique. Classes are the connected components of the pairs
    with Jaccard similarity ``threshold`` (0.8 or more) or above; ``root`` is the
    smallest uid. Texts without words (null, empty, blank) have no links and are
    alone. Copies are counted as links of each other. Very long texts are
    compared whole.
    """
    if threshold < THRESHOLD:
        raise ValueError("the runs are planned for similarities of 0.8 and more")
    signed = saved(docs.select("uid", "text").mapInArrow(_sign, "uid long, f1 long, f2 long, size long, sketch binary"), "signed")
    same = ["f1", "f2", "size"]
    groups = saved(signed.groupBy(*same).agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    named = groups.select(*[F.col(c).alias(f"_{c}") for c in same], "rep", "copies")
    equal = (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("size") == F.col("_size"))
    members = saved(signed.select("uid", *same).join(named, equal).select("uid", "rep", "copies"), "members")
    reps = signed.select("uid", "sketch").join(groups.select("rep"), F.col("uid") == F.col("rep")).select("rep", "sketch")
    found = components(candidate_links(saved(reps, "reps")))
    found = saved(found.select(F.col("node").alias("rep"), "root"), "candidates")
    pairs = block_pairs(found, "root", "rep", BLOCK)
    sizes = groups.select(F.col("rep").alias("_r"), "copies")
    texts = docs.select(F.col("uid").alias("_u"), "text")
    wanted = saved(pairs.join(sizes, F.col("rep") == F.col("_r")).select("root", "_i", "_j", "_own", "rep", "copies"), "pairs")
    # Only texts of candidate groups go on, so the join meets few of the rows.
    rows = wanted.join(texts, F.col("rep") == F.col("_u")).select("root", "_i", "_j", "_own", "rep", "copies", "text")
    linked = saved(_by_block(rows, ["root", "_i", "_j"]).mapInArrow(_verify(threshold), "a long, b long, links long"), "linked")
    counts = linked.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("links"))
    classes = components(linked.select("a", "b"))
    facts = counts.join(classes, F.col("_a") == F.col("node")).select("_a", "links", "root")
    inside = members.join(saved(facts, "facts"), F.col("rep") == F.col("_a"), "left").select(
        "uid", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    every = docs.select(F.col("uid").alias("_every"))
    return every.join(inside, F.col("_every") == F.col("uid"), "left").select(
        F.col("_every").alias("uid"), F.coalesce("root", "_every").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )


def with_row_id(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """(uid, ...): rows numbered by their place in the input, which must read the same each time, as files do."""
    return docs.withColumn("uid", F.monotonically_increasing_id() if row_id is None else row_id)


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of every document row; ``class_id`` is the class's smallest doc_id (null if it has none)."""
    rows = with_row_id(docs.select("doc_id", "text"))
    found = saved(near_duplicates(rows), "classes")
    named = rows.select(F.col("uid").alias("_u"), "doc_id").join(found, F.col("_u") == F.col("uid")).select("doc_id", "root", "links")
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("class_id"))
    return named.join(least, F.col("root") == F.col("_root")).select("doc_id", "class_id", F.col("links").alias("n_links"))
