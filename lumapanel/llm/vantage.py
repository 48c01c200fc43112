"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Rows are dealt to shards of bounded size by a hash; each shard is one tree, and
all rows are in some tree. With one more component that gives every row of a
shard the same length, the largest inner product is the smallest distance, so
the triangle inequality prunes: a ball is left out if its nearest point can't be
nearer than the k-th neighbour found so far, divided by ``factor``. Factor one
keeps the search exact; a larger one prunes more and may miss neighbours.

The queries are a stated set: blocks of them meet each tree once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

SHARD_ROWS, QUERY_ROWS, LEAF = 4096, 2048, 128
PAIRS = 1 << 17
EPS = 1e-9


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


@dataclass
class Tree:
    """Rows in leaf order; per node the vantage row, its radius and the two halves.

    ``nodes`` is (vantage, radius, low, mid, high, inside, outside): rows ``low``
    to ``mid`` are inside; a leaf has vantage -1. Children are node numbers.
    """

    vectors: np.ndarray
    lift: np.ndarray
    ids: np.ndarray
    known: np.ndarray  # false where the id is null
    nodes: list[tuple]
    reach: float  # squared length of the lifted rows


def build(vectors: np.ndarray, ids: np.ndarray, known: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over the rows; rows that can't be told apart share a leaf."""
    square = exact_products(vectors, vectors)
    reach = float(square.max())
    lift = np.sqrt(np.maximum(reach - square, 0))
    order, nodes = np.arange(len(ids)), []

    def grow(low: int, high: int) -> int:
        number = len(nodes)
        nodes.append((-1, 0.0, low, high, high, -1, -1))
        if high - low <= leaf:
            return number
        rows = order[low:high]
        # The row farthest from the first one, on the rim, splits best.
        vantage = rows[0]
        for _ in range(2):
            d = np.sqrt(np.maximum(2 * reach - 2 * (vectors[rows] @ vectors[vantage] + lift[rows] * lift[vantage]), 0))
            if _ == 0:
                vantage = rows[d.argmax()]
        ranked = np.argsort(d, kind="stable")
        radius = float(d[ranked[(len(rows) - 1) // 2]])
        mid = low + int((d <= radius).sum())
        if mid == high:  # the outer half is one sphere: put the rim itself outside
            radius = float(d[d < radius].max(initial=-1.0))
            mid = low + int((d <= radius).sum())
        if mid in (low, high):
            return number
        order[low:high] = rows[ranked]
        inside = grow(low, mid)
        outside = grow(mid, high)
        nodes[number] = (int(vantage), radius, low, mid, high, inside, outside)
        return number

    grow(0, len(ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes = [(int(place[n[0]]) if n[0] >= 0 else -1, *n[1:]) for n in nodes]
    return Tree(vectors[order], lift[order], ids[order], known[order], nodes, reach)


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best rows per query, -1 where there are fewer.

    Rows with the query's own id are left out; equal scores go to the smaller id,
    null ids last.
    """
    n = len(queries)
    rows, scores = np.full((n, k), -1), np.full((n, k), -np.inf)
    length = exact_products(queries, queries)
    home = np.full(n, -1)
    rank = np.empty(len(tree.ids), np.int64)
    rank[np.lexsort((tree.ids, ~tree.known))] = np.arange(len(tree.ids))
    rank = np.append(rank, len(rank))  # of the missing row -1

    def visit(node: int, active: np.ndarray) -> None:
        _, _, low, _, high, _, _ = tree.nodes[node]
        # A leaf of one common vector ties with itself for every query: few queries at a time bound the pairs.
        step = max(1, PAIRS // (high - low))
        for first in range(0, len(active), step):
            compare(low, high, active[first : first + step])

    def compare(low: int, high: int, active: np.ndarray) -> None:
        rough = queries[active] @ tree.vectors[low:high].T
        slack = EPS * (1 + np.sqrt(length[active] * tree.reach))
        a, b = np.nonzero(rough >= (scores[active, -1] - slack)[:, None])
        b += low
        ok = ~(tree.known[b] & (tree.ids[b] == own[active[a]]))
        a, b = a[ok], b[ok]
        found = exact_products(queries[active[a]], tree.vectors[b])
        every = np.concatenate([np.repeat(np.arange(len(active)), k), a])
        row = np.concatenate([rows[active].ravel(), b])
        score = np.concatenate([scores[active].ravel(), found])
        order = np.lexsort((rank[row], -score, every))
        first = np.searchsorted(every[order], np.arange(len(active)))
        best = order[first[:, None] + np.arange(k)]
        rows[active], scores[active] = row[best], score[best]

    def distance(node: int, active: np.ndarray) -> np.ndarray:
        product = queries[active] @ tree.vectors[tree.nodes[node][0]]
        return np.sqrt(np.maximum(length[active] + tree.reach - 2 * product, 0))

    def descend(node: int, active: np.ndarray) -> None:
        vantage, radius, _, _, _, inside, outside = tree.nodes[node]
        if not len(active):
            return
        if vantage < 0:
            home[active] = node
            visit(node, active)
            return
        near = distance(node, active) <= radius
        descend(inside, active[near])
        descend(outside, active[~near])

    def widen(node: int, active: np.ndarray) -> None:
        vantage, radius, _, _, _, inside, outside = tree.nodes[node]
        if not len(active):
            return
        if vantage < 0:
            active = active[home[active] != node]
            if len(active):
                visit(node, active)
            return
        d = distance(node, active)
        for child, margin in ((inside, d - radius), (outside, radius - d)):
            square = np.where(np.isfinite(scores[active, -1]), length[active] + tree.reach - 2 * scores[active, -1], np.inf)
            bound = np.sqrt(np.maximum(square, 0)) / factor
            slack = 1e-6 * (1 + np.sqrt(length[active] + tree.reach))  # roots of rounded differences
            widen(child, active[margin <= bound + slack])

    everyone = np.arange(n)
    descend(0, everyone)
    widen(0, everyone)
    return rows, scores


# --- jobs --------------------------------------------------------------------


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, vector, dim) of the rows whose vector is not null, empty or zero and has only finite components."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vector").isNotNull())
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.filter(F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def _by_part(rows: DataFrame, count: int, bound: int) -> tuple[DataFrame, int]:
    """Rows dealt to parts of about ``bound`` rows; every row of a part is in one task, in order of the parts."""
    parts = max(1, -(-count // bound))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("long"))
    return dealt.repartition(parts, "dim", "part").sortWithinPartitions("dim", "part", "vec_id"), parts


def _packed(make):
    """One row (dim, part, blob) per (dim, part) of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            vectors = np.concatenate([np.asarray(p["vector"].flatten()) for p in held]).reshape(-1, key[0])
            ids = pa.concat_arrays([p["vec_id"] for p in held])
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            blob = pickle.dumps(make(vectors, ids.fill_null(0).to_numpy(), known))
            return pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int64()), "part": [key[1]], "blob": [blob]})

        for batch in batches:
            dims, parts = batch["dim"].to_numpy(), batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(parts) != 0)) + 1).tolist(), len(dims)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if key is not None and key != (int(dims[low]), int(parts[low])):
                    yield flush()
                    held = []
                key = (int(dims[low]), int(parts[low]))
                held.append(batch.slice(low, high - low))
        if held:
            yield flush()

    return run


def nearest(df: DataFrame, is_query: Column, k: int, factor: float = 1.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product for each query row.

    ``is_query`` is a condition on ``vec_id``. Vectors of another length than the
    query's never match it; null, empty, zero and non-finite vectors take no part;
    rows with the query's own id are not its neighbours. Equal scores go to the
    smaller id (null last). Repeated query rows each get a list. ``score`` is the
    inner product in double precision on the original vectors.
    """
    rows = valid_vectors(df, id_col, vector)
    asked = rows.filter(is_query)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    dealt, _ = _by_part(rows, sizes["n"], SHARD_ROWS)
    trees = saved(dealt.mapInArrow(_packed(build), "dim long, part long, blob binary"), "trees")
    dealt, _ = _by_part(asked, sizes["q"], QUERY_ROWS)
    blocks = saved(dealt.mapInArrow(_packed(lambda *x: x), "dim long, part long, blob binary"), "query-blocks")
    # Each block of queries with each tree of its dimension.
    tree_keys = trees.select(F.col("dim").alias("_dim"), F.col("part").alias("tree"))
    pairs = blocks.select("dim", F.col("part").alias("block")).join(tree_keys, F.col("dim") == F.col("_dim")).select("dim", "tree", "block")
    left = blocks.select(F.col("dim").alias("_d1"), F.col("part").alias("_b"), F.col("blob").alias("queries"))
    right = trees.select(F.col("dim").alias("_d2"), F.col("part").alias("_t"), F.col("blob").alias("tree_blob"))
    both = pairs.join(left, (F.col("dim") == F.col("_d1")) & (F.col("block") == F.col("_b")))
    both = both.join(right, (F.col("dim") == F.col("_d2")) & (F.col("tree") == F.col("_t")))
    both = both.select("dim", "block", "tree", "queries", "tree_blob").repartition(max(1, pairs.count()), "dim", "block", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors, ids, _ = pickle.loads(batch["queries"][i].as_py())
                tree = pickle.loads(batch["tree_blob"][i].as_py())
                row, score = search(tree, vectors, ids, k, factor)
                q, at = np.nonzero(row >= 0)
                hit = row[q, at]
                name = np.full(len(q), batch["dim"][i].as_py()), np.full(len(q), batch["block"][i].as_py())
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": name[0],
                        "block": name[1],
                        "slot": q,
                        "query_id": ids[q],
                        "vec_id": pa.array(tree.ids[hit], mask=~tree.known[hit]),
                        "score": score[q, at],
                    }
                )

    found = both.mapInArrow(run, "dim long, block long, slot long, query_id long, vec_id long, score double")
    # k rows per tree and query; Spark keeps k per query before the shuffle.
    line = Window.partitionBy("dim", "block", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
