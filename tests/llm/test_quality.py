"""Boosted trees against walking them one by one, statistics against plain counting, and held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumapanel.llm import quality as Q
from lumapanel.llm.queries import QUERIES

TEXTS = ["Hello world.\nhello World\nhello World\n", "", None, " \t\n", "***!!! ### A1 b2\n\n| x | y |", "ÜBER über 漢字, x", "one", "a" * 3000 + "\nEnd."]


def column(x, name):
    return x[:, Q.STATISTICS.index(name)]


def test_statistics_by_counting():
    x = Q.statistics(pa.array(TEXTS))
    assert not x[1].any() and not x[2].any()
    for k, t in enumerate(TEXTS):
        if not t:
            continue
        words, raw = re.findall(r"[^ \t-\r]+", t), t.encode()
        assert math.isclose(column(x, "log_bytes")[k], math.log1p(len(raw)))
        assert math.isclose(column(x, "log_words")[k], math.log1p(len(words)))
        n = max(1, len(words))
        assert math.isclose(column(x, "distinct_words")[k], len(set(words)) / n)
        assert math.isclose(column(x, "top_word")[k], max(Counter(words).values(), default=0) / n)
        assert math.isclose(column(x, "distinct_pairs")[k], len(set(zip(words, words[1:]))) / max(1, len(words) - 1))
        assert math.isclose(column(x, "upper")[k], len(re.findall("[A-Z]", t)) / len(raw))
        assert math.isclose(column(x, "longest_word")[k], max((len(w.encode()) for w in words), default=0))
        assert math.isclose(column(x, "all_upper")[k], sum(bool(re.search("[A-Z].*[A-Z]", w)) and not re.search("[a-z]", w) for w in words) / n)
        lines = [p for p in re.findall(r"[^\n]*\n|[^\n]+$", t)]
        assert math.isclose(column(x, "log_lines")[k], math.log1p(len(lines)))
        assert math.isclose(column(x, "distinct_lines")[k], len(set(lines)) / len(lines))
        again = sum((c - 1) * len(v.encode()) for v, c in Counter(lines).items())
        assert math.isclose(column(x, "repeated_line_bytes")[k], again / len(raw))
        assert math.isclose(column(x, "lines_ending_sentence")[k], sum(v.rstrip(" \t\n\r\v\f")[-1:] in tuple(".!?") for v in lines) / len(lines))
        assert math.isclose(column(x, "byte_entropy")[k], -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values()), abs_tol=1e-9)


def test_a_text_counts_alike_in_every_batch():
    x = Q.statistics(pa.array(TEXTS * 3))
    for k, t in enumerate(TEXTS):
        assert np.array_equal(x[k], Q.statistics(pa.array([t], pa.string()))[0])
        assert np.array_equal(x[k], x[k + 2 * len(TEXTS)])


def walked(forest, row):
    total = forest.start
    for root in forest.roots:
        node = root
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


@pytest.mark.parametrize("depth,bins", [(1, 64), (4, 8), (6, 64)])
def test_flat_arrays_equal_single_walks(depth, bins):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + x[:, 2] > 0)).astype(float)
    forest = Q.fit(x, y, bins=bins, trees=30, depth=depth)
    fresh = rng.normal(size=(200, 5))
    assert np.allclose(forest.margins(fresh), [walked(forest, r) for r in fresh])
    if depth > 1:
        assert ((forest.probability(x) > 0.5) == y).mean() > 0.9


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) > 5).astype(float)
    forest = Q.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))

    def gain(f, cut):
        a = x[:, f] <= cut
        return sum(g[m].sum() ** 2 / (h[m].sum() + Q.RIDGE) for m in (a, ~a)) if min(h[a].sum(), h[~a].sum()) >= Q.LEAST_CURVATURE else -1

    best = max(gain(f, c + 0.5) for f in range(4) for c in range(8))
    root = forest.roots[0]
    assert math.isclose(gain(forest.feature[root], forest.threshold[root]), best)


def test_one_kind_of_label_only():
    forest = Q.fit(np.ones((5, 3)), np.ones(5))
    assert len(forest.roots) == 0 and (forest.probability(np.zeros((4, 3))) > 0.7).all()
    assert np.isfinite(Q.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3)))).all()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op11_histogram_boosted_quality"](spark, sf_dir)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    again = QUERIES["op11_histogram_boosted_quality"](spark, sf_dir)
    assert got.exceptAll(again).count() == 0


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 7), (1, 0, 7), (3, 0, 7), (5, 1, 7), (6, 1, 7), (None, 1, 7), (7, None, 7)], "doc_id long, quality int, text int")
    rows = Q.score_documents(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert Q.score_documents(no_docs, labels).count() == 0
    assert Q.score_documents(odd_docs, labels.filter("false")).count() == len(rows)
    bounded = Q.train(odd_docs, labels.filter("quality = 1"), max_rows=2)
    assert len(bounded.roots) == 0
