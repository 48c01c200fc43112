"""Quotient filters and phrases against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumapanel.llm import collocations as C


@pytest.mark.parametrize("bits", [1, 2, 5, 17, 20, 21, 22, 33, 42])
def test_packing_is_invertible(bits):
    packing, rng = C.Packing(bits), np.random.default_rng(bits)
    packing.check()
    words = [rng.integers(0, 2**bits, 500) for _ in range(3)]
    high, low = packing.pack(words)
    assert int(high.max()) < 1 << packing.half and int(low.max()) < 1 << packing.half
    for a, b in zip(words, packing.unpack(high, low), strict=True):
        assert (a == b).all()


def test_too_many_words():
    with pytest.raises(ValueError):
        C.Packing(43).check()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60), st.sampled_from([2, 21, 40]), st.integers(0, 3))
def test_filters_lose_nothing_and_merge(rows, bits, shard_bits):
    packing = C.Packing(bits)
    parts, want = [], Counter()
    for half in (rows[::2], rows[1::2] or rows[:1]):
        want.update(half)
        columns = [np.array(c) for c in zip(*half, strict=True)]
        filled = C.QuotientFilter.of(*packing.pack(columns), None, packing.half)
        cuts = filled.shard_cuts(min(shard_bits, packing.half), packing.half)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low < high:
                parts.append(C.QuotientFilter.unpacked(filled.packed(int(low), int(high), packing.half)))
    whole = C.QuotientFilter.of(*(np.concatenate(p) for p in zip(*parts, strict=True)), packing.half)
    words = packing.unpack(whole.high, whole.low)
    assert dict(zip(zip(*(w.tolist() for w in words), strict=True), whole.counts.tolist(), strict=True)) == want


def test_counts_over_a_byte():
    filled = C.QuotientFilter(np.array([1, 9], np.uint64), np.array([2, 2], np.uint64), np.array([255, 10**13]))
    assert C.QuotientFilter.unpacked(filled.packed(0, 2, 6))[2].tolist() == [255, 10**13]


def brute(docs, least, most, share):
    words, phrases, totals = Counter(), Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    phrases[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in totals:
        cand = {p: a for (g, p), a in phrases.items() if g == lang and a >= least and len(p) > 1}
        rows = []
        for p, a in cand.items():
            score, k = min((10**6 * a * a // (phrases[lang, p[:k]] * phrases[lang, p[k:]]), k) for k in range(1, len(p)))
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in cand.items()):
                continue
            rows.append((-score, -a, " ".join(p).encode(), phrases[lang, p[:k]], phrases[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("file_bytes,packing", [(1 << 20, None), (200, None), (1 << 20, C.Packing(40))])
def test_phrases_against_counting(spark, file_bytes, packing):
    rng = np.random.default_rng(4)
    vocab = ["New", "york", "ÉTÉ", "été", "of", "the", "a-b", "漢字", "x" * 50]
    docs = [(["en", None, "de"][k % 3], "".join(f"{rng.choice(vocab)}{rng.choice([' ', '  ', '. ', chr(9), chr(13)], p=[.7, .1, .1, .05, .05])}" for _ in range(60))) for k in range(40)]
    docs += [("en", None), (None, ""), ("fr", " . "), ("en", "new york " * 400)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in C.mine(df, least=4, most=25, share=50, file_bytes=file_bytes, packing=packing).collect())
    assert got == brute(docs, 4, 25, 50)


def test_scores_pass_64_bits(spark):
    f = [3_000_000_000_001, 2_999_999_999_999, 2_999_999_999_998]
    words = spark.createDataFrame([(0, "en", "p", f[0]), (1, "en", "q", f[1]), (2, "en", "r", f[2])], "id long, lang string, word string, f long")
    a12, a23, a = 2_500_000_000_003, 2_999_999_999_001, 2_400_000_000_007
    phrases = spark.createDataFrame([(0, 1, -1, a12), (1, 2, -1, a23), (0, 1, 2, a)], "w1 long, w2 long, w3 long, a long")
    got = {r["w3"]: r for r in C.score_phrases(C.Counts(words, phrases, words)).filter("w1 = 0").collect()}
    assert got[-1]["score"] == 10**6 * a12 * a12 // (f[0] * f[1])
    cuts = [(10**6 * a * a // (f[0] * a23), 1, f[0], a23), (10**6 * a * a // (a12 * f[2]), 2, a12, f[2])]
    best = min(cuts)
    assert (got[2]["score"], got[2]["l"], got[2]["r"]) == (best[0], best[2], best[3])


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in C.mine(odd_docs, least=2, most=50).collect())
    assert got == brute(rows, 2, 50, 50)
    assert C.mine(no_docs).count() == 0
