"""Near words by sorted lists against all pairs, and the query's odd rows."""

import random

import pytest

from lumapanel.llm import variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(words: dict[str, int], ratio: int) -> set[tuple]:
    out, forms = set(), {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
        out.add((w, n, len(found)))
    rows = set()
    for w, n, count in out:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, count, words[forms[w]] if forms[w] else None))
    return rows


def dense(seed: int, letters: str, low: int, high: int, n: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        words.add(w)
        k = rng.randrange(len(w) + 1)
        changed = [w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]]
        words.update(x for x in changed if low <= len(x))
    return {w: rng.choice([1, 1, 2, 3, 10, 30, 300, 5000]) for w in words}


@pytest.mark.parametrize("letters,low,high,list_words", [("ab", 3, 9, 4096), ("ab", 3, 9, 5), ("abcé漢", 2, 7, 3), ("a", 2, 40, 4)])
def test_all_pairs(spark, letters, low, high, list_words):
    words = {"a" * k: k % 7 * 50 + 1 for k in range(low, high)} if letters == "a" else dense(3, letters, low, high, 250)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in variants.group_variants(df, low, ratio=10, list_words=list_words).collect()]
    assert len(got) == len(words)
    assert set(got) == brute(words, 10)


def test_chain_of_forms(spark):
    chain = {"spelling": 100_000, "spellinx": 10_000, "spellixx": 1000, "spelxixx": 100, "spxlxixx": 10, "sxxlxixx": 1}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    rows = {r["word"]: r for r in variants.group_variants(df, 7).collect()}
    assert {r["root"] for r in rows.values()} == {"spelling"}
    assert rows["sxxlxixx"]["form"] == "spxlxixx"


def test_very_long_words_and_ties(spark):
    long = "ab" * 20_000
    words = {long: 5, long + "a": 50, "x" + long: 50, "variant": 1, "variants": 10, "variand": 10, "lonely": 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r["word"]: r for r in variants.group_variants(df, 6).collect()}
    assert rows[long]["form"] == long + "a" and rows[long]["n_near"] == 2
    assert rows["variant"]["form"] == "variand"  # as frequent as variants and smaller
    assert rows["lonely"]["n_near"] == 0 and rows["lonely"]["root"] == "lonely"


def test_odd_documents(spark, odd_docs, no_docs):
    runs = variants.letter_runs(odd_docs, least=5).select("run").distinct()
    assert {r["run"] for r in runs.collect()} >= {"quick", "brown", "jumps", "again", "words", "ünïcode"}
    counted = variants.count_words(variants.letter_runs(odd_docs, 5).selectExpr("run AS word"), 5, 2)
    assert variants.group_variants(counted, 5).count() == counted.count() > 0
    none = variants.count_words(variants.letter_runs(no_docs, 5).selectExpr("run AS word"), 5, 2)
    assert variants.group_variants(none, 5).count() == 0
