import difflib
import random
import string

import pytest
from pyspark.sql import functions as F

from lumapanel.functions import names as M
from lumapanel.operators import linkage as L
from lumapanel.operators.projection import project


def words(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeghimnoprst") for _ in range(rnd.randint(1, 14))) for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.5 and len(w) > 1:
                del w[min(i, len(w) - 1)]
            else:
                w.insert(i, rnd.choice(string.ascii_lowercase))
        out.add("".join(w))
    return sorted(out)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.85, 1.0])
def test_similar_pairs_miss_nothing(spark, threshold):
    xs, ys = words(1, 90), words(1, 150)[::2] + words(2, 30)
    left = spark.createDataFrame([(x,) for x in xs], "a string")
    right = spark.createDataFrame([(y,) for y in sorted(set(ys))], "b string")
    got = {(r.a, r.b) for r in L.similar_pairs(left, right, "a", "b", threshold).collect()}
    assert got == {(x, y) for x in xs for y in set(ys) if ratio(x, y) >= threshold}


def test_low_threshold_is_refused(spark):
    df = spark.createDataFrame([("a",)], "a string")
    with pytest.raises(ValueError):
        L.similar_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", 0.5)


def test_name_cascade(spark):
    known = spark.createDataFrame([("Pune",), ("Bid",), ("Ahmadnagar",), ("Gondiya",)], "k string")
    asked = spark.createDataFrame([("PUNÉ ",), ("Beed",), ("Ahmednagar",), ("gondia",), ("Nowhere",), (None,)], "n string")
    got = {r.n: (r.resolved, r.method) for r in L.resolve_names(asked, known, "n", "k").collect()}
    assert got == {
        "PUNÉ ": ("Pune", "exact"),
        "Beed": ("Bid", "override"),
        "gondia": ("Gondiya", "override"),
        "Ahmednagar": ("Ahmadnagar", "fuzzy"),
        "Nowhere": ("Nowhere", "unmatched"),
    }
    table = spark.createDataFrame([("Beed", 1), ("Nowhere", 2), (None, 3)], "n string, v int")
    out = {r.v: r.n for r in L.apply_resolution(table, L.resolve_names(asked, known, "n", "k"), "n").collect()}
    assert out == {1: "Bid", 2: "Nowhere", 3: None}


def sequential_matching(rows, threshold=0.85):
    """One district after the other, single-year names in order, each to its best open partner."""
    anchors, first = {}, {}
    for d, n, y, o in sorted(rows, key=lambda r: (r[2], r[3])):
        anchors.setdefault((d, n), {})[y] = (d, n)
        first.setdefault((d, n), o)
    singles = [k for k in anchors if len(anchors[k]) == 1]
    multis = [k for k in anchors if len(anchors[k]) > 1]
    for s in singles:
        year = next(iter(anchors[s]))
        best, top = None, 0.0
        for m in multis:
            if m[0] == s[0] and year not in anchors[m] and ratio(s[1], m[1]) > top:
                best, top = m, ratio(s[1], m[1])
        if best and top >= threshold:
            anchors[best][year] = s
            del anchors[s]
    return {(src[0], src[1], y): k[1] for k, by in anchors.items() for y, src in by.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_town_matching_equals_sequential_choice(spark, seed):
    rnd = random.Random(seed)
    rows, order = set(), 0
    for d in ("A", "B"):
        for base in ("nandurbar", "shirpur", "dondaicha", "kalyan", "bhiwandi"):
            rows |= {(d, base, y) for y in rnd.sample([1991, 2001, 2011], 2)}
            for _ in range(3):
                i = rnd.randrange(len(base))
                rows.add((d, base[:i] + rnd.choice("xyz") + base[i:], rnd.choice([1991, 2001, 2011])))
    rows = sorted(rows, key=lambda r: (r[2], rnd.random()))
    rows = [(d, n, y, order + i) for i, (d, n, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "district string, norm string, yr int, ord int")
    got = {(r.district, r.norm, r.yr): r.town_key for r in L.match_across_years(df, "district", "norm", "yr", "ord").collect()}
    assert got == sequential_matching(rows)


def test_name_cleaners(spark):
    cases = [
        ("Pune (M Corp.)", M.town_key, "pune"),
        ("Bhigwan (CT)", M.town_key, "bhigwan"),
        ("Alandi (M) ", M.town_key, "alandi"),
        ("Thane (Part)", M.town_key, "thane"),
        ("*Nira", M.town_key, "nira"),
        ("a)PUNE (M.CORP.) Ward No. 01", M.town_of_ward, "Pune (M.Corp.)"),
        ("BHIGWAN (CT)* Ward No. 01", M.town_of_ward, "Bhigwan (Ct)"),
        ("Greater Mumbai (M Corp.) (Part)", M.strict_query_name, "Greater Mumbai"),
        ("Ii)Kirkee Cantt.", M.strict_query_name, "Khadki"),
        ("Sangli  & Miraj!", M.url_slug, "sangli-miraj"),
        ("'Mumbai (Suburban)*", M.district_name, "Mumbai Suburban"),
        ("  É  cole ", M.normal_name, "e cole"),
    ]
    for text, fn, want in cases:
        df = spark.createDataFrame([(text,)], "x string")
        assert df.select(fn("x")).first()[0] == want, text


def test_projection_rules(spark):
    rows = [("a", 1991, 10.0, 5.0), ("a", 2001, 20.0, None), ("a", 2011, 50.0, None), ("b", 2011, 7.0, 3.0), ("c", 2001, 9.0, 1.0), ("c", 2011, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "e string, y int, p double, q double")
    hold = {(r.e, r.year): r for r in project(df, ["e"], "y", ["p", "q"], [1980, 1996, 2001, 2020]).collect()}
    assert ("b", 2020) not in hold
    assert [hold["a", t].p for t in (1980, 1996, 2001, 2020)] == pytest.approx([-1.0, 15.0, 20.0, 77.0])
    assert hold["a", 2020].q == 5.0 and hold["c", 2020].p == pytest.approx(-6.2)
    null = {(r.e, r.year): r for r in project(df, ["e"], "y", ["q"], [2020], single="null").collect()}
    assert null["a", 2020].q is None
    held = {(r.e, r.year): r for r in project(df, ["e"], "y", ["p"], [2020], 1, "hold", True).collect()}
    assert held["b", 2020].p == 7.0 and held["c", 2020].p == 0.0


def test_query_variants(spark):
    df = spark.createDataFrame([("Roha Ashtami",)], "x string")
    assert df.select(F.size(M.query_variants("x", F.lit("D"), "S", "C"))).first()[0] == 3


def test_short_names_get_suggestions(spark):
    a = spark.createDataFrame([("Pune",), ("Nashik",), ("Nanded",)], "n string")
    b = spark.createDataFrame([("Pun",), ("Nashik",), ("na",), ("NANDED",), ("Qq",)], "n string")
    got = sorted(((r["name"], r["status"], r["similar"]) for r in L.cross_check(a, b, "n", "n").collect()), key=str)
    assert got == sorted(
        [("Pun", "extra", "Pune"), ("Pune", "missing", None), ("na", "extra", "Nashik"), ("na", "extra", "Nanded"), ("NANDED", "case_only", None), ("Qq", "extra", None)],
        key=str,
    )


def test_frequent_pieces_lose_no_pair(spark):
    names = [f"district {i:04d}" for i in range(0, 2400, 20)]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(r["a"], r["b"]) for r in L.similar_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", 0.85).collect()}
    assert got == {(x, y) for x in names for y in names if ratio(x, y) >= 0.85}


def test_names_with_a_shared_part_make_few_candidates(spark):
    names = [f"district {i:04d}" for i in range(400)]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    other = df.withColumnRenamed("a", "b")
    assert L.candidate_rows(df, other, "a", "b", 0.85).count() < 0.15 * len(names) ** 2
    got = {(r["a"], r["b"]) for r in L.similar_pairs(df, other, "a", "b", 0.85).collect()}
    assert got == {(x, y) for x in names for y in names if ratio(x, y) >= 0.85}


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_long_names_by_their_rare_pieces(spark, threshold):
    rnd = random.Random(7)
    base = ["municipal area of " + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 14))) for _ in range(6)]
    names = set(base)
    for n in base:
        for _ in range(5):
            w = list(n)
            for _ in range(rnd.randint(1, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(["", "x", "ab"])
            names.add("".join(w))
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(r["a"], r["b"]) for r in L.similar_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", threshold).collect()}
    assert got == {(x, y) for x in names for y in names if ratio(x, y) >= threshold}


def test_a_chain_of_conflicts_in_one_pass(spark):
    # Town k is as near to name k as to name k + 1, and every name but the last is wanted by an earlier town.
    stem = lambda k: f"{chr(97 + k // 26)}{chr(97 + k % 26)}" * 3
    rows = []
    for k in range(51):
        rows += [("D", stem(k) + "nagarpur", y, 10_000 * (y == 2011) + k) for y in (1991, 2011)]
    n = len(rows)
    for k in range(50):
        rows += [("D", stem(k) + "nagarpu", 2001, 20_000 + n + 2 * k), ("D", stem(k) + "nagarpurr", 2001, 20_001 + n + 2 * k)]
    df = spark.createDataFrame(rows, "district string, norm string, yr int, ord int")
    out = L.match_across_years(df, "district", "norm", "yr", "ord", 0.8)
    got = {(r.district, r.norm, r.yr): r.town_key for r in out.collect()}
    assert got == sequential_matching(rows, 0.8)
    short = L.match_across_years(df.filter("ord % 7 = 0"), "district", "norm", "yr", "ord", 0.8)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString().count("\n")
    assert plan(out) == plan(short)


def test_long_chain_of_turned_away_names(spark):
    pairs = [("D", 2001, k, f"s{k:02d}", 1.0 - j / 1000, k + j, f"m{k + j:02d}") for k in range(50) for j in range(51 - k)]
    pairs = pairs[::-1]
    table = L.pa.Table.from_pylist([dict(zip(("district", "_y", "_ord", "single", "ratio", "_mord", "multi"), p)) for p in pairs])
    # All want the first places; each takes the best one left.
    got = {r["single"]: r["multi"] for r in L._by_turns(table).to_pylist()}
    assert got == {f"s{k:02d}": f"m{k:02d}" for k in range(50)}
