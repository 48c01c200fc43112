"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumapanel.llm import (
    backoff_lm,
    chosen_path,
    decontamination,
    mixing,
    sharding,
    substrings,
    token_files,
    toxicity,
    vantage,
    warc,
)
from lumapanel.llm.words import inside_text, window_hashes, words_of


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 7, 24, 500])
def test_jump_hash_is_the_published_one(spark, shards):
    keys = [0, 1, 2, 255, 2**40 + 3, 2**63 - 1, -1, -(2**63)] + list(range(1000, 1200))
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), shards, shards + 1).alias("s"))
    for r in df.collect():
        assert r["s"]["shard"] == jump(r["k"] % 2**64, shards)
        assert r["s"]["grown"] == jump(r["k"] % 2**64, shards + 1)


def test_sharding_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text")
    out = sharding.shard_rows(rows, "doc_id", ["text"], 3).collect()
    assert len(out) == 10
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in out)
    assert sharding.shard_rows(no_docs.select("doc_id", "text"), "doc_id", ["text"], 3).count() == 0


def test_mixing_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mix_sources(rows).collect()
    assert len(out) == 10 and all(0 <= r["copies"] <= 2 for r in out)
    assert {r["target"] for r in out if r["source"] is None} != {None}
    assert mixing.mix_sources(no_docs.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0


def test_targets_fill_up_and_share_again(spark):
    counts = spark.createDataFrame([("a", 1, 1000), ("b", 1, 10), ("c", 1, 300), (None, 1, 500)], "source string, size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(counts).collect()}
    sizes, weights = {"a": 1000, "b": 10, "c": 300, None: 500}, {"a": 5, "b": 2, "c": 1, None: 5}
    left, open_ = 1.5 * 1810, set(sizes)
    want = {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not full:
            want |= {s: weights[s] * level for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_warc_odd_rows(spark):
    rows = [(1, "http://a b\r\nX: y", "<p>ü</p>"), (2, None, None), (3, "u", ""), (None, "u", "<p>ü</p>"), (4, "u", "\r\n\r\n"), (2, None, None), (5, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    out = warc.archive_pages(pages, payloads=True).collect()
    assert sorted((r["page_id"] or 0) for r in out) == [0, 1, 2, 2, 3, 4, 5]
    by = {r["page_id"]: r for r in out if r["page_id"] not in (2,)}
    assert by[1]["record_type"] == "response" and by[1]["payload"].decode() == "<p>ü</p>"
    assert (by[None]["record_type"], by[None]["refers_to"]) == ("revisit", 1)
    assert by[3]["record_type"] == "response" and sum(r["record_type"] == "revisit" and r["refers_to"] == 3 for r in out) == 2
    assert by[4]["payload"] == b"\r\n\r\n" and by[5]["payload_bytes"] == 3_000_000
    assert warc.archive_pages(pages.filter("false")).count() == 0


def test_zip64_directory(tmp_path):
    import zipfile

    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(66_000):  # more members than the short directory can count
            z.writestr(f"m{k}", str(k))
    with pa.OSFile(str(path)) as f:
        members = warc.zip_directory(f, path.stat().st_size)
        m = members["m65999"]
        assert len(members) == 66_000 and warc._range(f, m["at"], m["size"]) == b"65999"


def test_decontamination_finds_edited_copies(spark, odd_docs):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    item = list(rng.choice(words, 40))
    edited = item.copy()
    for k in range(3, 40, 7):
        edited[k] = "changed"
    del edited[20]
    noise = lambda: list(rng.choice(words, 300))
    rows = [(1, " ".join(noise() + item + noise())), (2, ", ".join(noise() + edited).upper()), (3, " ".join(noise())), (4, None), (5, " ".join(item[:6]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (None, None), (8, "a b")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontamination.find_leaks(docs, items).collect()}
    assert set(out) == {1, 2} and out[1]["score"] == 1.0 and 0.6 < out[2]["score"] < 1
    assert out[1]["end_word"] == 340
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, items).collect()} == {3, 4, 5}
    assert decontamination.find_leaks(docs, items.filter("false")).count() == 0
    assert decontamination.find_leaks(odd_docs, items).count() == 0


def test_decontamination_finds_copies_with_every_fourth_word_changed(spark):
    rng = np.random.default_rng(4)
    item = [f"w{k}" for k in range(31)]
    changed = [f"c{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    noise = lambda: [f"n{k}" for k in rng.integers(0, 3000, 100)]
    docs = spark.createDataFrame([(1, " ".join(noise() + changed + noise())), (2, " ".join(noise()))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (8, "no document holds this")], "item_id long, text string")
    out = decontamination.find_leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in out] == [(1, 9)] and out[0]["score"] > 0.5
    assert [r["doc_id"] for r in decontamination.without_leaks(docs, items).collect()] == [2]
    assert decontamination.find_leaks(docs, items.filter("item_id = 8")).count() == 0
    better = spark.createDataFrame([(3, " ".join(noise() + item))], "doc_id long, text string")  # holds the neighbours of the short runs
    assert {r["doc_id"] for r in decontamination.find_leaks(docs.union(better), items).collect()} == {1, 3}


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table(spark):
    rng = np.random.default_rng(5)
    item = [f"i{k}" for k in rng.integers(0, 30, 25)]
    block = decontamination.Items([1], [words_of(pa.array([" ".join(item)]), plain=True).hashes])
    n = len(np.unique(np.concatenate(block.grams())))
    matcher = decontamination.Matcher(block, np.ones(n, np.int64))
    for _ in range(20):
        other = [f"i{k}" for k in rng.integers(0, 30, 60)]
        other[20:32] = item[5:17]
        w = words_of(pa.array([" ".join(other)]), plain=True)
        score, _ = matcher._align(w.hashes, np.array([0]), np.array([0]), np.array([60]))
        assert score[0] * 2 * 25 == smith_waterman(item, other)


def brute_repeats(texts, window):
    words = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, i + k) for places in seen.values() if len(places) > 1 for d, i in places for k in range(window)}
    return [(len(w), sum((d, i) in gone for i in range(len(w))), " ".join(x for i, x in enumerate(w) if (d, i) not in gone)) for d, w in enumerate(words)]


def test_repeats_equal_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for k in range(60):
        w = [f"r{x}" for x in rng.integers(0, 50_000, rng.integers(0, 120))]
        a = int(rng.integers(0, 20))
        texts.append(" ".join(w[:a] + shared[a : a + int(rng.integers(30, 41))] + w[a:]))
    texts += ["z " * 40, None, "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs).collect()}
    assert [out[k] for k in range(len(texts))] == brute_repeats(texts, 35)
    assert substrings.remove_repeats(odd_docs).count() == 10
    assert substrings.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, 35, 21, (0, 1, 2))


def test_windows_and_words():
    w = words_of(pa.array(["a b c d", None, "b c", "x y z"]))
    assert w.offsets.tolist() == [0, 4, 4, 6, 8]
    runs = window_hashes(w.hashes, 2)
    assert runs[1] == runs[4] and len(set(runs.tolist())) == len(runs) - 1
    assert inside_text(w.offsets, 2).tolist() == [True, True, True, False, True, False, True]


def test_vantage_trees_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(900, 8)).round(1)
    vectors[100:400] = vectors[0]  # one very common vector
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 2.0]), (None, vectors[5].tolist()), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vantage.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    whole = [(k, np.array(v)) for k, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    for q in range(0, 900, 20):
        found = sorted((-vantage.exact_products(vectors[q][None], v[None])[0], k is None, k or 0, k) for k, v in whole if k != q)[:5]
        assert [got[q, i + 1] for i in range(5)] == [(k, -s) for s, _, _, k in found]
    assert vantage.nearest(df.filter("false"), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 16))
    tree = vantage.build(vectors, np.arange(3000), np.ones(3000, bool))
    exact = vantage.search(tree, vectors[:100], np.arange(100), 10)[1]
    relaxed = vantage.search(tree, vectors[:100], np.arange(100), 10, factor=1.3)[1]
    assert (relaxed >= exact[:, -1:] - 1e-9).mean() >= 0.9


def test_token_files_odd_rows(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_token_files(odd_docs, path, 2, 50257, file_tokens=1000)
    out = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, -8, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1]]
    assert token_files.read_token_files(token_files.write_token_files(no_docs, path, 2, 50257)).count() == 0
    plain = Tokenizer.from_file(path)
    enc = token_files.UnitEncoder(path)
    for t in ["", " a", "a  b \n c", "\n", "a\n b c\x00 \x00d", "x  y <|endoftext|> z", "  ", "a ", "don't  stop", "a\r b", "  x  y z"]:
        assert enc.encode([t, t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids * 2


def test_token_files_end_with_the_document_that_fills_them(spark):
    import public_tokenizers

    texts = [" ".join(["word"] * (k * 37 % 90)) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    files = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 50257, file_tokens=1000)
    rows = files.orderBy("part", "file").collect()
    assert sum(r["docs"] for r in rows) == 400 and all(r["ids"] < 1000 + 90 for r in rows)
    last = {r["part"]: r["file"] for r in rows}
    assert all(r["ids"] >= 1000 for r in rows if r["file"] < last[r["part"]])
    out = token_files.read_token_files(files).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in out] == [(k, k * 37 % 90 + 1) for k in range(400)]


def test_repair_round_trip(tmp_path):
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.append(rng.choice([3, 4, 5, 5, 5], n), 2) for n in (1, 0, 500, 3000)]).astype(np.uint32)
    lengths = np.array([2, 1, 501, 3001])
    path = tmp_path / "t.tok"
    path.write_bytes(token_files.file_bytes(ids, lengths, [7, None, 8, 9], 2, 10))
    assert path.stat().st_size < 4 * len(ids)
    with pa.OSFile(str(path)) as f:
        held = token_files.TokenFile(f)
        assert held.doc_ids == [7, None, 8, 9]
        ends = np.cumsum(lengths)
        for k in (3, 0, 2, 1):
            assert held.ids(k, k + 1).tolist() == ids[ends[k] - lengths[k] : ends[k]].tolist()


def whole_automaton(files, counts, total, distinct, pair_least, triple_least):
    """The automaton of all texts at once."""
    parts = [backoff_lm.read_tokens(r["path"]) for r in files.select("path").collect()]
    words = np.unique(np.concatenate([p.words for p in parts]))
    word = np.concatenate([np.searchsorted(words, p.words)[p.word] for p in parts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.offsets) for p in parts]))])
    used = np.concatenate([p.used for p in parts])
    texts = backoff_lm.Texts(backoff_lm.Tokens(words, word, offsets, used, None))
    known = {r["key"]: r["c"] for r in counts.filter("first").collect()}
    word_c = np.array([known[int(k)] for k in words.view(np.int64)], np.int64)
    texts.keep(texts.pair_n, pair_least)
    triple_c = texts.triple_n
    word_mass = texts.word_mass(np.arange(len(texts.pairs)))
    pair_mass = texts.pair_mass(triple_c, np.flatnonzero((triple_c >= triple_least) & (triple_c > 0)))
    return backoff_lm.assemble(texts, word_c, (total, distinct, int(used.sum())), word_mass, pair_mass, triple_c, triple_least)


def test_token_files_hold_each_text(spark, odd_docs):
    texts = {k: " ".join(f"W{(k * j) % 37}" for j in range(k % 50)) for k in range(300)} | {300: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("held", F.col("doc_id") % 3 == 0)
    files = backoff_lm.save_tokens(docs, 1 << 10).collect()
    assert len(files) > 8
    seen = {}
    for f in files:
        t = backoff_lm.read_tokens(f["path"])
        assert (np.diff(t.words.astype(object)) > 0).all()
        for k, (doc_id, held) in enumerate(zip(t.rows["doc_id"].to_pylist(), t.rows["held"].to_pylist(), strict=True)):
            assert held == (doc_id % 3 == 0) and t.used[k] == (not held)
            seen[doc_id] = t.words[t.word[t.offsets[k] : t.offsets[k + 1]]]
    assert seen.keys() == texts.keys()
    for k, text in texts.items():
        own = words_of(pa.array([(text or "").lower()])).hashes
        assert seen[k].tolist() == [*own.tolist(), int(backoff_lm.END)]


def test_automaton_states_sum_to_one(spark, odd_docs, no_docs):
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice(list("abcdef"), rng.integers(0, 30), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held", F.lit(False))
    files = backoff_lm.save_tokens(docs, 1 << 14)
    counts = backoff_lm.saved(backoff_lm.word_counts(files), "words")
    total = sum(len(t.split()) + 1 for t in texts)
    model = whole_automaton(files, counts, total, 7, 1e-5, 1e-5)
    assert len(model.words) == 7 and len(model.back) > 9
    unknown = 1 / (total + 8)
    ends = 1 + int(np.flatnonzero(model.words == backoff_lm.END)[0])
    for state in range(len(model.back)):
        if state == ends:
            continue  # nothing follows an end
        p, _ = model.step(np.full(7, state), np.arange(7), model.word_p)
        rest, _ = model.step(np.array([state]), np.array([-1]), np.array([np.log10(unknown)]))
        assert np.isclose((10**p).sum() + 10 ** rest[0], 1.0, atol=1e-9)
    # A text longer than two stretches scores as if it were walked token by token.
    words = rng.integers(-1, 7, 4 * backoff_lm.STRETCH + 5)
    offsets = np.array([0, 3, 3 + backoff_lm.STRETCH, len(words)])
    base = np.where(words < 0, np.log10(unknown), model.word_p[words])
    for k, score in enumerate(model.scores(words, base, offsets)):
        state, want = np.array([model.start]), 0.0
        for at in range(offsets[k], offsets[k + 1]):
            p, state = model.step(state, words[[at]], base[[at]])
            want += p[0]
        assert np.isclose(score, want, rtol=1e-12)
    assert backoff_lm.score_documents(odd_docs).count() == 10
    assert backoff_lm.score_documents(no_docs).count() == 0


def test_rare_phrases_are_modelled_in_a_larger_corpus(spark):
    rng = np.random.default_rng(21)
    filler = [f"f{k}" for k in range(300)]
    phrase = "seldom seen words stand here together"
    texts = {k: " ".join(rng.choice(filler, 1000)) for k in range(260)}
    texts |= {1000 + k: f"{texts[k][:200]} {phrase} {texts[k + 1][:100]}" for k in range(2)}  # more than 2e5 tokens, the phrase twice
    texts |= {2000: f"f1 f2 {phrase} f3", 2001: "", 2002: "never met before"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in backoff_lm.score_documents(docs, F.col("doc_id") >= 2000).collect()}
    trained = [[None, *t.split(), ""] for k, t in texts.items() if k < 2000]  # None: start, "": end
    one, two, three = (collections.Counter(tuple(t[i : i + n]) for t in trained for i in range(len(t) - n + 1)) for n in (1, 2, 3))
    total = sum(n for (w,), n in one.items() if w is not None)
    kept, after = {2: two, 3: three}, {2: one, 3: two}
    mass = {n: collections.Counter() for n in kept}
    for n, grams in kept.items():
        for g, c in grams.items():
            if c >= 2:
                mass[n][g[:-1]] += c - 0.75

    def p(history, w):
        if not history:
            return (one[(w,)] + 1) / (total + len(one) - 1 + 1)
        n = len(history) + 1
        c, all_ = kept[n][history + (w,)], after[n][history]
        if not all_:
            return p(history[1:], w)
        return (c - 0.75 if c >= 2 else 0) / all_ + (1 - mass[n][history] / all_) * p(history[1:], w)

    for k in (0, 1, 1000, 1001, 2000, 2001, 2002):
        t = [None, *texts[k].split(), ""]
        assert np.isclose(got[k]["score"], sum(np.log10(p(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t))), rtol=1e-9)
    assert got[2000]["score"] - got[2000]["base_score"] > 15  # held out


def test_texts_with_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "plain text here", "<|endoftext|>", "", "a<|endoftext|>\r b <|endoftext", " lead  <|endoftext|>"]
    for some in (texts, texts[:1], texts[1:2], texts[3:4]):
        ids, n = token_files.UnitEncoder(path).encode(some)
        want = [tok.encode(t, add_special_tokens=False).ids for t in some]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_each_word_and_sign_is_encoded_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_files.UnitEncoder(path)
    words = ["tion" * (k % 7) + chr(97 + k % 26) + ("é" if k % 3 else "") for k in range(60)]
    texts = [f"{a}.\n{b}, {a}{sign}{b} {a}" for a in words for b in words for sign in ".;"]
    ids, n = enc.encode(texts)
    want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    assert enc.units <= 2 * len(words) + 4  # glued to their neighbours, the words make thousands of pieces


def test_units_end_where_tokens_end():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_files.UnitEncoder(path)
    parts = [*"abstdlmrveSx059.,;:!?'\"_-(  \n\t\r\x0b\x0c\x1c\x1f\x00\x7féÈ×÷ÿſжѿ漢。½²٣🙂αªº«́", *map(chr, [0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B])]
    parts += [*map(chr, [0x2019, 0x2028, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]), " the", "'s", "'re", " a", "\r\n"]
    rng = np.random.default_rng(11)
    for _ in range(40):
        texts = ["".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in rng.integers(0, 12, 200)]
        ids, n = enc.encode(texts)
        got = [w.tolist() for w in np.split(ids, np.cumsum(n))[:-1]]
        assert got == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("first", [40, 60000])
def test_repair_takes_the_most_frequent_pairs(first):
    rng = np.random.default_rng(12)
    ids = np.append(rng.choice(40, 20000, p=np.arange(40) / 780), 2).astype(np.uint32)
    seq, rules = token_files.repair(ids, 2, first, (30, 2500))
    lengths = token_files.rule_lengths(rules, first)
    flat, at = token_files.expansions(rules, lengths, first)
    assert [i for s in seq.tolist() for i in (flat[at[s - first] : at[s - first] + lengths[s - first]].tolist() if s >= first else [s])] == ids.tolist()
    n = collections.Counter((a, b) for a, b in itertools.pairwise(ids.tolist()) if 2 not in (a, b))
    assert sorted(n[tuple(r)] for r in rules[:30].tolist()) == sorted(sorted(n.values())[-30:])


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (6, 0)], "doc_id long, toxic int")
    for docs, n in ((odd_docs, 10), (no_docs, 0)):
        out = toxicity.score_documents(docs, labels).collect()
        assert len(out) == n and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(odd_docs, labels.filter("toxic = 0")).collect())


def test_letters_and_gaps():
    codes, word = toxicity.letters(["I.d1ot!", "", "é", "漢-x"])
    assert codes[word == 0].tolist() == [27, 9, 4, 9, 15, 20, 28]
    assert [int((word == k).sum()) for k in range(4)] == [7, 2, 3, 4]
    rng = np.random.default_rng(2)
    noise = lambda: {"".join(rng.choice(list("aeioubdfg"), 6)) for _ in range(20)}
    machine = toxicity.fit([noise() | {"zyxxwort"} for _ in range(100)], [noise() for _ in range(300)])
    score = lambda t: machine.probability(machine.worst([toxicity.tokens(t)], {}))[0]
    assert min(score("zyxxwort"), score("a z.y.x.x.w.o.r.t b"), score("z y x x w o r t"), score("zyxxwoort")) > 0.5 > score("aeibdf gugab")


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    out = chosen_path.document_classes(odd_docs).collect()
    assert sorted(((r["doc_id"] or 0), r["n_links"]) for r in out) == [(-8, 0), (0, 0), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1)]
    assert {r["class_id"] for r in out if r["doc_id"] in (6, 7)} == {6}
    assert chosen_path.document_classes(no_docs).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(120):  # one large group of near copies, and texts that share half of it
        w = base.copy()
        w[int(rng.integers(0, 200))] = f"n{k}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(base[:100] + [f"u{k}_{i}" for i in range(100)])) for k in range(60)]
    rows += [(300 + k, " ".join([f"p{k // 2}_{i}" for i in range(100)] + [str(k)])) for k in range(40)]
    monkeypatch.setattr(chosen_path, "BUCKET", 16)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.document_classes(docs).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    links = {a: sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    assert {k: n for k, (_, n) in out.items()} == links
    assert len({out[k][0] for k in range(120)}) == 1


def test_pipeline_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs, n in ((odd_docs, 10), (no_docs, 0)):
        out = corpus_pipeline.saved(docs, "odd")
        for _, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.saved(stage(spark, out, sf_dir), "odd")
        assert out.columns[: len(docs.columns)] == docs.columns
        assert (out.count() > 0) == (n > 0)


def test_recall_at_the_threshold_in_a_hot_bucket(spark):
    """Texts that share half their words all meet in the same buckets; pairs at 0.81 among them, and beside a large class, are found."""
    rng = np.random.default_rng(31)
    shared = [f"s{k}" for k in range(50)]

    def changed(words: list[str], times: int) -> list[str]:
        words, free = list(words), np.arange(55, len(words) - 5, 5)
        for at in rng.choice(free, times, replace=False):
            words[at] = f"c{rng.integers(1 << 60)}"
        return words

    def fresh() -> list[str]:
        return shared + [f"u{x}" for x in rng.integers(0, 1 << 60, 50)]

    texts = [fresh() for _ in range(1500)]
    pairs = []
    for _ in range(300):
        texts.append(fresh())
        texts.append(changed(texts[-1], 2))
        pairs.append((len(texts) - 2, len(texts) - 1))
    middle = fresh()
    for _ in range(400):  # a large class, and of some members a partner that few others of the class resemble
        texts.append(changed(middle, 2))
    for k in range(len(texts) - 100, len(texts)):
        texts.append(changed(texts[k], 2))
        pairs.append((k, len(texts) - 1))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "uid long, text string")
    rows = {r["uid"]: (r["root"], r["links"]) for r in chosen_path.near_duplicates(docs).collect()}
    held = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links, lost = collections.Counter(), 0
    owners = collections.defaultdict(set)
    for k, h in enumerate(held):
        for s in h:
            owners[s].add(k)
    common = collections.Counter()
    for s, some in owners.items():
        if len(some) < 1000:  # the shared part adds 46 to every pair
            common.update((a, b) for a in some for b in some if a < b)
    for (a, b), n in common.items():
        if (n + 46) / (len(held[a]) + len(held[b]) - n - 46) >= 0.8:
            links[a] += 1
            links[b] += 1
    for a, b in pairs:
        assert links[a] and links[b]
        lost += rows[a][0] != rows[b][0]
    assert lost <= len(pairs) // 100
    assert all(rows[k][1] <= links[k] for k in range(len(texts)))
    found = sum(n for _, n in rows.values())
    assert found >= 0.99 * sum(links.values())


def test_decontamination_holds_little_beside_the_texts():
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(50_000)])
    item = " ".join(words[:40])
    texts = pa.array([" ".join(rng.choice(words, 300)) + (" " + item if k % 100 == 0 else "") for k in range(4000)])
    hashes = words_of(pa.array([item]), plain=True).hashes
    matcher = decontamination.Matcher(decontamination.Items([7], [hashes]), np.ones(len(np.unique(window_hashes(hashes, decontamination.NGRAM)))))
    tracemalloc.start()
    try:
        found = matcher.matches(texts)[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.tolist() == list(range(0, 4000, 100))
    assert peak < 80e6, peak  # of 8 MB of text
