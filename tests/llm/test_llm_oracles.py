"""The registered corpus queries: SQL oracles, and brute force where SQL can't express them."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from oracle import connect, differences

import corpus_pipeline
from lumapanel.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def test_op3_finds_every_shared_run_and_nothing_else(spark, sf_dir, texts):
    plain = re.compile(r"[^\s!-/:-@\[-`{-~]+")
    items = {r["item_id"]: plain.findall(r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    runs = collections.defaultdict(set)
    for k, words in items.items():
        runs[" ".join(words)].add(k)
    want = {(d, k) for d, t in texts.items() for s, ks in runs.items() if s in " ".join(plain.findall(t.lower())) for k in ks}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_rare_seed_alignment"](spark, sf_dir).collect()}
    assert want <= got and len(got) <= 1.2 * len(want) + 1


def test_op6_is_an_exact_round_trip(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = {r["doc_id"]: r for r in QUERIES["op6_repair_tokens"](spark, sf_dir).collect()}
    for k in sorted(texts):
        ids = np.array(tok.encode(texts[k], add_special_tokens=False).ids + [2], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7_base_score_and_held_out_gain(spark, sf_dir, texts):
    tokens = {k: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op7_backoff_automaton"](spark, sf_dir).collect()
    for r in rows:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert sum(r["score"] - r["base_score"] for r in rows if r["held_out"]) > 0


def test_op8_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_kernel_toxicity"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.025


def test_op9_meets_targets(spark, sf_dir):
    rows = QUERIES["op9_entropy_mixing"](spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], r["target"]].append(r)
    for (_, target), part in by.items():
        assert abs(sum(r["taken"] for r in part) - target) <= max(0.05 * target, 60)
    assert math.isclose(sum(t * 1.0 for _, t in by), 1.5 * sum(r["size"] for r in rows), rel_tol=0.3)
    again = QUERIES["op9_entropy_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_op10_equals_all_pairs(spark, sf_dir, texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links, root = collections.Counter(), {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= 0.8:
            links.update([a, b])
            x, y = root[a], root[b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op10_chosen_path_join"](spark, sf_dir).collect()}
    assert got == {k: (root[k], links[k]) for k in sets}


def test_pipeline_stages_keep_columns_and_act(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns
        assert name == "sharding" or docs.columns == columns
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5]
