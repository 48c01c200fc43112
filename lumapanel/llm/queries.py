"""The operators of this subpackage as registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, chosen_path, collocations, decontamination, mixing, quality, sharding, substrings, token_files, toxicity, vantage, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# CRC-32 of a text in SQL: a text's bytes, folded with the table of the polynomial 0xEDB88320.
CRC_CTES = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"""


@query(
    "op1_jump_sharding",
    """WITH RECURSIVE k AS (SELECT row_number() OVER () AS rid, doc_id, text, CAST(coalesce(doc_id, 0) AS HUGEINT) AS key0,
        octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
    walk AS (
      SELECT rid, CAST(CASE WHEN key0 < 0 THEN key0 + 18446744073709551616 ELSE key0 END AS HUGEINT) AS key,
        CAST(0 AS BIGINT) AS nxt, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS grown FROM k
      UNION ALL
      SELECT rid, k2, CAST(floor((nxt + 1) * (CAST(2147483648 AS DOUBLE) / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT),
        CASE WHEN nxt < 24 THEN nxt ELSE shard END, nxt
      FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE nxt < 25)),
    ended AS (SELECT rid, max(shard) AS shard, max(grown) AS grown FROM walk GROUP BY rid),
    """ + CRC_CTES + """,
    crc AS (SELECT rid, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(1, length(h) // 2 + 1), lambda i: CAST(('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))),
        lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1]))) AS c
      FROM (SELECT rid, hex(encode(coalesce(text, ''))) AS h FROM k) CROSS JOIN crc_table)
    SELECT doc_id, size, CAST(c AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, c, size) - 1 AS slot, CAST(grown AS INT) AS grown_shard
    FROM k JOIN ended USING (rid) JOIN crc USING (rid)""",
)
def op1_jump_sharding(spark, sf_dir):
    """All documents in 24 shards by doc_id (law: key)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 8).cast("long").alias("size")
    )
    return sharding.shard_rows(rows, "doc_id", ["text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query("op9_entropy_mixing")
def op9_entropy_mixing(spark, sf_dir):
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1 in turn."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(rows)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


# Base32 of a SHA-1 in hex: five hex digits are four letters.
BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha1(payload), CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '')"""


@query(
    "op2_zip_warc",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    g AS (SELECT payload AS same, max(page_id) AS kept, count(*) AS n FROM p GROUP BY payload)
    SELECT page_id, octet_length(encode(payload)) AS payload_bytes, {BASE32} AS payload_digest,
      CASE WHEN page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
    FROM p JOIN g ON payload = same""",
)
def op2_zip_warc(spark, sf_dir):
    """All pages written as WARC records in ZIP archives and read back by byte ranges."""
    back = warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_repair_tokens")
def op6_repair_tokens(spark, sf_dir):
    """All documents as ids in grammar-compressed files, read back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_token_files(
        table(spark, sf_dir, "documents"), path, end_id=2, vocabulary=token_files.vocabulary_size(path)
    )
    return token_files.read_token_files(files)


@query("op8_kernel_toxicity")
def op8_kernel_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_rare_seed_alignment")
def op3_rare_seed_alignment(spark, sf_dir):
    """Documents that hold a benchmark item, whole or edited, with the alignment's score."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_chosen_path_join")
def op10_chosen_path_join(spark, sf_dir):
    """The near-duplicate class of every document, and its number of links."""
    return chosen_path.document_classes(table(spark, sf_dir, "documents"))


@query(
    "op4_difference_cover",
    r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
    again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
    covered AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN again USING (s)),
    word AS (SELECT rid, p, w[p] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
    kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN covered USING (rid, p) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)""",
)
def op4_difference_cover(spark, sf_dir):
    """All documents without passages of 35 words that start anywhere else."""
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op7_backoff_automaton")
def op7_backoff_automaton(spark, sf_dir):
    """Log-probability of every document under an n-gram automaton."""
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


@query(
    "op5_vantage_trees",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score
        FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 20 = 0)) WHERE rank <= 20""",
)
def op5_vantage_trees(spark, sf_dir):
    """The 20 nearest rows of every twentieth embedding, exactly."""
    return vantage.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


@query(
    "op12_sorted_list_variants",
    r"""WITH RECURSIVE """ + CRC_CTES + r""",
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    crc AS (SELECT run, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(1, length(x) // 2 + 1), lambda i: CAST(('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))),
        lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1]))) AS h
      FROM (SELECT run, hex(encode(id || ':' || run)) AS x FROM runs) CROSS JOIN crc_table),
    v AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
        || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM crc) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
    shorter AS (SELECT DISTINCT g.word AS a, v.word AS b FROM gaps g JOIN v ON g.d = v.word),
    near AS (SELECT a.word AS x, b.word AS y FROM gaps a JOIN gaps b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
    best AS (SELECT x, count(*) AS n_near, first(y ORDER BY v.n DESC, encode(y)) AS y, max(v.n) AS top FROM near JOIN v ON v.word = y GROUP BY x),
    formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN y END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
      FROM v LEFT JOIN best ON x = word),
    walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL),
    ended AS (SELECT w.word, w.root FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)""",
)
def op12_sorted_list_variants(spark, sf_dir):
    """The near words of every word of all documents, and the form it is a variant of."""
    runs = variants.letter_runs(table(spark, sf_dir, "documents"), least=7)
    mark = F.crc32(F.encode(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"), "UTF-8"))
    spot = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), spot), F.substr("run", spot + 2))
    words = runs.withColumn("h", mark).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return variants.group_variants(variants.count_words(words, min_length=7, min_count=2), min_length=7)


@query(
    "op13_quotient_filter_collocations",
    r"""WITH pieces AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    words AS (SELECT pid, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
    led AS (SELECT lang, x, lead(x, 1) OVER line AS y, lead(x, 2) OVER line AS z FROM words WINDOW line AS (PARTITION BY pid ORDER BY i)),
    grams AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, 1 AS k, x AS phrase FROM led
        UNION ALL SELECT lang, 2, x || ' ' || y FROM led WHERE y IS NOT NULL
        UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM led WHERE z IS NOT NULL) GROUP BY ALL HAVING count(*) >= 10),
    parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM grams WHERE k > 1),
    halves AS (SELECT *, array_to_string(ws[1 : c], ' ') AS p1, array_to_string(ws[c + 1 :], ' ') AS p2 FROM parts, LATERAL (SELECT unnest(range(1, k)) AS c)),
    cut AS (SELECT h.lang, h.k, h.phrase, h.a, c, f.a AS l, r.a AS r, (CAST(1000000 AS HUGEINT) * h.a * h.a) // (CAST(f.a AS HUGEINT) * r.a) AS score
      FROM halves h JOIN grams f ON f.lang = h.lang AND f.phrase = p1 JOIN grams r ON r.lang = h.lang AND r.phrase = p2),
    scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    longer AS (SELECT lang, array_to_string(ws[s : s + 1], ' ') AS phrase, max(a) AS top FROM parts, (VALUES (1), (2)) ss(s) WHERE k = 3 GROUP BY ALL),
    kept AS (SELECT s.* FROM scored s LEFT JOIN longer g ON s.k = 2 AND g.lang = s.lang AND g.phrase = s.phrase WHERE top IS NULL OR 100 * top < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
)
def op13_quotient_filter_collocations(spark, sf_dir):
    """The 2000 best phrases of two and three words of each language in all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"), least=10, most=2000, share=50)


@query("op11_histogram_boosted_quality")
def op11_histogram_boosted_quality(spark, sf_dir):
    """Quality of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
