import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n ", "en", "b", 4),
        (None, "words of a row without an id", None, "b", 5),
        (5, "one", "en", None, 3),
        (6, long, "en", "c", len(long)),
        (7, long + " tail", "en", "c", len(long)),
        (-8, "ünïcode ß 漢字   x", "de", "c", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("shard", "slot", "uid", "_row", "size", "root", "score", "chunk", "held"):
        df = df.selectExpr("*", f"7 AS `{name}`")
    return df.coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
