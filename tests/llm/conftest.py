import pytest

LONG = "word " * 40_000 + "x" * 50_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows and
    extra columns whose names operators might use themselves."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the old stone bridge\nshort\n\nshort", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog near the old stone bridge\nshort\n\nshort", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog near the old stone bridge!\nshort", "en", None),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t ", "en", "b"),
        (6, LONG, "en", "a"),
        (None, "a text without an id", "en", "a"),
        (None, None, None, "b"),
        (7, "é😀 ünïcode\x00 text with a secret: hunter2hunter2", "de", "c"),
    ]
    extra = "shard int, slot string, fp int, line string, key int, part string, queue int, n int, at int, start string, score string, text_hash int, words string, id string, h1 int, path string, blob int, _id string, _hash int, _gone int, sig int, component_id string, label string"
    names = [c.split()[0] for c in extra.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
