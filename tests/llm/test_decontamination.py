import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import decontamination as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, threshold):
    out = {}
    for doc, text in docs.items():
        have = words(text)
        for item, item_text in items.items():
            want = words(item_text)
            width = min(5, len(want))
            size = min(len(want), len(have))
            if not want or size < width:
                continue
            b = Counter(tuple(want[i : i + width]) for i in range(len(want) - width + 1))
            best = 0
            for start in range(len(have) - size + 1):
                w = have[start : start + size]
                a = Counter(tuple(w[i : i + width]) for i in range(size - width + 1))
                shared = sum((a & b).values())
                best = max(best, shared / (a.total() + b.total() - shared))
            if best >= threshold - 1e-12:
                out[doc, item] = round(best, 6)
    return out


def fixture():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(make(rng.randint(12, 60))) for i in range(20)}
    items |= {20: "only three words", 21: "one", 22: "", 23: None, 24: " ".join((make(10)) * 4)}
    docs = {}
    for d in range(120):
        text = make(rng.randint(0, 150))
        item = (words(items[rng.randrange(20)]) if d % 9 else words(items[24])) or []
        copy = list(item)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(copy))
            if rng.random() < 0.5:
                copy[at] = "changed"
            else:
                copy.insert(at, "added")
        if d % 4 == 1:
            copy = copy[len(copy) // 2 :] + copy[: len(copy) // 2]
        at = rng.randint(0, len(text))
        docs[d] = " ".join(text[:at] + copy + text[at:]).replace(" v7 ", ". V7, ") if d % 3 else " ".join(text)
    docs |= {200: "Only, three -- WORDS", 201: "one", 202: "", 203: None}
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.contaminated(df, benchmark).collect()}
    expected = brute(docs, items, 0.8)
    assert got.items() <= expected.items() and len(expected) > 20
    assert len(got) >= 0.98 * len(expected)
    assert all(k in got for k, v in expected.items() if v >= 0.9)


def test_recall_at_the_threshold(spark):
    """Passages with edits that leave a similarity just above 0.8."""
    rng = random.Random(9)
    items = {i: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(45, 90))) for i in range(60)}
    docs = {}
    for d in range(600):
        copy = words(items[d % 60])
        for at in rng.sample(range(6, len(copy) - 6), 1):
            copy[at] = "changed"
        if len(copy) > 70:
            copy[3] = "again"
        docs[d] = " ".join([f"x{rng.randrange(5000)}" for _ in range(rng.randint(0, 30))] + copy + ["tail"] * rng.randint(0, 3))
    expected = {k: v for k, v in brute(docs, items, 0.8).items() if v < 0.88}
    frames = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.contaminated(*frames).collect()}
    found = sum(got.get(k) == v for k, v in expected.items())
    assert len(expected) > 200 and found >= 0.95 * len(expected), (found, len(expected))


def test_blocks_find_items_that_no_shingle_names(spark):
    """The index is searched among all items of a window's size, by fingerprint alone."""
    items = spark.createDataFrame([(1, 11, 5, 20, 0b0111), (2, 12, 5, 20, -1), (3, 13, 5, 21, 0)], "item_id long, item long, width int, k int, item_fp long")
    items = items.withColumn("item_shingles", F.array(F.lit(1).cast("long")))
    windows = spark.createDataFrame([(7, 70, 5, 20, 4, True, [1], 0)], "doc_id long, text_hash long, width int, k int, start int, last boolean, shingles array<long>, fp long")
    assert [(r["item_id"], r["distance"]) for r in D.hamming_candidates(windows, items).collect()] == [(1, 3)]


def test_tables_against_brute_force(small):
    docs = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    items = {r["item_id"]: r["text"] for r in small("benchmark").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(small("documents"), small("benchmark")).collect()}
    joined = {d: " ".join(words(t)) for d, t in docs.items()}
    exact = {(d, i) for d in docs for i, t in items.items() if f" {' '.join(words(t))} " in f" {joined[d]} "}
    assert exact and exact <= found


def test_simhash_and_similarity(spark):
    rng = random.Random(1)
    rows = [([rng.getrandbits(64) - 2**63 for _ in range(n)],) for n in (1, 2, 3, 40, 41)]
    df = spark.createDataFrame(rows, "h array<long>").select("h", D.simhash_of(F.col("h")).alias("fp"))
    for r in df.collect():
        expected = sum(1 << b for b in range(64) if 2 * sum((h % 2**64) >> b & 1 for h in r["h"]) > len(r["h"]))
        assert r["fp"] % 2**64 == expected
    pairs = spark.createDataFrame([([1, 1, 2, 3], [1, 2, 2]), ([1, 2], [3]), ([5], [5])], "a array<long>, b array<long>")
    assert [round(r[0], 6) for r in pairs.coalesce(1).select(D.weighted_similarity(F.col("a"), F.col("b"))).collect()] == [0.4, 0.0, 1.0]


def test_blocks_find_all_within_the_radius():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, D.RADIUS)):
            b ^= 1 << bit
        blocks = [((a ^ b) >> lo & (1 << hi - lo) - 1).bit_count() for lo, hi in zip(D._CUTS, D._CUTS[1:])]
        assert sum(blocks) == (a ^ b).bit_count() and min(blocks) <= D.RADIUS // D.BLOCKS


def test_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the old stone bridge", "x"), (None, "", "y")], "item_id long, text string, words string")
    got = D.contaminated(odd_docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1)]
    kept = D.without_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert D.contaminated(no_docs, benchmark).count() == 0 and D.contaminated(odd_docs, benchmark.limit(0)).count() == 0
    assert D.without_contaminated(odd_docs, benchmark.limit(0)).count() == 10


def test_items_without_an_id(spark):
    """Items with a null id or one that repeats contaminate like any other."""
    texts = {k: " ".join(f"{k}{i}" for i in range(n)) for k, n in (("a", 20), ("b", 30), ("c", 25))}
    items = [(None, texts["a"]), (None, texts["b"]), (1, texts["c"]), (1, texts["a"])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts.values())] + [(9, "clean")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["n_words"], r["similarity"]) for r in D.contaminated(docs, benchmark).collect())
    assert got == [(0, 0, 20, 1.0), (0, 1, 20, 1.0), (1, 0, 30, 1.0), (2, 1, 25, 1.0)]
    assert [r["doc_id"] for r in D.without_contaminated(docs, benchmark).collect()] == [9]


def test_items_of_very_many_equal_words(spark):
    """More shingles than 16 bits count; an ordinary text of that length too."""
    hashes = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: F.lit(-1).cast("long")).alias("h"))
    assert hashes.select(D.simhash_of(F.col("h"))).first()[0] == -1
    item = "again " * 40_000
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "a clean text of some few words")], "doc_id long, text string")
    left = D.without_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["doc_id"] for r in left.collect()] == [2]
