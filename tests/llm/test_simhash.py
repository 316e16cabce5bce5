import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import components, simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aBc é\t\n\x0b\x1c\xa0x"), max_size=80))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_documents_against_brute_force(small):
    texts = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    got = simhash.near_duplicates(small("documents")).orderBy("doc_id").collect()
    fps = np.array([plain_fingerprint(texts[r["doc_id"]]) for r in got], np.uint64)
    assert [r["fingerprint"] for r in got] == [f"{int(f):016x}" for f in fps]
    assert [r["component_id"] for r in got] == [got[i]["doc_id"] for i in plain_components(fps, 4)]


@pytest.mark.parametrize("leaf_size", [8, 64, 4096])
def test_trees_find_every_link(spark, leaf_size):
    rng = np.random.default_rng(leaf_size)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for c in rng.choice(centres, 500)]
    fps = np.unique(np.array(fps + rng.integers(0, 2**63, 200, dtype=np.uint64).tolist(), np.uint64))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = simhash.near_links(df, 4, leaf_size=leaf_size)
    root = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    got = [root.get(int(f), int(f)) for f in fps.view(np.int64)]
    expected = plain_components(fps, 4)
    pairs = dict(zip(expected, got))
    assert len(set(zip(expected, got))) == len(set(expected)) == len(set(got)) == len(pairs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 10 and simhash.near_duplicates(no_docs).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["fingerprint"] == "0" * 16 and {by_id[i]["component_id"] for i in (3, 4, 5)} == {3}
    kept = simhash.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 3, 6, 7} and not kept.filter("doc_id in (4, 5)").count()
