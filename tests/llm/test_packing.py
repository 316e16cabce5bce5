import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.queries import QUERIES


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def checked(rows, texts, length):
    """Every id of every document lies in one piece, and sequences have no gap."""
    tok, by_doc, by_sequence = tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = tok.encode(texts[doc] or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    filled = []
    for s in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        filled.append(at)
    assert filled[:-1] == [length] * (len(filled) - 1) and filled[-1] <= length
    return by_sequence


def test_pieces_and_proportions(small):
    docs = small("documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack_documents(docs.repartition(5), length=512).collect()
    sequences = checked(rows, texts, 512)
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    whole = sum(total.values())
    for s in list(sequences)[:-1]:
        have = Counter()
        for p in sequences[s]:
            have[p["source"]] += p["length"]
        assert all(abs(have[q] - 512 * total[q] / whole) <= 2 for q in total)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs.filter("doc_id is null or doc_id != 1"), length=64).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] not in (None, 1)}
    assert {r["doc_id"] for r in rows} == {None, *texts}
    checked([r for r in packing.pack_documents(odd_docs.filter("doc_id > 1"), length=64).collect()], texts, 64)
    twice = packing.pack_documents(odd_docs.filter("doc_id = 1")).collect()
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    assert packing.pack_documents(no_docs).count() == 0


def test_special_tokens_in_texts_are_text(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b", "s")], "doc_id long, text string, source string")
    checked(packing.pack_documents(docs).collect(), {1: "a <|endoftext|> b"}, 2048)


def test_given_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 200, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    rows = packing.pack_documents(docs, length=100, mixture={"a": 3, "b": 1}).collect()
    first = Counter()
    for r in rows:
        if r["sequence_id"] < 40:
            first[r["source"]] += r["length"]
    assert first == {"a": 3000, "b": 1000}


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    docs = spark.createDataFrame([(i, f"text number {i}", f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    checked(packing.pack_documents(docs, length=16).collect(), {i: f"text number {i}" for i in range(20)}, 16)


def test_small_sources_have_queues_of_their_own_on_request(spark, monkeypatch):
    """Sources that share a queue by default keep their own proportions with a larger bound."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 1)
    texts = {i: "word " * (3000 if i < 40 else 30) for i in range(60)}
    docs = spark.createDataFrame([(i, t, "large" if i < 40 else "first" if i < 50 else "second") for i, t in texts.items()], "doc_id long, text string, source string").coalesce(1)

    def all_in_proportion(rows):
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += r["length"]
        sequences = checked(rows, texts, 6000)
        windows = [Counter() for _ in range(len(sequences) - 1)]
        for s, have in enumerate(windows):
            for p in sequences[s]:
                have[p["source"]] += p["length"]
        return all(abs(have[q] - 6000 * n / sizes.total()) <= 2 for have in windows for q, n in sizes.items())

    assert all_in_proportion(packing.pack_documents(docs, length=6000, max_queues=10_000).collect())
    assert not all_in_proportion(packing.pack_documents(docs, length=6000).collect())
    with pytest.raises(ValueError):
        packing.pack_documents(docs, max_queues=0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 50), st.data())
def test_round_robin(totals, capacity, data):
    shares = np.array(data.draw(st.lists(st.integers(0, 5), min_size=len(totals), max_size=len(totals))), float)
    totals = np.array(totals)
    rounds = -(-int(totals.sum()) // capacity)
    given_ = packing.deal(capacity, rounds, totals, shares)
    steps = np.diff(given_, axis=0)
    assert (steps >= 0).all() and (given_[-1] == totals).all()
    assert all(s == capacity for s in steps.sum(1)[:-1])
    if rounds and (totals > 0).all() and (shares == totals).all():
        assert np.abs(given_ - np.outer(given_.sum(1), shares / shares.sum())).max() <= len(totals)


def test_layout_covers_queues_exactly():
    rng = np.random.default_rng(2)
    totals = rng.integers(0, 4000, 7)
    layout = packing.Layout(totals, totals.astype(float), 100, max_cells=40)
    seen = set()
    for q, n in enumerate(totals.tolist()):
        at = 0
        while at < n:
            size = min(n - at, int(rng.integers(1, 300)))
            for a, length, sequence, offset in layout.pieces(q, at, size):
                for k in range(length):
                    assert (sequence, offset + k) not in seen
                    seen.add((sequence, offset + k))
            at += size
    assert len(seen) == totals.sum() and max(o for _, o in seen) < 100


def test_queries_give_the_tokenizers_own_ids(spark, tmp_path):
    """Special tokens in texts as the JSON file's tokenizer has them by default."""
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>x", 3: "a  <|endoftext|>  \n b <|endoftext", 4: "plain"}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encode(texts[1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for rows in (QUERIES["op10_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        for r in rows.collect():
            ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
            assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_proportions_beyond_the_queues(spark, monkeypatch):
    """Sources that share queues keep their names; named and large ones their shares."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 6)
    few = [(i, "word " * (2000 if i == 7 else 200), f"s{i}") for i in range(20)]
    docs = [(100 + i, "word " * 200, "ab"[i % 2]) for i in range(40)] + few + [(99, "word " * 2000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    source = {d: s for d, _, s in docs}

    def shares(rows, windows):
        assert all(r["source"] == source[r["doc_id"]] for r in rows) and {r["source"] for r in rows} == set(source.values())
        first = Counter()
        for r in rows:
            if r["sequence_id"] < windows:
                first[r["source"]] += r["length"]
        return first

    rows = packing.pack_documents(df, length=100, mixture={"a": 2, "b": 1, "s7": 1}).collect()
    assert shares(rows, 8) == {"a": 400, "b": 200, "s7": 200}
    rows = packing.pack_documents(df, length=100, mixture={"a": 3, None: 1}).collect()
    assert shares(rows, 8) == {"a": 600, None: 200}
    rows = packing.pack_documents(df, length=610).collect()
    sequences = checked(rows, {d: t for d, t, _ in docs}, 610)
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    for s in range(len(sequences) - 1):
        have = Counter()
        for p in sequences[s]:
            have[p["source"]] += p["length"]
        assert all(abs(have[q] - 610 * total[q] / total.total()) <= 2 for q in "ab")


@pytest.mark.parametrize("special", [True, False])
def test_very_long_white_space_is_encoded(special):
    """Where the ranks' pattern gives up, the ids are those of the tokenizer."""
    for text in ("a" + " " * 1_000_000 + "b", "\n" * 1_000_000):
        ids = packing.encoder("byte_bpe_50k", special)(text)
        tokenizer = packing.load_tokenizer("byte_bpe_50k", special)
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids and tokenizer.decode(ids) == text


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", " ", "\n", "\t ", "é", "1", "<|endoftext|>", "文", "́"]), st.integers(1, 300)), max_size=6))
def test_long_runs_have_the_tokenizers_ids(runs):
    text = "".join(c * n for c, n in runs)
    assert packing.encoder("byte_bpe_50k", True)(text) == packing.load_tokenizer("byte_bpe_50k", True).encode(text, add_special_tokens=False).ids
