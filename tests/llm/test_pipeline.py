"""Each stage's rows against brute force on the rows that it was given, which
calls nothing of the operators."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.queries import QUERIES
from tests.llm import test_copies, test_decontamination, test_lines

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, small):
    """(columns, rows by id before, after) of each stage but the last, and the last one's rows."""
    docs, out = small("documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.stored(stage(spark, docs, DATA), "test")
        out[name] = docs.columns, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in made.collect()}
        assert made.columns == docs.columns and made.count() == len(out[name][2])
        docs = made
    out["packing"] = docs.collect(), corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    return out


def same_rows(before, after, changed=()):
    return all(before[d][c] == r[c] for d, r in after.items() for c in r.asDict() if c not in changed)


def test_toxic_documents_go_and_others_stay(spark):
    """By the labels, held-out ones included, which no fit has seen."""
    data = "/root/testdata/sf0.1"  # a fit needs some hundred positives
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_filter(spark, docs, data).select("doc_id").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.filter("toxic is not null").collect()}
    for fold in ({d for d in toxic if zlib.crc32(str(d).encode()) % 3 == 1}, set(toxic)):
        bad = [d not in kept for d in fold if toxic[d] == 1]
        good = [d in kept for d in fold if toxic[d] == 0]
        assert len(bad) > 50 and np.mean(bad) >= 0.9 and np.mean(good) >= 0.98, (np.mean(bad), np.mean(good))


def test_toxicity_keeps_rows_as_they_are(steps):
    _, before, after = steps["toxicity"]
    assert set(after) <= set(before) and same_rows(before, after) and len(after) > 0.8 * len(before)


def test_line_dedup(steps):
    """A line stays where it first occurs, unless an earlier line is within the edits."""
    columns, before, after = steps["line dedup"]
    first = {}
    for d in sorted(before):
        for no, line in enumerate((before[d]["text"] or "").split("\n")):
            if line.strip():
                first.setdefault(line, (d, no))
    by_length = defaultdict(list)
    for line in first:
        by_length[len(line)].append(line)

    def earlier(line):
        for n in range(len(line) - 2, len(line) + 3):
            for other in by_length[n]:
                edits = 1 if min(n, len(line)) < 40 else 2
                if first[other] < first[line] and min(n, len(line)) >= 2 and abs(n - len(line)) <= edits and test_lines.distance(line, other, edits) <= edits:
                    return True
        return False

    gone = {line for line in first if earlier(line)}
    for d, row in before.items():
        lines = (row["text"] or "").split("\n")
        left = [x for no, x in enumerate(lines) if not x.strip() or (first[x] == (d, no) and x not in gone)]
        assert after[d]["text"] == (None if row["text"] is None else "\n".join(left)) and after[d]["n_chars"] == len(after[d]["text"] or "")
    assert set(after) == set(before) and same_rows(before, after, ("text", "n_chars")) and len(columns) == 5


def test_near_dedup(steps):
    _, before, after = steps["near dedup"]
    assert {(d, r["text"] or "") for d, r in after.items()} == test_copies.brute([(d, r["text"]) for d, r in before.items()])
    assert same_rows(before, after) and len(after) < len(before)


def test_benchmark_filter(steps, small):
    _, before, after = steps["benchmark filter"]
    items = {r["item_id"]: r["text"] for r in small("benchmark").collect()}
    found = test_decontamination.brute({d: r["text"] for d, r in before.items()}, items, 0.8)
    assert set(before) - set(after) == {d for d, _ in found} and found and same_rows(before, after)


def test_packing(steps):
    docs, pieces = steps["packing"]
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(int)
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        at[p["doc_id"]] += p["length"]
    assert at == {d: len(own) for d, own in ids.items()}
    filled = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled[p["sequence_id"]]
        filled[p["sequence_id"]] += p["length"]
    assert list(filled) == list(range(len(filled))) and [*filled.values()][:-1] == [2048] * (len(filled) - 1)


def test_run_and_registration(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "benchmark filter", "packing"]
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    whole = lambda rows: {d: sum(n for e, _, n, _ in key(rows) if e == d) for d in {r["doc_id"] for r in rows}}
    assert whole(corpus_pipeline.run(spark, DATA).collect()) == whole(steps["packing"][1])
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
