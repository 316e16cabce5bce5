import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity


def words(rng, n):
    return " ".join(rng.choice([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], n))


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = words(rng, int(rng.integers(20, 200)))
        docs.append((i, text + (" idiot moron" if toxic else "")))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.toxicity_scores(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    hits = [r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held]
    assert len(held) > 200 and np.mean(hits) > 0.97


def test_scores_follow_the_text_alone(small):
    docs, labels = small("documents"), small("labels")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    for r in docs.limit(50).collect():
        assert model.score(r["text"]) == again.score(r["text"])


def test_held_out_labels_are_not_used(spark, small):
    docs, labels = small("documents"), small("labels")
    flipped = labels.withColumn("toxic", (toxicity.fold_of(labels["doc_id"]) == 1).cast("int") * (1 - labels["toxic"]) + (toxicity.fold_of(labels["doc_id"]) != 1).cast("int") * labels["toxic"])
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.table == b.table and a.bias == b.bias


def test_negative_risk_is_held_at_zero():
    rng = np.random.default_rng(1)
    make = lambda has: (np.array([1, 2] if has else [2]), np.ones(2 if has else 1, np.float32), 10)
    positive = [make(True) for _ in range(40)]
    unlabelled = [make(rng.random() < 0.3) for _ in range(200)]
    model = toxicity.fit(positive, unlabelled, 0.3)
    assert 1 in model.table and np.isfinite(list(model.table[1])).all() and np.isfinite(model.bias)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd_docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.toxicity_scores(odd_docs, labels.limit(0)).count() == 10
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    assert toxicity.without_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns


def plain_fit(positive, unlabelled, prior, rounds, step, l2, least_docs):
    """The estimator by its definition, feature by feature and document by document."""
    docs = [*positive, *unlabelled]
    has = [{int(f): float(c) for f, c in zip(d[0], d[1])} for d in docs]
    n_p, n_u = len(positive), len(unlabelled)
    kept = []
    for f in sorted({f for d in has[:n_p] for f in d}):
        in_p, in_u = sum(f in d for d in has[:n_p]), sum(f in d for d in has[n_p:])
        pooled = (in_p + in_u) / (n_p + n_u)
        z = (in_p / n_p - in_u / n_u) / math.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
        if in_p >= least_docs and z > 3:
            kept.append(f)
    inputs = []
    for d, (_, _, total) in zip(has, docs):
        row = {("w", f): min(d[f], 1.0) for f in kept if f in d}
        row |= {("r", f): min(50 * d[f] / max(total, 1), 3.0) for f in kept if f in d}
        inputs.append(row | {"bias": 1.0, "length": math.log1p(total)})
    theta = dict.fromkeys([*(("w", f) for f in kept), *(("r", f) for f in kept), "bias", "length"], 0.0)
    theta["bias"] = math.log(prior / (1 - prior))
    first, second = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    for t in range(1, rounds + 1):
        scores = [sum(theta[k] * v for k, v in row.items()) for row in inputs]
        sigmoid = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in scores]
        softplus = [math.log1p(math.exp(x)) for x in scores]
        risk = sum(softplus[n_p:]) / n_u - prior * sum(softplus[:n_p]) / n_p  # of the negative class
        gradient = dict.fromkeys(theta, 0.0)
        for i, row in enumerate(inputs):
            of_positive = prior * (sigmoid[i] - 1) / n_p if i < n_p else 0.0
            of_negative = -prior * sigmoid[i] / n_p if i < n_p else sigmoid[i] / n_u
            for k, v in row.items():
                gradient[k] += v * (of_positive + of_negative if risk >= 0 else -of_negative)
        for k in theta:
            g = gradient[k] + (0 if k in ("bias", "length") else l2 * theta[k])
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            theta[k] -= step * (first[k] / (1 - 0.9**t)) / (math.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return theta


def test_fit_and_scores_against_plain_ones():
    rng = np.random.default_rng(3)
    texts = [words(rng, int(rng.integers(3, 60))) + (" idiot moron" * int(rng.integers(1, 3)) if i % 3 == 0 else "") for i in range(120)]
    made = [(*toxicity.document_features(t), len(t.split())) for t in texts]
    positive, unlabelled = made[::6], made[1:]
    for prior in (0.05, 0.3, 0.6):  # the last ones drive the negative risk below zero
        model = toxicity.fit(positive, unlabelled, prior, least_docs=3, rounds=60)
        plain = plain_fit(positive, unlabelled, prior, 60, 0.05, 1e-4, 3)
        assert {f for _, f in plain.keys() - {"bias", "length"}} >= set(model.table) and model.table
        assert abs(model.bias - plain["bias"]) < 1e-3 and abs(model.length_weight - plain["length"]) < 1e-3
        for f, (w, r) in model.table.items():
            assert abs(w - plain["w", f]) < 1e-3 and abs(r - plain["r", f]) < 1e-3
        for text in [*texts[:30], "", None, "no known word"]:
            found = Counter(toxicity._WORD.findall((text or "").lower()))
            total, z = sum(found.values()), plain["bias"]
            z += plain["length"] * math.log1p(total)
            for f in {f for w in found for f in toxicity.features_of(w)}:
                n = sum(found[w] for w in found if f in toxicity.features_of(w))
                z += plain.get(("w", f), 0) + plain.get(("r", f), 0) * min(50 * n / total, 3.0)
            assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-3


def test_an_id_that_repeats_is_one_training_row(spark):
    docs = spark.createDataFrame([(1, "same text")] * 500 + [(2, "b"), (2, "a")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert len(toxicity._training_documents(docs, ids, "doc_id", "text")) == 2


def test_memory_of_workers_and_of_a_fit():
    ids = [f for i in range(0, 60_000, 7) for f in toxicity.features_of(f"word{chr(97 + i % 26)}{'abcdefghij'[i % 10]}")]
    model = toxicity.Model(np.array(ids), np.ones(len(ids)), np.ones(len(ids)), -1.0, 0.1)
    names = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(60_000)]
    first, last = " ".join(names[:100]), " ".join(["worda", "wordaa", *names[-100:]])
    fresh = toxicity.Model(np.array(ids), np.ones(len(ids)), np.ones(len(ids)), -1.0, 0.1).score(last)
    kept = model.score(first)
    model.score(" ".join(names))
    assert model.score(last) == fresh and model.score(first) == kept
    assert len(model.words) < 50_000 and toxicity.features_of.cache_info().currsize < 50_000
    rng = np.random.default_rng(3)
    make = lambda n: (np.unique(rng.integers(0, 2**32, n)), np.ones(n, np.float32), n)
    positive, unlabelled = [make(10) for _ in range(50)], [make(500) for _ in range(2000)]
    tracemalloc.start()
    toxicity.fit(positive, unlabelled, 0.1, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # all features of the unlabelled texts at once would be 8e6


def test_a_fit_collects_only_features_that_it_keeps(spark, small, monkeypatch):
    """The same model as by all features of the training texts on the driver."""
    docs, labels = small("documents"), small("labels")
    given, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: given.append((p, u, prior)) or fit(p, u, prior))
    model = toxicity.train(docs, labels)
    positive, unlabelled, prior = given[0]
    rows = labels.filter((F.col("toxic") == 1) & (toxicity.fold_of(F.col("doc_id")) != toxicity.HELD_OUT)).select(F.col("doc_id").alias("id")).distinct()
    ids = docs.select(F.col("doc_id").alias("id")).filter(toxicity.fold_of(F.col("id")) != toxicity.HELD_OUT).distinct()
    whole = [toxicity._training_documents(docs, x, "doc_id", "text") for x in (rows, ids)]
    assert [len(x) for x in whole] == [len(positive), len(unlabelled)] and model.table
    plain = fit(*whole, prior)
    assert set(plain.table) == set(model.table)
    for f, weights in plain.table.items():
        assert np.allclose(weights, model.table[f], atol=1e-9)
    assert sum(len(d[0]) for d in [*positive, *unlabelled]) < sum(len(d[0]) for x in whole for d in x) / 10
