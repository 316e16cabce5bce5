import numpy as np
import pytest

from ledgerloom.llm import negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain_negatives(rows):
    known = []
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        known.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in vec], (label + 1) % 10 if i % 7 == 0 else label))
    out = set()
    for a, av, al in known:
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in known if i != a)
        for p, pid in [(-s, i) for s, i, label in scores if label == al][:5]:
            fit = [(-s, i) for s, i, label in scores if label != al and 50 * p <= -100 * s <= 95 * p][:3]
            out |= {(a, pid, rank, i, p, s) for rank, (s, i) in enumerate(fit, 1)}
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, None, None) for i, v, label in rows], "vec_id long, embedding array<float>, label int, anchor string, score string")


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_against_brute_force(spark, spread, monkeypatch):
    """Vectors of very different lengths around a few centres, in many small
    buckets, so that lengths and coordinates both prune."""
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(negatives.length_buckets, "__defaults__", (40,))
    rng = np.random.default_rng(int(spread * 10))
    centres = rng.normal(size=(6, 8))
    rows = [(i, (rng.lognormal(0, 0.7) * (centres[i % 6] + spread * rng.normal(size=8))).tolist(), int(rng.integers(0, 3)) if i % 6 else None) for i in range(700)]
    rows = [(i, v, 1 if label is None and i % 5 else label) for i, v, label in rows]
    assert got(negatives.hard_negatives(frame(spark, rows))) == plain_negatives(rows)


def test_coordinate_ranges_keep_all_that_reach():
    """Candidates are a superset at every threshold, and a small one at high ones."""
    rng = np.random.default_rng(0)
    rows = {"vec_id": np.arange(500), "label": np.zeros(500, np.int64)}
    vectors = rng.normal(size=(500, 6))
    vectors[:50] = vectors[0] + 0.05 * rng.normal(size=(50, 6))
    vectors = np.rint(500 * vectors / np.sqrt((vectors**2).sum(1))[:, None]).astype(np.int64)
    import pandas as pd

    pdf = pd.DataFrame({**rows, "q": list(vectors), "norm2": (vectors.astype(float) ** 2).sum(1)})
    lengths = np.sqrt(pdf["norm2"])
    unit = vectors / lengths.to_numpy()[:, None]
    lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
    bucket = negatives._Bucket(pd.Series({"longest": lengths.max(), **negatives._packed(pdf, vectors), "lists": lists.tobytes()}))
    pruned = 0
    for anchor in vectors[:100].astype(float):
        scores = vectors @ anchor
        for threshold in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            found = bucket.candidates(anchor, float(threshold))
            if found is not None:
                assert set(np.flatnonzero(scores >= threshold)) <= set(found.tolist())
                pruned += len(found) < 100
    assert pruned >= 50


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (2, [0.9, 0.5], 1), (3, [0.4, float("nan")], 2), (4, [0.4, None], 2), (5, None, 2),
        (6, [0.45, 0.1], 2), (8, [0.45, 0.1], 2), (9, [0.45, 0.1], None), (None, [0.45, 0.1], 2), (10, [], 2), (11, [0.0, 0.0], 3), (50, [0.0, 0.0], 3), (12, [float("inf"), 0.0], 2), (13, [0.4], 4),
    ]
    assert got(negatives.hard_negatives(frame(spark, rows))) == plain_negatives(rows)
    for few in (rows[:0], rows[2:3]):
        none = negatives.hard_negatives(frame(spark, few))
        assert none.count() == 0 and none.columns == COLUMNS


def test_sums_beyond_doubles():
    import pandas as pd

    for size, fails in ((1 << 29, False), (1 << 33, True)):
        vectors = np.array([[size + 1, 3]], np.int64)
        pdf = pd.DataFrame({"vec_id": [1], "label": [1]})
        bucket = negatives._Bucket(pd.Series({"longest": float(size), **negatives._packed(pdf, vectors), "lists": np.zeros((2, 1), np.int32).tobytes()}))
        if fails:
            with pytest.raises(ValueError):
                bucket.scores(vectors[0].astype(float), vectors[0], None)
        else:
            assert bucket.scores(vectors[0].astype(float), vectors[0], None)[0] == (size + 1) ** 2 + 9
