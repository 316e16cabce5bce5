"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts without regard to any label (U) train a
logistic scorer on hashed words and word beginnings. The risk of the negative
class is estimated from U less the share that the class prior gives to P, and
held at zero or above (Kiryo et al., 2017).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import scratch, stored, text_or_empty

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT = 3, 1


#: Words whose features a worker keeps; idle workers keep them beside later stages.
CACHED_WORDS = 30_000
#: What a feature needs to be fitted: positives that have it, and their excess over the unlabelled texts.
LEAST_DOCS, LEAST_Z = 4, 3.0


@lru_cache(maxsize=CACHED_WORDS)
def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, 32 bits each."""
    raw = [f"w:{word}", *(f"p:{word[:k]}" for k in _PREFIXES if len(word) > k)]
    return tuple(zlib.crc32(x.encode()) for x in raw)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted feature hashes, counts) of a whole text."""
    seen: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in features_of(word):
            seen[f] += n
    ids = np.fromiter(seen.keys(), np.int64, len(seen))
    counts = np.fromiter(seen.values(), np.float32, len(seen))
    order = np.argsort(ids)
    return ids[order], counts[order]


class Model:
    """Weights for the kept features; a score is a sigmoid of their sum."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, rate_weights: np.ndarray, bias: float, length_weight: float):
        self.bias, self.length_weight = bias, length_weight
        self.table = {int(i): (float(w), float(r)) for i, w, r in zip(ids, weights, rate_weights) if w or r}
        self.words: dict[str, tuple[int, ...]] = {}

    def _kept(self, word: str) -> tuple[int, ...]:
        kept = self.words.get(word)
        if kept is None:
            kept = tuple([f for f in features_of.__wrapped__(word) if f in self.table])
            if len(self.words) < CACHED_WORDS:  # frequent words come early
                self.words[word] = kept
        return kept

    def score(self, text: str | None) -> float:
        words = Counter(_WORD.findall((text or "").lower()))
        total = sum(words.values())
        seen: dict[int, int] = {}
        for word, n in words.items():
            for f in self._kept(word):
                seen[f] = seen.get(f, 0) + n
        z = self.bias + self.length_weight * math.log1p(total)
        for f in sorted(seen):
            w, r = self.table[f]
            z += w + r * min(50.0 * seen[f] / total, 3.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def presence(count):
    return np.minimum(count, 1.0)


def rate(count, total):
    """Share of the words, in a range like that of presence."""
    return np.minimum(50.0 * count / np.maximum(total, 1.0), 3.0)


def excess(positives, unlabelled, n: int, m: int, sqrt):
    """Two-sample z of a feature's shares of n positives and of m unlabelled texts, by its counts."""
    pooled = (positives + unlabelled) / (n + m)
    return (positives / n - unlabelled / m) / sqrt(pooled * (1 - pooled) * (1 / n + 1 / m) + 1e-12)


def fit(positive: list[tuple], unlabelled: list[tuple], prior: float, least_docs: int = LEAST_DOCS, rounds: int = 600, step: float = 0.05, l2: float = 1e-4) -> Model:
    """Fit on documents given as (feature hashes, counts, number of words).

    Features that fewer than least_docs positives have are left out: they can't
    raise a score reliably. Full-batch gradients with Adam's step sizes.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), float(np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6)))), 0.0)
    ids, df = np.unique(np.concatenate([p[0] for p in positive]), return_counts=True)
    in_u = np.zeros(len(ids))
    for found, *_ in unlabelled if len(ids) else ():  # a document has a feature once
        at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
        in_u[at[ids[at] == found]] += 1
    # kept: clearly more frequent in P than in U
    kept = ids[(df >= least_docs) & (excess(df, in_u, len(positive), len(unlabelled), np.sqrt) > LEAST_Z)]
    k = len(kept)
    docs = [*positive, *unlabelled]
    rows, cols, vals, rates = [], [], [], []
    totals = np.array([d[2] for d in docs], float)
    for i, (f, c, total) in enumerate(docs):
        at = np.searchsorted(kept, f)
        ok = (at < k) & (kept[np.minimum(at, max(k - 1, 0))] == f) if k else np.zeros(len(f), bool)
        rows.append(np.full(ok.sum(), i)), cols.append(at[ok]), vals.append(presence(c[ok])), rates.append(rate(c[ok], total))
    rows, cols, vals, rates = (np.concatenate(x) for x in (rows, cols, vals, rates))
    rows, cols = rows.astype(np.int64), cols.astype(np.int64)
    length = np.log1p(totals)
    np_, nu = len(positive), len(unlabelled)
    theta, m1, m2 = np.zeros(2 * k + 2), np.zeros(2 * k + 2), np.zeros(2 * k + 2)
    theta[2 * k] = np.log(prior / (1 - prior))

    def gradient(err: np.ndarray) -> np.ndarray:
        """Of sum(err * f) by theta."""
        g = np.empty_like(theta)
        g[:k] = np.bincount(cols, vals * err[rows], k)
        g[k : 2 * k] = np.bincount(cols, rates * err[rows], k)
        g[2 * k], g[2 * k + 1] = err.sum(), (err * length).sum()
        return g

    for t in range(1, rounds + 1):
        f = theta[2 * k] + theta[2 * k + 1] * length + np.bincount(rows, vals * theta[cols] + rates * theta[k + cols], len(docs))
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        softplus = np.logaddexp(0, f)
        negative_risk = softplus[np_:].mean() - prior * softplus[:np_].mean()
        toward_p = np.concatenate([prior * (s[:np_] - 1) / np_, np.zeros(nu)])
        toward_n = np.concatenate([-prior * s[:np_] / np_, s[np_:] / nu])
        g = gradient(toward_p + toward_n if negative_risk >= 0 else -toward_n) + l2 * np.append(theta[: 2 * k], [0, 0])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Model(kept, theta[:k], theta[k : 2 * k], float(theta[2 * k]), float(theta[2 * k + 1]))


@dataclass(frozen=True)
class Sample:
    """How many training rows a fit may take, least by hash of the id first."""

    positives: int = 3000
    unlabelled: int = 6000


def _training_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(f, c, n): features, counts and number of words of the documents whose ids
    are in a table of bounded size; of rows that share an id, of the one with the
    least text hash. Hashes are signed here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                text = text.as_py()
                f, c = document_features(text)
                out.append((f.astype(np.uint32).view(np.int32), c.astype(np.float32), len(_WORD.findall(text.lower()))))
            f, c, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.float32())), pa.array(n, pa.int64())], names=["f", "c", "n"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text")
    return texts.mapInArrow(run, "f array<int>, c array<float>, n long")


def _features_to_fit(positive: DataFrame, unlabelled: DataFrame, n: int, m: int) -> np.ndarray:
    """All features that fit() keeps, ascending, and perhaps some at the very
    bound; they are counted by Spark, as all features of the training texts are
    too much for the driver."""
    each = [side.select(F.explode("f").alias("f"), F.lit(p).alias("p")) for side, p in ((positive, 1), (unlabelled, 0))]
    counts = each[0].unionByName(each[1]).groupBy("f").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("u"))
    found = counts.filter((F.col("p") >= LEAST_DOCS) & (excess(F.col("p"), F.col("u"), n, m, F.sqrt) > LEAST_Z - 1e-6)).select("f").collect()
    return np.sort(np.array([r["f"] for r in found], np.int32).view(np.uint32))


def _collected(features: DataFrame, wanted: np.ndarray | None = None) -> list[tuple]:
    """The documents on the driver, with the wanted features alone, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, c in zip(batch.column("f"), batch.column("c")):
                f, c = f.values.to_numpy().view(np.uint32), c.values.to_numpy()
                if wanted is not None:
                    own = np.isin(f, wanted)
                    f, c = f[own], c[own]
                out.append((f.astype("<u4").tobytes(), c.astype("<f4").tobytes()))
            f, c = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(c, pa.binary()), batch.column("n")], names=["f", "c", "n"])

    rows = features.select("f", "c", "n").mapInArrow(run, "f binary, c binary, n long").collect()
    rows.sort(key=lambda r: (r["n"], r["f"], r["c"]))  # the order of rows must not change a fit
    return [(np.frombuffer(r["f"], "<u4"), np.frombuffer(r["c"], "<f4"), r["n"]) for r in rows]


def _training_documents(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[tuple]:
    """The documents with all their features."""
    return _collected(_training_features(docs, ids, id_col, text_col))


def fold_of(id_column: Column) -> Column:
    """CRC-32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: Sample = Sample()) -> Model:
    """Fit on the rows outside the held-out fold.

    The positives are labelled 1 (by any of a document's labels), the
    unlabelled texts are drawn without regard to labels, and the prior is the
    share of 1 among all labelled training rows. Without a positive, every text
    gets the prior as its score.
    """
    ids = docs.select(F.col(id_col).alias("id")).filter(fold_of(F.col("id")) != HELD_OUT).distinct()
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.filter(fold_of(F.col("id")) != HELD_OUT)
    prior = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    prior = min(max(prior or 0.0, 1e-4), 0.9)

    def least(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("id").orderBy(F.xxhash64("id"), "id").limit(n)

    with scratch(docs.sparkSession):
        positive = stored(_training_features(docs, least(known.filter("y = 1"), sample.positives), id_col, text_col), "positive")
        unlabelled = stored(_training_features(docs, least(ids, sample.unlabelled), id_col, text_col), "unlabelled")
        n, m = positive.count(), unlabelled.count()
        if not n or not m:
            return fit([], [], prior)
        wanted = _features_to_fit(positive, unlabelled, n, m)
        return fit(_collected(positive, wanted), _collected(unlabelled, wanted), prior)


def score_udf(docs: DataFrame, model: Model):
    """A column function text -> score; the model goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A score is a function of the text alone. Null and empty texts are scored as
    texts without words; a null id is never trained on and isn't held out;
    repeated rows score alike; other columns are ignored; an empty table gives
    no row.
    """
    score = score_udf(docs, train(docs, labels, id_col, text_col))
    scored = docs.select(F.col(id_col).alias("doc_id"), score(text_or_empty(text_col)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Null and empty texts score as texts without words; rows with a null id are
    scored like any other; repeated rows stay or go together; an empty table
    gives no row.
    """
    score = score_udf(docs, train(docs, labels, id_col, text_col))
    return docs.filter(score(text_or_empty(text_col)) < threshold)
