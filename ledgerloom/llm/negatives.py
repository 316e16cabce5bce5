"""Hard negatives by inner products, pruned by length and by coordinate.

Rows lie in buckets by the length of their vectors, longest first; a bucket keeps,
for each coordinate, its rows in order of that coordinate of the unit vector
(LEMP: Teflioudi et al., 2015). An anchor with a threshold t can only reach it in
a bucket with longest vector l if t <= |anchor| * l, and only with rows whose
angle to it is at most acos(t / (|anchor| * l)). A row within that angle has each
of its coordinates within a range around the anchor's, so the ranges of the
anchor's largest (focus) coordinates, cut out of the ordered lists, intersect in
a superset of the rows that matter; these are verified by exact inner products.

Anchors are a stated set of queries. They meet all rows in blocks: a task holds
one block of anchors and one bucket. Buckets are searched in rounds, the longest
one first and eight times as many each time; after a round every anchor's
threshold is what its best rows so far reach, so later rounds return few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import scratch, stored

BUCKET_ROWS = 4096
ANCHOR_ROWS = 1024
FOCUS = 3
#: How many times the buckets of the rounds before a round has.
GROWTH = 8
SCALE = 256
_EPS = 1e-9
_PACKED = "vec_ids binary, labels binary, width int, vectors binary"
_FOUND = ["anchor", "positive_id", "positive_score", "other_id", "score"]
_PAIR = ["anchor", "positive_id", "positive_score"]
_BEST = "anchor long, positive_id long, positive_score long, other_id long, score long"


def labelled_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q, norm2) of the rows that take part."""
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # nan is above it
    rows = embeddings.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite)
    label = F.col(label_col).cast("long")
    shifted = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    q = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * SCALE))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), shifted.alias("label"), q.alias("q"))
    norm2 = F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return rows.withColumn("norm2", norm2)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max(map(len, frame["q"]), default=0)
    out = np.zeros((len(frame), width), np.int64)
    for i, q in enumerate(frame["q"]):
        out[i, : len(q)] = q
    return out


def _in_chunks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        while len(frame):
            held.append(frame.iloc[: size - n])
            frame, n = frame.iloc[size - n :], n + len(held[-1])
            if n == size:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def _packed(rows: pd.DataFrame, vectors: np.ndarray) -> dict:
    return {"vec_ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "labels": rows["label"].to_numpy(np.int64).tobytes(), "width": vectors.shape[1], "vectors": vectors.tobytes()}


def length_buckets(rows: DataFrame, size: int = BUCKET_ROWS) -> DataFrame:
    """A row for each bucket: its longest length, its rows by length, its ordered
    lists of coordinates and its place among all buckets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _in_chunks(frames, size):
            vectors = _matrix(chunk)
            lengths = np.sqrt(chunk["norm2"].to_numpy(np.float64))
            unit = vectors / np.maximum(lengths, 1e-300)[:, None]
            lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
            yield pd.DataFrame([{"longest": float(lengths.max()), **_packed(chunk, vectors), "lists": lists.tobytes()}])

    parts = max(1, -(-rows.count() // size))
    by_length = [F.desc("norm2"), "vec_id", "label"]
    packed = rows.repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length).mapInPandas(run, f"longest double, {_PACKED}, lists binary")
    return packed.withColumn("place", F.spark_partition_id())  # longest first


class _Bucket:
    def __init__(self, row: pd.Series):
        self.ids, self.labels = np.frombuffer(row["vec_ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), row["width"])
        self.longest = row["longest"]
        self.floats = self.vectors.astype(np.float64)
        self.unit = self.floats / np.maximum(np.sqrt((self.floats**2).sum(1)), 1e-300)[:, None]
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(row["width"], len(self.ids))
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def candidates(self, anchor: np.ndarray, threshold: float) -> np.ndarray | None:
        """Rows that may reach the threshold; null stands for all of them."""
        length = float(np.sqrt((anchor**2).sum()))
        if threshold <= 0 or threshold == -np.inf:
            return None
        reach = length * self.longest
        if threshold > reach * (1 + _EPS):
            return np.zeros(0, np.int64)
        angle = np.arccos(min(1.0, threshold / reach)) + 1e-7
        ranges = []
        for f in np.argsort(-np.abs(anchor[: self.unit.shape[1]]), kind="stable")[:FOCUS]:
            own = np.arccos(np.clip(anchor[f] / length, -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - _EPS, np.cos(max(0.0, own - angle)) + _EPS
            values = self.unit[self.lists[f], f]
            ranges.append((int(np.searchsorted(values, low)), int(np.searchsorted(values, high, "right")), low, high, f))
        ranges.sort(key=lambda r: r[1] - r[0])
        start, stop, _, _, f = ranges[0]
        if 2 * (stop - start) > len(self.ids):
            return None
        found = self.lists[f][start:stop]
        for _, _, low, high, f in ranges[1:]:
            values = self.unit[found, f]
            found = found[(values >= low) & (values <= high)]
        return found

    def scores(self, anchor: np.ndarray, exact: np.ndarray, found: np.ndarray | None) -> np.ndarray:
        """Integer inner products; doubles hold them as long as no sum passes 2**53."""
        n = min(len(anchor), self.vectors.shape[1])
        bound = max(1, n) * self.largest * int(np.abs(exact).max(initial=0))
        if bound < 1 << 53:
            table = self.floats if found is None else self.floats[found]
            return (table[:, :n] @ anchor[:n]).astype(np.int64)
        if bound >= 1 << 63:
            raise ValueError("inner products of these vectors don't fit in 64 bits")
        table = self.vectors if found is None else self.vectors[found]
        return table[:, :n] @ exact[:n]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, ties by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _positives(bucket: _Bucket, anchor: dict, scores: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple]:
    own = np.flatnonzero((bucket.labels[at] == anchor["label"]) & (bucket.ids[at] != anchor["vec_id"]) & (scores >= anchor["threshold"]))
    for i in own[_best(scores[own], bucket.ids[at[own]], k)]:
        yield anchor["anchor"], None, None, int(bucket.ids[at[i]]), int(scores[i])


def _negatives(bucket: _Bucket, anchor: dict, scores: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple]:
    other = np.flatnonzero((bucket.labels[at] != anchor["label"]) & (bucket.ids[at] != anchor["vec_id"]))
    ids, theirs = bucket.ids[at[other]], scores[other]
    for positive, score, floor in zip(anchor["positive_ids"], anchor["positive_scores"], anchor["floors"]):
        within = np.flatnonzero((theirs >= floor) & (theirs <= 95 * int(score) // 100))
        for i in within[_best(theirs[within], ids[within], k)]:
            yield anchor["anchor"], int(positive), int(score), int(ids[i]), int(theirs[i])


def _search(anchors: DataFrame, buckets: DataFrame, find: Callable, k: int) -> DataFrame:
    """The first k of each bucket for each anchor (or each positive of it).
    anchors has anchor, vec_id, label, q, threshold and lists of positives; blocks
    of them go by the length that they need, so blocks can skip whole buckets."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _in_chunks(frames, ANCHOR_ROWS):
            yield pd.DataFrame([{"needed": float(chunk["needed"].min()), "block": chunk.drop(columns="needed").to_dict("list")}])

    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    needed = F.when((F.col("threshold") > 0) & (length > 0), F.col("threshold") / length * (1 - 1e-6)).otherwise(F.lit(float("-inf")))
    columns = ["anchor", "vec_id", "label", "q", "threshold", "positive_ids", "positive_scores", "floors"]
    kinds = dict(anchors.dtypes)
    block = ",".join(f"{c}:array<{kinds[c]}>" for c in columns)
    rows = anchors.select(*columns).withColumn("needed", needed)
    parts = max(1, -(-rows.count() // ANCHOR_ROWS))
    blocks = stored(rows.repartitionByRange(parts, "needed", "anchor").mapInPandas(pack, f"needed double, block struct<{block}>"), "anchorblocks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                bucket, found = _Bucket(row), []
                everyone = np.arange(len(bucket.ids))
                for values in zip(*[row["block"][c] for c in columns]):
                    anchor = dict(zip(columns, values))
                    exact = np.asarray(anchor["q"], np.int64)
                    vector = exact.astype(np.float64)
                    some = bucket.candidates(vector, anchor["threshold"])
                    scores = bucket.scores(vector, exact, some)
                    found += find(bucket, anchor, scores, everyone if some is None else some, k)
                yield pd.DataFrame(found, columns=_FOUND).astype({"positive_id": "Int64", "positive_score": "Int64"})

    # Blocks of stated queries against buckets; a pair whose lengths can't reach is left out.
    pairs = buckets.join(blocks, F.col("needed") <= F.col("longest"))
    pairs = pairs.repartition(F.col("needed"), F.col("longest"), F.xxhash64("vec_ids"))
    return pairs.mapInPandas(run, _BEST)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_rounds(buckets: DataFrame, parts: int, keys: list[str], k: int, search: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """The first k of all buckets for each key. search(some buckets, reached)
    returns what may be among them; reached has (keys, least): the k-th best score
    of the keys that have k rows already."""
    best, reached, done, upto = None, None, 0, 1
    while best is None or done < parts:
        found = search(buckets.filter((F.col("place") >= done) & (F.col("place") < upto)), reached).select(*_FOUND)
        found = found if best is None else best.unionByName(found)
        best = stored(_first(found, keys, k).select(*_FOUND), "bestsofar")
        reached = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select(*keys, "least")
        done, upto = upto, GROWTH * upto
    return best


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`. Rows with a null id,
    label, vector or component, or one that isn't finite, take no part. Rows that
    share an id are each ranked, but none is a positive or negative of an anchor
    with its id; equal anchors count once. A shorter vector counts as filled up
    with zeros; an empty or zero one scores zero. Vectors whose products don't fit
    in 64 bits are an error. Other columns are ignored; an empty table, or one
    without anchors, gives no row.
    """
    with scratch(embeddings.sparkSession):
        rows = stored(labelled_vectors(embeddings, id_col, vec_col, label_col), "vectors")
        buckets = stored(length_buckets(rows), "lengthbuckets")
        parts = buckets.agg(F.max("place")).first()[0]
        parts = 0 if parts is None else parts + 1
        anchors = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "q").distinct()
        anchors = stored(anchors.withColumn("anchor", F.xxhash64("vec_id", "label", "q")), "anchors")
        none = [F.array().cast("array<long>").alias(c) for c in ("positive_ids", "positive_scores", "floors")]
        unknown = F.lit(float("-inf"))

        def nearest(some: DataFrame, reached: DataFrame | None) -> DataFrame:
            asking = anchors.withColumn("least", F.lit(None).cast("long")) if reached is None else anchors.join(reached, "anchor", "left")
            return _search(asking.select("anchor", "vec_id", "label", "q", F.coalesce(F.col("least").cast("double"), unknown).alias("threshold"), *none), some, _positives, positives)

        found = _in_rounds(buckets, parts, ["anchor"], positives, nearest)
        best = stored(found.select("anchor", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).distinct(), "positives")
        least = F.ceil(F.col("positive_score") / 2)  # half the positive's score is what a negative must reach

        def between(some: DataFrame, reached: DataFrame | None) -> DataFrame:
            asked = best.withColumn("least", F.lit(None).cast("long")) if reached is None else best.join(reached, _PAIR, "left")
            asked = asked.withColumn("p", F.struct("positive_id", "positive_score", F.greatest(least, F.coalesce("least", least)).alias("floor")))
            lists = asked.groupBy("anchor").agg(F.collect_list("p").alias("l"))
            lists = lists.select("anchor", *[F.col(f"l.{c}").alias(name) for c, name in (("positive_id", "positive_ids"), ("positive_score", "positive_scores"), ("floor", "floors"))])
            return _search(anchors.join(lists, "anchor").withColumn("threshold", F.array_min("floors").cast("double")), some, _negatives, negatives)

        found = stored(_in_rounds(buckets, parts, _PAIR, negatives, between), "negatives", lasting=True)
        of_anchor = stored(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchorids", lasting=True)
    ranked = _first(found, _PAIR, negatives).select(*_PAIR, F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(of_anchor, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
