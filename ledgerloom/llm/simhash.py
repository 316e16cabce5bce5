"""Near-duplicate documents by SimHash and vantage-point trees.

A fingerprint has a bit where more than half of its text's shingle hashes have
it. Two fingerprints link at `radius` or fewer differing bits. The 64 bits are
cut into bands; a link differs by at most radius // bands bits in some band,
so one vantage-point tree for each band, searched at that small radius, finds
every link. A tree's upper levels deal the fingerprints out: each has one home
leaf, and visits the leaves on the far side of every boundary that it is close
enough to. Within a leaf a last vantage point bounds what has to be compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, text_or_empty
from ledgerloom.llm.components import connected_components

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_ROWS_AT_ONCE = 512


def shingle_digests(text: str | None, width: int, seed: int = 42) -> bytes:
    """XXH64 of every shingle, eight bytes each: A-Z lower-cased, words between
    ASCII white space, shingles of `width` words with repeats (fewer words: one
    shingle; none: nothing)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())])


def majority(digests: np.ndarray) -> int:
    """The bits that more than half of the digests have (rows of eight bytes); zero without any."""
    if not len(digests):
        return 0
    seen = np.bincount((digests + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS_OF_BYTE) > len(digests)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's shingles (no word: zero)."""
    return majority(np.frombuffer(shingle_digests(text, width, seed), np.uint8).reshape(-1, 8))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


class Tree:
    """The upper levels of one band's tree: a vantage point and a distance for
    each level, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, reach: int):
        self.mask, self.reach, self.levels = np.uint64(mask), reach, []
        known: list[np.ndarray] = []
        pool = sample[:256]
        for _ in range(depth if len(sample) >= 16 else 0):
            far = np.bitwise_count((pool[:, None] ^ sample[None, :]) & self.mask).astype(np.float64)
            centred = far - far.mean(1, keepdims=True)
            norm = np.sqrt((centred**2).sum(1)) + 1e-9
            alike = sum(((centred @ k) / norm) ** 2 for k in known) if known else -norm
            best = int(np.argmin(np.where(norm > 1e-6, alike, np.inf)))
            known.append(centred[best] / norm[best])
            counts = np.cumsum(np.bincount(far[best].astype(np.int64), minlength=65))
            self.levels.append((pool[best], int(np.argmin(np.abs(counts / len(sample) - 0.5)))))

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, at home) of every place that the fingerprints go to."""
        home_leaf = np.zeros(len(fps), np.int64)
        rows, leaves = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for vantage, middle in self.levels:
            far = np.bitwise_count((fps ^ vantage) & self.mask).astype(np.int64)
            right = far > middle
            crossing = np.flatnonzero(~right & (far > middle - self.reach))
            to_left, to_right = far[rows] <= middle + self.reach, far[rows] > middle - self.reach
            leaves = np.concatenate([2 * leaves[to_left], 2 * leaves[to_right] + 1, 2 * home_leaf[crossing] + 1])
            rows = np.concatenate([rows[to_left], rows[to_right], crossing])
            home_leaf = 2 * home_leaf + right
        at_home = np.zeros(len(fps) + len(rows), bool)
        at_home[: len(fps)] = True
        return np.concatenate([np.arange(len(fps)), rows]), np.concatenate([home_leaf, leaves]), at_home


def band_masks(bands: int) -> list[int]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]


def _near(queries: np.ndarray, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, its points within the radius); points lie by their distance from
    the first one, and the triangle bound skips those too near or too far."""
    vantage = points[0]
    far = np.bitwise_count(points ^ vantage).astype(np.int64)
    order = np.argsort(far, kind="stable")
    points, far = points[order], far[order]
    own = np.bitwise_count(queries ^ vantage).astype(np.int64)
    for d in np.unique(own):
        lo, hi = np.searchsorted(far, [d - radius, d + radius + 1])
        if lo == hi:
            continue
        mine = np.flatnonzero(own == d)
        for at in range(0, len(mine), _ROWS_AT_ONCE):
            some = mine[at : at + _ROWS_AT_ONCE]
            hit = np.bitwise_count(queries[some][:, None] ^ points[lo:hi][None, :]) <= radius
            for i in np.flatnonzero(hit.any(1)):
                yield int(some[i]), order[lo:hi][hit[i]]


def _links_of_leaf(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links within a leaf, or between two blocks of
    it; its edges are links themselves."""
    fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    home, second = pdf["home"].to_numpy(bool), pdf["block"].to_numpy() != pdf["lo"].to_numpy()
    label, edges = np.arange(len(fps)), [np.zeros((0, 2), np.int64)]

    def join(queries: np.ndarray, points: np.ndarray) -> None:
        if not len(queries) or not len(points):
            return
        for q, near in _near(fps[queries], fps[points], radius):
            own = queries[q]
            labels, first = np.unique(label[points[near]], return_index=True)
            other = labels != label[own]
            if other.any():
                met = points[near][first[other]]
                edges.append(np.stack([np.full(len(met), own), met], 1))
                label[np.isin(label, labels)] = label[own]

    if pdf["lo"].iat[0] == pdf["hi"].iat[0]:
        join(np.arange(len(fps)), np.flatnonzero(home))
    else:
        join(np.flatnonzero(~second), np.flatnonzero(home & second))
        join(np.flatnonzero(second & ~home), np.flatnonzero(home & ~second))
    ends = fps.view(np.int64)[np.concatenate(edges)]
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def near_links(distinct: DataFrame, radius: int = 4, bands: int = 3, leaf_size: int = 2048, sample_size: int = 4096) -> DataFrame:
    """(a, b): fingerprints within the radius of each other, which join all that are.

    distinct has each fingerprint once, in column fp. The result spans what the
    links connect, it doesn't list every pair of a group. Vantage points come
    from a sample of sample_size fingerprints (least by hash); every fingerprint
    is dealt to the leaves. A leaf with more than twice leaf_size fingerprints
    is cut into blocks, and pairs of blocks are tasks of their own. A null fp
    counts as none; an empty table gives no link.
    """
    distinct = distinct.filter("fp is not null")
    n = distinct.count()
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()]
    points = np.array(sample, np.int64).view(np.uint64)
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf_size)))
    trees = [Tree(points, mask, depth, radius // bands) for mask in band_masks(bands)]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                for k, tree in enumerate(trees):
                    rows, leaves, home = tree.route(some.view(np.uint64))
                    yield pd.DataFrame({"leaf": leaves * len(trees) + k, "fp": some[rows], "home": home})

    dealt = distinct.select("fp").mapInPandas(deal, "leaf long, fp long, home boolean")
    sizes = dealt.filter("home").groupBy("leaf").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit(2 * leaf_size)) + 1).cast("int").alias("blocks"))
    blocked = dealt.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    with_other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = with_other.select("leaf", "fp", "home", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return _links_of_leaf(pdf, radius)

    return tasks.groupBy("leaf", "lo", "hi").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least id that links reach, the row's own included.
    Null and empty texts have fingerprint zero and link like any other; copies
    share a fingerprint and are searched once; ids that are null stay, and give
    a component only if another id does; other columns are ignored; an empty
    table gives no row.
    """
    fps = stored(with_fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = connected_components(near_links(distinct, radius))
    groups = linked.join(distinct, linked["node"] == distinct["fp"]).select("node", "root", "least")
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    component = groups.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component_id")
    of_fp = distinct.join(component, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    of_fp = stored(of_fp, "components")  # both sides of the last join are then plain shuffles, whose skew Spark can split
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies of the pipeline, which are those of five
    words and a similarity of 0.8: see copies.one_per_group."""
    from ledgerloom.llm import copies

    return copies.one_per_group(docs, id_col=id_col, text_col=text_col)
