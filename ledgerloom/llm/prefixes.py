"""A trie of conversation prefixes, screened by a count-min sketch.

Every conversation is a path of turns from the root. Digests of all prefixes go
into a count-min sketch; an estimate is never too low, so a prefix whose estimate
is one belongs to a single conversation, and so do all longer ones of it. Such
tails are written where they are; only prefixes that may be shared are shuffled
and grouped exactly. Sums over subtrees take a round for each power of two up to
the deepest shared prefix. Texts aren't shuffled, only digests of turns are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import scratch, stored

ROOT = bytes(16)
_BLOCK = 1 << 16
#: Turns of the first conversation of a hundred that others may begin with.
_LONGEST_HEAD = 5
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a role and a text; the role's length keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """(c, depth, digest, parent, size, ends) of every prefix of every rebuilt
    conversation, the root's included: a fold over turns that lie in order, which
    holds one digest and the first few turns of a hundred's first conversation."""
    c = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        (c - c % 100).alias("base"), c.alias("c"), F.col("turn").alias("turn"), turn_digest(role, text).alias("x"), F.length(text).cast("long").alias("size"),
        (F.crc32(c.cast("string").cast("binary")) % 6).cast("int").alias("head"),
    )
    order = ["base", F.col("c") != F.col("base"), "c", F.col("turn").asc_nulls_first(), "x", "size"]
    ordered = turns.repartition("base").sortWithinPartitions(*order)
    names = ["c", "depth", "digest", "parent", "size", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []  # the open conversation's last prefix stays last, as it may be its end
        base = conv = None
        first: list[tuple[bytes, int]] = []
        at = depth = 0
        digest = ROOT

        def step(x: bytes, size: int) -> None:
            nonlocal digest, depth
            before, digest, depth = digest, xxhash.xxh3_128_digest(digest + x), depth + 1
            out.append([conv, depth, digest, before, size, False])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for b, c, x, size, head in zip(*columns):
                if b != base:
                    base, first = b, []
                if c != conv:
                    if out:
                        out[-1][5] = True
                    conv, at, depth, digest = c, 0, 0, ROOT
                    out.append([c, 0, ROOT, None, 0, False])
                    if c != base:
                        for known in first[:head]:
                            step(*known)
                at += 1
                if c == base and at <= _LONGEST_HEAD:
                    first.append((x, size))
                if c == base or at > head:
                    step(x, size)
            if len(out) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[:-1]), kinds)], names=names)
                out = out[-1:]
        if out:
            out[-1][5] = True
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(run, "c long, depth long, digest binary, parent binary, size long, ends boolean")


def _places(digests: pa.Array, width: int, rows: int) -> np.ndarray:
    """The counters of each digest, a line for each row of the sketch."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return np.stack([(halves[:, 0] + np.uint64(r) * (halves[:, 1] | np.uint64(1))) % np.uint64(width) for r in range(rows)]).astype(np.int64)


def sketch(prefixes: DataFrame, width: int, rows: int) -> np.ndarray:
    """For each counter, a bit: did it count two or more. Counters stop at two, as
    only an estimate of one says anything. A task adds up its own prefixes and
    sends the counters that it touched, two bytes each; counters are merged in
    blocks, and rows * width / 8 bytes come to the driver."""
    held = -(-width // _BLOCK) * _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((rows, held), np.uint8)
        for batch in batches:
            for r, at in enumerate(_places(batch.column(0), width, rows)):
                touched, n = np.unique(at, return_counts=True)
                counters[r, touched] = np.minimum(counters[r, touched] + np.minimum(n, 2), 2)
        flat = counters.reshape(-1, _BLOCK)
        for block in np.flatnonzero(flat.any(1)):
            lists = [[np.flatnonzero(flat[block] == k).astype("<u2").tobytes()] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int64()), *[pa.array(x, pa.binary()) for x in lists]], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(_BLOCK, np.uint8)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for b, once, twice in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if b != block:
                    if block is not None:
                        yield made()
                    block, total = b, np.zeros(_BLOCK, np.uint8)
                for k, places in ((1, once), (2, twice)):
                    at = np.frombuffer(places, "<u2")
                    total[at] = np.minimum(total[at] + k, 2)
        if block is not None:
            yield made()

    counted = prefixes.filter("depth > 0").select("digest").mapInArrow(count, "block long, once binary, twice binary")
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    many = np.zeros((rows * held // _BLOCK, _BLOCK // 8), np.uint8)
    for row in merged.collect():
        many[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return many.reshape(rows, -1)


def screened(prefixes: DataFrame, max_width: int = 1 << 25, rows: int = 2) -> DataFrame:
    """prefixes with `alone` and `parent_alone`: the sketch proves that no other
    conversation has the prefix, or the one before it. A wrong doubt costs a
    shuffled row. The sketch has some four counters a prefix, and max_width for
    each of its rows at most: rows * max_width / 8 bytes (8 MB) are broadcast."""
    n = prefixes.count()
    width = min(max_width, max(_BLOCK, 1 << (4 * n).bit_length()))
    many = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, width, rows))

    def alone(digests: pa.Array) -> np.ndarray:
        shared = np.ones(len(digests), bool)
        for bits, at in zip(many.value, _places(digests, width, rows)):
            shared &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return ~shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column("depth").to_numpy()
            own = alone(batch.column("digest")) & (depth > 0)
            before = alone(batch.column("parent").fill_null(ROOT)) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(before)], names=[*batch.schema.names, "alone", "parent_alone"])

    kept = ", ".join(f"{c} {k}" for c, k in prefixes.dtypes)
    return prefixes.mapInArrow(run, f"{kept}, alone boolean, parent_alone boolean")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the ids of each prefix's own conversations, in
    order: read as a stream, so a prefix's ids are never in memory together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, text = None, None
        for batch in batches:
            done = []
            for d, c in zip(*[batch.column(i).to_pylist() for i in range(2)]):
                if d != digest:
                    if digest is not None:
                        done.append((digest, text.hexdigest()))
                    digest, text = d, hashlib.sha256(str(c).encode())
                else:
                    text.update(b",%d" % c)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), (pa.binary(), pa.string()))], names=["digest", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([text.hexdigest()])], names=["digest", "ends_sha256"])

    return ends.select("digest", "c").repartition("digest").sortWithinPartitions("digest", "c").mapInArrow(run, "digest binary, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """(digest, leaves, saved) of nodes (digest, depth, parent, leaves, saved),
    summed over subtrees. After round j a node has the sums of what lies less
    than 2**(j+1) below it, and a pointer that far up."""
    sums, up = nodes.select("digest", "depth", "leaves", "saved", F.col("parent").alias("up")), 1
    while up <= deepest:
        below = sums.filter(F.col("depth") >= up).groupBy(F.col("up").alias("digest")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        further = sums.select(F.col("digest").alias("up"), F.col("up").alias("_up"))
        joined = sums.join(below, "digest", "left").join(further, "up", "left")
        added = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        sums, up = stored(joined.select("digest", "depth", *added, F.col("_up").alias("up")), "triesums"), 2 * up
    return sums.select("digest", "leaves", "saved")


def prefix_trie(conversations: DataFrame, max_width: int = 1 << 25) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (the
    least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    A conversation is rebuilt from the first h turns of the first one of its
    hundred (h: CRC-32 of its id, modulo 6) and its own turns after h. Turns go
    by `turn`, nulls first; where it repeats, by the digests of role and text.
    Null roles and texts are empty; rows with a null conv_id belong to no
    conversation. Equal rows are turns of their own. Conversations without turns
    end at the root. Texts of any length count by their digests; other columns
    are ignored; an empty table has no node.
    """
    with scratch(conversations.sparkSession):
        found = stored(screened(stored(rebuilt_prefixes(conversations), "prefixes"), max_width), "screened", lasting=True)
        shared, heads = found.filter("not alone"), found.filter("alone and not parent_alone")
        least = [F.first(c).alias(c) for c in ("depth", "parent", "size")]
        nodes = stored(shared.groupBy("digest").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *least), "trienodes", lasting=True)
        below = nodes.filter("parent is not null").select(F.col("parent").alias("digest"), F.lit(0).alias("tail")).unionByName(heads.select(F.col("parent").alias("digest"), F.lit(1).alias("tail")))
        below = below.groupBy("digest").agg(F.count(F.lit(1)).alias("n_children"), F.sum("tail").alias("tails"))
        own = nodes.join(below, "digest", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "tails": F.coalesce("tails", F.lit(0))})
        own = own.withColumn("leaves", F.col("tails") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
        own = stored(own.select("digest", "depth", "parent", "leaves", "saved", "n_children"), "triecounts")
        deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
        sums = _subtree_sums(own, deepest).join(own.select("digest", "n_children"), "digest")
        sums = stored(sums.join(_ends_digests(shared.filter("ends")), "digest", "left"), "trieresults", lasting=True)
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # A doubted prefix whose parent was proven single has no parent here: both are of one conversation.
    above = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")
    inner = nodes.join(sums, "digest").join(parents, "parent", "left").select(
        "conv_id", "depth", above, "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")
    )
    tail = [
        F.lit(1).cast("long").alias("n_convs"), (~F.col("ends")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    ]
    rest = found.filter("alone and parent_alone").select(F.col("c").alias("conv_id"), "depth", F.col("c").alias("parent_conv_id"), *tail)
    begun = heads.join(parents, "parent").select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", *tail)
    return inner.unionByName(begun).unionByName(rest)
