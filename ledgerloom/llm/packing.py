"""Mixture-controlled packing by deficit round-robin over source queues.

Every document is a run of token ids in the queue of its source. Windows of a
fixed length are filled from all queues in target proportions; what a queue got
too little or too much is carried on as its deficit. A first round-robin on the
driver deals whole blocks of windows (its state is a few numbers for each
source and block); a second one, the same in every task that needs it, deals
the windows of a block. So a task knows where its documents' tokens lie without
seeing other documents, and token ids are neither shuffled nor collected.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, text_or_empty

MAX_QUEUES = 1024
MAX_CELLS = 1 << 21
MAX_CACHED = 1 << 20
BROADCAST_ROWS = 1_000_000
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@lru_cache(maxsize=4)
def load_encoding(name: str):
    """The tokenizer by its ranks: the ids are those of the byte-level BPE of
    the same name, whose JSON file lists the special tokens."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), "rb") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    if max([*ranks.values(), *special.values()]) > 0xFFFF:
        raise ValueError(f"{name} has ids beyond 16 bits, in which they are stored")
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def load_tokenizer(name: str, special_tokens: bool):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(f"{name}.json")))
    tokenizer.encode_special_tokens = not special_tokens
    return tokenizer


def encoder(name: str, special_tokens: bool):
    """ids of a text. Ranks are the faster way; their pattern gives up on a run
    of about a million white-space characters, and such a text goes to the
    tokenizer of the JSON file, whose ids are the same."""
    encoding = load_encoding(name)
    # Not encode_ordinary, which ends the process there.
    fast = partial(encoding.encode, allowed_special="all" if special_tokens else set(), disallowed_special=())

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except ValueError:
            return load_tokenizer(name, special_tokens).encode(text, add_special_tokens=False).ids

    return encode


def tokenise(docs: DataFrame, queue, source, tokenizer: str, end_id: int, id_col: str, text_col: str, special_tokens: bool) -> DataFrame:
    """(doc_id, source, part, queue, local_start, n, ids) of every row: its ids as
    little-endian 16-bit numbers and where they start in what the task has for
    that queue. Stored, so parts stay what they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(tokenizer, special_tokens), np.array([end_id], "<u2")
        part, reached = TaskContext.get().partitionId(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                starts, counts, ids = [], [], []
                for text, name in zip(batch.column("text"), batch.column("queue").to_pylist()):
                    each = np.append(np.array(encode(text.as_py()), "<u2"), ends)
                    starts.append(reached.get(name, 0))
                    counts.append(len(each))
                    ids.append(each.tobytes())
                    reached[name] = starts[-1] + len(each)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source"), pa.array([part] * len(ids), pa.int32()), batch.column("queue"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "queue", "local_start", "n", "ids"],
                )

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), text_or_empty(text_col).alias("text"), queue.alias("queue"))
    return stored(narrow.mapInArrow(run, f"doc_id {kind}, source string, part int, queue string, local_start long, n long, ids binary"), "tokens")


def deal(capacity: int, rounds: int, totals: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Deficit round-robin: what each queue has given before each round, as an
    array of rounds + 1 rows.

    In a round every queue that has tokens earns capacity times its share of
    the shares of such queues, and gives the whole tokens of its deficit; the
    rest of the round goes one token at a time to the largest deficits. What it
    earned and didn't give, or gave and hadn't earned, stays as its deficit.
    """
    left, deficit = totals.astype(np.int64).copy(), np.zeros(len(totals))
    remaining, weight = int(left.sum()), None
    given = np.zeros((rounds + 1, len(totals)), np.int64)
    for i in range(rounds):
        if not remaining:
            given[i + 1 :] = given[i]
            break
        if weight is None:  # again whenever a queue runs dry
            weight = np.where(left > 0, shares, 0.0)
            weight = weight / weight.sum() if weight.sum() > 0 else (left > 0) / np.count_nonzero(left)
            deficit[left == 0] = 0.0
        room = min(capacity, remaining)
        deficit += room * weight
        take = np.minimum(np.maximum(np.floor(deficit + 1e-9), 0), left).astype(np.int64)
        need = room - int(take.sum())
        if need < 0:  # deficits of queues that ran dry have left more than a round's room
            for s in np.argsort(deficit - take, kind="stable"):
                back = min(-need, int(take[s]))
                take[s] -= back
                need += back
                if not need:
                    break
        while need > 0:
            order = np.argsort(take - deficit, kind="stable")
            can = order[left[order] > take[order]][:need]
            take[can] += 1
            need -= len(can)
        deficit -= take
        left -= take
        remaining -= room
        given[i + 1] = given[i] + take
        if not left[take > 0].all():
            weight = None
    return given


def queue_of(docs: DataFrame, mixture: dict | None, text_col: str, source_col: str, max_queues: int) -> Column:
    """The queue of a row: its source's own ("=" and the name, "" if null) where
    the mixture names the source or it has a share of 1 / max_queues of all bytes
    or more; smaller sources share queues ("#" and a number). So the number of
    queues is bounded, whatever the number of sources."""
    source = F.col(source_col).cast("string")
    own = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    sizes = docs.groupBy(own.alias("_queue")).agg(F.sum(F.octet_length(text_or_empty(text_col)).cast("long") + F.lit(1)).alias("_size"))
    sizes = stored(sizes, "sources")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    single = {"" if m is None else f"={m}" for m in mixture or ()}
    single |= {r["_queue"] for r in sizes.filter(F.col("_size") * F.lit(max_queues) >= F.lit(total)).collect()}  # max_queues rows at most
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(max_queues)).cast("string"))
    return F.when(own.isin(*single), own).otherwise(shared) if single else shared


class Layout:
    """Where every token of every queue lies: blocks of windows, dealt once."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, length: int, max_cells: int = MAX_CELLS):
        windows = -(-int(totals.sum()) // length) if len(totals) else 0
        blocks = max(1, min(-(-windows // 16), max_cells // max(1, len(totals)), 1 << 16))
        self.length, self.windows = length, max(1, -(-windows // blocks))
        self.blocks = -(-windows // self.windows) if windows else 0
        self.given = deal(length * self.windows, self.blocks, totals, shares)
        self.starts = self.given.T.tolist()
        self.cache: dict[int, tuple[list, list]] = {}
        self.cached = max(4, MAX_CACHED // (2 * (self.windows + 1) * max(1, len(totals))))

    def block(self, b: int) -> tuple[list, list]:
        """By queue: what it has given before each window, and its offset in
        each window. The queues of a task's documents run side by side, so the
        blocks it needs are computed about once if as many are kept as fit."""
        if b not in self.cache:
            if len(self.cache) >= self.cached:
                self.cache.pop(next(iter(self.cache)))
            own = self.given[b + 1] - self.given[b]
            given = deal(self.length, self.windows, own, own.astype(float))
            took = np.diff(given, axis=0)
            self.cache[b] = given.T.tolist(), (np.cumsum(took, axis=1) - took).T.tolist()
        return self.cache[b]

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of n tokens that
        begin at `start` of a queue."""
        done, b = 0, bisect_right(self.starts[queue], start) - 1
        while done < n:
            given, offsets = self.block(b)
            column, offset = given[queue], offsets[queue]
            x = start + done - self.starts[queue][b]
            w = bisect_right(column, x) - 1
            while done < n and w < self.windows:
                size = min(column[w + 1] - x, n - done)
                if size > 0:
                    yield done, size, b * self.windows + w, offset[w] + x - column[w]
                    done, x = done + size, x + size
                w += 1
            b += 1


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k",
    length: int = 2048,
    end_id: int = 1,
    mixture: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    special_tokens: bool = False,
    max_queues: int | None = None,
) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and source.

    mixture gives target shares by source (0 for one it doesn't name); by default
    each source's share is that of its tokens, so all last to the end. Sources
    that the mixture names, and those with 1 / max_queues of all bytes or more
    (MAX_QUEUES if none is given), have queues of their own; smaller ones share
    queues by hash, each with the sum of their shares (0 beside a mixture), and
    windows hold the proportions of queues. With max_queues at the number of bytes
    every source has a queue; the driver holds a few numbers for each queue. All sequences but the last are full;
    the last is filled as far as tokens last. With special_tokens their strings
    in a text are their ids, else ordinary text. Null and empty texts are the end
    id alone, a null source is a queue of its own, null and repeated ids are
    packed row by row, an empty table gives no row, other columns are ignored.
    """
    max_queues = MAX_QUEUES if max_queues is None else max_queues
    if max_queues < 1:
        raise ValueError("max_queues must be 1 or more")
    queue = queue_of(docs, mixture, text_col, source_col, max_queues)
    tokens = tokenise(docs, queue, F.col(source_col).cast("string"), tokenizer, end_id, id_col, text_col, special_tokens)
    by_part = stored(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "queues")
    totals = {r["queue"]: r["n"] for r in by_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # 2 * max_queues rows at most, and what the mixture names
    names = sorted(totals)
    counts = np.array([totals[q] for q in names], np.int64)
    shares = counts.astype(float) if mixture is None else np.array([0.0 if q.startswith("#") else mixture.get(q[1:] if q else None, 0.0) for q in names])
    shared = docs.sparkSession.sparkContext.broadcast((names, Layout(counts, shares, length)))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    if by_part.count() <= BROADCAST_ROWS:  # then token ids aren't shuffled, and lie as the queues do
        base = F.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, layout = shared.value
        index = {q: i for i, q in enumerate(names)}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, found, whole_n = [], [], []
                starts, queues = batch.column("at").to_pylist(), batch.column("queue").to_pylist()
                for row, (raw, start, q) in enumerate(zip(batch.column("ids"), starts, queues)):
                    ids = memoryview(np.frombuffer(raw.as_buffer(), "<u2").astype("<u4").tobytes())
                    n = len(ids) // 4
                    pieces = [(a, size, zlib.crc32(ids[4 * a : 4 * (a + size)]), seq, off) for a, size, seq, off in layout.pieces(index[q], start, n)]
                    found += pieces
                    rows += [row] * len(pieces)
                    whole_n += [n] * len(pieces)
                starts, sizes, crcs, sequences, offsets = np.array(found, np.int64).reshape(-1, 5).T
                numbers = [pa.array(v) for v in (starts, sizes, crcs, np.array(whole_n, np.int64), sequences, offsets)]
                of_row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(of_row), *numbers, batch.column("source").take(of_row)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    kind = dict(docs.dtypes)[id_col]
    placed = tokens.join(base, ["part", "queue"]).select("doc_id", "source", "queue", (F.col("base") + F.col("local_start")).alias("at"), "ids")
    return placed.mapInArrow(run, PIECES.format(id=kind))
