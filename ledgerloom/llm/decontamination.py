"""Benchmark decontamination, in SQL functions.

A document is contaminated by an item if one of its windows of the item's size
has a weighted (counted) shingle similarity of `threshold` or more with it.
Windows of every item size get a SimHash. A multi-index of Hamming blocks finds,
among all items of that size, those whose fingerprint is within the radius, and
the exact similarity decides.

Fingerprinting every window of every size would cost words x sizes. A window
that has the similarity with some item has so many shingles that occur in items
of its size, and of all such windows one of the best begins with one of them;
so the others, which can't be found, are left out beforehand, without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let, stored, unused

#: At similarity 0.8 the expected distance is 64 * acos(0.889) / pi = 9.7 bits, with a deviation of
#: 2.9, so some 99.6 % of such windows are within the radius, and more of those that are nearer.
RADIUS = 17
BLOCKS = 6
#: Rows of a table that may be sent to every task (some 40 bytes each).
BROADCAST_ROWS = 1_000_000
_LONG_SIGN = -(1 << 63)
_CUTS = [64 * b // BLOCKS for b in range(BLOCKS + 1)]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """XXH64 of every run of `width` words; none if there are fewer."""
    last = F.size(words) - F.lit(width)
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash_of(hashes: Column) -> Column:
    """64-bit majority of an array of hashes: bit counts are kept two to a long,
    in fields of 32 bits (an array has fewer elements), so 32 sums count all 64."""
    field = F.lit(0x0000000100000001)
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{q}") for q in range(32)])

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"c{q}"] + F.shiftrightunsigned(h, q).bitwiseAND(field)).alias(f"c{q}") for q in range(32)])

    def majority(acc: Column) -> Column:
        out = F.lit(0).cast("long")
        for q in range(32):
            for f in range(2):
                b = q + 32 * f
                count = F.shiftrightunsigned(acc[f"c{q}"], 32 * f).bitwiseAND(F.lit(0xFFFFFFFF))
                out = out.bitwiseOR(F.when(count * 2 > F.size(hashes), F.lit(_LONG_SIGN if b == 63 else 1 << b)).otherwise(F.lit(0)))
        return out

    return F.aggregate(hashes, zero, add, majority)


def _block(fp: Column, b: int) -> Column:
    width = _CUTS[b + 1] - _CUTS[b]
    return F.shiftrightunsigned(fp, _CUTS[b]).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _count_in(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of largest counts of two arrays of shingles."""
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(common, F.lit(0), lambda acc, h: acc + F.least(_count_in(a, h), _count_in(b, h)))
    shared = F.when(plain, F.size(common)).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_items(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item, width, shingles, fp) of every item with a word; item is a
    hash of its id and words. Items of fewer words than the shingle width are
    one shingle of all their words."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0).distinct()
    shingles = F.array().cast("array<bigint>")
    for w in range(1, width + 1):
        wanted = F.size("words") == w if w < width else F.size("words") >= w
        shingles = F.when(wanted, shingles_of(F.col("words"), w)).otherwise(shingles)
    items = items.select("item_id", F.xxhash64("item_id", "words").alias("item"), F.least(F.size("words"), F.lit(width)).alias("width"), shingles.alias("item_shingles"))
    return items.withColumn("item_fp", simhash_of(F.col("item_shingles")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of the table is known by its id and its text's hash."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).filter(text.isNotNull())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each document and item that contaminates it: doc_id, text_hash,
    item_id, start_word, n_words, distance and similarity of its best window
    (the earliest of the best that begin with a shingle of the item or end the text).

    Only contaminated documents have rows. Null, empty and short texts match
    only as far as they have the words (a text shorter than an item is one
    window); repeated rows with an id are found once; null ids of documents and
    items are kept, and items that share an id but not their words have rows of
    their own; other columns are ignored; an empty table on either side gives no row.
    """
    items = stored(benchmark_items(benchmark, width), "benchmark").withColumn("k", F.size("item_shingles"))
    texts = _texts(docs, id_col, text_col)
    windows = _windows(texts, stored(_starts(texts, items, threshold), "windows"), width)
    close = hamming_candidates(stored(windows, "fingerprints"), items).withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles")))
    begins = F.array_contains("item_shingles", F.get("shingles", F.lit(0))) | F.col("last")
    best = close.filter((F.col("similarity") >= threshold) & begins).groupBy("doc_id", "text_hash", "item_id", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), (F.size("shingles") + F.col("width") - 1).alias("n_words"), "distance")).alias("m")
    )
    return best.select(
        "doc_id", "text_hash", "item_id", (-F.col("m.back")).alias("start_word"), "m.n_words", F.col("m.distance").cast("int").alias("distance"), F.round("m.similarity", 6).alias("similarity")
    )


def _starts(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_hash, width, k, n, starts): where windows begin that have
    enough shingles of items with k shingles; n is the number of the text's own."""
    known = items.select("width", "k", F.explode(F.array_distinct("item_shingles")).alias("shingle")).distinct()
    n_known, hits = known.count(), None
    for w in [r["width"] for r in items.select("width").distinct().orderBy("width").collect()]:  # 1 to the shingle width at most
        rows = texts.select("doc_id", "text_hash", let(words_of(F.col("text")), lambda words: shingles_of(words, w)).alias("s"))
        rows = rows.select("doc_id", "text_hash", F.size("s").alias("n"), F.posexplode("s").alias("at", "shingle"))
        found = rows.join(_small(known.filter(F.col("width") == w), n_known), "shingle").select("doc_id", "text_hash", "n", "at", "width", "k")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.select("doc_id", "text_hash", *[F.lit(0).alias(c) for c in ("n", "at", "width", "k")]).limit(0)
    size = F.least("k", "n")
    least = F.ceil(F.lit(threshold) * (F.col("k") + size) / F.lit(1 + threshold) - F.lit(1e-9)).cast("int")
    places = hits.groupBy("doc_id", "text_hash", "width", "k", "n").agg(F.array_sort(F.collect_set("at")).alias("at"))
    enough = F.transform("at", lambda p, i: F.when(F.get(F.col("at"), i + least - 1) <= p + size - 1, F.least(p, F.col("n") - size)))
    return places.select("doc_id", "text_hash", "width", "k", "n", F.array_distinct(F.array_compact(enough)).alias("starts")).filter(F.size("starts") > 0)


def _near_blocks(fp: Column, b: int) -> Column:
    """A block's values within RADIUS // BLOCKS bits of a fingerprint's own:
    fingerprints within RADIUS agree to that in some block."""
    flips = [v for v in range(1 << (_CUTS[b + 1] - _CUTS[b])) if v.bit_count() <= RADIUS // BLOCKS]
    own = _block(fp, b)
    return F.struct(F.lit(b).alias("block"), F.transform(F.array(*[F.lit(v) for v in flips]), lambda v: own.bitwiseXOR(v)).alias("values"))


def hamming_candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Every window with every item of its size whose fingerprint is within the
    radius, and their distance. Items lie in the index under all values near
    their own blocks; a pair that meets in several blocks counts in the first."""
    index = items.select("item", "width", "k", "item_fp", F.explode(F.array(*[_near_blocks(F.col("item_fp"), b) for b in range(BLOCKS)])).alias("near"))
    index = index.select("item", F.col("width").alias("item_width"), F.col("k").alias("item_k"), "item_fp", F.col("near.block").alias("block"), F.explode("near.values").alias("value"))
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)]))
    probes = windows.select("doc_id", "text_hash", "width", "k", "start", "fp", blocks.alias("b")).select("*", F.col("b.block").alias("own_block"), F.col("b.value").alias("own_value")).drop("b")
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(True)
    for b in range(BLOCKS - 1):
        first = first & ((F.col("block") <= b) | (F.bit_count(_block(differing, b)) > RADIUS // BLOCKS))
    met = (F.col("own_block") == F.col("block")) & (F.col("own_value") == F.col("value")) & (F.col("width") == F.col("item_width")) & (F.col("k") == F.col("item_k"))
    close = probes.join(index, met & first & (F.bit_count(differing) <= RADIUS))
    close = close.select("doc_id", "text_hash", "width", "k", "start", "item", F.bit_count(differing).alias("distance"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("start") == F.col("_start")) & (F.col("k") == F.col("_k")) & (F.col("width") == F.col("_width"))
    whole = windows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("start").alias("_start"), F.col("k").alias("_k"), F.col("width").alias("_width"), "last", "shingles")
    return close.join(whole, same).join(items.select("item_id", "item", "item_shingles"), "item")


def _windows(texts: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """The windows with their shingles and fingerprints. Texts are read again
    for the documents that have any, and cut into words once for each."""
    of_text = starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("width", "k", "n", "starts")).alias("of"))
    of_text = of_text.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    rows = texts.join(_small(of_text, starts.count()), same).select("doc_id", "text_hash", "of", words_of(F.col("text")).alias("words"))

    def cuts(x: Column, words: Column) -> Column:
        size = F.least(x["k"], x["n"])
        return F.transform(x["starts"], lambda s: F.struct(x["width"].alias("width"), x["k"].alias("k"), s.alias("start"), (s == x["n"] - size).alias("last"), F.slice(words, s + 1, size + x["width"] - 1).alias("words")))

    each = F.flatten(F.transform("of", lambda x: cuts(x, F.col("words"))))
    rows = rows.select("doc_id", "text_hash", F.explode(each).alias("x")).select("doc_id", "text_hash", "x.*").dropDuplicates(["doc_id", "text_hash", "width", "k", "start"])
    shingles = F.array().cast("array<bigint>")
    for w in range(1, width + 1):
        shingles = F.when(F.col("width") == w, shingles_of(F.col("words"), w)).otherwise(shingles)
    rows = rows.select("doc_id", "text_hash", "width", "k", "start", "last", shingles.alias("shingles"))
    return rows.withColumn("fp", simhash_of(F.col("shingles")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns.

    Null and empty texts stay; rows that share an id but not their text are told
    apart; an empty table on either side leaves docs as it is.
    """
    bad = contaminated(docs, benchmark, threshold, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own_id, own_hash = unused(docs, "_id", "_hash")
    bad = stored(bad, "contaminated").toDF(own_id, own_hash)
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    return docs.join(_small(bad, bad.count()), same, "left_anti")
