"""Line dedup by a segment-partition edit join, in SQL functions.

Equal lines are one class. Classes link at `threshold` edits or fewer, at one
edit if the shorter line has under 40 characters: a line is cut into one segment
more than that, and any line so close has one of them as a substring near its
place (Li et al., 2011). So segments and substrings get keys that know the
lengths. A first pass over keys alone finds those that different lines share;
only these lines meet, in an equi-join that counts letters, verifies by a banded
bit-parallel edit distance and goes into counts at once: no pair is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let, scratch, stored, unused

#: Two numbers of letter counts, of three bits each.
_LETTERS = {"letters": "abcdefghijklmnopqrst", "signs": "0123456789uvwxyz ,.-"}
_COUNT_BITS = 3
#: Rows of some 60 bytes that may be sent to every task.
BROADCAST_ROWS = 200_000
#: Lines under so many characters link at one edit.
SHORT = 40
#: Lines with one key that probe in one task; the lines they meet go to each such task.
CHUNK = 1000


@dataclass(frozen=True)
class Entry:
    """A key of a line: its own segment, or a substring where that segment of a
    line shorter by `delta` may lie. least to largest: lengths of that line."""

    least: int
    largest: int | None
    edits: int
    segment: int
    delta: int = 0
    shift: int = 0
    own: bool = False


def length_ranges(threshold: int, min_chars: int | None) -> list[tuple[int, int | None, int]]:
    """(least, largest, edits): how near lines must be whose shorter one has a
    length in the range. A given min_chars leaves shorter lines out."""
    if min_chars is not None:
        return [(min_chars, None, threshold)]
    return [(2, SHORT - 1, 1), (SHORT, None, threshold)]


def _probes(threshold: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift): where a segment of a shorter or
    equal line can lie in a line within the threshold, seen from both ends.
    A line's own segments aren't among them."""
    out = []
    for delta in range(threshold + 1):
        for i in range(threshold + 1):
            right = threshold - i
            out += [(delta, i, s) for s in range(max(-i, delta - right), min(i, delta + right) + 1) if delta or s]
    return out


def entries_of(threshold: int, min_chars: int | None) -> list[Entry]:
    """All keys that a line may have, in the order of their places."""
    out = []
    for least, largest, edits in length_ranges(threshold, min_chars):
        out += [Entry(least, largest, edits, i, own=True) for i in range(edits + 1)]
        out += [Entry(least, largest, edits, i, delta, shift) for delta, i, shift in _probes(edits)]
    return out


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of every line of every text; null texts
    have none. A row of the table is known by its id and its text's hash."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _keys(lines: DataFrame, entries: list[Entry]) -> DataFrame:
    """lines with `keys`: for each entry a hash of the segment, or null where the
    entry isn't for lines of that length. Characters are cut as UTF-32, where
    their places are known."""
    lines = lines.withColumn("_u", units(F.col("line"))).withColumn("_n", n_units(F.col("_u")))

    def key(e: Entry) -> Column:
        n, segments = F.col("_n") - F.lit(e.delta), e.edits + 1
        base, extra = F.floor(n / F.lit(segments)).cast("int"), F.pmod(n, F.lit(segments))
        short = F.lit(segments) - extra  # the segments before this one have the lesser length
        start = F.lit(e.segment) * base + F.greatest(F.lit(0), F.lit(e.segment) - short) + F.lit(e.shift)
        size = base + F.when(F.lit(e.segment) >= short, 1).otherwise(0)
        fits = n >= e.least if e.largest is None else (n >= e.least) & (n <= e.largest)
        return F.when(fits, F.xxhash64(F.lit(e.segment), n, F.substr("_u", start * 4 + 1, size * 4)))

    return lines.withColumn("keys", F.array(*map(key, entries))).drop("_n").withColumnRenamed("_u", "u")


def line_classes(docs: DataFrame, entries: list[Entry], id_col: str, text_col: str) -> DataFrame:
    """Every different line that isn't blank, once: 128 bits of hash, the place
    where it first occurs and its keys. Its text stays where it is."""
    rows = occurrences(docs, id_col, text_col).filter(F.rlike("line", F.lit(r"\S")))
    rows = _keys(rows.select("doc_id", "text_hash", "line_no", "line", *_hashes(F.col("line"))), entries).drop("line", "u")
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("place"), F.first("keys").alias("keys"))


def _letter_counts(line: Column, letters: str) -> Column:
    """Counts of some letters modulo 8. An edit changes the sum of their
    differences by 2 at most, and differences modulo 8, taken the shorter way
    round, are no larger."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(7)).cast("long"), _COUNT_BITS * i))
    return out


def _letters_apart(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for i in range(20):
        apart = (F.shiftright(a, _COUNT_BITS * i).bitwiseAND(F.lit(7)) - F.shiftright(b, _COUNT_BITS * i).bitwiseAND(F.lit(7))).bitwiseAND(F.lit(7)).cast("int")
        total = total + F.least(apart, F.lit(8) - apart)
    return total


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two arrays of characters if it is threshold or less,
    else null.

    For each number of errors e a word has a bit for each diagonal of the band
    of 2 * threshold + 1: set where the characters of a read so far and those
    of b up to that diagonal are within e edits. A character of a moves all
    diagonals at once.
    """
    width = 2 * threshold + 1
    band = F.lit((1 << width) - 1)
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << threshold & (1 << width) - 1).cast("long").alias(f"r{e}") for e in range(threshold + 1)])

    def equal_to(char: Column, i: Column) -> Column:
        out = F.lit(0).cast("long")
        for d in range(width):
            at = i + F.lit(d - threshold)
            same = F.when(at >= 0, F.coalesce(F.get(b, F.greatest(at, F.lit(0))) == char, F.lit(False))).otherwise(F.lit(False))
            out = out.bitwiseOR(F.when(same, F.lit(1 << d)).otherwise(F.lit(0)))
        return out

    def step(acc: Column, x: Column) -> Column:
        new, fields = None, []
        for e in range(threshold + 1):
            cell = acc["s"][f"r{e}"].bitwiseAND(x)
            if e:
                less = acc["s"][f"r{e - 1}"]
                cell = cell.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(band)
            new = cell
            fields.append(cell.alias(f"r{e}"))
        return F.struct(F.struct(*fields).alias("s"))

    matches = F.transform(a, lambda char, i: equal_to(char, i))
    last = F.aggregate(matches, F.struct(start.alias("s")), step, lambda acc: acc["s"])
    bit = F.lit(1).cast("long")
    apart = F.size(b) - F.size(a)
    inside = F.abs(apart) <= threshold
    end = F.least(F.greatest(apart + F.lit(threshold), F.lit(0)), F.lit(2 * threshold))

    def least_errors(words: Column) -> Column:
        out = F.lit(None).cast("int")
        for e in range(threshold, -1, -1):
            reached = F.call_function("shiftright", words[f"r{e}"], end).bitwiseAND(bit) == 1
            out = F.when(reached, F.lit(e)).otherwise(out)
        return out

    return F.when(inside, let(last, least_errors))


def units(line: Column) -> Column:
    """A line as UTF-32: four bytes a character, so that places are known."""
    return F.encode(line, "UTF-32")


def n_units(u: Column) -> Column:
    return (F.octet_length(u) / 4).cast("int")


def characters(u: Column) -> Column:
    """The characters of a line in UTF-32."""
    places = F.when(F.octet_length(u) > 0, F.sequence(F.lit(0), F.greatest(n_units(u) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(u, i * 4 + 1, F.lit(4)))


def _shared(pair: Column, from_end: bool) -> Column:
    """Characters that two lines share at an end, found by halving steps (of two
    million at most: a shorter shared end serves as well)."""
    a, b, a_n, b_n, shorter = (pair[c] for c in ("a", "b", "a_n", "b_n", "shorter"))

    def block(u: Column, n: Column, at: Column, size: Column) -> Column:
        return F.substr(u, ((n - at - size) if from_end else at) * 4 + 1, size * 4)

    def longer(at: Column, size: Column) -> Column:
        return F.when(at + size > shorter, at).when(block(a, a_n, at, size) == block(b, b_n, at, size), at + size).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(20, -1, -1)]), F.lit(0), longer)


def line_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two lines in UTF-32 if it is threshold or less, else
    null. What they share at both ends doesn't change it and is cut off first."""

    def measured(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), n_units(a).alias("a_n"), n_units(b).alias("b_n"), F.least(n_units(a), n_units(b)).alias("shorter"))

    def cut(pair: Column, from_end: bool, body) -> Column:
        def rest(p: Column) -> Column:
            x, at = p["p"], p["at"]
            return let(measured(*[F.substr(x[c], F.lit(1) if from_end else at * 4 + 1, (x[f"{c}_n"] - at) * 4) for c in "ab"]), body)

        return let(F.struct(pair.alias("p"), _shared(pair, from_end).alias("at")), rest)

    def distance(pair: Column) -> Column:
        return let(F.struct(characters(pair["a"]).alias("a"), characters(pair["b"]).alias("b")), lambda c: banded_distance(c["a"], c["b"], threshold))

    return let(measured(a, b), lambda pair: cut(pair, False, lambda left: cut(left, True, distance)))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def meetings(classes: DataFrame, entries: list[Entry]) -> DataFrame:
    """(key, h1, e, chunks): the keys that two different lines or more have, at
    least one as its own segment; chunks: in how many parts they are to probe.
    Keys are counted before they are shuffled, so a frequent one is no large task."""
    rows = classes.select("h1", F.posexplode("keys").alias("e", "key")).filter(F.col("key").isNotNull())
    own = F.col("e").isin(*[i for i, e in enumerate(entries) if e.own])
    seen = rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max(own).alias("own"))
    keys = stored(seen.filter(F.col("own") & (F.col("lo") != F.col("hi"))).select("key"), "linekeys")
    met = stored(rows.join(_small(keys), "key"), "linemeetings")
    chunks = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    return met.join(chunks, "key")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, place, line) of the classes with a wanted h1, read where they first occur."""
    kept = stored(classes.select("h1", "h2", "place").join(_small(wanted), "h1", "left_semi"), "lineplaces")
    of_row = kept.groupBy(F.col("place.doc_id").alias("_id"), F.col("place.text_hash").alias("_hash")).agg(F.collect_list(F.struct("h1", "h2", "place")).alias("_of"))
    of_row = F.broadcast(of_row) if kept.count() <= BROADCAST_ROWS else of_row
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    rows = docs.select(id_col, text_col).join(of_row, same).select("_of", F.split(text_col, "\n", -1).alias("_lines"))
    rows = rows.select(F.explode(F.transform("_of", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["place"].alias("place"), F.get("_lines", x["place"]["line_no"]).alias("line")))).alias("x"))
    return rows.select("x.*").dropDuplicates(["h1", "h2"])


def line_links(docs: DataFrame, classes: DataFrame, entries: list[Entry], id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, n_links, earliest) of all classes with another one within the
    threshold of their lengths: how many, and the least of their places.

    A pair may share several keys; it counts at the first of them.
    """
    met = stored(meetings(classes, entries), "linechunks")
    lines = _keys(_texts(docs, classes, met.select("h1").distinct(), id_col, text_col), entries)
    counts = {name: _letter_counts(F.col("line"), letters) for name, letters in _LETTERS.items()}
    lines = stored(lines.withColumns(counts).drop("line"), "linetexts")

    def by_entry(value) -> Column:
        """value(i, entry) of the row's entry."""
        out = F.lit(None)
        for i, e in enumerate(entries):
            out = F.when(F.col("e") == i, value(i, e)).otherwise(out)
        return out

    def earlier(i: int, e: Entry) -> Column:
        return F.array(*[F.get("keys", F.lit(j)) for j, x in enumerate(entries[:i]) if (x.least, x.delta) == (e.least, e.delta)]).cast("array<bigint>")

    rows = met.join(lines, "h1").filter(F.get("keys", F.col("e")) == F.col("key"))
    own = F.array_compact(F.array(*[F.get("keys", F.lit(i)) for i, e in enumerate(entries) if e.own]))
    index = rows.filter(F.col("e").isin(*[i for i, e in enumerate(entries) if e.own]))
    carried = ["h1", "h2", "place", "u", *_LETTERS]
    index = index.select(F.col("key").alias("a_key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("a_chunk"), *[F.col(c).alias(f"a_{c}") for c in carried], own.alias("a_own"))
    probe = rows.select(
        "key", F.pmod("h2", F.col("chunks")).cast("int").alias("chunk"), *[F.col(c).alias(f"b_{c}") for c in carried],
        by_entry(earlier).alias("b_earlier"), by_entry(lambda _, e: F.lit(e.delta)).alias("delta"), by_entry(lambda _, e: F.lit(e.edits)).alias("edits"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probe = probe.repartition(parts, "key", "chunk")  # few rows with much work each: as many tasks as a shuffle has
    ordered = (F.col("delta") > 0) | (F.col("b_h1") > F.col("a_h1")) | ((F.col("b_h1") == F.col("a_h1")) & (F.col("b_h2") > F.col("a_h2")))
    first = ~F.arrays_overlap("a_own", "b_earlier")
    alike = F.lit(True)
    for counts in _LETTERS:
        alike = alike & (_letters_apart(F.col(f"a_{counts}"), F.col(f"b_{counts}")) <= 2 * F.col("edits"))
    near = line_distance(F.col("a_u"), F.col("b_u"), max(e.edits for e in entries)) <= F.col("edits")
    pairs = probe.join(index.hint("merge"), (F.col("key") == F.col("a_key")) & (F.col("chunk") == F.col("a_chunk")) & ordered & first & alike & near)
    sides = F.explode(F.array(*[F.struct(F.col(f"{x}_h1").alias("h1"), F.col(f"{x}_h2").alias("h2"), F.col(f"{y}_place").alias("other")) for x, y in ("ab", "ba")])).alias("s")
    return pairs.select(sides).groupBy("s.h1", "s.h2").agg(F.count(F.lit(1)).alias("n_links"), F.min("s.other").alias("earliest"))


def line_report(docs: DataFrame, threshold: int = 2, min_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of each text: doc_id, line_no, class_doc and
    class_line (where the line first occurs), n_links (other lines within the
    threshold), near_doc and near_line (the first place of the earliest of
    those, if it is before the line's own) and kept.

    A line is kept where it first occurs, unless an earlier line is within the
    threshold. The threshold is one edit where the shorter of two lines has under
    40 characters; lines of one character have classes but no links. A given
    min_chars leaves all shorter lines without links, and one threshold for the
    others. Order is by id, text hash and line number, null ids first. Blank
    lines are kept and have no class; null texts have no lines; rows that share an id and a text count as one
    place, rows that share only an id don't; other columns are ignored; an empty
    table gives no row.
    """
    return _report(docs, threshold, min_chars, id_col, text_col).drop("text_hash")


def _report(docs: DataFrame, threshold: int, min_chars: int | None, id_col: str, text_col: str) -> DataFrame:
    """line_report with the text_hash of the line's own row."""
    entries = entries_of(threshold, min_chars)
    classes = stored(line_classes(docs, entries, id_col, text_col), "lines")
    linked = stored(line_links(docs, classes, entries, id_col, text_col), "linelinks")
    rows = occurrences(docs, id_col, text_col).select("doc_id", "text_hash", "line_no", *_hashes(F.col("line")))
    joined = rows.join(classes.select("h1", "h2", "place"), ["h1", "h2"], "left").join(_small(linked), ["h1", "h2"], "left")
    near = F.when(F.col("earliest") < F.col("place"), F.col("earliest"))
    own = F.struct("doc_id", "text_hash", "line_no")
    return joined.withColumn("near", near).select(
        "doc_id",
        "text_hash",
        "line_no",
        F.col("place.doc_id").alias("class_doc"),
        F.col("place.line_no").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("near.doc_id").alias("near_doc"),
        F.col("near.line_no").alias("near_line"),
        (F.col("place").isNull() | (F.col("near").isNull() & (F.col("place") == own))).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, threshold: int = 2, min_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of each text that line_report keeps; no row goes, and
    every other column stays as it is. Null and blank texts stay; rows that
    share an id and a text lose the same lines; an empty table gives no row."""
    with scratch(docs.sparkSession):
        gone = _report(docs, threshold, min_chars, id_col, text_col).filter(~F.col("kept"))
        gone = stored(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "line_no"), "linesgone", lasting=True)
    few = gone.count() <= BROADCAST_ROWS  # then texts aren't shuffled
    own_id, own_hash, lines = unused(docs, "_id", "_hash", "_gone")
    gone = gone.groupBy(F.col("_id").alias(own_id), F.col("_hash").alias(own_hash)).agg(F.collect_set("line_no").alias(lines))
    gone = F.broadcast(gone) if few else gone
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    joined = docs.join(gone, same & F.col(lines).isNotNull(), "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains(F.col(lines), i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
