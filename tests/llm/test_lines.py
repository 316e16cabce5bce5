import random

import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm import lines


def distance(a, b, limit=99):
    """Edit distance, or more than the limit if it is more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > limit:
            return limit + 1
    return row[-1]


def mutated(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(chars))
        kind = rng.random()
        if kind < 0.4 or not chars:
            chars.insert(at, rng.choice("abcé"))
        elif kind < 0.7:
            chars.pop(min(at, len(chars) - 1))
        else:
            chars[min(at, len(chars) - 1)] = rng.choice("abcé😀")
    return "".join(chars)


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abc😀") for _ in range(rng.randint(0, 12)))
        pairs.append((a, mutated(rng, a, rng.randint(0, 4))))
    for threshold in (1, 2, 3):
        df = spark.createDataFrame(pairs, "a string, b string")
        df = df.select("a", "b", lines.units(F.col("a")).alias("x"), lines.units(F.col("b")).alias("y"))
        plain = lines.banded_distance(lines.characters(F.col("x")), lines.characters(F.col("y")), threshold)
        for r in df.select("a", "b", plain.alias("d"), lines.line_distance(F.col("x"), F.col("y"), threshold).alias("cut")).collect():
            true = distance(r["a"], r["b"])
            assert r["d"] == r["cut"] == (true if true <= threshold else None)


def make_lines(rng):
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 120))) for _ in range(25)]
    return base + [mutated(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(80)] + ["short", "shirt", "short", "", "  "]


def brute(docs, threshold, min_chars):
    first = {}
    for doc, text in docs:
        for no, line in enumerate(text.split("\n")):
            if line.strip() and (line not in first or (doc, no) < first[line]):
                first[line] = (doc, no)
    near = [x for x in first if len(x) >= min_chars]
    links = {x: [y for y in near if y != x and abs(len(x) - len(y)) <= threshold and distance(x, y, threshold) <= threshold] for x in near}
    out = {}
    for doc, text in docs:
        for no, line in enumerate(text.split("\n")):
            place, mine = first.get(line), links.get(line, [])
            earliest = min((first[y] for y in mine), default=None)
            earliest = earliest if earliest and earliest < place else None
            out[doc, no] = (place, len(mine), earliest, place is None or (place == (doc, no) and earliest is None))
    return out


def test_report_against_brute_force(spark):
    rng = random.Random(3)
    every = make_lines(rng)
    rng.shuffle(every)
    docs = [(i, "\n".join(every[i * 10 : i * 10 + 10])) for i in range(11)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (1, 2):
        expected = brute(docs, threshold, 40)
        got = lines.line_report(df, threshold, 40).collect()
        assert len(got) == len(expected)
        for r in got:
            place = (r["class_doc"], r["class_line"]) if r["class_doc"] is not None else None
            near = (r["near_doc"], r["near_line"]) if r["near_doc"] is not None else None
            assert (place, r["n_links"], near, r["kept"]) == expected[r["doc_id"], r["line_no"]]
        assert any(v[2] for v in expected.values())


def test_lines_go_and_rows_stay(spark, odd_docs, no_docs):
    out = lines.without_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 10
    texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id is not null").collect()}
    assert texts[1] == "the quick brown fox jumps over the lazy dog near the old stone bridge\nshort\n"
    assert texts[2] == "" and texts[3] is None and texts[4] == "" and texts[5] == " \n\t "
    assert lines.without_repeated_lines(no_docs).count() == 0 and lines.line_report(no_docs).count() == 0


def test_many_variants_of_a_line(spark):
    """Variants that share segments but aren't near don't make links."""
    stem = "a line that very many documents share, but for one word: "
    rows = [(i, f"{stem}{chr(97 + i % 26) * 6}{i:05d} and its end") for i in range(120)]
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string"), 2, 40).collect()
    expected = brute(rows, 2, 40)
    assert {(r["doc_id"], r["n_links"]) for r in got} == {(d, v[1]) for (d, _), v in expected.items()}


def test_rows_are_known_by_id_and_text(spark):
    """Null and repeated ids with different texts lose their own lines only."""
    long = "a footer line of more than forty characters, page 1"
    docs = [(None, f"{long}\nfirst own"), (None, f"{long}\nsecond own"), (None, "third own\nfirst own"), (7, f"{long[:-1]}2\nfourth own"), (7, "fifth own\nfourth own\nlast")]
    out = lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = [x for r in out for x in r["text"].split("\n") if x]
    assert len(out) == 5 and sorted(x for x in left if x != long) == ["fifth own", "first own", "fourth own", "last", "second own", "third own"]
    assert left.count(long) == 1


def test_short_lines_link_at_one_edit(spark):
    """All lines of 2 characters or more, by the length of the shorter one."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 38, 39, 40, 41, 60]))) for _ in range(60)]
    every = [x for x in base + [mutated(rng, rng.choice(base), rng.randint(1, 3)) for _ in range(120)] if "\n" not in x]
    footers = ["A footer of thirty-nine characters: p 1", "A footer of thirty-nine characters: p 2"]
    rows = [(i, x) for i, x in enumerate(every + footers)]
    first = {}
    for i, x in rows:
        if x.strip():
            first.setdefault(x, i)
    got = {r["doc_id"]: r for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = 0
    for i, x in rows:
        near = [y for y in first if x.strip() and y != x and min(len(x), len(y)) >= 2 and distance(x, y, 2) <= (1 if min(len(x), len(y)) < 40 else 2)]
        short += len(x) < 40 and bool(near)
        earlier = min([first[y] for y in near if first[y] < first[x]], default=None)
        assert (got[i]["n_links"], got[i]["near_doc"]) == (len(near), earlier), x
    assert short > 40 and not got[len(rows) - 1]["kept"]


def test_thousands_of_near_equal_lines(spark):
    """Numbered boilerplate: all lines share segments, and no pair is stored."""
    stem, end = "this page was left blank on purpose, see the notice on page ", " of the printed volume"
    rows = [(i, f"{stem}{i:05d}{end}") for i in range(5000)]
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = {r["doc_id"]: (r["n_links"], r["near_doc"]) for r in got.collect()}
    pages = duckdb.sql("SELECT i, printf('%05d', i) AS n FROM range(5000) t(i)")  # what all lines share doesn't change a distance
    assert len(pages.columns) == 2
    near = duckdb.sql("SELECT a.i, count(*) AS links, min(b.i) AS first FROM pages a, pages b WHERE a.i != b.i AND levenshtein(a.n, b.n) <= 2 GROUP BY a.i").fetchall()
    assert got == {i: (n, first if first < i else None) for i, n, first in near}
