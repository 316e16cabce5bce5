"""URL filters: rules by host and path, and logistic regression on hashed
character n-grams of host and path, both in SQL functions.

The model is fitted by full-batch gradient descent over a small labelled URL
table: one row holds the examples, one array the weights, and each round is an
array expression. Everything that touches `pages` is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, let

# Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The labelled URL table, 1 for junk.
LABELLED_URLS = (
    ("http://casino-royal.example.com/en/1", 1), ("https://www.best-casino.example.org/de/22", 1),
    ("http://online-casino.example.com/play?bonus=1", 1), ("http://win-casino-win.example.com/fr/8", 1),
    ("https://m.win-big.example.org/es/9", 1), ("http://casino.example.org/win/7", 1),
    ("http://free-bets-now.example.com/en/2", 1), ("https://sports-bets.example.org/en/3", 1),
    ("http://bets.example.com/free/11", 1), ("https://www.free-spins.example.com/de/4", 1),
    ("http://m.bets-online.example.org/fr/541", 1), ("http://free-cash.example.com/es/2", 1),
    ("http://cheap-meds.example.com/en/5", 1), ("https://pills-online.example.org/fr/6", 1),
    ("http://buy-pills.example.com/cheap/1", 1), ("http://cheap-replica.example.org/de/77", 1),
    ("https://blog.diet-pills.example.com/es/8", 1), ("http://pills.example.org/en/300", 1),
    ("http://ads-server.example.com/en/9", 1), ("https://track-ads.example.org/click/10", 1),
    ("http://ads.example.com/track?id=3", 1), ("http://m.ad-tracker.example.org/en/52", 1),
    ("https://popup-ads.example.com/fr/91", 1), ("http://click-track.example.com/de/12", 1),
    ("http://spam-links.example.com/en/13", 1), ("https://link-farm.example.org/es/14", 1),
    ("http://spam.example.com/farm/15", 1), ("http://content-farm.example.org/en/616", 1),
    ("http://www.seo-spam.example.com/de/401", 1), ("http://blog.spam-blog.example.org/fr/3", 1),
    ("http://adult-video.example.com/en/16", 1), ("https://xxx-adult.example.org/fr/17", 1),
    ("http://adult.example.com/x/18", 1), ("https://m.adult-x-chat.example.org/de/9", 1),
    ("http://x-cams.example.com/es/77", 1), ("http://www.adult-dating.example.org/en/80", 1),
    ("http://library.example.com/en/1", 0), ("https://www.university.example.org/de/22", 0),
    ("http://news.example.com/en/825?page=2", 0), ("https://blog.garden.example.org/es/853/", 0),
    ("http://museum.example.com/fr/8", 0), ("https://m.weather.example.org/es/9", 0),
    ("http://thehistory.example.com/en/2", 0), ("https://thenation.example.org/en/3", 0),
    ("http://theother.example.com/en/11#top", 0), ("https://www.tradition.example.com/de/4", 0),
    ("http://m.station.example.org/fr/541", 0), ("http://motion.example.com/es/2.html", 0),
    ("http://recipes.example.com/en/5", 0), ("https://physics.example.org/fr/6", 0),
    ("http://mathematics.example.com/notes/1", 0), ("http://railway.example.org/de/77", 0),
    ("https://blog.thermal.example.com/es/8", 0), ("http://thatched.example.org/en/300", 0),
    ("http://docs.example.com/en/9", 0), ("https://archive.example.org/papers/10", 0),
    ("http://anthology.example.com/en/3?utm_source=feed", 0), ("http://m.theatre.example.org/en/52", 0),
    ("https://nationalpark.example.com/fr/91", 0), ("http://education.example.com/de/12", 0),
    ("http://orchestra.example.com/en/13", 0), ("https://translation.example.org/es/14", 0),
    ("http://inheritance.example.com/en/15", 0), ("http://therapist.example.org/en/616", 0),
    ("http://www.rendering.example.com/de/401", 0), ("http://blog.kitchen.example.org/fr/3", 0),
    ("http://healthcare.example.com/en/16", 0), ("https://astronomy.example.org/fr/17", 0),
    ("http://elections.example.com/results/18", 0), ("https://m.theironing.example.org/de/9", 0),
    ("http://fiction.example.com/es/77", 0), ("http://www.erosion.example.org/en/80", 0),
)


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; empty where the url is null or has no `://`."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, and
    the url's path starts with its path. Null without one."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ngram_buckets(host: Column, path: Column, buckets: int, sizes=(3, 4, 5)) -> Column:
    """Distinct hash buckets of the character n-grams of `^host$` and of `/path$`."""

    def grams(mark: str, text: Column, n: int) -> Column:
        positions = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(positions, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    whole_host, whole_path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    each = [grams("h", whole_host, n) for n in sizes] + [grams("p", whole_path, n) for n in sizes]
    return F.array_sort(F.array_distinct(F.concat(*each)))


def _logit(grams: Column, weights: Column, buckets: int) -> Column:
    """Sum of the weights over the root of the number of grams, plus the bias,
    which is the last weight."""
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(weights, g))
    return total / F.sqrt(F.size(grams).cast("double")) + F.get(weights, F.lit(buckets))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(spark: SparkSession, labelled=LABELLED_URLS, buckets: int = 4096, rounds: int = 100, rate: float = 4.0, l2: float = 5e-4) -> DataFrame:
    """One row with `weights`, an array of buckets + 1 doubles.

    The labelled table is a bounded parameter (some hundred rows), so its one
    row of examples is too.
    """
    urls = spark.createDataFrame(list(labelled), "url string, junk int")
    grams = urls.select("url", "junk", ngram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("grams"))
    examples = grams.agg(F.array_sort(F.collect_list(F.struct("url", "junk", "grams"))).alias("xs"))
    numbered = examples.select("xs", F.posexplode("xs").alias("at", "x"))
    has = numbered.select(F.explode(F.concat("x.grams", F.array(F.lit(buckets)))).alias("bucket"), "at", F.size("x.grams").alias("n"))
    has = has.groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("bucket") == buckets, 1.0).otherwise(1 / F.sqrt(F.col("n").cast("double"))).alias("v")))).alias("of")
    )
    # both tables have one row in the end; they meet as parts of one aggregate
    parts = examples.select("xs", F.lit(None).cast("struct<bucket:int,of:array<struct<at:int,v:double>>>").alias("b"))
    parts = parts.unionByName(has.select(F.struct("bucket", "of").alias("b")), allowMissingColumns=True)
    both = parts.agg(F.first("xs", ignorenulls=True).alias("xs"), F.map_from_entries(F.collect_list("b")).alias("lists"))
    row = both.select(
        "xs",
        F.transform(
            F.sequence(F.lit(0), F.lit(buckets)),
            lambda b: F.coalesce(F.col("lists")[b], F.array().cast("array<struct<at:int,v:double>>")),
        ).alias("of"),
    )
    n = F.size("xs").cast("double")

    def one_round(weights: Column) -> Column:
        errors = F.transform("xs", lambda x: _sigmoid(_logit(x["grams"], weights, buckets)) - x["junk"])

        def moved(error: Column) -> Column:
            return F.transform(
                F.col("of"),
                lambda of, b: F.get(weights, b)
                - F.lit(rate)
                * (F.aggregate(of, F.lit(0.0), lambda acc, e: acc + F.get(error, e["at"]) * e["v"]) / n + F.lit(l2) * F.get(weights, b)),
            )

        return let(errors, moved)

    start = F.array_repeat(F.lit(0.0), buckets + 1)
    return row.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda w, _: one_round(w)).alias("weights"))


def judge_urls(pages: DataFrame, rules=RULES, labelled=LABELLED_URLS, buckets: int = 4096, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every page.

    A null url, or one without `://`, has an empty host and path, fits no rule
    and is judged by the model. Ids may be null or repeat; other columns are
    ignored; an empty table gives no row. The weights (buckets + 1 doubles,
    whatever the size of pages) pass through the driver as a literal.
    """
    weights = F.lit([float(w) for w in fit(pages.sparkSession, labelled, buckets).first()["weights"]])
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    scored = parts.select(
        "*",
        rule_of(F.col("host"), F.col("path"), rules).alias("rule"),
        _sigmoid(_logit(ngram_buckets(F.col("host"), F.col("path"), buckets), weights, buckets)).alias("score"),
    )
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), F.round("score", 6).alias("score"))
