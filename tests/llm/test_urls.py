import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import urls

CASES = [
    ("HTTP://M.Example.NET/en/1?q=/x#y", "m.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.net/", "a.net", "/", "net/", "block"),
    ("http://a.net", "a.net", "", None, None),
    ("http://net/x", "net", "/x", "net/", "block"),
    ("http://anet/x", "anet", "/x", None, None),
    ("https://sub.example.com/de/9", "sub.example.com", "/de/9", "example.com/de/", "block"),
    ("https://sub.example.com/DE/9", "sub.example.com", "/DE/9", None, None),
    ("https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("https://xorg/fr/", "xorg", "/fr/", None, None),
    ("http://É.NET?x://y/z", "É.net", "", None, None),
    ("//a.net/b", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("x://a.net:80/p#?", "a.net:80", "/p", None, None),
    ("a://b://c.net/d", "b:", "//c.net/d", None, None),
]


def numpy_model(labelled, grams, buckets, rounds=100, rate=4.0, l2=5e-4):
    x = np.zeros((len(labelled), buckets + 1))
    y = np.array([label for _, label in labelled], float)
    for i, (url, _) in enumerate(labelled):
        x[i, grams[url]] = 1 / np.sqrt(len(grams[url]))
        x[i, buckets] = 1
    w = np.zeros(buckets + 1)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-x @ w)) - y
        w -= rate * (x.T @ error / len(y) + l2 * w)
    return w


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    return {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}


def test_parts_and_rules(judged):
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = judged[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), CASES[i]
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_fit_against_numpy(spark):
    labelled = list(urls.LABELLED_URLS)
    df = spark.createDataFrame(labelled, "url string, junk int")
    df = df.select("url", urls.ngram_buckets(urls.host_of(F.col("url")), urls.path_of(F.col("url")), 4096).alias("g"))
    grams = {r["url"]: r["g"] for r in df.collect()}
    expected = numpy_model(labelled, grams, 4096)
    got = np.array(urls.fit(spark).first()["weights"])
    assert np.abs(got - expected).max() < 1e-9


def test_held_out_hosts(spark):
    junk = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com", "spam-farm.example.com"]
    clean = ["reading-room.example.com", "thorough.example.com", "oldstation.example.com", "botany.example.com"]
    rows = [(h, f"http://{h}/en/77") for h in junk + clean]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id string, url string")).collect()}
    assert [got[h] for h in junk] == ["block"] * 5 and [got[h] for h in clean] == ["allow"] * 4


def test_empty_table_and_extra_columns(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x", "r", "v", 1)], "page_id long, url string, rule string, verdict string, host int")
    assert urls.judge_urls(pages).first()["verdict"] == "block" and urls.judge_urls(pages.limit(0)).count() == 0
