import random

import pytest
from pyspark.sql import functions as F

from evalsweep.llm import url_filter
from evalsweep.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com?x=/en/", "https://example.com/en/",
    "https://x.EXAMPLE.com/en/1#top", "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://net/es/",
    "http://a.net/es", "http://a.net/fr/?q", "http://anet/fr/", "http://a.net//es/", "http://spam.net/de/",
    "http://a.example.org/en/", "://b.net/es/x", "x://y://com/", "http://a.com:80/", "http://É.COM/", "http://a..com/",
]


def judged(url, blocked):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if fits:
        rule = max(fits, key=lambda r: len(r.key))
        return host, path, rule.key, rule.verdict
    return host, path, None, "block" if host in blocked else "allow"


@pytest.fixture()
def pages(spark):
    rows = [(i, url, "html", "clash") for i, url in enumerate([*URLS, URLS[8]])] + [(None, URLS[7], None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string")


def test_verdicts_equal_brute_force(spark, pages):
    blocked = spark.createDataFrame([("spam.net",), ("a.com",), ("elsewhere.org",), (None,)], "key string")
    out = url_filter.judge_urls(pages, URL_RULES, blocked).collect()
    assert len(out) == pages.count()
    for row in out:
        url = URLS[7] if row["page_id"] is None else [*URLS, URLS[8]][row["page_id"]]
        expected = judged(url, {"spam.net", "a.com"})
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == expected, url


def test_empty_tables_and_lists(spark, pages):
    nothing = spark.createDataFrame([], "key string")
    assert url_filter.judge_urls(pages.filter("false"), URL_RULES, nothing).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, (), nothing).collect()} == {"allow"}


@pytest.mark.parametrize("n_listed", [0, 1, 40, 700])
def test_a_cascade_is_exact_on_its_universe(spark, n_listed):
    keys = [f"host{i}.example" for i in range(3000)]
    listed = set(random.Random(3).sample(keys, n_listed))
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = url_filter.fit_cascade(universe)
    wrong = universe.filter(cascade.contains(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0
    assert n_listed < 700 or len(cascade.levels) > 1


@pytest.mark.parametrize("most", [256])
def test_long_lists_are_cut_into_slices_and_stay_exact(spark, pages, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_BITS", most)
    keys = [f"host{i}.example" for i in range(3000)]
    listed = set(random.Random(5).sample(keys, 900))
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = url_filter.fit_cascade(universe)
    assert all(level.bits <= most for level in cascade.levels)
    assert len(cascade.levels[0].slices) > 900 // most
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    blocked = spark.createDataFrame([("spam.net",), *[(f"other{i}.org",) for i in range(300)]], "key string")
    out = url_filter.judge_urls(pages, URL_RULES, blocked).filter("host in ('spam.net', 'a.com')")
    assert {(r["host"], r["verdict"]) for r in out.collect()} >= {("spam.net", "block"), ("a.com", "allow")}


def test_the_main_path_is_native(spark, pages, capsys):
    out = url_filter.judge_urls(pages, URL_RULES, spark.createDataFrame([("spam.net",)], "key string"))
    out.explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Join", "Python", "Arrow", "Exchange"))
