"""Rules and the filter cascade against plain sets."""

from pyspark.sql import functions as F

from tidemark.llm import url_filter as U
from tidemark.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme/here", "http://", "https://A.Example.ORG/es/1", "http://example.org/en/1x", "http://example.org/en/2?q=://x", "HTTP://Foo.com/fr/?a#b",
    "http://foo.com/de/", "http://foo.com/de", "http://notexample.org/es/", "http://xcom/fr/", "ftp://a.b.com?x=/fr/", "http://é.ORG/path#frag/es/", "a://b://c/d", "http://ÄB.com/FR/",
]


def plain(url):
    _, found, rest = (url or "").partition("://")
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    path = path[:stop]
    if not found:
        host = path = ""
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "###" * (i % 3), "k") for i, u in enumerate(urls)], "page_id long, url string, html string, key string")


def judged(df, **options):
    return df, {r.page_id: r for r in U.judge_urls(df, URL_RULES, F.col("html").contains("######"), **options).collect()}


def check(urls, got):
    listed = {plain(u)[0] + plain(u)[1] for i, u in enumerate(urls) if i % 3 == 2}
    for i, u in enumerate(urls):
        host, path, best = plain(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best.text), u
        assert r.listed == (host + path in listed)
        assert r.verdict == (best.verdict if best else "block" if r.listed else "allow")


def test_rules_and_membership(spark):
    urls = URLS + [f"http://h{i % 97}.net/p{i % 41}" for i in range(3000)] + ["http://h1.net/p1"] * 5
    _, got = judged(pages(spark, urls))
    check(urls, got)
    _, by_join = judged(pages(spark, urls), max_words=1)
    check(urls, by_join)


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    cascade = U.build_cascade(keys)
    assert len(cascade.levels) >= 3
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = U.judge_urls(pages(spark, URLS), URL_RULES, F.lit(True))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan.split("Physical Plan")[-1]


def test_nothing_listed_and_empty(spark):
    df = pages(spark, URLS)
    assert not any(r.listed for r in U.judge_urls(df, [], F.lit(None).cast("boolean")).collect())
    assert U.judge_urls(df.limit(0), URL_RULES, F.lit(True)).count() == 0
