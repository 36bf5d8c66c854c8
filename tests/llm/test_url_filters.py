"""URL verdicts against a plain computation; the filter may pass too much, the join may not."""

import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import url_filters as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme/x", "http://", "http://NET", "http://net/", "https://a.b.NET/x?y#z", "http://example.net/en/1", "http://notexample.net/en/1",
    "http://example.com/de/", "http://example.com/de", "http://xexample.com/de/q", "http://a.org/fr/1", "http://org/fr/", "http://torg/fr/", "ftp://x://y/z",
    "http://www.spam.io/a/?b=2&a=1&utm_source=x", "https://SPAM.io:443/a?a=1&b=2#frag", "http://spam.io/a/index.html?b=2&&a=1", "http://spam.io/A?a=1&b=2",
    "http://spam.io/a?a=1", "http://k\n.io/p", "http://" + "y" * 50_000 + "/p",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = rest.split("#")[0].partition("?")[2]
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[a-z]+|ref|fbclid|gclid)(=|$)", p))
    bare = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", host))
    canonical = bare + re.sub(r"/+(index\.html?)?$", "", path) + ("?" + "&".join(kept) if kept else "")
    return host, path, canonical if host else None


def judged(urls, listed):
    known = {plain(u)[2] for u in listed} - {None}
    out = []
    for i, u in enumerate(urls):
        host, path, canonical = plain(u)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "block" if canonical in known else "allow")
        out.append((i, host, path, *rule, canonical in known))
    return out


@pytest.mark.parametrize("blocks", [1, 1 << 17])
@pytest.mark.parametrize("extra", [0, 3000])
def test_verdicts(spark, monkeypatch, blocks, extra):
    monkeypatch.setattr(U, "MAX_BLOCKS", blocks)
    urls = URLS + [f"http://h{i}.io/p" for i in range(300)]
    listed = ["http://spam.io/a?a=1&b=2", "http://k\n.io/p", "http://" + "y" * 50_000 + "/p/", None, "x", "http://h7.io/p/"] + [f"http://z{i}.io/" for i in range(extra)]
    pages = spark.createDataFrame([(i, u, "c", "w", "r") for i, u in enumerate(urls)], "page_id long, url string, canonical string, w0 string, rule string")
    got = U.judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES)
    assert sorted(tuple(r) for r in got.collect()) == judged(urls, listed)


def test_repeated_rows_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.io/x")] * 40 + [(1, None), (1, "http://a.io/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert {(r.verdict, r.listed) for r in U.judge_urls(pages, none, []).collect()} == {("allow", False)}
    got = U.judge_urls(pages, spark.createDataFrame([("https://www.a.io/x/",)], "url string"), []).groupBy("page_id", "verdict").count()
    assert {tuple(r) for r in got.collect()} == {(None, "block", 40), (1, "allow", 1), (1, "block", 1)}
    assert U.judge_urls(pages.limit(0), none, RULES).collect() == []


def test_the_filter_stops_nearly_all_others_and_none_of_its_own(spark):
    own = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("u"))
    marked = U.BlockedBloom(own, "u").mark(spark.range(40_000).select("id", F.concat(F.lit("u"), "id").alias("u")), "u", "hit")
    hits = {r.mine: r.n for r in marked.where("hit").groupBy((F.col("id") < 20_000).alias("mine")).agg(F.count("*").alias("n")).collect()}
    assert hits[True] == 20_000 and hits.get(False, 0) < 100


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.io/x")], "page_id long, url string")
    plan = U.judge_urls(pages, pages.select("url"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
