import pytest

from tidewater.llm import url_filter
from tidewater.llm.queries import QUERIES, URL_RULES, URLS_SQL

URLS = ["https://Example.ORG/es/1", "http://a.example.org/es/x?q=1", "https://example.org/en/12", "https://b.example.org/en/2", "https://x.com/fr/", "https://x.com/fr",
        "https://x.com/de/1#top", "https://COM/de/", "https://notexample.org/es/", "https://example.net/es/", "no scheme at all", "", None, "http://", "://org/", "x://org",
        "http://org?x=/", "http://u@example.org/es/", "http://example.org:80/es/", "a://b://c.org/d", "http://exämple.org/ÄÖ", "https://example.org/ES/", "http://com.org.com/fr/de/"]


def brute(url, rules, listed=()):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else ("block" if url in listed else "allow")


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, key string")


def judged(spark, urls, entries):
    out = url_filter.judged(spark, frame(spark, urls), entries).collect()
    return [tuple(r)[1:] for r in sorted(out, key=lambda r: r.page_id)]


def test_rules(spark):
    out = judged(spark, URLS, url_filter.rules(spark, URL_RULES))
    assert [(h, p, r, v) for h, p, r, _, v in out] == [brute(u, URL_RULES) for u in URLS]


def test_rules_of_many_shapes(spark):
    rules = [("b.c", "/x", "block"), ("a.b.c", "/", "allow"), ("c", "/x/y", "block"), ("a.b.c", "", "block"), ("B.C", "/x/y", "allow"), ("z", "/" + "p" * 300, "block"), ("ab", "c/", "block")]
    urls = [f"http://{h}{p}" for h in ("c", "b.c", "a.b.c", "q.a.b.c", "xb.c", "z", "abc", "a.bc") for p in ("", "/", "/x", "/x/y", "/x/yz", "/" + "p" * 400, "c/", "/c/")]
    low = [(h.lower(), p, v) for h, p, v in rules]
    out = judged(spark, urls, url_filter.rules(spark, rules))
    assert [(h, p, r, v) for h, p, r, _, v in out] == [brute(u, low) for u in urls]


def test_listed_pages(spark):
    pages = ["http://www.bad.net/a/?b=2&a=1&utm_source=x#top", "https://bad.net:443/c", None, "nothing", "http://worse.net"]
    entries = url_filter.pages_list(frame(spark, pages), "url", "block").unionAll(url_filter.rules(spark, [("bad.net", "/c", "allow")]))
    urls = ["https://BAD.net/a?a=1&b=2", "http://bad.net/a?a=1&b=3", "http://bad.net/a", "https://bad.net/c/", "https://bad.net/c/d", "http://user@www.worse.net:80/?ref=1", "nothing", None]
    out = judged(spark, urls, entries)
    assert [(r, on, v) for _, _, r, on, v in out] == [(None, True, "block"), (None, False, "allow"), (None, False, "allow"), ("bad.net/c", True, "allow"), ("bad.net/c", False, "allow"),
                                                     (None, True, "block"), (None, False, "allow"), (None, False, "allow")]


@pytest.mark.parametrize("blocks", [1, 2, 64])
def test_filter_loses_nothing_and_stops_most(spark, blocks):
    keys = spark.range(60).selectExpr("concat('key ', id) AS key")
    held = url_filter.bloom(keys, blocks)
    assert held.count() <= blocks
    tried = spark.range(2000).selectExpr("concat('key ', id) AS key")
    passed = {r.key for r in url_filter.passing(tried, held, blocks).collect()}
    assert {f"key {k}" for k in range(60)} <= passed
    if blocks >= 2:
        assert len(passed) < 80


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 1)  # a filter so full that it passes everything
    pages = [f"http://n{k}.net/p" for k in range(3000)]
    entries = url_filter.pages_list(frame(spark, pages[:1500]), "url", "block")
    assert [v for *_, v in judged(spark, pages, entries)] == ["block"] * 1500 + ["allow"] * 1500


def test_hot_pages_and_long_urls(spark):
    urls = ["http://hot.org/es/"] * 500 + ["http://" + "a." * 20_000 + "org/x", "http://h.com/fr/" + "y" * 50_000, "http://h.net/?" + "&".join(f"k{k}=1" for k in range(5000))]
    out = judged(spark, urls, url_filter.rules(spark, URL_RULES))
    assert [(h, p, r, v) for h, p, r, _, v in out] == [brute(u, URL_RULES) for u in urls]


def test_empty(spark):
    none = url_filter.rules(spark, URL_RULES).limit(0)
    assert judged(spark, [], url_filter.rules(spark, URL_RULES)) == []
    assert [v for *_, v in judged(spark, URLS, none)] == ["allow"] * len(URLS)
    odd = spark.createDataFrame([(None, "/x", None, "block"), ("", "/", None, "block"), (None, None, None, None), ("org", None, None, "block"), ("net", "/", None, None)],
                                "host string, path string, page string, verdict string")
    assert [v for *_, v in judged(spark, ["http://a.org/x", "http://a.net/"], odd)] == ["block", "allow"]


def test_query_on_small_tables(spark, duck):
    from compare import compare

    assert compare(QUERIES["op13_urls"](spark, "/root/testdata/sf0.001"), URLS_SQL, duck)["ok"]


def test_native(spark):
    plan = url_filter.judged(spark, frame(spark, URLS), url_filter.rules(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
