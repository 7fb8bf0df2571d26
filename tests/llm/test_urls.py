import re

import pytest

from tessera.llm import queries, urls

URLS = [
    None, "", "no scheme /ads/", "http://", "http://com", "http://com/", "https://A.Example.COM/en/1", "https://www.example.com/en/1", "https://x.www.example.com/en/", "https://example.com/en", "https://example.com/EN/",
    "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/fr?x=/fr/", "http://a.net/de/", "http://a.org/ads/1", "http://a.org/lads/1", "http://a.org/x?PHPSESSID=1", "http://a.org/ad-3x.js?v=1", "http://user@h.net/es/#f", "http://h:80/login",
    "http://a.com://b/es/", "ftp://b.net/es/x y\nz", "http://ex.com/" + "a" * 100_000, "http://é.net/es/", "http://a.org/search?q=casino", "http://a.org#/es/", "http://a.net?/es/",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for r in urls.HOST_RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    low = (url or "").lower()
    hit = any(re.search(r.regex(), low, re.S) for r in urls.PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def test_against_trying_every_rule(spark):
    rows = [(i if i else None, u) for i, u in enumerate(URLS)] + [(5, URLS[5]), (5, URLS[5])]
    df = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in rows], "page_id long, url string, host string, token string, row int")
    got = urls.judged(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain(u)) for i, u in rows), key=str)
    assert urls.judged(df.where("false")).count() == 0


def test_sf_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = queries.op10_url_filter(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((p.page_id, *plain(p.url)) for p in pages)


def test_tokens_must_stand_alone(spark):
    assert urls.Rule("block", "/ad^*.js^").tokens() == ["ad", "js"]
    assert urls.Rule("block", "foo*bar/").tokens() == []
    assert urls.Rule("block", "||example.com/en/").tokens() == ["example", "com", "en"]
    with pytest.raises(ValueError, match="stands alone"):
        urls.judged(spark.createDataFrame([], "page_id long, url string"), (urls.Rule("block", "*a*"),))


def test_no_python_in_the_plan(spark):
    plan = urls.judged(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rules_without_a_token_run_on_all_rows(spark, monkeypatch):
    rules = (*urls.RULES, urls.Rule("block", "*q=ca*"), urls.Rule("allow", "||"), urls.Rule("block", "*lads*1"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")

    def tried(url):
        host, path, _, _ = plain(url)
        fits = [(r.anchored, len(r.name), r.name, r.verdict) for r in rules if re.search(r.regex(), host + path if r.anchored else (url or "").lower(), re.S)]
        best = max(fits, default=None)
        return best and best[0] and best[2] or None if best else None, best[3] if best else "allow"

    got = {r.page_id: (r.rule or None, r.verdict) for r in urls.judged(df, rules, scan_bare=True).collect()}
    assert got == {i: tried(u) for i, u in enumerate(URLS)}
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    assert {r.page_id: (r.rule or None, r.verdict) for r in urls.judged(df, rules, scan_bare=True).collect()} == got
