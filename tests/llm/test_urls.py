import re

from sealtrail.llm import bloom
from sealtrail.llm import urls as U

URLS = [
    None, "", "no scheme", "http://", "http:///path", "HTTPS://Www.Example.NET/en/1?utm_source=a&b=2#x", "ftp://net", "http://net/",
    "http://a.example.net/en", "http://a.example.net/en/", "http://example.com/de/1.html", "http://xexample.com/de/1",
    "http://deep.er.org/fr/2/", "http://org/fr", "http://user@host.net:80/p", "http://x.net?q=http://y.org/fr/",
    "http://ÄÖ.net/en/\nzwei", "a://b://c.net/", "http://www.listed.org/a/?ref=1&z=2&a=1", "https://listed.org/a?a=1&z=2",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules_match_brute_force(spark, table):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[7], None), (5, URLS[5], "again")]
    pages = table(rows, "page_id long, url string, host string")
    listed = table([("listed.org/a?a=1&z=2",), (None,)], "canonical_url string")
    out = U.judge_urls(pages, U.rule_table(spark), listed).collect()
    assert len(out) == len(rows)
    for row in out:
        url = URLS[7 if row.page_id is None else row.page_id]
        host, path, rule, verdict = judged(url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        in_list = bool(url) and "listed.org" in url
        assert row.listed == in_list
        assert row.verdict == (verdict or ("block" if in_list else "allow"))


def test_a_crowded_filter_only_costs_time(spark, table):
    pages = table(list(enumerate(URLS)), "page_id long, url string")
    listed = table([(f"host{i}.org/x",) for i in range(500)] + [("listed.org/a?a=1&z=2",)], "canonical_url string")
    wide = U.judge_urls(pages, U.rule_table(spark), listed)
    tight = U.judge_urls(pages, U.rule_table(spark), listed, blocks=1)
    assert sorted(map(str, wide.collect())) == sorted(map(str, tight.collect()))


def test_bloom_filter_never_loses_a_key(spark):
    keys = spark.range(2000).selectExpr("cast(id as string) AS k")
    known = bloom.build(keys, "k", blocks=256)
    assert known.count() <= 256
    assert bloom.possible(keys, "k", known, blocks=256).count() == 2000
    others = spark.range(10_000, 20_000).selectExpr("cast(id as string) AS k")
    assert bloom.possible(others, "k", known, blocks=256).count() < 3000


def test_empty_tables(spark, table):
    none = table([], "page_id long, url string")
    assert U.judge_urls(none, U.rule_table(spark), table([], "canonical_url string")).count() == 0
    rules = U.rule_table(spark).limit(0)
    only = U.judge_urls(table([(1, "http://net/")], "page_id long, url string"), rules, table([], "canonical_url string"))
    assert only.first().verdict == "allow"
