"""URL rules against a rule-by-rule version."""

import re

from ferrybook.llm.url_filters import RULES, judge_urls, rule_table

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.net/x", "HTTP://A.NET/x?q",
    "https://example.net/en/1", "https://www.example.net/en/1#t", "https://example.net/e", "x://example.net/en",
    "http://notexample.net/en/", "http://example.com/de/a/b", "http://m.example.com/de", "http://example.com?/de/",
    "http://org/fr/", "http://a.b.org/fr/x", "http://a.b.org/FR/x", "http://example.net:80/en/", "http://a..net/",
    "http://-.net/", "http://xnet/", "http://example.net./en/", "a://b://net/", "http://ex-ample.net/en/",
]


def plain(url, rules=RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def judged(spark, urls, rules=RULES, **options):
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr(
        "*", "'x' as host", "'y' as path", "'z' as key", "1 as salt", "'w' as stack", "0 as id"
    )
    return judge_urls(df, rule_table(spark, rules), **options)


def test_equals_plain_version(spark):
    got = {r.page_id: tuple(r)[2:] for r in judged(spark, URLS).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_nested_rules_close_in_order(spark):
    rules = [
        ("block", "com", "/"), ("allow", "a.com", "/"), ("block", "b.a.com", "/x"), ("allow", "b.a.com", "/x/y"),
        ("block", "c.com", ""), ("allow", "com", "/deep/er"), ("block", "a.com", "/"),
    ]
    urls = [f"h://{h}{p}" for h in ("com", "a.com", "b.a.com", "z.b.a.com", "aa.com", "c.com", "b.com", "d.c.com")
            for p in ("", "/", "/x", "/x/y/z", "/deep/er")]
    got = {r.page_id: tuple(r)[2:] for r in judged(spark, urls, rules, salts=3).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_repeated_rows_empty_tables_and_no_rules(spark):
    page = spark.createDataFrame([(1, "h://a.net/")] * 3, "page_id long, url string")
    assert judge_urls(page, rule_table(spark, RULES)).count() == 3
    assert judge_urls(page.limit(0), rule_table(spark, RULES)).count() == 0
    none = judge_urls(page, rule_table(spark, RULES).limit(0), default="block").collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "block")] * 3
