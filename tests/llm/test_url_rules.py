"""URL rules against a direct reading of the rules, and their plan."""

import re

from pyspark.sql import functions as F

from peakloom.llm import catalog, url_rules

URLS = [
    "https://example.com/en/a", "https://WWW.Example.com/en/", "http://a.www.example.com/en/x?q=1", "https://shop.com/",
    "https://shop.com", "https://x.net/es/1", "https://x.net/fr/1#f", "https://x.net/de/", "net/es/", None, "", "://",
    "https://badexample.com/en/", "http://casino.org/x", "http://mycasino.org/x", "https://u.org/login/7/reset",
    "https://u.org/login/7/reset/no", "https://cheap-pills.org/es/", "https://x.org:80/casino/", "ftp://a?b://example.com/en/",
    "https://x.org/CASINO/", "https://x.org/" + "a/" * 30_000 + "casino/",
]


def expected(url, rules=catalog.SITE_RULES, patterns=catalog.PATTERNS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (h := r.label[: r.label.index("/")]) and (host == h or host.endswith("." + h))
            and path.startswith(r.label[len(h):])]
    if fits:
        best = max(fits, key=lambda r: len(r.label))
        return host, path, best.label, best.verdict
    tests = {"cheap-pills": "cheap-pills" in host + path, "/casino/": "/casino/" in host + path,
             "||casino.": re.search(r"(^|\.)casino\.", host), "/login/*/reset|": re.search("/login/.*/reset$", host + path)}
    return host, path, None, "block" if any(tests.values()) else "allow"


def judged(spark, urls, rules=(*catalog.SITE_RULES, *catalog.PATTERNS)):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, verdict string")
    return url_rules.judge(pages, url_rules.rule_table(spark, rules))


def test_verdicts(spark):
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, URLS).collect()}
    assert found == {i: expected(u) for i, u in enumerate(URLS)}


def test_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.com/")] * 3 + [(None, None)] * 2, "page_id long, url string")
    rules = url_rules.rule_table(spark, [*catalog.SITE_RULES, url_rules.UrlRule("*", "block", "any"),
                                         url_rules.UrlRule("%", "block", "percent")])
    rows = url_rules.judge(pages, rules).orderBy("page_id").collect()
    assert [(r.page_id, r.rule, r.verdict, r.pattern) for r in rows] == [
        (None, None, "block", "any")] * 2 + [(1, "com/", "allow", "com/")] * 3
    assert url_rules.judge(pages.limit(0), rules).collect() == []
    none = url_rules.rule_table(spark, [])
    assert {r.verdict for r in url_rules.judge(pages, none, default="review").collect()} == {"review"}


def test_tokens_are_whole_and_the_rarest_is_chosen(spark):
    assert url_rules.literal_tokens("||example.com/en/") == ["com", "en", "example"]
    assert url_rules.literal_tokens("/login/*/reset|") == ["login", "reset"]
    assert url_rules.literal_tokens("ab*cd/ef") == [] and url_rules.literal_tokens("Casino/x/") == ["x"]
    rules = url_rules.rule_table(spark, [url_rules.site_rule("example.com", "/en/", "block"), url_rules.UrlRule("b*", "block", "b")])
    tokens = spark.createDataFrame([("com",)] * 5 + [("en",)] * 2 + [("example",)] * 3, "token string")
    chosen = {r.rank: r.token for r in url_rules.rarest_token(rules, tokens).collect()}
    assert sorted(chosen.values()) == ["", "en"]


def test_rules_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(url_rules.small, "__defaults__", (0,))
    found = judged(spark, URLS)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {
        i: expected(u) for i, u in enumerate(URLS)}


def test_plan_is_native(spark):
    plan = judged(spark, URLS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert url_rules.host_and_path(F.col("u"))
