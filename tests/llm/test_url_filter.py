from __future__ import annotations

import pytest

from basketry.llm.queries import URL_RULES
from basketry.llm.url_filter import UrlRules, filter_urls
from tests.conftest import rows


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in rules:
        rule_host, slash, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return (host, path, best[1] if best else None, best[0] if best else "allow")


URLS = [
    "http://example.org/es/1", "https://www.Example.ORG/en/12?x=/es/", "http://example.org/en/2#a", "http://org/", "http://org",
    "http://a.org?/es/", "http://notexample.org/es/", "http://example.org.evil.com/de/x", "http://X.COM/fr/", "http://com/de/",
    "http://é.com/DE/", "http://com/de", "example.org/es/", "", None, "a://b://example.org/es/", "http:///es/", "http://x.org\n/es/",
    "http://" + "a." * 500 + "com/de/" + "x" * 5000,
]


def test_brute_force(spark, clashing):
    pages = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)] + [(None, "http://a.com/fr/")] * 2, "page_id bigint, url string")
    found = {r.page_id: tuple(r)[1:] for r in filter_urls(clashing(pages), UrlRules(spark, URL_RULES)).collect()}
    assert {n: found[n] for n in range(len(URLS))} == {n: brute(u, URL_RULES) for n, u in enumerate(URLS)}
    assert rows(filter_urls(pages, UrlRules(spark, URL_RULES)).where("page_id is null"), "rule") == [("com/fr/",)] * 2
    assert filter_urls(pages.limit(0), UrlRules(spark, URL_RULES)).count() == 0


def test_many_rules(spark):
    rules = [("block" if n % 3 else "allow", f"h{n % 97}.com/{'p' * (n % 11)}{n % 13}/") for n in range(900)]
    last = dict(sorted(((r, v) for v, r in rules), key=lambda x: (x[0], x[1])))  # of two verdicts the block stays
    urls = [f"http://s.h{n % 120}.com/{'p' * (n % 12)}{n % 14}/{n}" for n in range(700)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = {r.page_id: tuple(r)[1:] for r in filter_urls(pages, UrlRules(spark, rules)).collect()}
    assert found == {n: brute(u, [(v, r) for r, v in last.items()]) for n, u in enumerate(urls)}


def test_collisions_are_confirmed(spark):
    """A digest of one value for all: only the stored strings decide."""
    pages = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)], "page_id bigint, url string")
    same = UrlRules(spark, URL_RULES, digest=lambda text: 7)
    assert rows(filter_urls(pages, same)) == rows(filter_urls(pages, UrlRules(spark, URL_RULES)))


def test_no_rules_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/fr/")], "page_id bigint, url string")
    assert rows(filter_urls(pages, UrlRules(spark, []))) == [(1, "a.com", "/fr/", None, "allow")]
    with pytest.raises(ValueError):
        UrlRules(spark, [("maybe", "a/")])
    with pytest.raises(ValueError):
        UrlRules(spark, [("block", "a/"), ("block", "b/")], max_rules=1)
