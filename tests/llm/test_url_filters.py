import random

from tessera.llm.queries import RULES
from tessera.llm.url_filters import Rule, filter_urls, index


def brute(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([len(path), *(path.index(c) for c in "?#" if c in path)])]
    best = None
    for k, r in enumerate(rules):
        if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(rules[best].text)):
            best = k
    return host, path, None if best is None else rules[best].text, default if best is None else rules[best].verdict


URLS = [None, "", "no scheme", "http://", "https://net/", "https://net", "http://a.net/x", "http://example.net/en/", "http://EXAMPLE.net/en/a?b#c", "http://xexample.net/en/", "http://m.example.com/de/1", "http://example.com/de", "ftp://x.org/fr/#f", "http://org/fr/", "http://é.org/fr/a", "http://a.net:80/x", "x://y://z.net/", "http://net?q", "http://a.net/\n/b", "http://a\nb.net/x", "http://\n.org/fr/y"]


def test_equals_brute_force(spark):
    rng = random.Random(6)
    hosts, paths = ["net", "example.net", "a.example.com", "org", "x.org", "com"], ["", "/", "/en/", "/de/1", "/fr/x/y", "/en"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)] * 2
    rules = RULES + [Rule("block", "example.com/"), Rule("allow", "a.example.com/de"), Rule("block", "com/")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    for used in (RULES, rules):
        for at_once in (2, 100):
            got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, used, rules_at_once=at_once).collect()}
            assert got == {i: brute(u, used) for i, u in enumerate(urls)}


def test_other_columns_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://x.net/", "a", "b", "c", 1)] * 2 + [(None, None, None, None, None, None)], "page_id int, url string, _url string, _host string, path string, verdict int")
    out = filter_urls(pages, RULES)
    assert out.columns == ["page_id", "url", "_url", "_host", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == [(1, "http://x.net/", "a", "b", "x.net", "/", "net/", "block")] * 2 + [(None, None, None, None, "", "", None, "allow")]
    assert {r["verdict"] for r in filter_urls(pages, []).collect()} == {"allow"}


def test_wildcards_and_index(spark):
    rules = [Rule("block", "*.example.com/*/private/"), Rule("block", "*/ads*"), Rule("allow", "shop.*/x/")]
    by, always = index(rules, {"com": 9, "example": 1, "private": 5})
    assert by["example"] == [0] and always == [1]
    pages = spark.createDataFrame([(1, "http://a.example.com/u/private/z"), (2, "http://q/adserver"), (3, "http://shop.tld/x/1"), (4, "http://shop.a.b/x/1")], "page_id int, url string")
    assert {r["page_id"]: r["rule"] for r in filter_urls(pages, rules).collect()} == {1: rules[0].text, 2: rules[1].text, 3: rules[2].text, 4: None}
    assert filter_urls(pages.limit(0), rules).count() == 0
