import random

import pytest

from shardquill.llm import url_filters
from shardquill.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host, path = url_filters.split_url(url)
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return (host, path, *(best or (None, default)))


def random_url(rng):
    labels = ["net", "com", "org", "example", "a", "b", "EXAMPLE", "xn--p1"]
    host = ".".join(rng.choice(labels) for _ in range(rng.randrange(0, 4)))
    return rng.choice(["http://", "https://", "", "://"]) + host + rng.choice(["", "/", "/en/x", "/en", "/de/", "/fr/?a=/en/", "#t", "?q=://net/"])


@pytest.mark.parametrize("limit", [32 << 20, 40, 1])
def test_against_brute_force(spark, monkeypatch, limit):
    """In one part, and with rules cut into parts that urls pass one after the other."""
    monkeypatch.setattr(url_filters, "RULE_BYTES", limit)
    rng = random.Random(0)
    urls = [random_url(rng) for _ in range(600)] + [None, "", "x", "http://", "http://NET", "http://net/", "http://a.net./", "ftp://net/en/\nz", "http://ÄB.net/"]
    rules = URL_RULES + [("block", "a.example.net", "/"), ("allow", "b.a", ""), ("block", "net", "/en/x"), ("allow", "net", "/")]
    df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)] + [(0, urls[0], "old", 1)], "page_id bigint, url string, HOST string, rule0 int")
    out = url_filters.judge(df, rules)
    assert out.columns == ["page_id", "url", "rule0", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_empty(spark):
    df = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filters.judge(df, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a/")], df.schema)
    assert [tuple(r) for r in url_filters.judge(one, []).collect()] == [(1, "http://a/", "a", "/", None, "allow")]


def test_parts_hold_all_rules_and_no_host_twice():
    rules = [("block", f"h{i % 7}.net", f"/{i}") for i in range(50)]
    parts = list(url_filters.parts_of(rules, 60))
    assert len(parts) > 3 and sorted(r for p in parts for r in p) == sorted(rules)
    hosts = [{h for _, h, _ in p} for p in parts]
    assert sum(map(len, hosts)) == len(set().union(*hosts))
