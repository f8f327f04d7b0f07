"""URL filters: rules on a host, its subdomains and a path prefix, found by a sort-merge range join.

A host's labels, reversed, make its canonical key (``blog.example.net`` -> ``(net, example, blog)``), so that a host
with all its subdomains is one interval of keys. Hosts and rules are both sorted by that key and swept together once;
a stack holds the nested rules whose interval is open. Among the rules on the stack, the longest whose path is a prefix
of the url's path decides.

Rules are configuration, a list held by the driver. They travel with the tasks and urls are swept where they lie, batch
by batch, without a shuffle. A worker holds at most ``RULE_BYTES`` of them: longer lists are cut, in canonical order,
into parts of that size, which the urls pass one after the other, and the longest hit of all parts decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, map_texts

#: Bytes of rules that a Python worker holds.
RULE_BYTES = 32 << 20

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: null or no ``://`` gives two empty strings."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    for mark in "#?":
        rest, cut, _ = rest.partition(mark)
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def key_of(host: str) -> tuple[str, ...]:
    return tuple(reversed(host.split(".")))


class Rules:
    """(verdict, host, path) rules in canonical order, one entry for each host."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        by_host: dict[tuple[str, ...], dict[str, tuple[str, str]]] = defaultdict(dict)
        for verdict, host, path in rules:
            host = host.translate(_LOWER)
            by_host[key_of(host)].setdefault(path, (host + path, verdict))
        self.entries = [(key, sorted({len(p) for p in paths}, reverse=True), paths) for key, paths in sorted(by_host.items())]
        self.keys = [e[0] for e in self.entries]

    def sweep(self, urls: dict[tuple[str, ...], set[str]]) -> dict[tuple[tuple[str, ...], str], tuple[str, str]]:
        """Decisions for the paths of each host key; hosts are taken in key order, with a stack of open intervals."""
        keys = sorted(urls)
        if not keys:
            return {}
        out: dict = {}
        stack: list = []
        i = bisect_left(self.keys, keys[0])
        for n in range(len(keys[0])):  # rules before the first key whose interval it is in: those of its beginnings
            at = bisect_left(self.keys, keys[0][:n])
            if at < i and self.keys[at] == keys[0][:n]:
                stack.append(self.entries[at])
        for key in keys:
            while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                stack.pop()
            while i < len(self.entries) and self.entries[i][0] <= key:
                entry = self.entries[i]
                i += 1
                if key[: len(entry[0])] == entry[0]:
                    stack.append(entry)
            if not stack:
                continue
            for path in urls[key]:
                best = None
                for _, lengths, paths in reversed(stack):
                    hit = next((paths[path[:n]] for n in lengths if path[:n] in paths), None)
                    if hit and (best is None or len(hit[0]) > len(best[0])):
                        best = hit
                if best:
                    out[key, path] = best
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (``default`` if none fits).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule (host and path
    together) wins, the deeper host on a tie. Of two rules on the same host and path the first counts. Null urls, and
    urls without ``://``, have an empty host and path and so fit no rule. Every row gets one row, repeated ones too;
    input columns called host, path, rule or verdict are replaced. An empty table gives an empty result.
    """

    def make_of(part: list[tuple[str, str, str]]):
        def make():
            table = Rules(part)

            def run(urls: list[str | None]) -> list[list]:
                split = [split_url(u) for u in urls]
                keys = {host: key_of(host) for host in {h for h, _ in split}}
                hosts: dict[tuple[str, ...], set[str]] = defaultdict(set)
                for host, path in split:
                    hosts[keys[host]].add(path)
                found = table.sweep(hosts)
                hits = [found.get((keys[h], p)) for h, p in split]
                return [[h for h, _ in split], [p for _, p in split], [x and x[0] for x in hits], [x[1] if x else default for x in hits]]

            return run

        return make

    text = pa.string()
    out, of = aside(pages)
    parts = list(parts_of(rules))
    for k, part in enumerate(parts):
        out = map_texts(out, [("host", "string", text), ("path", "string", text), (f"rule{k}", "string", text), (f"verdict{k}", "string", text)], make_of(part), text=of(url))
    hits = [F.struct(F.length(f"rule{k}").alias("n"), F.length(F.substring_index(f"rule{k}", "/", 1)).alias("host"), F.col(f"rule{k}").alias("rule"), F.col(f"verdict{k}").alias("verdict")) for k in range(len(parts))]
    best = F.greatest(*[F.when(h["rule"].isNotNull(), h) for h in hits]) if len(hits) > 1 else hits[0]
    out = out.withColumn("best", best)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    done = out.select(*[of(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return done.toDF(*kept, "host", "path", "rule", "verdict")


def parts_of(rules: list[tuple[str, str, str]], limit: int | None = None) -> Iterator[list[tuple[str, str, str]]]:
    """The rules in canonical order, cut into lists of at most ``limit`` bytes; all rules of a host are in one."""
    limit = RULE_BYTES if limit is None else limit
    ordered = sorted(rules, key=lambda r: key_of(r[1].translate(_LOWER)))  # stable: of equal rules the first stays first
    held: list = []
    total, last = 0, None
    for rule in ordered:
        key, size = key_of(rule[1].translate(_LOWER)), len(rule[1]) + len(rule[2])
        if held and total + size > limit and key != last:
            yield held
            held, total = [], 0
        held.append(rule)
        total, last = total + size, key
    yield held
