"""Line dedup and decontamination, against plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shardquill.llm import common, decontamination, line_dedup


def brute_lines(rows, ratio, least_pages):
    pages, having = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        pages[host or ""] += 1
        having[host or ""].update({x.strip(" \t\r") for x in (text or "").split("\n")} - {""})
    out = []
    for i, host, text in rows:
        h = host or ""
        drop = {x for x, n in having[h].items() if n >= least_pages and n > ratio * pages[h]}
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if x.strip(" \t\r") not in drop]
        out.append((i, text if text is None or len(left) == len(lines) else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "a", "b", "c", None, ""])
        lines = [f"line {rng.randrange(5000)}" for _ in range(rng.randrange(0, 6))] + rng.sample(["menu", " menu\t", "footer\r", "rare", ""], rng.randrange(0, 4))
        rng.shuffle(lines)
        rows.append((i, host, "\n".join(lines)))
    rows += [(400, "a", None), (401, "a", ""), (402, "d", "menu"), (403, "a", "menu\nmenu\nfooter"), (404, "a", "x\n" * 20_000 + "menu"), rows[0], rows[1], (None, "a", "menu\nown")]
    return rows


def test_lines(spark, monkeypatch):
    rows = line_rows()
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, source string, text string, n_lines int")
    for limit in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = line_dedup.dedup_lines(df, ratio=0.1, least_pages=5).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 0.1, 5)


def test_small_hosts_lose_lines_too(spark):
    rows = [(i, "small", f"menu\nown {i}") for i in range(9)] + [(20, "tiny", "menu\nown"), (21, "tiny", "menu\nmore")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES)
    assert {r.doc_id: r.n_dropped for r in got} == {**dict.fromkeys(range(9), 1), 20: 0, 21: 0}


def test_clashing_columns(spark):
    """Names of results and of helper columns, in any case, come back as they were, or are replaced."""
    rows = [(i, "site", f"menu\nown {i}", 1, 2, 3, 4, 5, 6) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, N_Lines int, __key int, key int, Drop int, __host int, flagged int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "source", "text", "__key", "key", "Drop", "__host", "flagged", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(i, "site", f"own {i}", 2, 3, 4, 5, 6, 2, 1) for i in range(40)]
    left = common.without(df, spark.createDataFrame([(3,), (None,)], "doc_id bigint"))
    assert left.columns == df.columns and left.count() == 39 and left.dtypes == df.dtypes
    items = spark.createDataFrame([(1, "a b c d e f")], "ITEM_ID bigint, Text string")
    docs = spark.createDataFrame([(5, "x a b c d e f", 1, 2, 3)], "DOC_ID bigint, TEXT string, h int, q int, item_id int")
    assert decontamination.contaminated(docs, items).select("doc_id", "item_id").collect() == [(5, 1)]


def test_no_lines(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert line_dedup.dedup_lines(df).count() == 0


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 11, 30, 60])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "too few words"), items[0], (None, items[1][1]), (103, "a b c d e " * 50)]
    docs = []
    for i in range(200):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 900]))]
        if i % 3 == 0:
            part = items[rng.randrange(40)][1].upper().split()
            for _ in range(rng.randrange(0, 2)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((i, ", ".join(text)))
    docs += [(300, None), (301, ""), docs[0], (None, docs[3][1]), (302, "x " * 50_000 + items[2][1]), (303, "a b c d e a b c d")]
    want = {}
    for d, t in docs:
        for i, q in items:
            s = shingles(q)
            if d is not None and i is not None and s and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9:
                want[d, i] = max(want.get((d, i), 0), len(s & shingles(t)) / len(s))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, h int")
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): r.containment for r in got} == want and len(got) == len(want) > 30


def test_a_sketch_is_never_too_short(spark):
    rows = [(q,) for q in range(1, 300)]
    for r in spark.createDataFrame(rows, "q int").select("q", decontamination.sketch_sizes(0.8).alias("k")).collect():
        need = -(-4 * r.q // 5)
        assert r.k >= r.q - need + 1 or r.k == r.q


def test_no_items(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contaminated(df, none).count() == 0
    assert decontamination.contaminated(df.limit(0), none.union(spark.createDataFrame([(1, "a b c d e f")], none.schema))).count() == 0
    assert decontamination.contaminated(df, spark.createDataFrame([(1, "A b, c d e f")], none.schema)).select(F.col("n_item")).collect() == [(2,)]
