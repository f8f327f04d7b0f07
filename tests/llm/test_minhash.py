import random
import re
from collections import Counter

import numpy as np

from shardquill.llm import minhash


def shingles(text, count=False):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    found = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()
    return found if count else Counter(dict.fromkeys(found, 1))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, threshold=0.8, count=False):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t, count)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and similarity(a, b) >= threshold:
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: root(i) for i in ids}


def corpus(seed, families=12, size=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([30, 60, 200]))]
        for k in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if k == 5:
                text = text[: len(text) // 2]
            rows.append((i, " ".join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, " .. "), (903, "two words"), (904, "Two, words!"), (905, "two words more"), (None, "two words")]
    rows += [rows[0], (906, rows[3][1].upper()), (907, "a b c d e " * 3000), (908, "a b c d e " * 3000 + "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, bands int")
    for count in (False, True):
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weighting="count" if count else "set").collect()}
        assert got == brute(rows, count=count)
    kept = minhash.dedup(df)
    assert kept.columns == df.columns
    want = sorted(i for i, c in brute(rows).items() if i == c)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want and kept.where("doc_id is null").count() == 1


def test_a_chain_and_a_bucket_of_different_documents(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(1000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(30):  # each differs a little from the last
        base = list(base)
        base[(i * 7) % 120] = f"new{i}"
        rows.append((i, " ".join(base)))
    shared = [rng.choice(words) for _ in range(300)]
    for i in range(30, 45):  # a common part, below the threshold
        rows.append((i, " ".join(shared[:200] + [f"own{i}_{k}" for k in range(60)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(df).count() == 0 and minhash.dedup(df).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.random(200) * 5, rng.random(200) * 5
    b[:100] = a[:100]
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    out = minhash.sketch(np.concatenate([keys, keys]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, k=4000)
    assert abs((out[0] == out[1]).mean() - true) < 0.03
    alone = minhash.sketch(keys, a, np.zeros(200, dtype=int), 1, k=4000)
    assert (alone[0] == out[0]).all()


def test_bitmaps_bound_the_similarity_from_above(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (5, 100, 1000, 9000):
        for share in (0.5, 0.8, 0.95, 1.0):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)])
            rows.append((n, n, minhash.bitmap(a).tolist(), minhash.bitmap(b).tolist(), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    df = spark.createDataFrame(rows, "lo int, x_lo int, map array<bigint>, x_map array<bigint>, j double")
    got = df.select("lo", "j", minhash._most_similar().alias("most")).collect()
    assert all(r.most >= r.j - 1e-9 for r in got) and all(r.most <= r.j + 0.06 for r in got if r.lo <= 100)
