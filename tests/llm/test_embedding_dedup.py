import numpy as np
import pytest

from shardquill.llm import embedding_dedup


def brute(rows, threshold):
    best = {}
    for i, v, label in rows:
        if i is not None:
            k = (label is not None, label, v is not None, v or [])
            best[i] = min(best.get(i, k), k)
    ok = {}
    for i, (_, label, _, v) in best.items():
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, dtype=float))
    parent, links, ids = {i: i for i in best}, dict.fromkeys(best, 0), sorted(ok)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            (la, a), (lb, b) = ok[i], ok[j]
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: (links[i], root(i), root(i) == i) for i in best}


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, **kw).collect()}


def test_small_groups_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = np.random.default_rng(i % 12).standard_normal(16)
        v = base + (rng.standard_normal(16) * 0.15 if i % 3 else 0)
        rows.append((100 - i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] * 16, 1), (205, rows[0][1], None), (206, [1.0, 2.0], 0), (207, [float("inf")] + [1.0] * 15, 0), rows[0], rows[3]]
    assert got(spark, rows) == brute(rows, 0.93)


def test_a_bucket_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.standard_normal(8) * 0.3], 0) for i in range(90)]
    want, have = brute(rows, 0.93), got(spark, rows)
    assert sum(v[0] for v in have.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert {i: v[1] for i, v in have.items()} == {i: v[1] for i, v in want.items()}


def test_empty_and_null_id(spark):
    assert got(spark, []) == {}
    assert got(spark, [(None, [1.0, 0.0], 1)]) == {None: (0, None, True)}


@pytest.mark.parametrize("n,bits", [(0, 8), (5000, 8), (1 << 20, 14)])
def test_plan(n, bits):
    b, tables = embedding_dedup.plan(n, 0.93)
    assert b == bits and (1 - (1 - np.arccos(0.93) / np.pi) ** b) ** tables <= 1 - embedding_dedup.RECALL


def test_signs_that_may_differ():
    for signs in (144, 588):
        p, most = np.arccos(0.93) / np.pi, embedding_dedup.most_differing(signs, 0.93)
        differ = np.random.default_rng(3).binomial(signs, p, 1_000_000)
        assert (differ > most).mean() < 1e-5 and most < signs * 0.3
    assert embedding_dedup.most_differing(144, 1.0) == 0


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MANY", 5)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((6, 12))
    rows = [(i, [float(np.float32(x)) for x in vectors[0 if i < 30 else i % 6]], i % 2) for i in range(60)] + [(None, [1.0] * 12, 0)] * 2
    have = got(spark, rows)
    assert have.pop(None) == (0, None, True)
    assert have == brute(rows, 0.93)
