import datetime as dt
import random

import pytest

from shardquill.functions.values import text_of
from shardquill.plans import query
from shardquill.plans.predicates import compile_where, families, family_of
from shardquill.plans.spec import TABLES, StoreConfig

ROWS = [
    ("1", "Alice", "approved", "/a", "", "2026-09-25T10:00:00.000Z", "u1", "a_c%d"),
    ("2", "Bob", "spam", "/a", "1", "2026-09-25T08:00:00.000Z", "u2", "abcd"),
    ("3", None, "waiting", "/b", None, "", "u1", "[x]*"),
    ("4", "", "approved", None, "1", None, "", "10"),
    ("5", "Ann", "approved", "/c", "2", "not a time", None, "9"),
]
NAMES = ["objectId", "nick", "status", "url", "rid", "insertedAt", "user_id", "comment"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{n} string" for n in NAMES)).cache()


def model(row, where):
    """The where language in plain Python."""

    def one(field, given):
        have = row.get(field) or ""
        if not isinstance(given, list):
            return have == text_of(given)
        op, value = given[0].upper(), given[1]
        if op in ("IN", "NOT IN"):
            values = [text_of(v) for v in (value if isinstance(value, list) else [value])]
            return (have in values) == (op == "IN")
        if op == "!=":
            return have != text_of(value)
        if op == ">":
            return have > text_of(value)
        p = value
        if p == "%":
            return True
        head, tail = p.startswith("%"), p.endswith("%")
        core = p[1 if head else 0 : -1 if tail else None]
        return core in have if head and tail else have.endswith(core) if head else have.startswith(core) if tail else have == core

    outer = all(one(f, c) for f, c in where.items() if f != "_complex")
    branches = {f: c for f, c in where.get("_complex", {}).items() if f != "_logic"}
    if not branches:
        return outer
    join = any if where["_complex"].get("_logic", "and").lower() == "or" else all
    return outer and join(one(f, c) for f, c in branches.items())


def ids(df, where):
    return sorted(r.objectId for r in query.filtered(df, where).collect())


CONDITIONS = [
    ("nick", "Alice"), ("nick", None), ("nick", ""), ("rid", 1), ("absent", None), ("absent", "x"), ("status", ["in", ["spam", "waiting"]]),
    ("rid", ["IN", ["1", None]]), ("rid", ["IN", []]), ("rid", ["NOT IN", []]), ("rid", ["Not In", ["1"]]), ("url", ["IN", "/a"]), ("nick", ["!=", "Bob"]),
    ("rid", ["!=", ""]), ("comment", ["LIKE", "%_c%"]), ("comment", ["LIKE", "a_c%"]), ("comment", ["LIKE", "%]*"]), ("comment", ["LIKE", "abcd"]),
    ("comment", ["LIKE", "%"]), ("comment", ["LIKE", "%%"]), ("nick", ["like", "%a%"]), ("comment", [">", 9]), ("comment", [">", "2"]), ("absent", ["NOT IN", ["x"]]),
]


def test_single_conditions(df):
    for field, given in CONDITIONS:
        where = {field: given}
        assert ids(df, where) == sorted(r[0] for r in ROWS if model(dict(zip(NAMES, r, strict=True)), where)), where


def test_random_combinations(df):
    rng = random.Random(4)
    for _ in range(25):
        where = dict(rng.sample(CONDITIONS, rng.randrange(0, 3)))
        if rng.random() < 0.7:
            where["_complex"] = dict(rng.sample(CONDITIONS, rng.randrange(0, 3))) | rng.choice([{}, {"_logic": "or"}, {"_logic": "AND"}])
        assert ids(df, where) == sorted(r[0] for r in ROWS if model(dict(zip(NAMES, r, strict=True)), where)), where


def test_times(df):
    nine = dt.datetime(2026, 9, 25, 9, tzinfo=dt.UTC)
    assert ids(df, {"insertedAt": [">", nine]}) == ["1"]
    assert ids(df, {"insertedAt": dt.datetime(2026, 9, 25, 8)}) == ["2"]


@pytest.mark.parametrize("where", [{"a": ["<", 1]}, {"a": ["IN"]}, {"a": []}, {"a": {"b": 1}}, {"_logic": "or"}, {"_complex": [1]}, {"_complex": {"_logic": "xor", "a": 1}}, ["a"], {"a": [None, 1]}])
def test_malformed_conditions_raise(df, where):
    with pytest.raises(ValueError):
        compile_where(df, where)


def test_empty_wheres_filter_nothing(df):
    assert compile_where(df, {}) is None and compile_where(df, None) is None and compile_where(df, {"_complex": {}}) is None


def test_families():
    spec = TABLES["Comment"]
    fam = lambda *keys: {family_of(spec, k) for k in keys}
    assert families(spec, {"url": "/a", "status": "x"}) == fam("/a")
    assert families(spec, {"url": ["IN", ["/a", "/b"]]}) == fam("/a", "/b")
    assert families(spec, {"url": None}) == fam("")
    assert families(spec, {"_complex": {"_logic": "or", "url": "/a"}}) == fam("/a")
    assert families(spec, {"_complex": {"_logic": "or", "url": "/a", "nick": "x"}}) is None
    assert families(spec, {"url": ["LIKE", "/a%"]}) is None and families(spec, {}) is None and families(spec, {"status": "x"}) is None
    assert family_of(TABLES["Users"], "abcdef") == "ab/ab"


def test_sort_pages_and_projection(spark):
    rows = [("c1", "1", 21), ("c2", "", 22), ("c3", "1", 23), ("c4", "", 24), ("c5", None, 25)]
    df = spark.createDataFrame([(i, s, f"2026-09-{d}T10:00:00.000Z") for i, s, d in rows], "objectId string, sticky string, insertedAt string")
    order = [{"field": "sticky", "direction": "desc"}, {"field": "insertedAt", "direction": "desc"}]
    page = lambda **kw: [r.objectId for r in query.select(df, **kw).collect()]
    assert page(order=order, limit=2) == ["c3", "c1"] and page(order=order, limit=2, offset=2) == ["c5", "c4"]
    assert page(order=[{"field": "sticky"}, {"field": "id"}]) == ["c1", "c3", "c2", "c4", "c5"]
    assert page(order=[{"field": "sticky", "direction": "desc", "nulls": "first"}, {"field": "id"}])[:3] == ["c2", "c4", "c5"]
    assert page(desc="insertedAt", limit=1) == ["c5"] and len(page(limit=0)) == 5
    assert query.select(df, field=["sticky", "nope", "id"]).columns == ["sticky", "objectId"]
    for bad in ({"field": "sticky", "direction": "up"}, {"field": "sticky", "nulls": "middle"}):
        with pytest.raises(TypeError):
            query.select(df, order=[bad])


def test_counts(df):
    got = {(r.status, r["count"]) for r in query.count(df, None, ["status"]).collect()}
    assert got == {("approved", 3), ("spam", 1), ("waiting", 1)}
    assert {(r.rid, r.gone, r["count"]) for r in query.count(df, None, ["rid", "gone"]).collect()} == {("", "", 2), ("1", "", 2), ("2", "", 1)}
    assert query.count(df, {"nick": "nobody"}, []).collect() == [] and query.count(df, {"nick": "nobody"}).collect()[0][0] == 0


def test_config():
    c = StoreConfig.from_env({"SHARD_MAX_ROWS": "7", "CSV_STORE_DIR": "d", "MAX_RETRIES": " "})
    assert (c.shard_max_rows, c.store_dir, c.max_retries) == (7, "d", 3)
    with pytest.raises(ValueError):
        StoreConfig.from_env({"SHARD_MAX_ROWS": "many"})


def test_text_of():
    pairs = [(None, ""), (3, "3"), (3.0, "3"), (0.5, "0.5"), (True, "true"), ({"a": [1]}, '{"a":[1]}'), (dt.datetime(2026, 1, 2, 3, 4, 5, 678_900), "2026-01-02T03:04:05.678Z")]
    assert [text_of(v) for v, _ in pairs] == [t for _, t in pairs]


def test_after_a_time_falls_back_to_text(spark):
    df = spark.createDataFrame([("1", "2026-09-25T10:00:00.000Z"), ("2", "zzz"), ("3", "1 not a time"), ("4", ""), ("5", None), ("6", "2026-09-25T08:00:00.000Z")], "objectId string, insertedAt string")
    nine = dt.datetime(2026, 9, 25, 9, tzinfo=dt.UTC)
    hit = compile_where(df, {"insertedAt": [">", nine]})
    assert sorted(r.objectId for r in df.where(hit).collect()) == ["1", "2"]
