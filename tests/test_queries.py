"""Every query that has SQL gives DuckDB's rows, at the smallest size; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def key(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    theirs = sorted(tuple(key(dict(zip(relation.columns, r, strict=True))[c]) for c in columns) for r in relation.fetchall())
    assert sorted(tuple(key(r[c]) for c in columns) for r in df.collect()) == theirs


def test_entry(spark):
    assert entry.entry(spark).columns


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    from shardquill.plans.spec import StoreConfig
    from shardquill.queries import comments
    from shardquill.sources.store import Store
    from shardquill.streaming.ingest import deduplicated, ingest

    rows = comments(spark, SF).drop("objectId")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"), StoreConfig(shard_hash_len=1))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(stream, store, "Comment", str(tmp_path / "marks")).awaitTermination()
    assert store.count("Comment").collect()[0][0] == rows.count()
    timed = stream.withColumn("at", stream["insertedAt"].cast("timestamp"))
    assert deduplicated(timed, "at").isStreaming
