import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardquill.operators import dml, merge
from shardquill.operators.layout import parse_shard_path, with_family
from shardquill.plans.spec import StoreConfig, table_spec
from shardquill.sources.store import ConflictError, Store

NOW = dt.datetime(2026, 9, 25, 10, tzinfo=dt.UTC)


def comment(**changes):
    return {"user_id": "", "comment": "hello world", "insertedAt": NOW, "ip": "127.0.0.1", "link": "https://example.com", "mail": "a@example.com", "nick": "Alice", "pid": "", "rid": "", "status": "approved", "ua": "Mozilla/5.0", "url": "/post-1"} | changes


def make(spark, path, **config):
    return Store(spark, str(path), StoreConfig(**config), clock=lambda: NOW, sleep=lambda s: None)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_add_select_count_and_group(spark, tmp_path):
    store = make(spark, tmp_path)
    ids = store.add("Comment", [comment(url="/a", comment="1, \"x\"\nline\r2 世界"), comment(url="/a", comment="2", sticky=True), comment(url="/b", comment="3", like=1.0)])
    assert len(set(ids)) == 3 and store.version() == 0
    assert sorted(r["comment"] for r in rows(store.select("Comment", {"url": "/a"}))) == ["1, \"x\"\nline\r2 世界", "2"]
    assert rows(store.count("Comment", {"url": "/a"})) == [{"count": 2}]
    assert sorted((r["url"], r["count"]) for r in rows(store.count("Comment", None, ["url"]))) == [("/a", 2), ("/b", 1)]
    by = {r["comment"]: r for r in rows(store.select("Comment"))}
    assert by["2"]["sticky"] == "true" and by["2"]["like"] == "" and by["3"]["like"] == "1" and by["3"]["sticky"] == ""
    assert by["3"]["insertedAt"] == "2026-09-25T10:00:00.000Z" == by["3"]["createdAt"]
    assert rows(store.get("Comment", ids[1]))[0]["comment"] == "2" and parse_shard_path(store.shard_of("Comment", ids[1]))
    headers = {e["columns"] for e in store.manifest("Comment").values()}
    assert len(headers) == 2


def test_split_fill_first_compact_and_delete(spark, tmp_path):
    store = make(spark, tmp_path, shard_max_rows=5, dedup_window_seconds=0)
    store.add("Comment", [comment(comment=str(i)) for i in range(12)])
    assert sorted(e["row_count"] for e in store.manifest("Comment").values()) == [2, 5, 5]
    assert sorted(parse_shard_path(p)[2] for p in store.manifest("Comment")) == [0, 1, 2]
    store.add("Comment", [comment(comment="12")])
    assert sorted(e["row_count"] for e in store.manifest("Comment").values()) == [3, 5, 5]
    store.delete("Comment", {"comment": ["IN", [str(i) for i in range(9)]]})
    assert store.compact("Comment") == {"merged": 1, "removed": len({1}) if len(store.manifest("Comment", store.version() - 1)) == 2 else 2}
    assert [e["row_count"] for e in store.manifest("Comment").values()] == [4]
    assert store.compact("Comment") == {"merged": 0, "removed": 0}
    store.delete("Comment", {})
    assert store.manifest("Comment") == {} and store.count("Comment").collect()[0][0] == 0


def test_pruned_read(spark, tmp_path):
    store = make(spark, tmp_path)
    store.add("Comment", [comment(url=f"/p{i}", comment=f"{i} {k}") for i in range(5) for k in range(3)])
    assert len(store.read("Comment", {"url": "/p3"}).inputFiles()) == 1 < len(store.read("Comment").inputFiles())
    assert store.select("Comment", {"url": "/p3"}).count() == 3


def test_update_moves_rows_whose_key_changes(spark, tmp_path):
    store = make(spark, tmp_path)
    ids = store.add("Comment", [comment(url="/a", comment="1"), comment(url="/a", comment="2")])
    store.update("Comment", {"url": "/elsewhere", "objectId": "never"}, {"objectId": ids[0]})
    assert [r["objectId"] for r in rows(store.select("Comment", {"url": "/elsewhere"}))] == [ids[0]]
    assert [r["objectId"] for r in rows(store.select("Comment", {"url": "/a"}))] == [ids[1]]
    store.update("Comment", {"url": "/gone"}, {"objectId": ids[0]})
    store.update("Comment", lambda df: {"comment": F.concat(F.col("comment"), F.lit("!"))}, {"url": "/a"})
    assert sorted(r["comment"] for r in rows(store.select("Comment"))) == ["1", "2!"]


def test_dedup_window(spark, tmp_path):
    store = make(spark, tmp_path)
    first = store.add("Comment", [comment()])
    assert store.add("Comment", [comment()]) == first
    assert store.count("Comment").collect()[0][0] == 1
    assert store.add("Comment", [comment(comment="other")]) != first
    old = store.add("Comment", [comment(comment="old", insertedAt=NOW - dt.timedelta(hours=1))])
    assert store.add("Comment", [comment(comment="old")]) != old
    both = store.add("Comment", [comment(comment="twice"), comment(comment="twice")])
    assert both[0] == both[1] and store.count("Comment", {"comment": "twice"}).collect()[0][0] == 1


def test_two_writers(spark, tmp_path):
    a, b = make(spark, tmp_path), make(spark, tmp_path)
    a.add("Comment", [comment(comment="first")])
    ta, tb = a.begin(), b.begin()
    ta.add("Comment", [comment(comment="from a")])
    tb.add("Comment", [comment(comment="from b")])
    real, lost = a.publish, []

    def race(base, manifests, message):
        if not lost:
            lost.append(tb.commit())
        return real(base, manifests, message)

    a.publish = race
    ta.commit()
    assert sorted(r["comment"] for r in rows(a.select("Comment"))) == ["first", "from a", "from b"]
    assert a.counters["conflicts"] == 1


def test_counters_of_two_writers_add_up(spark, tmp_path):
    from shardquill.operators.dml import increment

    a, b = make(spark, tmp_path), make(spark, tmp_path)
    a.add("Counter", [{"url": "/a", "time": 1}])
    real, once = a.publish, []

    def race(*args):
        if not once:
            once.append(b.update("Counter", increment("time"), {"url": "/a"}))
        return real(*args)

    a.publish = race
    a.update("Counter", increment("time"), {"url": "/a"})
    assert rows(a.select("Counter"))[0]["time"] == "3"


def test_lost_commit_leaves_nothing(spark, tmp_path):
    store = make(spark, tmp_path)
    store.add("Comment", [comment(comment="kept")])
    store.publish = lambda *a: False
    with pytest.raises(ConflictError):
        store.add("Comment", [comment(comment="lost")])
    fresh = make(spark, tmp_path)
    assert fresh.version() == 0 and fresh.count("Comment").collect()[0][0] == 1
    assert store.counters["failures"] == 1


def test_snapshots_restore_retention_and_reset(spark, tmp_path):
    store = make(spark, tmp_path)
    assert store.create_snapshot("2026-09-20") is None
    store.add("Comment", [comment(comment="keep")])
    assert store.create_snapshot("2026-09-21") == "2026-09-21"
    store.add("Comment", [comment(comment="lose")])
    store.create_snapshot("2026-09-22")
    assert store.snapshots() == ["2026-09-22", "2026-09-21"]
    assert [p for p, _ in store.snapshot_files("2026-09-21")] == sorted(store.manifest("Comment", 0))
    store.restore("2026-09-21")
    assert [r["comment"] for r in rows(store.select("Comment"))] == ["keep"]
    with pytest.raises(ValueError):
        store.restore("yesterday")
    assert store.prune_snapshots(1) == ["2026-09-21"] and store.prune_snapshots(0) == []
    assert store.maybe_run_daily() and not store.maybe_run_daily() and "2026-09-25" in store.snapshots()
    with pytest.raises(ValueError):
        store.reset()
    store.reset(keep_snapshots=False, confirm=True)
    assert store.snapshots() == [] and [r["comment"] for r in rows(store.select("Comment"))] == ["keep"]
    with pytest.raises(ValueError):
        store.state(0)


def test_rebuild_after_a_lost_shard(spark, tmp_path):
    store = make(spark, tmp_path)
    store.add("Comment", [comment(url="/a"), comment(url="/b", comment="b")])
    gone = next(p for p, e in store.manifest("Comment").items() if e["min_key"] == "/b")
    store.files.remove(store.manifest("Comment")[gone]["place"])
    assert store.rebuild("Comment") == {"changed": 0, "removed": 1}
    assert store.stats()["shards"] == {"Comment": 1} and store.rebuild("Comment") == {"changed": 0, "removed": 0}
    assert store.tree().count() == 1


def test_users_and_unknown_names(spark, tmp_path):
    store = make(spark, tmp_path)
    ids = store.add("Users", [{"display_name": "A", "email": "a@x", "type": "guest", "2fa": "s"}, {"display_name": "B", "email": "b@x", "type": "banned"}])
    assert rows(store.select("Users", {"objectId": ids[0], "type": ["!=", "banned"]}, field=["id", "email", "nope"])) == [{"objectId": ids[0], "email": "a@x"}]
    assert parse_shard_path(store.shard_of("Users", ids[1]))[1] == f"{ids[1][:2]}/{ids[1][:2]}"
    with pytest.raises(ValueError):
        store.add("Posts", [{}])
    with pytest.raises(ValueError):
        store.begin().stage("upsert", "Users")


def test_a_batch_that_comes_again_after_its_commit(spark, tmp_path):
    """A crash between commit and checkpoint: the version itself holds the batch's number."""
    store = make(spark, tmp_path)
    for _ in range(2):
        txn = store.begin()
        seen = txn.seen("Comment from x", 0)
        txn.add("Comment", [comment(comment="one"), comment(comment="two")], dedup=False)
        txn.commit()  # the second time as if the check had come too early
    assert seen and store.version() == 0 and store.count("Comment").collect()[0][0] == 2
    txn = store.begin()
    assert not txn.seen("Comment from x", 1) and store.add("Comment", [comment(comment="three")])
    assert store.state()["marks"] == {"Comment from x": 0}


def test_reset_keeps_what_others_commit_meanwhile(spark, tmp_path):
    a, b = make(spark, tmp_path), make(spark, tmp_path)
    a.add("Comment", [comment(comment="first")])
    a.add("Comment", [comment(comment="second")])
    real, once = a.attempt, []

    def late(change, message, mark=None):
        version = real(change, message, mark)
        if message == "reset" and not once:
            once.append(b.add("Comment", [comment(comment="meanwhile")]))
        return version

    a.attempt = late
    a.reset(confirm=True)
    assert sorted(r["comment"] for r in rows(make(spark, tmp_path).select("Comment"))) == ["first", "meanwhile", "second"]
    with pytest.raises(ValueError):
        a.state(0)


def test_ids_of_a_frame_are_those_that_were_stored(spark, tmp_path):
    store = make(spark, tmp_path)
    at = "2026-09-25T10:00:00.000Z"
    frame = spark.createDataFrame([("/a", "a@x", "same", at), ("/a", "a@x", "same", at), ("/a", "a@x", "other", at)], "url string, mail string, comment string, insertedAt string")
    first = sorted(r[0] for r in store.add("Comment", frame).collect())
    again = sorted(r[0] for r in store.add("Comment", frame).collect())
    stored = {r["objectId"] for r in rows(store.select("Comment"))}
    assert set(first) == set(again) == stored and len(stored) == 2 and len(first) == 3


def test_unlisted_shards_and_content_addresses(spark, tmp_path):
    store = make(spark, tmp_path)
    store.add("Comment", [comment(url="/a"), comment(url="/b", comment="b")])
    held = store.manifest("Comment")
    path, entry = next((p, e) for p, e in held.items() if e["min_key"] == "/b")
    text = store.blob(entry["sha"])
    assert text.splitlines()[0].startswith("objectId,") and len(text.splitlines()) == 2 and store.blob("0" * 40) is None
    same = store.write_shards(table_spec("Comment"), with_family(store.read("Comment", {"url": "/b"}), table_spec("Comment"), store.config.shard_hash_len).withColumn("suffix", F.lit(0)), store.known(held))
    assert {p: (e["sha"], e["place"]) for p, e in same.items()} == {path: (entry["sha"], entry["place"])}
    for x in store.files.list("_log"):
        store.files.remove(f"_log/{x}")
    store.publish(-1, {"Comment": store.write_manifest("Comment", {p: e for p, e in held.items() if p != path})}, "lost an entry")
    assert store.rebuild("Comment") == {"changed": 0, "removed": 0}
    assert store.rebuild("Comment", unlisted=True) == {"changed": 1, "removed": 0}
    assert {p: e["sha"] for p, e in store.manifest("Comment").items()} == {p: e["sha"] for p, e in held.items()}


def test_object_stores_are_refused(spark):
    with pytest.raises(Exception):
        Store(spark, "s3a://bucket/x")


def test_dedup_window_of_repeated_order_values(spark):
    rows_ = [("a", 1, 1), ("a", 2, 2), ("b", 2, 1), ("a", 2, 400), (None, 2, 5), (None, 3, 6), ("a", 9, None), ("b", 1, 200)]
    df = spark.createDataFrame([(g, o, None if t is None else f"2026-01-01T00:{t // 60:02d}:{t % 60:02d}.000Z") for g, o, t in rows_], "g string, id int, at string")
    got = sorted((r.g or "", r.id) for r in dml.dedup_window(df, ["g"], "at", 60, "id").collect())
    assert got == sorted([("a", 1), ("b", 2), ("a", 2), ("", 2), ("a", 9), ("b", 1)])


def test_whole_rows_of_counters_merge(spark):
    local = spark.createDataFrame([("1", "5", "/a", "2026-01-02T00:00:00.000Z"), ("2", "1", "/b", "2026-01-01T00:00:00.000Z"), ("3", "9", "/c", "")], "objectId string, time string, url string, updatedAt string")
    remote = spark.createDataFrame([("1", "7", "/x", "2026-01-01T00:00:00.000Z", "3"), ("2", "", "/y", "2026-01-03T00:00:00.000Z", ""), ("4", "2", "/d", "", "1")], "objectId string, time string, url string, updatedAt string, like string")
    changes = spark.createDataFrame([("1", "time", 2), ("1", "time", 1), ("2", "time", 4)], "objectId string, field string, delta bigint")
    got = {r.objectId: (r.time, r.url, r.updatedAt, r.like) for r in merge.merge_rows(local, remote, changes).collect()}
    assert got == {"1": ("10", "/a", "2026-01-02T00:00:00.000Z", "3"), "2": ("1", "/b", "2026-01-03T00:00:00.000Z", None), "3": ("9", "/c", "", None), "4": ("2", "/d", "", "1")}


def test_numbers_of_a_hot_family_are_those_of_one_window(spark):
    from pyspark.sql import Window

    from shardquill.operators.layout import numbered

    n = F.col("id")
    ids = {"text": F.concat(F.lit("é"), F.sha1(n.cast("string"))), "number": n * 7919 % 5003, "tied": n % 3}
    for kind, order in ids.items():
        held = spark.range(5003).select(F.when(n % 3 == 0, "hot").when(n % 50 == 1, F.lit(None)).otherwise((n % 40).cast("string")).alias("family"), F.when(n % 997 != 5, order).alias("k"))
        found = numbered(held, "k", sample=200)
        assert "__part" not in found.columns and found.count() == 5003
        want = held.withColumn("w", F.row_number().over(Window.partitionBy("family").orderBy("k")) - 1)
        if kind == "tied":  # numbers of ties may differ, but not which there are
            assert found.groupBy("family", "__n").count().where("count > 1").isEmpty()
        else:
            known = want.where("k is not null and family is not null")
            assert known.join(found, ["family", "k"]).where("w <> __n").isEmpty()
        assert sorted(r[0] for r in found.where("family = 'hot'").select("__n").collect()) == list(range(held.where("family = 'hot'").count()))


def test_import_of_a_snapshot(spark, tmp_path):
    store = make(spark, tmp_path, dedup_window_seconds=0)
    store.add("Comment", [comment(url=f"/p{i}") for i in range(4)])
    text = store.snapshot_csv(store.create_snapshot("2024-03-01"))
    store.delete("Comment", {"url": ["IN", ["/p1", "/p2"]]})
    assert store.import_snapshot("2024-02-01", text) == "2024-02-01" and store.snapshot_csv("2024-02-01") == text
    store.restore("2024-02-01")
    assert store.count("Comment").collect()[0][0] == 4
    with pytest.raises(ValueError, match="no version holds"):
        store.import_snapshot("2024-02-02", "path,sha\nComment/aa/aabb.csv,0000\n")
    with pytest.raises(ValueError, match="no shard paths"):
        store.import_snapshot("2024-02-02", "path,sha\nelsewhere.csv,0000\n")
    assert store.snapshots() == ["2024-03-01", "2024-02-01"]
