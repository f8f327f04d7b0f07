"""One query for each operation of the engine over the test tables, and its SQL.

The tables stand in for a comment service's: events for comments (objectId event_id, url /u/<user_id>, status
event_type, insertedAt ts, a sticky column with empties), customer for users, counts of events by user for counters.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import ISO, content_sha
from .operators import dml, layout, manifest, merge
from .plans import query, shapes
from .plans.predicates import families
from .plans.spec import TABLES, StoreConfig, TableSpec
from .sources import csvio
from .sources.store import Store
from .streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def comments(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    sticky = F.when(F.col("event_id") % 7 == 0, "1").when(F.col("event_id") % 7 == 1, F.lit(None).cast("string")).otherwise("")
    rid = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") - F.col("event_id") % 3).cast("string"))
    return e.select(
        F.col("event_id").cast("string").alias("objectId"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("status"),
        F.col("user_id").cast("string").alias("user_id"),
        F.date_format("ts", ISO).alias("insertedAt"),
        F.col("props").alias("comment"),
        sticky.alias("sticky"),
        rid.alias("rid"),
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 50).cast("string")).alias("ip"),
        F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"), F.lit("@example.com")).alias("mail"),
    )


COMMENTS = """comments AS (SELECT CAST(event_id AS VARCHAR) AS "objectId", '/u/' || CAST(user_id AS VARCHAR) AS url, event_type AS status,
  CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "insertedAt", props AS comment,
  CASE WHEN event_id % 7 = 0 THEN '1' WHEN event_id % 7 = 1 THEN NULL ELSE '' END AS sticky,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id - event_id % 3 AS VARCHAR) END AS rid,
  '10.0.0.' || CAST(event_id % 50 AS VARCHAR) AS ip, 'm' || CAST(event_id % 5 AS VARCHAR) || '@example.com' AS mail FROM events)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 50 == 0, "banned").when(F.col("c_custkey") % 97 == 0, "administrator").otherwise("guest")
    return c.select(F.col("c_custkey").cast("string").alias("objectId"), F.col("c_name").alias("display_name"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"), kind.alias("type"))


USERS = """users AS (SELECT CAST(c_custkey AS VARCHAR) AS "objectId", c_name AS display_name, 'u' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
  CASE WHEN c_custkey % 50 = 0 THEN 'banned' WHEN c_custkey % 97 = 0 THEN 'administrator' ELSE 'guest' END AS type FROM customer)"""


def counter_rows(spark: SparkSession, sf: str) -> DataFrame:
    by = _table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    n = F.when(F.col("user_id") % 11 == 0, "").otherwise(F.col("n").cast("string"))
    return by.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("objectId"), n.alias("time"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"))


COUNTERS = """counters AS (SELECT 'c' || CAST(user_id AS VARCHAR) AS "objectId", CASE WHEN user_id % 11 = 0 THEN '' ELSE CAST(count(*) AS VARCHAR) END AS time,
  '/u/' || CAST(user_id AS VARCHAR) AS url FROM events GROUP BY user_id)"""

_C = ["objectId", "url", "status", "user_id", "insertedAt", "sticky", "rid"]
_S = '"objectId", url, status, user_id, "insertedAt", sticky, rid'
SINCE = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)
_SINCE = "TIMESTAMP '2024-01-15 00:00:00'"
_AT = """CAST(left("insertedAt", 23) AS TIMESTAMP)"""


def _where(name: str, where: dict | None, sql: str) -> None:
    _register(name, f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE {sql}")(lambda spark, sf: query.select(comments(spark, sf), where).select(*_C))


_where("full_scan", None, "true")
_where("filter_eq", {"status": "click"}, "status = 'click'")
_where("filter_empty", {"sticky": None}, "coalesce(sticky, '') = ''")
_where("filter_in", {"status": ["in", ["click", "error"]]}, "status IN ('click', 'error')")
_where("filter_in_empty", {"sticky": ["IN", ["1", None]]}, "coalesce(sticky, '') IN ('1', '')")
_where("filter_in_scalar", {"status": ["IN", "click"]}, "status = 'click'")
_where("filter_not_in", {"sticky": ["NOT IN", ["1"]]}, "coalesce(sticky, '') <> '1'")
_where("filter_ne", {"sticky": ["!=", "1"]}, "coalesce(sticky, '') <> '1'")
_where("like_contains", {"url": ["LIKE", "%/u/1%"]}, "contains(url, '/u/1')")
_where("like_prefix", {"url": ["LIKE", "/u/2%"]}, "starts_with(url, '/u/2')")
_where("like_suffix", {"url": ["LIKE", "%3"]}, "ends_with(url, '3')")
_where("like_exact", {"url": ["LIKE", "/u/8"]}, "url = '/u/8'")
_where("filter_gt_ts", {"insertedAt": [">", SINCE]}, f"{_AT} > {_SINCE}")
_where("filter_gt_lex", {"objectId": [">", 5]}, "\"objectId\" > '5'")
_where("filter_and", {"status": "view", "url": ["LIKE", "%1"], "sticky": None}, "status = 'view' AND ends_with(url, '1') AND coalesce(sticky, '') = ''")
_where("filter_complex", {"url": ["IN", ["/u/8", "/u/9", "/u/10"]], "_complex": {"_logic": "or", "status": ["NOT IN", ["error", "view"]], "sticky": "1"}}, "url IN ('/u/8', '/u/9', '/u/10') AND (status NOT IN ('error', 'view') OR sticky = '1')")
_where("filter_complex_and", {"status": "click", "_complex": {"sticky": ["!=", "1"], "rid": None}}, "status = 'click' AND coalesce(sticky, '') <> '1' AND coalesce(rid, '') = ''")
_where("get_by_id", {"objectId": "42"}, "\"objectId\" = '42'")


@_register("filter_eq_ts", f"""WITH {COMMENTS} SELECT {_S} FROM comments WHERE "insertedAt" = (SELECT min("insertedAt") FROM comments)""")
def _filter_eq_ts(spark, sf):
    rows = comments(spark, sf)
    first = rows.agg(F.min(F.to_timestamp("insertedAt")).cast("string")).collect()[0][0]  # one value: the time that is asked for
    return query.select(rows, {"insertedAt": dt.datetime.fromisoformat(first).replace(tzinfo=dt.UTC)}).select(*_C)


_PATTERNED = "WHEN CAST(\"objectId\" AS BIGINT) % 4 = 0 THEN comment || '_%:x' WHEN CAST(\"objectId\" AS BIGINT) % 4 = 1 THEN comment || 'ab:x'"


@_register("like_literal", f"WITH {COMMENTS}, c AS (SELECT \"objectId\", CASE {_PATTERNED} ELSE comment END AS comment FROM comments) SELECT * FROM c WHERE contains(comment, '_%:')")
def _like_literal(spark, sf):
    n = F.col("objectId").cast("bigint") % 4
    rows = comments(spark, sf).select("objectId", F.when(n == 0, F.concat("comment", F.lit("_%:x"))).when(n == 1, F.concat("comment", F.lit("ab:x"))).otherwise(F.col("comment")).alias("comment"))
    return query.select(rows, {"comment": ["LIKE", "%_%:%"]}).select("objectId", "comment")


@_register("filter_gt_ts_text", f"""WITH {COMMENTS}, c AS (SELECT "objectId", CASE WHEN CAST("objectId" AS BIGINT) % 4 = 0 THEN 'zzz' WHEN CAST("objectId" AS BIGINT) % 4 = 1 THEN '1 is no time' ELSE "insertedAt" END AS "insertedAt" FROM comments)
SELECT * FROM c WHERE CASE WHEN "insertedAt" = 'zzz' THEN true WHEN "insertedAt" = '1 is no time' THEN false ELSE {_AT} > {_SINCE} END""")
def _filter_gt_ts_text(spark, sf):
    """What is no time is compared with the time's text."""
    n = F.col("objectId").cast("bigint") % 4
    rows = comments(spark, sf).select("objectId", F.when(n == 0, "zzz").when(n == 1, "1 is no time").otherwise(F.col("insertedAt")).alias("insertedAt"))
    return query.select(rows, {"insertedAt": [">", SINCE]}).select("objectId", "insertedAt")


@_register("project", f"WITH {COMMENTS} SELECT status, url, \"objectId\" FROM comments")
def _project(spark, sf):
    return query.select(comments(spark, sf), field=["status", "url", "nowhere"])


@_register("project_alias", f"WITH {USERS} SELECT \"objectId\", email FROM users")
def _project_alias(spark, sf):
    return query.select(users(spark, sf), field=["id", "email"])


def _sorted(name: str, order: list[dict], sql: str) -> None:
    # the limit is the feature here: a page of a sorted table
    _register(name, f"WITH {COMMENTS} SELECT {_S} FROM comments ORDER BY {sql} LIMIT 50 OFFSET 20")(lambda spark, sf: query.select(comments(spark, sf), order=order, limit=50, offset=20).select(*_C))


_E = "nullif(sticky, '')"
_sorted("sort_multi", [{"field": "sticky", "direction": "desc"}, {"field": "status"}, {"field": "insertedAt", "direction": "desc"}], f"{_E} DESC NULLS LAST, status ASC, {_AT} DESC, \"objectId\"")
_sorted("sort_asc_nulls_first", [{"field": "sticky", "nulls": "first"}, {"field": "url"}], f"{_E} ASC NULLS FIRST, url, \"objectId\"")
_sorted("sort_desc_nulls_first", [{"field": "sticky", "direction": "DESC", "nulls": "First"}, {"field": "url", "direction": "desc"}], f"{_E} DESC NULLS FIRST, url DESC, \"objectId\"")


@_register("sort_desc", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE status = 'click' ORDER BY {_AT} DESC, \"objectId\" LIMIT 25")
def _sort_desc(spark, sf):
    return query.select(comments(spark, sf), {"status": "click"}, desc="insertedAt", limit=25).select(*_C)


_PAGE = f"url = '/u/8' AND status NOT IN ('error') AND coalesce(rid, '') = '' ORDER BY {_E} DESC NULLS LAST, {_AT} DESC, \"objectId\""


@_register("list_page", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE {_PAGE} LIMIT 10")
def list_page(spark, sf):
    return shapes.list_page(comments(spark, sf), "/u/8", hidden=["error"]).select(*_C)


@_register("page2", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE {_PAGE.replace(chr(39) + '/u/8' + chr(39), chr(39) + '/u/9' + chr(39))} LIMIT 2 OFFSET 2")
def _page2(spark, sf):
    return shapes.list_page(comments(spark, sf), "/u/9", page=2, size=2, hidden=["error"]).select(*_C)


@_register("page_children", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE status NOT IN ('error') AND rid IN (SELECT \"objectId\" FROM comments WHERE {_PAGE} LIMIT 10)")
def _page_children(spark, sf):
    c = comments(spark, sf)
    return shapes.children(c, shapes.list_page(c, "/u/8", hidden=["error"]), hidden=["error"]).select(*_C)


@_register("page_counts", f"WITH {COMMENTS} SELECT count(*) AS comments, count(*) FILTER (WHERE rid = '') AS threads FROM comments WHERE url = '/u/8' AND status NOT IN ('error')")
def _page_counts(spark, sf):
    return shapes.page_counts(comments(spark, sf), "/u/8", hidden=["error"])


@_register("count", f"WITH {COMMENTS} SELECT count(*) AS count FROM comments WHERE status <> 'error'")
def _count(spark, sf):
    return query.count(comments(spark, sf), {"status": ["!=", "error"]})


@_register("count_group", f"WITH {COMMENTS} SELECT url, count(*) AS count FROM comments GROUP BY url")
def _count_group(spark, sf):
    return query.count(comments(spark, sf), None, ["url"])


@_register("count_group_two", f"WITH {COMMENTS} SELECT coalesce(sticky, '') AS sticky, status, count(*) AS count FROM comments GROUP BY ALL")
def _count_group_two(spark, sf):
    return query.count(comments(spark, sf), None, ["sticky", "status"])


@_register("count_group_empty", f"WITH {COMMENTS} SELECT count(*) AS count FROM comments WHERE status = 'click' HAVING count(*) > 0")
def _count_group_empty(spark, sf):
    return query.count(comments(spark, sf), {"status": "click"}, [])


@_register("recent", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE status NOT IN ('error') ORDER BY {_AT} DESC, \"objectId\" LIMIT 10")
def _recent(spark, sf):
    return shapes.recent(comments(spark, sf), hidden=["error"]).select(*_C)


@_register("admin_search", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE contains(comment, 'k') AND status = 'purchase' ORDER BY {_AT} DESC, \"objectId\" LIMIT 10 OFFSET 10")
def _admin_search(spark, sf):
    return shapes.search(comments(spark, sf), "k", page=2, status="purchase").select(*_C)


@_register("document_search", "SELECT doc_id FROM documents WHERE contains(text, 'License')")
def _document_search(spark, sf):
    return query.select(_table(spark, sf, "documents"), {"text": ["LIKE", "%License%"]}, primary_key="doc_id", field=["id"])


@_register("rate_limit", f"WITH {COMMENTS} SELECT count(*) AS count FROM comments WHERE ip = '10.0.0.7' AND {_AT} > {_SINCE}")
def _rate_limit(spark, sf):
    return shapes.recent_by_ip(comments(spark, sf), "10.0.0.7", SINCE)


@_register("visible_or_own", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE url = '/u/12' AND (status NOT IN ('error', 'view') OR user_id = '12')")
def _visible_or_own(spark, sf):
    return shapes.visible_or_own(comments(spark, sf), "/u/12", "12", hidden=["error", "view"]).select(*_C)


@_register("user_lookup", f"WITH {USERS} SELECT \"objectId\", email, display_name, type FROM users WHERE email = 'u42@example.com' AND type <> 'banned'")
def _user_lookup(spark, sf):
    return shapes.user_by_email(users(spark, sf), "u42@example.com")


@_register("user_join", f"WITH {COMMENTS}, {USERS} SELECT c.\"objectId\", c.user_id, u.display_name, u.type AS user_type FROM comments c LEFT JOIN users u ON c.user_id = u.\"objectId\"")
def _user_join(spark, sf):
    return shapes.with_users(comments(spark, sf), users(spark, sf)).select("objectId", "user_id", "display_name", "user_type")


@_register("counter_batch", f"WITH {COUNTERS} SELECT \"objectId\", time, url FROM counters WHERE url IN ('/u/1', '/u/2', '/u/11')")
def _counter_batch(spark, sf):
    return shapes.counters(counter_rows(spark, sf), ["/u/1", "/u/2", "/u/11"])


# layout

_PAGES = TableSpec("Comment", ("objectId", "url"), "url")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("objectId"), "url")


PAGES = "pages_ AS (SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS \"objectId\", url FROM pages)"
FAMILY = "substr(sha1(url), 1, 2) || '/' || substr(sha1(url), 1, 4)"


@_register("shard_family", f"WITH {PAGES} SELECT \"objectId\", {FAMILY} AS family, 'Comment/' || {FAMILY} || '.csv' AS shard_path FROM pages_")
def _shard_family(spark, sf):
    rows = layout.with_family(pages(spark, sf), _PAGES)
    return rows.select("objectId", "family", layout.path_column("Comment", F.col("family"), F.lit(0)).alias("shard_path"))


@_register("user_family", f"WITH {USERS} SELECT \"objectId\", substr(\"objectId\", 1, 2) || '/' || substr(\"objectId\", 1, 2) AS family FROM users")
def _user_family(spark, sf):
    return layout.with_family(users(spark, sf), TABLES["Users"]).select("objectId", "family")


@_register("family_scan", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE url IN ('/u/3', '/u/4')")
def _family_scan(spark, sf):
    """From a store of all comments, whose other families' folders are not read."""
    where = {"url": ["IN", ["/u/3", "/u/4"]]}
    store = Store(spark, _tmp(spark), StoreConfig(shard_hash_len=1), clock=lambda: NOW)
    store.add("Comment", comments(spark, sf).withColumn("pid", F.col("objectId")), dedup=False)
    assert set(families(TABLES["Comment"], where, 1)) >= {layout.parse_shard_path(p)[1] for p in store.shards("Comment", where)}
    found = store.select("Comment", where).withColumn("objectId", F.col("pid"))
    return found.select(*[F.when(F.col("objectId").cast("bigint") % 7 == 1, F.lit(None)).otherwise(F.col("sticky")).alias(c) if c == "sticky" else F.col(c) for c in _C])


_SPLIT = f"SELECT *, CAST(floor((row_number() OVER (PARTITION BY family ORDER BY \"objectId\") - 1) / 2.0) AS INT) AS suffix FROM (SELECT *, substr(sha1(url), 1, 1) || '/' || substr(sha1(url), 1, 3) AS family FROM pages_)"


def _split(spark, sf) -> DataFrame:
    return layout.split(layout.with_family(pages(spark, sf), _PAGES, 1), 2)


@_register("shard_split", f"WITH {PAGES} SELECT \"objectId\", family, suffix FROM ({_SPLIT})")
def _shard_split(spark, sf):
    return _split(spark, sf).select("objectId", "family", "suffix")


@_register("fill_first", f"""WITH {PAGES}, f AS (SELECT *, substr(sha1(url), 1, 1) || '/' || substr(sha1(url), 1, 3) AS family FROM pages_),
n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY "objectId") - 1 AS n FROM f)
SELECT "objectId", family, CAST(CASE WHEN n < 1 THEN 0 WHEN n < 3 THEN 1 ELSE 2 + floor((n - 3) / 3.0) END AS INT) AS suffix FROM n""")
def _fill_first(spark, sf):
    rows = layout.with_family(pages(spark, sf), _PAGES, 1)
    held = rows.select("family").distinct().select("family", F.explode(F.array(F.struct(F.lit(0).alias("suffix"), F.lit(2).alias("row_count")), F.struct(F.lit(1).alias("suffix"), F.lit(1).alias("row_count")))).alias("x")).select("family", "x.suffix", "x.row_count")
    return layout.route(rows, held, 3).select("objectId", "family", "suffix")


@_register("hot_family", f"""WITH {COMMENTS}, f AS (SELECT "objectId", CASE WHEN CAST("objectId" AS BIGINT) % 3 = 0 THEN 'hot' ELSE url END AS family FROM comments),
n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY "objectId") - 1 AS n FROM f)
SELECT "objectId", family, CAST(CASE WHEN family <> 'hot' THEN floor(n / 20.0) WHEN n < 13 THEN 0 ELSE 2 + floor((n - 13) / 20.0) END AS INT) AS suffix FROM n""")
def _hot_family(spark, sf):
    """A third of all rows in one family, which is numbered in parts."""
    rows = comments(spark, sf).select("objectId", F.when(F.col("objectId").cast("bigint") % 3 == 0, "hot").otherwise(F.col("url")).alias("family"))
    held = spark.createDataFrame([("hot", 0, 7), ("hot", 1, 20)], "family string, suffix int, row_count bigint")
    return layout.route(rows, held, 20, sample=64)


_PATHS = f"SELECT 'Comment/' || family || CASE WHEN suffix > 0 THEN '-' || CAST(suffix AS VARCHAR) ELSE '' END || '.csv' AS shard_path, family, suffix, \"objectId\", url FROM ({_SPLIT})"


def _pathed(spark, sf) -> DataFrame:
    rows = _split(spark, sf)
    return rows.withColumn("shard_path", layout.path_column("Comment", F.col("family"), F.col("suffix")))


@_register("parse_path", f"WITH {PAGES} SELECT DISTINCT shard_path, 'Comment' AS table_name, family, suffix FROM ({_PATHS})")
def _parse_path(spark, sf):
    table, family, suffix = layout.parse_columns(F.col("shard_path"))
    return _pathed(spark, sf).select("shard_path").distinct().select("shard_path", table.alias("table_name"), family.alias("family"), suffix.alias("suffix"))


_MANIFEST = f"SELECT shard_path, count(*) AS row_count, min(url) AS min_key, max(url) AS max_key FROM ({_PATHS}) GROUP BY shard_path"


@_register("manifest", f"WITH {PAGES} {_MANIFEST} ORDER BY shard_path")
def _manifest(spark, sf):
    return manifest.entries(_pathed(spark, sf), _PAGES).orderBy("shard_path")


#: Shards of four rows, of which most rows are deleted afterwards, so that many families fit in one file again.
_THINNED = f"SELECT * FROM (SELECT \"objectId\", family, CAST(floor((row_number() OVER (PARTITION BY family ORDER BY \"objectId\") - 1) / 4.0) AS INT) AS suffix FROM (SELECT *, {FAMILY} AS family FROM comments)) WHERE CAST(\"objectId\" AS BIGINT) % 20 = 0"


def _thinned(spark, sf) -> DataFrame:
    rows = layout.split(layout.with_family(comments(spark, sf), TABLES["Comment"]), 4)
    return rows.where(F.col("objectId").cast("bigint") % 20 == 0).select("objectId", "family", "suffix")


@_register("merge_plan", f"WITH {COMMENTS} SELECT family, count(DISTINCT suffix) AS files, CAST(count(*) AS BIGINT) AS row_count FROM ({_THINNED}) GROUP BY family HAVING count(DISTINCT suffix) > 1 AND count(*) <= 4")
def _merge_plan(spark, sf):
    counts = _thinned(spark, sf).groupBy("family", "suffix").agg(F.count("*").alias("row_count"))
    return layout.merge_plan(counts, 4)


@_register("compact", f"WITH {COMMENTS}, p AS ({_THINNED}), m AS (SELECT family FROM p GROUP BY family HAVING count(*) <= 4 AND count(DISTINCT suffix) > 1) SELECT \"objectId\", family, CASE WHEN family IN (SELECT family FROM m) THEN 0 ELSE suffix END AS suffix FROM p")
def _compact(spark, sf):
    rows = _thinned(spark, sf)
    plan = layout.merge_plan(rows.groupBy("family", "suffix").agg(F.count("*").alias("row_count")), 4)
    marked = rows.join(plan.select("family", F.lit(True).alias("merge")), "family", "left")
    return marked.select("objectId", "family", F.when(F.col("merge"), 0).otherwise(F.col("suffix")).alias("suffix"))


@_register("manifest_sha", f"""WITH {PAGES}, p AS ({_PATHS}), c AS (SELECT shard_path, 'objectId,url' || chr(10) || string_agg("objectId" || ',' || url, chr(10) ORDER BY "objectId") || chr(10) AS content FROM p GROUP BY shard_path)
SELECT shard_path, sha1('blob ' || CAST(strlen(content) AS VARCHAR) || chr(0) || content) AS sha FROM c""")
def _manifest_sha(spark, sf):
    return manifest.with_sha(manifest.contents(_pathed(spark, sf), _PAGES, ["objectId", "url"])).select("shard_path", "sha")


def _two_manifests(spark, sf):
    rows = _pathed(spark, sf)
    old = manifest.with_sha(manifest.contents(rows, _PAGES, ["objectId", "url"])).select("shard_path", "sha")
    number = F.col("objectId").cast("bigint")
    changed = rows.where(number % 10 != 3).withColumn("url", F.when(number % 10 == 5, F.concat("url", F.lit("#"))).otherwise(F.col("url"))).where(~F.col("shard_path").startswith("Comment/a"))
    new = manifest.with_sha(manifest.contents(changed, _PAGES, ["objectId", "url"])).select("shard_path", "sha")
    return old, new


_TWO = f"""p AS ({_PATHS}), a AS (SELECT shard_path, md5(string_agg("objectId" || ',' || url, chr(10) ORDER BY "objectId")) AS sha FROM p GROUP BY 1),
b AS (SELECT shard_path, md5(string_agg("objectId" || ',' || CASE WHEN CAST("objectId" AS BIGINT) % 10 = 5 THEN url || '#' ELSE url END, chr(10) ORDER BY "objectId")) AS sha
  FROM p WHERE CAST("objectId" AS BIGINT) % 10 <> 3 AND NOT starts_with(shard_path, 'Comment/a') GROUP BY 1)"""


@_register("manifest_diff", f"""WITH {PAGES}, {_TWO} SELECT coalesce(a.shard_path, b.shard_path) AS shard_path,
CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.shard_path = b.shard_path WHERE a.sha IS DISTINCT FROM b.sha""")
def _manifest_diff(spark, sf):
    return manifest.diff(*_two_manifests(spark, sf))


@_register("carry_forward", f"WITH {PAGES}, {_TWO} SELECT shard_path, b.sha IS NOT NULL AS rewritten FROM a LEFT JOIN b USING (shard_path) WHERE NOT (b.sha IS NULL AND starts_with(shard_path, 'Comment/a0'))")
def _carry_forward(spark, sf):
    old, new = _two_manifests(spark, sf)
    removed = old.where(F.col("shard_path").startswith("Comment/a0")).join(new, "shard_path", "left_anti")
    mark = lambda df, v: df.select("shard_path", F.lit(v).alias("rewritten"))
    return manifest.carry_forward(mark(old, False), mark(new, True), removed)


@_register("content_sha", "SELECT doc_id, sha1('blob ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS sha FROM documents")
def _content_sha(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", content_sha(F.col("text")).alias("sha"))


# cells and files


@_register("normalize_row", """SELECT CAST(event_id AS VARCHAR) AS "objectId", strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "insertedAt", CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
CAST(event_id % 10 AS VARCHAR) AS whole, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS status, '{"k":' || CAST(event_id AS VARCHAR) || '}' AS obj FROM events""")
def _normalize_row(spark, sf):
    e = _table(spark, sf, "events").select(F.col("event_id").alias("objectId"), F.col("ts").alias("insertedAt"), (F.col("event_id") % 2 == 0).alias("flag"), (F.col("event_id") % 10).cast("double").alias("whole"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("status"), F.struct(F.col("event_id").alias("k")).alias("obj"))
    return manifest.normalize(e, TABLES["Comment"]).select("objectId", "insertedAt", "flag", "whole", "status", "obj")


_LINE = """'"' || replace(text, '"', '""') || '"'"""


@_register("csv_encode", f"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[\",\\n\\r]|^\\s|\\s$') THEN {_LINE} ELSE text END) AS line_md5 FROM documents")
def _csv_encode(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(manifest.csv_field(F.col("text"))).alias("line_md5"))


def _tmp(spark: SparkSession) -> str:
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{where.rstrip('/')}/shardquill/{uuid.uuid4().hex}" if where else tempfile.mkdtemp(prefix="shardquill-")


@_register("csv_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS \"objectId\", md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS lang, CASE WHEN doc_id % 2 = 1 THEN source ELSE '' END AS source FROM documents")
def _csv_roundtrip(spark, sf):
    docs, path = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("objectId"), "text", "lang", "source", (F.col("doc_id") % 2).alias("odd")), _tmp(spark)
    csvio.write_csv(docs.where("odd = 0").select("objectId", "text", "lang"), f"{path}/even")
    csvio.write_csv(docs.where("odd = 1").select("objectId", "text", "source"), f"{path}/odd")
    back = csvio.read_groups(spark, {("objectId", "text", "lang"): [f"{path}/even"], ("objectId", "text", "source"): [f"{path}/odd"]})
    return back.select("objectId", F.md5("text").alias("text_md5"), "lang", "source")


_CANONICAL = ", ".join(f"({i}, '{c}')" for i, c in enumerate(TABLES["Comment"].columns))


@_register("dynamic_columns", f"""WITH c(place, name) AS (VALUES {_CANONICAL}), n AS (SELECT DISTINCT unnest(json_keys(props)) AS name FROM events UNION SELECT DISTINCT event_type FROM events UNION SELECT 'url')
SELECT name, place FROM c UNION ALL SELECT name, CAST((SELECT count(*) FROM c) + row_number() OVER (ORDER BY name) - 1 AS INT) FROM n WHERE name NOT IN (SELECT name FROM c)""")
def _dynamic_columns(spark, sf):
    """A header of rows whose further columns are those that the data names: its JSON keys and types."""
    e = _table(spark, sf, "events")
    named = e.select(F.explode(F.json_object_keys("props")).alias("name")).union(e.select("event_type")).distinct()
    header = manifest.columns_of(TABLES["Comment"], [r[0] for r in named.collect()] + ["url"])  # names of columns: a few
    return spark.createDataFrame([(c, i) for i, c in enumerate(header)], "name string, place int")


@_register("shard_order", f"WITH {PAGES}, p AS (SELECT DISTINCT shard_path, family, suffix FROM ({_PATHS})) SELECT shard_path, CAST(row_number() OVER (ORDER BY family, suffix) - 1 AS INT) AS place FROM p")
def _shard_order(spark, sf):
    """Paths as a listing sorts them: a family's base file first, then its numbered ones by number."""
    paths = sorted((r[0] for r in _pathed(spark, sf).select("shard_path").distinct().collect()), key=layout.shard_order)  # a store's listing, held by the driver
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "shard_path string, place int")


@_register("manifest_codec", f"WITH {PAGES} {_MANIFEST}")
def _manifest_codec(spark, sf):
    """A manifest written as text and read back."""
    held = [r.asDict() for r in manifest.entries(_pathed(spark, sf), _PAGES).collect()]
    back = csvio.decode_manifest(csvio.encode_manifest(held))
    return spark.createDataFrame([(p, e["row_count"], e["min_key"], e["max_key"]) for p, e in back.items()], "shard_path string, row_count bigint, min_key string, max_key string")


@_register("migrate", """SELECT CAST(event_id AS VARCHAR) AS "objectId", '/u/' || CAST(user_id AS VARCHAR) AS url, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "insertedAt" FROM events WHERE event_id % 9 <> 0""")
def _migrate(spark, sf):
    e, path = _table(spark, sf, "events"), _tmp(spark)
    old = e.select(F.when(F.col("event_id") % 9 != 0, F.col("event_id").cast("string")).otherwise("").alias("id"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS").alias("insertedAt"))
    csvio.write_csv(old, f"{path}/legacy")
    return csvio.migrate(spark, f"{path}/legacy", TABLES["Comment"], "yyyy/MM/dd HH:mm:ss.SSS").select("objectId", "url", "insertedAt")


# writes

NOW = dt.datetime(2026, 9, 25, 10, tzinfo=dt.UTC)
_NOW = "'2026-09-25T10:00:00.000Z'"


@_register("dml_add", f"WITH {COMMENTS} SELECT \"objectId\", url, status, \"insertedAt\", '' AS \"createdAt\" FROM comments UNION ALL SELECT 'n' || \"objectId\", url, 'new', \"insertedAt\", {_NOW} FROM comments WHERE status = 'click'")
def _dml_add(spark, sf):
    base = comments(spark, sf)
    new = base.where("status = 'click'").select(F.col("objectId").alias("was"), "url", F.lit("new").alias("status"), "insertedAt")
    table = manifest.normalize(base, TABLES["Comment"])
    return dml.add(table, new, TABLES["Comment"], ids=F.concat(F.lit("n"), "was"), now=NOW).select("objectId", "url", "status", "insertedAt", "createdAt")


@_register("dml_update", f"WITH {COMMENTS} SELECT \"objectId\", CASE WHEN status = 'error' THEN 'fixed' ELSE status END AS status, CASE WHEN status = 'error' THEN url || '?' ELSE url END AS url, CASE WHEN status = 'error' THEN {_NOW} ELSE '' END AS \"updatedAt\" FROM comments")
def _dml_update(spark, sf):
    patch = lambda df: {"status": "fixed", "url": F.concat("url", F.lit("?")), "objectId": "never", "updatedAt": "never"}
    return dml.update(comments(spark, sf), patch, {"status": "error"}, TABLES["Comment"], now=NOW).select("objectId", "status", "url", "updatedAt")


@_register("dml_delete", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE NOT (status = 'error' AND coalesce(sticky, '') = '')")
def _dml_delete(spark, sf):
    return dml.delete(comments(spark, sf), {"status": "error", "sticky": None}).select(*_C)


@_register("cascade_delete", f"WITH {COMMENTS} SELECT {_S} FROM comments WHERE NOT (\"objectId\" IN ('3', '6') OR rid IN ('3', '6'))")
def _cascade_delete(spark, sf):
    return dml.delete(comments(spark, sf), dml.cascade(["3", "6"])).select(*_C)


@_register("counter_inc", f"WITH {COUNTERS} SELECT \"objectId\", CASE WHEN url IN ('/u/1', '/u/11') THEN CAST(coalesce(CAST(nullif(time, '') AS BIGINT), 0) + 1 AS VARCHAR) ELSE time END AS time FROM counters")
def _counter_inc(spark, sf):
    return dml.update(counter_rows(spark, sf), dml.increment("time"), {"url": ["IN", ["/u/1", "/u/11"]]}, TABLES["Counter"], now=NOW).select("objectId", "time")


@_register("dedup_hash", f"WITH {COMMENTS} SELECT \"objectId\", sha1(coalesce(mail, '') || chr(0) || coalesce(url, '') || chr(0) || comment) AS hash FROM comments")
def _dedup_hash(spark, sf):
    return comments(spark, sf).select("objectId", dml.dedup_hash(F.col("mail"), F.col("url"), F.col("comment")).alias("hash"))


@_register("dedup_window", """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT event_id, user_id, event_type, n, ts AS last, true AS kept FROM o WHERE n = 1 UNION ALL
 SELECT o.event_id, o.user_id, o.event_type, o.n, CASE WHEN o.ts > k.last + INTERVAL 1 DAY THEN o.ts ELSE k.last END, o.ts > k.last + INTERVAL 1 DAY FROM k JOIN o ON o.user_id = k.user_id AND o.event_type = k.event_type AND o.n = k.n + 1)
SELECT event_id, user_id, event_type FROM k WHERE kept""")
def _dedup_window(spark, sf):
    return dml.dedup_window(_table(spark, sf, "events"), ["user_id", "event_type"], "ts", 86_400, "event_id").select("event_id", "user_id", "event_type")


@_register("dedup_window_repeats", """WITH RECURSIVE e AS (SELECT event_id % 5 AS id, user_id, ts, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM e),
k AS (SELECT id, user_id, n, ts, ts AS last, true AS kept FROM o WHERE n = 1 UNION ALL
 SELECT o.id, o.user_id, o.n, o.ts, CASE WHEN o.ts > k.last + INTERVAL 12 HOUR THEN o.ts ELSE k.last END, o.ts > k.last + INTERVAL 12 HOUR FROM k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1)
SELECT id, user_id, ts FROM k WHERE kept""")
def _dedup_window_repeats(spark, sf):
    """Ids that repeat within groups and across them."""
    rows = _table(spark, sf, "events").select((F.col("event_id") % 5).alias("id"), "user_id", "ts")
    return dml.dedup_window(rows, ["user_id"], "ts", 43_200, "id")


# merges


@_register("merge_local_first", f"""WITH {COMMENTS}, l AS (SELECT * FROM comments WHERE CAST("objectId" AS BIGINT) % 4 = 0), d AS (SELECT "objectId" FROM comments WHERE CAST("objectId" AS BIGINT) % 10 = 1)
SELECT "objectId", 'local' AS side FROM l UNION ALL SELECT "objectId", 'remote' FROM comments WHERE "objectId" NOT IN (SELECT "objectId" FROM l) AND "objectId" NOT IN (SELECT "objectId" FROM d)""")
def _merge_local_first(spark, sf):
    c = comments(spark, sf)
    number = F.col("objectId").cast("bigint")
    local = c.where(number % 4 == 0).withColumn("side", F.lit("local"))
    remote = c.withColumn("side", F.lit("remote")).unionByName(c.withColumn("objectId", F.lit("")).withColumn("side", F.lit("keyless")))
    return merge.local_first(local, remote, c.where(number % 10 == 1)).select("objectId", "side")


@_register("merge_three_way", """WITH b AS (SELECT event_id AS i, event_type AS s FROM events)
SELECT CAST(i AS VARCHAR) AS "objectId", CASE WHEN i % 5 = 0 THEN 'local' WHEN i % 3 = 0 THEN 'remote' ELSE s END AS status FROM b WHERE i % 7 <> 1 AND NOT (i % 11 = 1 AND i % 5 <> 0)""")
def _merge_three_way(spark, sf):
    base = comments(spark, sf).select("objectId", "status")
    n = F.col("objectId").cast("bigint")
    local = base.where(n % 7 != 1).withColumn("status", F.when(n % 5 == 0, "local").otherwise(F.col("status")))
    remote = base.where(n % 11 != 1).withColumn("status", F.when(n % 3 == 0, "remote").otherwise(F.col("status")))
    return merge.three_way(base, local, remote)


@_register("delta_merge", f"""WITH {COUNTERS}, d AS (SELECT 'c' || CAST(user_id AS VARCHAR) AS "objectId", CAST(sum(event_id % 3) AS BIGINT) AS d FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
SELECT c."objectId", CASE WHEN d.d IS NULL THEN c.time ELSE CAST(coalesce(CAST(nullif(c.time, '') AS BIGINT), 0) + d.d AS VARCHAR) END AS time FROM counters c LEFT JOIN d ON c."objectId" = d."objectId" """)
def _delta_merge(spark, sf):
    changes = _table(spark, sf, "events").where("user_id % 2 = 0").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("objectId"), F.lit("time").alias("field"), (F.col("event_id") % 3).alias("delta"))
    return merge.merge_counters(counter_rows(spark, sf), changes, TABLES["Counter"]).select("objectId", "time")


@_register("delta_merge_rows", f"""WITH {COUNTERS}, d AS (SELECT 'c' || CAST(user_id AS VARCHAR) AS "objectId", CAST(sum(event_id % 3) AS BIGINT) AS d FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
u AS (SELECT c."objectId", c.time, c.url, CAST(replace(c.url, '/u/', '') AS BIGINT) AS n, coalesce(d.d, 0) AS d FROM counters c LEFT JOIN d ON c."objectId" = d."objectId")
SELECT "objectId", CASE WHEN n % 5 = 0 THEN '1' WHEN time = '' THEN '1' ELSE CAST(CAST(time AS BIGINT) + CASE WHEN n % 7 = 0 THEN 0 ELSE d END AS VARCHAR) END AS time,
 CASE WHEN n % 5 = 0 OR n % 7 <> 0 THEN 'local' ELSE url END AS url, CASE WHEN n % 5 = 0 OR (n % 7 <> 0 AND n % 2 = 0) THEN '2024-02-01T00:00:00.000Z' ELSE CASE WHEN n % 7 = 0 OR n % 3 = 0 THEN '2024-03-01T00:00:00.000Z' ELSE '2024-01-15T00:00:00.000Z' END END AS "updatedAt"
FROM (SELECT * FROM u WHERE n % 5 <> 0 OR n % 7 <> 0) WHERE NOT (n % 2 = 0 AND n % 3 = 0 AND n % 5 <> 0 AND n % 7 <> 0)
UNION ALL SELECT "objectId", CASE WHEN time = '' THEN '1' ELSE CAST(CAST(time AS BIGINT) + d AS VARCHAR) END, 'local', '2024-03-01T00:00:00.000Z' FROM u WHERE n % 2 = 0 AND n % 3 = 0 AND n % 5 <> 0 AND n % 7 <> 0""")
def _delta_merge_rows(spark, sf):
    """Whole rows: counters add up, other columns stay local, the newer time wins; some rows are only local, some only remote."""
    number = F.regexp_replace("url", "/u/", "").cast("bigint")
    base = counter_rows(spark, sf)
    all_ = base.where((number % 5 != 0) | (number % 7 != 0))
    local_at = F.when((number % 2 == 0) | (number % 5 == 0), "2024-02-01T00:00:00.000Z").otherwise("2024-01-01T00:00:00.000Z")
    remote_at = F.when((number % 3 == 0) | (number % 7 == 0), "2024-03-01T00:00:00.000Z").otherwise("2024-01-15T00:00:00.000Z")
    local = all_.where(number % 7 != 0).select("objectId", F.lit("1").alias("time"), F.lit("local").alias("url"), local_at.alias("updatedAt"))
    remote = all_.where(number % 5 != 0).select("objectId", F.when(number % 7 == 0, F.when(F.col("time") == "", "1").otherwise(F.col("time"))).otherwise(F.col("time")).alias("time"), "url", remote_at.alias("updatedAt"))
    changes = _table(spark, sf, "events").where("user_id % 2 = 0").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("objectId"), F.lit("time").alias("field"), (F.col("event_id") % 3).alias("delta"))
    return merge.merge_rows(local, remote, changes)


@_register("thread_pages", "SELECT conv_id, turn, role FROM conversations WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 ORDER BY conv_id DESC LIMIT 20)")
def _thread_pages(spark, sf):
    c = _table(spark, sf, "conversations")
    # the limit is the feature: a page of threads
    roots = query.select(c, {"turn": 0}, desc="conv_id", limit=20, primary_key="conv_id").select("conv_id")
    return c.where("turn > 0").join(F.broadcast(roots), "conv_id", "left_semi").select("conv_id", "turn", "role")


# the store: nations as counters, one url a region


def _store(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, _tmp(spark), clock=lambda: NOW)
    n = _table(spark, sf, "nation")
    store.add("Counter", n.select(F.concat(F.lit("/r/"), F.col("n_regionkey").cast("string")).alias("url"), F.col("n_nationkey").alias("time"), F.col("n_name").alias("name")))
    return store


_NATIONS = "SELECT '/r/' || CAST(n_regionkey AS VARCHAR) AS url, CAST(n_nationkey AS VARCHAR) AS time, n_name AS name FROM nation"
_N = ["url", "time", "name"]


@_register("version_pin", _NATIONS)
def _version_pin(spark, sf):
    store = _store(spark, sf)
    store.update("Counter", {"time": 0}, {"url": "/r/1"})
    return store.select("Counter", version=0).select(*_N)


@_register("store_changes", f"SELECT url, CASE WHEN url = '/r/1' THEN CAST(CAST(time AS BIGINT) + 1 AS VARCHAR) ELSE time END AS time, name FROM ({_NATIONS}) WHERE url <> '/r/2'")
def _store_changes(spark, sf):
    store = _store(spark, sf)
    store.begin().update("Counter", dml.increment("time"), {"url": "/r/1"}).delete("Counter", {"url": "/r/2"}).commit()
    return store.select("Counter").select(*_N)


@_register("snapshot_restore", _NATIONS)
def _snapshot_restore(spark, sf):
    store = _store(spark, sf)
    date = store.create_snapshot()
    store.delete("Counter", {"url": ["IN", ["/r/2", "/r/3"]]})
    store.restore(date)
    return store.select("Counter").select(*_N)


@_register("rebuild", f"SELECT * FROM ({_NATIONS}) WHERE url <> '/r/3'")
def _rebuild(spark, sf):
    store = _store(spark, sf)
    store.files.remove(next(e["place"] for e in store.manifest("Counter").values() if e["min_key"] == "/r/3"))
    store.rebuild("Counter")
    return store.select("Counter").select(*_N)


@_register("rebuild_unlisted", _NATIONS)
def _rebuild_unlisted(spark, sf):
    """A shard that the manifest has lost comes back from what is stored."""
    store = _store(spark, sf)
    held = store.manifest("Counter")
    for x in store.files.list("_log"):
        store.files.remove(f"_log/{x}")
    store.publish(-1, {"Counter": store.write_manifest("Counter", {p: e for p, e in held.items() if e["min_key"] != "/r/3"})}, "an entry is lost")
    store.rebuild("Counter", unlisted=True)
    return store.select("Counter").select(*_N)


@_register("snapshot_list", "SELECT * FROM (VALUES ('2024-03-03'), ('2024-03-02')) t(date)")
def _snapshot_list(spark, sf):
    store = _store(spark, sf)
    for day in ("2024-03-01", "2024-03-03", "2024-03-02"):
        store.create_snapshot(day)
    store.prune_snapshots(2)
    return spark.createDataFrame([(d,) for d in store.snapshots()], "date string")


@_register("snapshot_import", _NATIONS)
def _snapshot_import(spark, sf):
    """A snapshot's list of paths and content addresses, read back under another date and restored."""
    store = _store(spark, sf)
    text = store.snapshot_csv(store.create_snapshot("2024-03-01"))
    store.delete("Counter", {"url": ["IN", ["/r/2", "/r/3"]]})
    store.prune_snapshots(1)
    store.restore(store.import_snapshot("2024-02-01", text))
    return store.select("Counter").select(*_N)


@_register("commit_conflict", f"SELECT url, CAST(CAST(time AS BIGINT) + 1 + CASE WHEN url = '/r/1' THEN 1 ELSE 0 END AS VARCHAR) AS time, name FROM ({_NATIONS}) UNION ALL SELECT '/r/9', '7', 'late'")
def _commit_conflict(spark, sf):
    """Two writers begin at one version: the later one's changes are applied again, so both count."""
    store = _store(spark, sf)
    late = store.begin().update("Counter", dml.increment("time"), None)
    late.add("Counter", [{"url": "/r/9", "time": 7, "name": "late"}])
    rival, publish = Store(spark, store.root.rsplit("/", 1)[0], clock=lambda: NOW, sleep=lambda s: None), store.publish

    def beaten(*args, **kwargs):
        store.publish = publish
        rival.update("Counter", dml.increment("time"), {"url": "/r/1"})
        return publish(*args, **kwargs)

    store.publish, store.sleep = beaten, lambda s: None
    late.commit()
    return store.select("Counter").select(*_N)


@_register("reset_state", f"SELECT *, CAST(0 AS INT) AS older FROM ({_NATIONS}) WHERE url <> '/r/4'")
def _reset_state(spark, sf):
    """Versions before a reset are gone, the rows stay."""
    store = _store(spark, sf)
    store.delete("Counter", {"url": "/r/4"})
    version = store.reset(confirm=True)
    older = sum(int(x[:-5]) < version for x in store.files.list("_log"))
    return store.select("Counter").select(*_N, F.lit(older).alias("older"))


@_register("daily_snapshot", f"SELECT *, true AS first, false AS again FROM ({_NATIONS})")
def _daily_snapshot(spark, sf):
    """The day's snapshot is made once, and holds what was there."""
    store = _store(spark, sf)
    first, again = store.maybe_run_daily(), store.maybe_run_daily()
    store.delete("Counter", None)
    store.restore(store.snapshots()[0])
    return store.select("Counter").select(*_N, F.lit(first).alias("first"), F.lit(again).alias("again"))


@_register("generated_ids", "SELECT count(*) AS ids, CAST(0 AS BIGINT) AS odd FROM events")
def _generated_ids(spark, sf):
    """Ids of new rows: different, and none empty."""
    store = Store(spark, _tmp(spark), clock=lambda: NOW)
    ids = store.add("Comment", comments(spark, sf).drop("objectId"), dedup=False)
    return ids.agg(F.countDistinct("objectId").alias("ids"), F.coalesce(F.sum((F.col("objectId") == "").cast("bigint")), F.lit(0)).cast("bigint").alias("odd"))


@_register("stream_ingest", f"WITH {COMMENTS} SELECT url, status, \"insertedAt\", comment FROM comments")
def _stream_ingest(spark, sf):
    """Events as a stream into the store; the stream is started again when it has ended, which adds nothing."""
    store, marks = Store(spark, _tmp(spark), clock=lambda: NOW), _tmp(spark)
    schema = _table(spark, sf, "events").schema
    shape = lambda e: e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("status"), F.date_format("ts", ISO).alias("insertedAt"), F.col("props").alias("comment"))
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"), store, "Comment", f"{marks}/checkpoint", shape).awaitTermination()
    return store.select("Comment").select("url", "status", "insertedAt", "comment")


_MALFORMED = {"unknown operator": {"url": ["~", "x"]}, "object": {"url": {"a": 1}}, "empty list": {"url": []}, "top-level logic": {"_logic": "or", "url": "/u/8"}}


@_register("malformed_where", f"SELECT shape, true AS raises, (SELECT count(*) FROM events) AS row_count FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _MALFORMED)}) t(shape)")
def _malformed_where(spark, sf):
    """Conditions that are refused, where others would match every row."""
    rows, out = comments(spark, sf), []
    for shape, where in _MALFORMED.items():
        try:
            query.select(rows, where)
            out.append((shape, False))
        except ValueError:
            out.append((shape, True))
    n = query.count(rows, None).collect()[0][0]  # one number
    return spark.createDataFrame([(*x, n) for x in out], "shape string, raises boolean, row_count bigint")


@_register("shard_of", f"WITH n AS ({_NATIONS}) SELECT name, 'Counter/' || substr(sha1(url), 1, 2) || '/' || substr(sha1(url), 1, 4) || '.csv' AS shard_path FROM n WHERE time IN ('3', '7')")
def _shard_of(spark, sf):
    store = _store(spark, sf)
    ids = store.select("Counter", {"time": ["IN", [3, 7]]}).select("name", "objectId").collect()
    return spark.createDataFrame([(r.name, store.shard_of("Counter", r.objectId)) for r in ids], "name string, shard_path string")


@_register("blob_by_sha", f"SELECT url, CAST(count(*) AS BIGINT) AS row_count FROM ({_NATIONS}) GROUP BY url")
def _blob_by_sha(spark, sf):
    """Each shard's text, found by its content address."""
    store = _store(spark, sf)
    texts = [csvio.decode_rows(store.blob(e["sha"])) for e in store.manifest("Counter").values()]
    return spark.createDataFrame([(t[0]["url"], len(t)) for t in texts], "url string, row_count bigint")


@_register("export_csv", _NATIONS)
def _export_csv(spark, sf):
    store, path = _store(spark, sf), _tmp(spark)
    store.export_csv("Counter", f"{path}/out")
    return csvio.read_groups(spark, csvio.header_groups(spark, f"{path}/out")).select(*_N)


@_register("stats", "SELECT 'Counter' AS name, count(DISTINCT n_regionkey) AS shards, count(*) AS row_count FROM nation")
def _stats(spark, sf):
    found = _store(spark, sf).stats()
    return spark.createDataFrame([(t, n, found["rows"][t]) for t, n in found["shards"].items()], "name string, shards bigint, row_count bigint")


@_register("store_tree", f"WITH n AS ({_NATIONS}) SELECT DISTINCT substr(sha1(url), 1, 2) || '~' || substr(sha1(url), 1, 4) AS family FROM n")
def _store_tree(spark, sf):
    return _store(spark, sf).tree().where("size > 0").select(F.regexp_extract("path", r"family=([^/]+)/", 1).alias("family")).distinct()
