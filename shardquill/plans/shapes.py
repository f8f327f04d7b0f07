"""The queries that a comment service asks, over any comment, user or counter DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .query import count, select

#: Statuses that a visitor does not see.
HIDDEN = ("waiting", "spam")
STICKY_FIRST = [{"field": "sticky", "direction": "desc"}, {"field": "insertedAt", "direction": "desc"}]


def list_page(comments: DataFrame, url: str, page: int = 1, size: int = 10, hidden=HIDDEN) -> DataFrame:
    """A page of a url's visible threads: sticky ones first, then the newest."""
    where = {"url": url, "status": ["NOT IN", list(hidden)], "rid": None}
    return select(comments, where, order=STICKY_FIRST, limit=size, offset=(page - 1) * size)


def children(comments: DataFrame, roots: DataFrame, hidden=HIDDEN) -> DataFrame:
    """The visible replies in a page's threads. A page is small by its size, so its ids are broadcast."""
    ids = F.broadcast(roots.select(F.col("objectId").alias("rid")))
    return select(comments, {"status": ["NOT IN", list(hidden)]}).join(ids, "rid", "left_semi")


def page_counts(comments: DataFrame, url: str, hidden=HIDDEN) -> DataFrame:
    """Comments and threads of a url in one scan."""
    visible = select(comments, {"url": url, "status": ["NOT IN", list(hidden)]})
    root = F.coalesce(F.col("rid"), F.lit("")) == ""
    return visible.agg(F.count("*").alias("comments"), F.count(F.when(root, 1)).alias("threads"))


def counts_by_url(comments: DataFrame, urls: list[str], hidden=HIDDEN) -> DataFrame:
    return count(comments, {"url": ["IN", urls], "status": ["NOT IN", list(hidden)]}, ["url"])


def recent(comments: DataFrame, size: int = 10, hidden=HIDDEN) -> DataFrame:
    return select(comments, {"status": ["NOT IN", list(hidden)]}, desc="insertedAt", limit=size)


def search(comments: DataFrame, keyword: str, page: int = 1, size: int = 10, **where) -> DataFrame:
    return select(comments, {**where, "comment": ["LIKE", f"%{keyword}%"]}, desc="insertedAt", limit=size, offset=(page - 1) * size)


def recent_by_ip(comments: DataFrame, ip: str, since: dt.datetime) -> DataFrame:
    return count(comments, {"ip": ip, "insertedAt": [">", since]})


def visible_or_own(comments: DataFrame, url: str, user: str, hidden=HIDDEN) -> DataFrame:
    return select(comments, {"url": url, "_complex": {"_logic": "or", "status": ["NOT IN", list(hidden)], "user_id": user}})


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return select(users, {"email": email, "type": ["!=", "banned"]}, field=["id", "email", "display_name", "type"])


def with_users(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Comments with their users' names and kinds; comments without a user stay. The join's strategy is Spark's choice."""
    known = users.select(F.col("objectId").alias("user_id"), "display_name", F.col("type").alias("user_type"))
    return comments.join(known, "user_id", "left")


def counters(table: DataFrame, urls: list[str]) -> DataFrame:
    return select(table, {"url": ["IN", urls]})
