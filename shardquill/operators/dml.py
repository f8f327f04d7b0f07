"""Writes as transformations of a table: add, update, delete, duplicate submissions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import iso, moment, number, text_of
from ..plans.predicates import compile_where
from ..plans.spec import TableSpec
from .manifest import normalize


def new_ids() -> Column:
    """13 characters of base 36."""
    return F.lower(F.substring(F.conv(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 15), 16, 36), 1, 13))


def dedup_hash(mail: Column, url: Column, comment: Column) -> Column:
    """What makes two submissions equal; null without a comment, which is never a duplicate."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.when(text(comment) != "", F.sha1(F.concat_ws("\0", text(mail), text(url), text(comment)).cast("binary")))


def dedup_window(rows: DataFrame, by: list[str], time: str, seconds: float, order: str) -> DataFrame:
    """Rows that are accepted in order of time: a row within ``seconds`` of the last accepted one of its group is not.

    Compared with the last accepted row, not the last row, which no window function expresses; rows are dealt by group,
    sorted by (time, order) and streamed once, and a task keeps one time between batches, however large a group is. Rows
    without a time are accepted and block nothing. Nulls of ``by`` are equal; ``order`` may repeat, in a group or across.
    """
    at = F.col(time).cast("timestamp_ntz") if dict(rows.dtypes)[time] == "timestamp_ntz" else moment(F.col(time).cast("string"))
    group = F.struct(*[x for c in by for x in (F.col(c).isNull(), F.col(c))])
    marked = rows.withColumns({"__a": F.xxhash64(group), "__b": F.xxhash64(F.lit("group"), group), "__at": F.unix_micros(at.cast("timestamp"))})
    dealt = marked.repartition("__a", "__b").sortWithinPartitions("__a", "__b", "__at", order)
    names, apart = marked.columns, int(seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            a, b, times = (batch.column(names.index(c)) for c in ("__a", "__b", "__at"))
            a, b, timed = a.to_numpy(), b.to_numpy(), times.is_valid().to_numpy(zero_copy_only=False)
            times = times.fill_null(0).to_numpy()
            keep = ~timed
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if group != (a[lo], b[lo]):
                    group, last = (a[lo], b[lo]), None
                i = lo + int((~timed[lo:hi]).sum())  # nulls are first
                while i < hi:
                    if last is not None and times[i] - last <= apart:
                        i += int(np.searchsorted(times[i:hi], last + apart, side="right"))
                        continue
                    keep[i], last = True, int(times[i])
                    i += 1
            yield batch.filter(pa.array(keep)).select(names[:-3])

    return dealt.mapInArrow(run, rows.schema)


def add(table: DataFrame, new: DataFrame, spec: TableSpec, ids: Column | None = None, now: dt.datetime | None = None) -> DataFrame:
    """``table`` with ``new`` rows, normalized, under ids of their own (a given primary key is not kept)."""
    rows = new.drop(spec.primary_key).withColumn(spec.primary_key, new_ids() if ids is None else ids)
    rows = normalize(rows, spec, defaults=now is None)
    if now is not None:
        for c in ("createdAt", "updatedAt"):
            rows = rows.withColumn(c, F.coalesce(F.nullif(c, F.lit("")), F.lit(iso(now)))) if c in rows.columns else rows
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, patch: dict | Callable[[DataFrame], dict], where: dict | None, spec: TableSpec, now: dt.datetime | None = None, where_column: Column | None = None) -> DataFrame:
    """``table`` with ``patch`` applied to rows of ``where``.

    A patch maps fields to values or Columns, or is a function from the table to such a dict. The primary key stays;
    updatedAt becomes now, whatever the patch says. Fields that are not there yet become columns.
    """
    change = dict(patch(table) if callable(patch) else patch)
    change.pop(spec.primary_key, None)
    change["updatedAt"] = iso(now or dt.datetime.now(dt.UTC))
    hit = where_column if where_column is not None else compile_where(table, where)
    hit = F.lit(True) if hit is None else F.coalesce(hit, F.lit(False))
    out = {}
    for field, value in change.items():
        value = value.cast("string") if isinstance(value, Column) else F.lit(text_of(value))
        old = F.col(f"`{field}`") if field in table.columns else F.lit("")
        out[field] = F.when(hit, value).otherwise(old)
    return table.withColumns(out)


def delete(table: DataFrame, where: dict | None) -> DataFrame:
    """``table`` without rows of ``where``; an empty where deletes every row."""
    hit = compile_where(table, where)
    return table.where(F.lit(False)) if hit is None else table.where(~F.coalesce(hit, F.lit(False)))


def increment(column: str, by: int = 1) -> Callable[[DataFrame], dict]:
    """A patch that adds to a counter; empty counts as 0."""
    return lambda df: {column: (F.coalesce(number(F.col(column)), F.lit(0.0)) + by).cast("bigint").cast("string")}


def cascade(ids: list[str]) -> dict:
    """The where of rows with one of the ids, their children and their threads."""
    return {"_complex": {"_logic": "or", "objectId": ["IN", ids], "pid": ["IN", ids], "rid": ["IN", ids]}}


