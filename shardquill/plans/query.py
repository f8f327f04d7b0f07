"""Reading: filter, order, page and project; counts; lookup by primary key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import moment
from .predicates import compile_where
from .spec import TIME_FIELDS


def filtered(df: DataFrame, where: dict | None) -> DataFrame:
    predicate = compile_where(df, where)
    return df if predicate is None else df.where(predicate)


def _field(name: str, primary_key: str) -> str:
    return primary_key if name == "id" else name


def order_columns(df: DataFrame, order: list[dict] | None = None, desc: str | None = None, primary_key: str = "objectId", times=TIME_FIELDS) -> list[Column]:
    """Sort columns. Empties come last whatever the direction, unless ``nulls`` says first; the primary key breaks ties.

    ``desc`` is short for one descending field and is ignored if ``order`` is given, even an empty one.
    """
    entries = order if order is not None else [{"field": desc, "direction": "desc"}] if desc else []
    out = []
    for entry in entries:
        direction = str(entry.get("direction") or "asc").lower()
        nulls = str(entry.get("nulls") or "last").lower()
        if direction not in ("asc", "desc"):
            raise TypeError(f"no order direction {entry['direction']!r}")
        if nulls not in ("first", "last"):
            raise TypeError(f"no order of nulls {entry['nulls']!r}")
        name = _field(entry["field"], primary_key)
        if name not in df.columns:
            continue  # empty in every row
        column = F.col(f"`{name}`")
        texts = isinstance(df.schema[name].dataType, T.StringType)
        value = F.nullif(column, F.lit("")) if texts else column
        keys = [moment(value), value] if texts and name in times else [value]
        out += [getattr(k, f"{direction}_nulls_{nulls}")() for k in keys]
    if entries and primary_key in df.columns:
        out.append(F.col(f"`{primary_key}`").asc())
    return out


def project(df: DataFrame, fields: list[str] | None, primary_key: str = "objectId") -> DataFrame:
    """The fields asked for that exist, and always the primary key; ``id`` means the primary key. None: all columns."""
    if fields is None:
        return df
    names = [_field(f, primary_key) for f in fields] + [primary_key]
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names) if n in df.columns])


def select(df: DataFrame, where: dict | None = None, *, order: list[dict] | None = None, desc: str | None = None, limit: int = 0, offset: int = 0, field: list[str] | None = None, primary_key: str = "objectId") -> DataFrame:
    """Rows of ``where``, sorted, then from ``offset`` up to ``limit`` (0: all) of them, projected."""
    out = filtered(df, where)
    if columns := order_columns(out, order, desc, primary_key):
        out = out.orderBy(*columns)
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    return project(out, field, primary_key)


def count(df: DataFrame, where: dict | None = None, group: list[str] | None = None) -> DataFrame:
    """One row ``count``, or with ``group`` one row for each different combination; empties are a group of their own.

    An empty ``group`` gives one row, or none where no row matches.
    """
    out = filtered(df, where)
    if group is None:
        return out.agg(F.count("*").alias("count"))
    if not group:
        return out.agg(F.count("*").alias("count")).where("count > 0")
    named = []
    for g in group:
        present = g in df.columns
        texts = present and isinstance(df.schema[g].dataType, T.StringType)
        named.append((F.coalesce(F.col(f"`{g}`"), F.lit("")) if texts else F.col(f"`{g}`") if present else F.lit("")).alias(g))
    return out.groupBy(*named).agg(F.count("*").alias("count"))


def get(df: DataFrame, key, primary_key: str = "objectId") -> DataFrame:
    return filtered(df, {primary_key: key})
