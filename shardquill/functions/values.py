"""How values become the text that is stored and compared: the one type of the store."""

from __future__ import annotations

import datetime as dt
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(value: dt.datetime) -> str:
    """ISO 8601 in UTC with milliseconds; a time without a zone is UTC."""
    value = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)
    return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"


def text_of(value) -> str:
    """A Python value as stored text: None is empty, true and false are words, whole floats lose their point."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return iso(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else "Infinity" if value == math.inf else "-Infinity" if value == -math.inf else str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, (dict, list, tuple)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return str(value)


def cell(column: Column, kind: T.DataType) -> Column:
    """A column of any type as stored text, never null (``normalize``'s counterpart of :func:`text_of`)."""
    if isinstance(kind, T.StringType):
        out = column
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        out = F.date_format(F.to_utc_timestamp(column, F.current_timezone()), ISO)
    elif isinstance(kind, T.TimestampNTZType):
        out = F.date_format(column, ISO)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        out = F.to_json(column)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (F.floor(column) == column) & (F.abs(column) < 1e15)
        out = F.when(whole, column.cast("decimal(18,0)").cast("string")).otherwise(column.cast("string"))
    else:
        out = column.cast("string")
    return F.coalesce(out, F.lit(""))


def moment(column: Column) -> Column:
    """A stored text as a time, null where it is none."""
    return F.try_to_timestamp(column)


def number(column: Column) -> Column:
    """A stored text as a number, null where it is none; empty is no number, never 0."""
    return F.nullif(F.trim(column), F.lit("")).try_cast("double")


def content_sha(content: Column) -> Column:
    """The content address of a file: SHA-1 of ``blob <bytes>\\0<content>``, in hexadecimal."""
    data = F.encode(content, "UTF-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")), "UTF-8")
    return F.sha1(F.concat(head, data))
