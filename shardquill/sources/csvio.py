"""CSV files of text cells: written RFC 4180 style, read back by groups of equal headers."""

from __future__ import annotations

import csv
import io
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.manifest import normalize
from ..plans.spec import MANIFEST_COLUMNS, TableSpec

#: Quotes are doubled, blanks kept, line ends allowed inside cells.
WRITE = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}
READ = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    kept = partition_by or []
    cells = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c not in kept else F.col(f"`{c}`") for c in df.columns])
    cells.write.mode(mode).options(**WRITE).partitionBy(*kept).csv(path) if kept else cells.write.mode(mode).options(**WRITE).csv(path)


def read_csv(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Files that share one header, as text; empty cells are empty, never null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.options(**READ).schema(schema).csv(paths)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns], F.col("_metadata.file_path").alias("__file"))


def read_groups(spark: SparkSession, groups: dict[tuple[str, ...], list[str]]) -> DataFrame | None:
    """Files grouped by header, each group read by its own: Spark's reader goes by place, not by name."""
    out = None
    for columns, paths in sorted(groups.items()):
        df = read_csv(spark, sorted(paths), list(columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return None
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns])


def header_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by their header, which is the only line read of each."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.csv").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"))
    firsts = lines.where("s = 0").groupBy("f").agg(F.first("value").alias("h"))
    out = defaultdict(list)
    for row in firsts.collect():
        out[tuple(next(csv.reader([row.h.lstrip("﻿")])))].append(row.f)
    return dict(out)


def migrate(spark: SparkSession, path: str, spec: TableSpec, time_format: str | None = None) -> DataFrame:
    """A table from legacy CSV, one file or many: cells normalized, times in ISO form, rows without a key dropped.

    Times that neither ISO nor ``time_format`` reads become empty.
    """
    rows = read_groups(spark, header_groups(spark, path)).drop("__file")
    if "id" in rows.columns and spec.primary_key not in rows.columns:
        rows = rows.withColumnRenamed("id", spec.primary_key)
    rows = normalize(rows, spec)
    for name in spec.times & set(rows.columns):
        read = F.try_to_timestamp(F.col(name))
        if time_format:
            read = F.coalesce(read, F.try_to_timestamp(F.col(name), F.lit(time_format)))
        rows = rows.withColumn(name, F.coalesce(F.date_format(F.to_utc_timestamp(read, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")))
    return rows.where(F.col(spec.primary_key) != "")


def encode_rows(rows: list[dict], columns: list[str]) -> str:
    """A small file on the driver: header always, quotes only where needed, newline ends."""
    out = io.StringIO()
    writer = csv.DictWriter(out, columns, lineterminator="\n", extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def decode_rows(text: str | None) -> list[dict]:
    """The rows of a small file: ragged ones padded, blank lines and a byte order mark skipped."""
    rows = [r for r in csv.reader(io.StringIO((text or "").lstrip("﻿"))) if r]
    return [dict(zip(rows[0], [*r, *[""] * len(rows[0])], strict=False)) for r in rows[1:]] if rows else []


def encode_manifest(entries: list[dict]) -> str:
    return encode_rows(sorted(entries, key=lambda e: e["shard_path"]), [*MANIFEST_COLUMNS, "place", "columns"])


def decode_manifest(text: str | None) -> dict[str, dict]:
    """Entries by path: blank paths skipped, a row count that is no number is 0, an empty sha is None."""
    out = {}
    for row in decode_rows(text):
        if not row.get("shard_path"):
            continue
        count = row.get("row_count") or ""
        out[row["shard_path"]] = row | {"row_count": int(count) if count.lstrip("-").isdigit() else 0, "sha": row.get("sha") or None}
    return out


