"""Manifests: what each shard holds, how two of them differ, and what to carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import cell, content_sha
from ..plans.spec import TableSpec


def columns_of(spec: TableSpec, present: list[str]) -> list[str]:
    """A file's header: canonical columns in their order, then the others by name."""
    return [*spec.columns, *sorted(set(present) - set(spec.columns))]


def normalize(df: DataFrame, spec: TableSpec, defaults: bool = False) -> DataFrame:
    """All canonical columns and all further ones as text; ``defaults`` fills empty createdAt and updatedAt with now."""
    out = []
    for name in columns_of(spec, df.columns):
        value = cell(F.col(f"`{name}`"), df.schema[name].dataType) if name in df.columns else F.lit("")
        if defaults and name in ("createdAt", "updatedAt"):
            value = F.coalesce(F.nullif(value, F.lit("")), cell(F.current_timestamp(), T.TimestampType()))
        out.append(value.alias(name))
    return df.select(*out)


def csv_field(column):
    """A value as a field of a file: quoted only when it must be."""
    quoted = F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(column.rlike('[",\\n\\r]|^\\s|\\s$'), quoted).otherwise(column)


def csv_line(names: list[str]):
    return F.concat_ws(",", *[csv_field(F.coalesce(F.col(f"`{n}`"), F.lit(""))) for n in names])


def contents(rows: DataFrame, spec: TableSpec, names: list[str], by: str = "shard_path") -> DataFrame:
    """(by, content): each shard as the text of its file; a shard holds at most shard_max_rows rows, which bounds it."""
    header = ",".join(names)
    lines = F.array_sort(F.collect_list(F.struct(F.col(spec.primary_key).alias("k"), csv_line(names).alias("line"))))
    return rows.groupBy(by).agg(F.concat(F.lit(header + "\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def entries(rows: DataFrame, spec: TableSpec, by: str = "shard_path") -> DataFrame:
    """(by, row_count, min_key, max_key): the smallest and largest shard keys that are not empty, as text."""
    key = F.nullif(F.col(f"`{spec.shard_key}`").cast("string"), F.lit(""))
    return rows.groupBy(by).agg(F.count("*").alias("row_count"), F.coalesce(F.min(key), F.lit("")).alias("min_key"), F.coalesce(F.max(key), F.lit("")).alias("max_key"))


def with_sha(files: DataFrame) -> DataFrame:
    return files.withColumn("sha", content_sha(F.col("content")))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shard_path, change): added, changed or removed between two manifests, by their shas."""
    a, b = old.select("shard_path", F.col("sha").alias("__old")), new.select("shard_path", F.col("sha").alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return a.join(b, "shard_path", "full_outer").select("shard_path", change.alias("change")).where("change is not null")


def carry_forward(old: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """The next manifest: new entries, and old ones that are neither replaced nor removed."""
    gone = new.select("shard_path").union(removed.select("shard_path")).distinct()
    return new.unionByName(old.join(gone, "shard_path", "left_anti"))
