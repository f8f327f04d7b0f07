"""Where rows live: families, shard paths, fill-first routing, merge plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.predicates import family_column
from ..plans.spec import TableSpec

#: Rows a shuffle partition whose keys are looked at to cut hot families.
PART_SAMPLE = 32

_PATH = re.compile(r"^(\w+)/([^/]+)/([^/]+?)(?:-(\d+))?\.csv$")


def shard_path(table: str, family: str, suffix: int = 0) -> str:
    return f"{table}/{family}{f'-{suffix}' if suffix else ''}.csv"


def parse_shard_path(path: str) -> tuple[str, str, int] | None:
    """(table, family, suffix); None for anything but a shard's path."""
    m = _PATH.match(path)
    if not m or not m[3].startswith(m[2]):
        return None
    return m[1], f"{m[2]}/{m[3]}", int(m[4] or 0)


def shard_order(path: str) -> tuple[str, int]:
    """Sort key: a family's base file first, then its numbered ones by number."""
    parsed = parse_shard_path(path)
    return (path, 0) if parsed is None else (f"{parsed[0]}/{parsed[1]}", parsed[2])


def path_column(table: str, family: Column, suffix: Column) -> Column:
    return F.concat(F.lit(f"{table}/"), family, F.when(suffix > 0, F.concat(F.lit("-"), suffix.cast("string"))).otherwise(""), F.lit(".csv"))


def parse_columns(path: Column) -> tuple[Column, Column, Column]:
    """table, family and suffix of a column of shard paths; nulls for other paths."""
    pattern = r"^(\w+)/([^/]+/[^/]+?)(?:-(\d+))?\.csv$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    table = part(1)
    return table, part(2), F.when(table.isNotNull(), F.coalesce(part(3).cast("int"), F.lit(0)))


def resolve_write_shard(counts: dict[int, int], limit: int) -> int:
    """The suffix that a family's next row goes to: its first file below the limit, else a new one."""
    return next((s for s in sorted(counts) if counts[s] < limit), max(counts, default=-1) + 1)


def plan_merge(counts: dict[int, int], limit: int) -> bool:
    """Whether a family's files fit in one."""
    return len(counts) > 1 and sum(counts.values()) <= limit


def with_family(df: DataFrame, spec: TableSpec, hash_len: int = 2) -> DataFrame:
    return df.withColumn("family", family_column(spec, F.col(f"`{spec.shard_key}`"), hash_len))


def _points(rows: DataFrame, order: str, sample: int | None = None) -> list:
    """Values of ``order`` that cut ``rows`` into about as many parts as there are shuffle partitions; none for few rows."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = PART_SAMPLE * parts if sample is None else sample
    drawn = [r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.rand(7)).limit(size).collect()]
    if len(drawn) < size:
        return []
    drawn.sort(key=lambda x: x.encode() if isinstance(x, str) else x)
    return list(dict.fromkeys(drawn[len(drawn) * i // parts] for i in range(1, parts)))


def _part(value: Column, points: list, kind: str) -> Column:
    """How many of the sorted ``points`` are not above ``value``, by halving; 0 for null."""
    held = F.array(*[F.lit(x) for x in points]).cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, b: F.when(F.coalesce(F.get(held, at + b - 1) <= value, F.lit(False)), at + b).otherwise(at))


def numbered(rows: DataFrame, order: str, sample: int | None = None) -> DataFrame:
    """``rows`` (with ``family``) with ``__n``: a row's place among its family's in order of ``order``, from 0.

    So that one hot family is not sorted by one task, rows are cut at values of ``order`` and numbered within (family,
    part); the sizes of a family's parts before that are added. The points are literals drawn from PART_SAMPLE rows a
    shuffle partition, and any points give the same numbers; a table of fewer rows than that is not cut.
    """
    points = _points(rows, order, sample)
    if not points:
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy("family").orderBy(order)).cast("bigint") - 1)
    # the family as a struct, in which nulls are equal
    cut = rows.withColumns({"__part": _part(F.col(order), points, rows.schema[order].dataType.simpleString()), "__g": F.struct("family")})
    sizes = cut.groupBy("__g", "__part").agg(F.count("*").alias("__k"))
    before = F.sum("__k").over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("__n", F.row_number().over(Window.partitionBy("__g", "__part").orderBy(order)).cast("bigint") - 1)
    joined = placed.join(sizes.select("__g", "__part", before.alias("__before")), ["__g", "__part"], "left")
    return joined.withColumn("__n", F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__part", "__before", "__g")


def route(rows: DataFrame, held: DataFrame, limit: int, order: str = "objectId", sample: int | None = None) -> DataFrame:
    """``rows`` (with ``family``) with ``suffix``: a family's files are filled first to last, then new ones are begun.

    ``held``: (family, suffix, row_count) of the files there are. A family's rows are numbered in order of ``order``.
    """
    free = held.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("suffix", F.greatest(F.lit(limit) - F.col("row_count"), F.lit(0)).cast("bigint").alias("free")))).alias("files"))
    joined = numbered(rows, order, sample).join(free, "family", "left")
    # walk the files: what is left of the number after each file's free rows, and the file it first fits
    start = F.struct(F.col("__n").cast("bigint").alias("left"), F.lit(-1).alias("suffix"), F.lit(-1).alias("last"))

    def step(at, x):
        fits = (at["suffix"] < 0) & (at["left"] < x["free"])
        return F.struct(F.when(at["suffix"] < 0, F.greatest(at["left"] - x["free"], F.lit(-1))).otherwise(at["left"]).cast("bigint").alias("left"), F.when(fits, x["suffix"]).otherwise(at["suffix"]).alias("suffix"), F.greatest(at["last"], x["suffix"]).alias("last"))

    none = F.array().cast("array<struct<suffix:int,free:bigint>>")
    walked = F.aggregate(F.coalesce("files", none), start, step)
    routed = joined.withColumn("__w", walked)
    new = F.col("__w.last") + 1 + F.floor(F.col("__w.left") / limit).cast("int")
    return routed.withColumn("suffix", F.when(F.col("__w.suffix") >= 0, F.col("__w.suffix")).otherwise(new)).drop("__n", "__w", "files")


def split(rows: DataFrame, limit: int, order: str = "objectId", sample: int | None = None) -> DataFrame:
    """:func:`route` for families without files: consecutive runs of ``limit`` rows."""
    return numbered(rows, order, sample).withColumn("suffix", F.floor(F.col("__n") / limit).cast("int")).drop("__n")


def merge_plan(manifest: DataFrame, limit: int) -> DataFrame:
    """(family, files, row_count): families of several files whose rows fit in one."""
    by = manifest.groupBy("family").agg(F.count("*").alias("files"), F.sum("row_count").cast("bigint").alias("row_count"))
    return by.where((F.col("files") > 1) & (F.col("row_count") <= limit))


