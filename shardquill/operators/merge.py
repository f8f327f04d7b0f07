"""How two writers' rows come together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import moment, number
from ..plans.spec import TableSpec


def local_first(local: DataFrame, remote: DataFrame, deleted: DataFrame, key: str = "objectId") -> DataFrame:
    """Local rows, and remote ones that are neither there locally nor deleted; remote rows without a key are dropped."""
    known = remote.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    rest = known.join(local.select(key).distinct(), key, "left_anti").join(deleted.select(key).distinct(), key, "left_anti")
    return local.unionByName(rest.select(*remote.columns), allowMissingColumns=True)


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "objectId") -> DataFrame:
    """Each row from the side that changed it since ``base``, local if both did; rows that either side deleted are gone."""
    columns = list(dict.fromkeys([*local.columns, *remote.columns]))
    mark = lambda df, n: df.select(key, F.xxhash64(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in df.columns else F.lit("") for c in columns]).alias(n), F.struct(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns]).alias(f"{n}_row"))
    joined = mark(base, "b").join(mark(local, "l"), key, "full_outer").join(mark(remote, "r"), key, "full_outer")
    in_base, in_local, in_remote = F.col("b").isNotNull(), F.col("l").isNotNull(), F.col("r").isNotNull()
    changed = in_local & (~in_base | (F.col("l") != F.col("b")))
    row = F.when(changed, F.col("l_row")).when(in_base & ~in_local, None).when(in_base & ~in_remote, None).otherwise(F.coalesce("r_row", "l_row"))
    return joined.select(row.alias("x")).where("x is not null").select(*[F.col(f"x.`{c}`").alias(c) for c in columns])


def deltas(changes: DataFrame, key: str = "objectId") -> DataFrame:
    """(key, field, delta): a row's numeric changes, summed by field."""
    return changes.groupBy(key, "field").agg(F.sum("delta").alias("delta"))


def merge_counters(remote: DataFrame, changes: DataFrame, spec: TableSpec, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``remote`` with the sums of local changes added to its counter columns; an empty counter counts as 0 if it changed."""
    key, out = spec.primary_key, remote
    for field in fields or spec.counters:
        mine = deltas(changes.where(F.col("field") == field), key).select(key, F.col("delta").alias("__d"))
        total = F.coalesce(number(F.col(field).cast("string")), F.lit(0.0)) + F.col("__d")
        kind = out.schema[field].dataType
        text = F.when(total == F.floor(total), total.cast("bigint").cast("string")).otherwise(total.cast("string"))
        out = out.join(mine, key, "left").withColumn(field, F.when(F.col("__d").isNull(), F.col(field)).otherwise(text.cast(kind))).drop("__d")
    return out


def merge_rows(local: DataFrame, remote: DataFrame, changes: DataFrame, key: str = "objectId") -> DataFrame:
    """Whole rows of counters: what is a number remotely becomes that number and the sum of local changes to it; all else
    stays local; updatedAt is the newer one. Rows of one side only stay as they are."""
    columns = list(dict.fromkeys([*local.columns, *remote.columns]))
    named = lambda df, n: df.select(F.col(key), F.struct(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns]).alias(n))
    sums = deltas(changes, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "delta"))).alias("d"))  # an entry a column
    joined = named(local, "l").join(named(remote, "r"), key, "full_outer").join(sums, key, "left")
    out = []
    for c in columns:
        mine, theirs = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        total = number(theirs) + F.coalesce(F.try_element_at("d", F.lit(c)).cast("double"), F.lit(0.0))
        text = F.when(total == F.floor(total), total.cast("bigint").cast("string")).otherwise(total.cast("string"))
        both = F.when(number(theirs).isNotNull(), text).otherwise(mine)
        if c == "updatedAt":
            a, b = F.coalesce(theirs, F.lit("")), F.coalesce(mine, F.lit(""))
            newer = F.coalesce(moment(a) > moment(b), a > b)
            both = F.when((a != "") & ((b == "") | newer), a).otherwise(mine)
        value = F.when(F.col("l").isNull(), theirs).when(F.col("r").isNull(), mine).otherwise(both)
        out.append((F.col(key).cast("string") if c == key else value).alias(c))
    return joined.select(*out)
