"""Line deduplication by site-relative frequency, in DataFrame operations only.

Within a host, the pages that contain a line are counted and divided by the host's pages; lines above a ratio are
boilerplate and dropped from every page of the host. Counts are summed in each task before they are shuffled by host and
line, so neither a large host nor a common line gathers in one place. A host has at most (lines of an average page /
ratio) boilerplate lines, which bounds the set that its pages are held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, aside

#: A line is boilerplate if over RATIO of its host's pages have it, and LEAST_PAGES at least: on few pages of a small
#: host a ratio alone would take each line that is there at all (one of nine pages is over a tenth).
RATIO, LEAST_PAGES = 0.1, 3
#: Boilerplate lines that may be broadcast (16 bytes each and their host), and shares a host is dealt in beyond that.
BROADCAST_LINES, SHARES = 500_000, 64
_BLANKS = " \t\r"


def lines_of(text: Column) -> Column:
    """A text's lines; a null text has none."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def print_of(line: Column) -> Column:
    """What a line is counted by: 128 bits of its hash without blanks at its ends."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line): the lines to drop, as prints. Null hosts are one host, the empty one; blank lines never count."""
    keyed = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), lines_of(F.col(text)).alias("lines"))
    pages = keyed.groupBy("host").agg(F.count("*").alias("pages"))
    marked = F.array_distinct(F.transform(F.filter("lines", lambda x: F.btrim(x, F.lit(_BLANKS)) != ""), print_of))
    counted = keyed.select("host", F.explode(marked).alias("line")).groupBy("host", "line").agg(F.count("*").alias("having")).where(F.col("having") >= least_pages)
    salted = counted.withColumn("share", F.pmod("line.a", F.lit(SHARES)).cast("int"))
    dealt = pages.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return salted.join(dealt, ["host", "share"]).where(F.col("having") > F.lit(ratio) * F.col("pages")).select("host", "line")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines, n_dropped.

    Lines are parts between newlines, compared without blanks at their ends. A page counts once for a line however often
    it has it. Null texts stay null with 0 lines; texts that lose nothing stay as they are; a text that is boilerplate
    altogether becomes empty, and its row stays. Repeated rows are pages of their own. An empty table stays empty.
    Columns called n_lines or n_dropped, in any case, are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(boilerplate(docs, host, text, ratio, least_pages))
    drops = found.groupBy("host").agg(F.collect_set("line").alias("drop")).withColumnRenamed("host", "of")
    inner, name = aside(docs)
    rows = inner.withColumn("key", F.coalesce(F.col(name(host)).cast("string"), F.lit("")))
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(drops), F.col("key") == F.col("of"), "left")
    else:  # too many to broadcast: hosts are dealt in shares, each with its own copy of the host's lines
        share = F.pmod(F.xxhash64(name(text)), F.lit(SHARES)).cast("int")
        copies = drops.withColumn("share_of", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        joined = rows.withColumn("share", share).join(copies, (F.col("key") == F.col("of")) & (F.col("share") == F.col("share_of")), "left")
    joined = joined.withColumn("lines", lines_of(F.col(name(text))))
    left = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", print_of(x))))
    joined = joined.withColumn("left", left)
    n, kept = F.size("lines"), F.size("left")
    whole = F.when(kept == n, F.col(name(text))).otherwise(F.array_join("left", "\n"))
    out = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")]
    counts = [F.when(F.col(name(text)).isNull(), 0).otherwise(n).cast("bigint"), (n - kept).cast("bigint")]
    done = joined.select(*[whole.alias(f"_in{i}") if f"_in{i}" == name(text) else F.col(f"_in{i}") for i, _ in out], counts[0].alias("n_lines"), counts[1].alias("n_dropped"))
    return done.toDF(*[c for _, c in out], "n_lines", "n_dropped")


def sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """What the query of this operator returns, for the documents table."""
    bare = "trim(line, ' ' || chr(9) || chr(13))"
    return f"""
WITH l AS (
  SELECT page, doc_id, host, pos, lines[pos] AS line FROM (
    SELECT page, doc_id, host, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (
      SELECT row_number() OVER () AS page, doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), drops AS (
  SELECT c.host, c.bare FROM (
    SELECT host, {bare} AS bare, count(DISTINCT page) AS having_it FROM l WHERE {bare} <> '' GROUP BY ALL
  ) c JOIN (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY ALL) p ON c.host = p.host
  WHERE c.having_it >= {least_pages} AND c.having_it > CAST({ratio} AS DOUBLE) * p.pages
), k AS (
  SELECT l.*, d.bare IS NOT NULL AS gone FROM l LEFT JOIN drops d ON l.host = d.host AND trim(l.line, ' ' || chr(9) || chr(13)) = d.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM k GROUP BY page, doc_id
"""
