"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

Short test items are sought in long documents, where similarity of the whole is near zero and only containment tells:
the share of an item's five-word shingles that a document holds. Items are partitioned by their number of shingles into
ranges (u/2, u]. In a partition, an item's MinHash sketch is its k smallest shingle hashes, with k from the partition's
upper size u: a document that holds at least ceil(t*q) of an item's q shingles misses at most q - ceil(t*q), so it holds
one of any q - ceil(t*q) + 1 of them. With that many smallest hashes as sketch no containment of t or more is missed,
whatever the document's length; documents that share a sketch hash are candidates, and the exact containment of each
candidate pair is computed from all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

WORDS, THRESHOLD = 5, 0.8
#: Rows of a benchmark's shingles or of candidate ids that may be broadcast.
BROADCAST_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(text: Column) -> Column:
    """The distinct hashes of all runs of WORDS words: of each word's hash, then of five neighbours' hashes.

    The words' hashes are bound to a lambda variable, so that they are computed once for a text wherever the optimizer
    moves the expression; a plain alias could be inlined into each of the places that read it.
    """
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    none = F.array().cast("array<bigint>")
    return F.get(F.transform(F.array(hashed), lambda h: F.when(F.size(h) < WORDS, none).otherwise(F.array_distinct(runs(h)))), F.lit(0))


def sketch_sizes(threshold: float) -> Column:
    """How many smallest hashes an item of ``q`` shingles is sketched by: enough for its size partition's upper size."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("q"))))
    return F.least(F.col("q"), (upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1).cast("int"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): pairs where the document holds at least ``threshold`` of the item.

    Shingles are sets, of words in lower case without punctuation. Items or documents of fewer than five words, or with
    null texts, have no shingles and are in no pair. Repeated items (the same id and text) count once; of an id with
    several texts each text counts, and the largest containment is returned. Repeated documents with one id give one row.
    Null ids are in no pair. Either table may be empty.
    """
    scratch = Scratch(docs.sparkSession)
    distinct = items.select(F.col(item).alias("item_id"), F.col(text).alias("__t")).where(F.col(item).isNotNull()).distinct()
    sets = scratch.keep(distinct.select("item_id", F.xxhash64("__t").alias("version"), F.array_sort(shingles_of(F.col("__t"))).alias("s")))
    sets = sets.where(F.size("s") > 0).withColumn("q", F.size("s")).withColumn("sketch", F.slice("s", F.lit(1), sketch_sizes(threshold)))
    sketch = sets.select(F.explode("sketch").alias("h")).distinct()
    parts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__t")).where(F.col(key).isNotNull())
    texts = parts.select("doc_id", F.explode_outer(shingles_of(F.col("__t"))).alias("h"))
    candidates = scratch.keep(texts.join(sized(sketch, BROADCAST_SHINGLES), "h", "left_semi").select("doc_id").distinct())
    again = parts.join(sized(candidates), "doc_id", "left_semi")
    held = again.select("doc_id", F.explode_outer(shingles_of(F.col("__t"))).alias("h")).distinct()
    inverted = sets.select("item_id", "version", "q", F.explode("s").alias("h"), F.col("sketch").alias("k")).select("item_id", "version", "q", "h", F.array_contains("k", F.col("h")).alias("sketched"))
    shared = held.join(sized(inverted, BROADCAST_SHINGLES), "h").groupBy("doc_id", "item_id", "version", "q").agg(F.count("*").alias("n"), F.max("sketched").alias("found"))
    close = shared.where(F.col("found") & (F.col("n") >= F.ceil(F.lit(threshold) * F.col("q") - 1e-9)))
    best = close.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n") / F.col("q")).alias("c"), "n", "q")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").cast("bigint").alias("n_shared"), F.col("b.q").cast("bigint").alias("n_item"), F.col("b.c").alias("containment"))


def sql(threshold: float = THRESHOLD) -> str:
    """What the query of this operator returns, for the tables documents and benchmark."""
    def cut(name: str, key: str) -> str:
        words = f"SELECT {key}, r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT {key}, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS w FROM {name} WHERE {key} IS NOT NULL)"
        nexts = " || ' ' || ".join(f"lead(x, {k}) OVER (PARTITION BY r ORDER BY i)" if k else "x" for k in range(WORDS))
        return f"SELECT DISTINCT {key}, s FROM (SELECT {key}, {nexts} AS s FROM ({words})) WHERE s IS NOT NULL"

    return f"""
WITH d AS ({cut("documents", "doc_id")}), b AS ({cut("benchmark", "item_id")}),
q AS (SELECT item_id, count(*) AS q FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, q AS n_item, count(*) / CAST(q AS DOUBLE) AS containment
FROM d JOIN b USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id, q HAVING count(*) >= ceil({threshold} * q - 1e-9)
"""
