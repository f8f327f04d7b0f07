"""A corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its input, whatever
they are. Rows with a null id pass every filter. ``run`` writes each stage's result to the shared folder and reads it
back as the next one's input, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardquill.llm import bpe, decontamination, line_dedup, minhash, toxicity
from shardquill.llm.common import Scratch, table, without


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns called like an operator's results renamed, and how to get the input's columns back."""
    moved = {c: f"__aside_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), lambda df: df.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labels of these documents."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), F.lit(True))
    rows, back = _aside(docs, ("score", "predicted"))
    return back(toxicity.score(rows, model).where("predicted = 0"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; n_chars follows the text."""
    rows, back = _aside(docs, ("n_lines", "n_dropped"))
    done = line_dedup.dedup_lines(rows)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(done)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates."""
    return minhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    scratch = Scratch(spark)
    found = scratch.keep(decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return without(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of the text decoded from them."""
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"))
    return done.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the toxicity model nor DartMinHash classes nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
