"""Structured Streaming into a store: each micro-batch is one commit, and a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import dedup_hash
from ..sources.store import Store


def deduplicated(comments: DataFrame, time: str, window: str = "60 seconds") -> DataFrame:
    """A stream of comments without those sent again within ``window``; state is dropped as the watermark passes.

    Spark's operator keeps the first of equal comments until the window after its time has passed, which is the rule of
    the store's window for streams in order of time.
    """
    marked = comments.withColumn("__hash", F.coalesce(dedup_hash(F.col("mail"), F.col("url"), F.col("comment")), F.expr("uuid()")))
    return marked.withWatermark(time, window).dropDuplicatesWithinWatermark(["__hash"]).drop("__hash")


def ingest(stream: DataFrame, store: Store, table: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True) -> StreamingQuery:
    """Append a stream to a table. ``once``: what is there now, in as many batches as it takes, then stop."""

    def commit(batch: DataFrame, number: int) -> None:
        # the batch's number is part of the version that holds its rows, so a batch that comes again finds it there
        txn = store.begin()
        if not txn.seen(f"{table} from {checkpoint}", number):
            txn.add(table, shape(batch), dedup=False)
            txn.commit()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


