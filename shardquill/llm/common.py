"""What the text operators share: table reading, scratch tables, batched Python over Arrow, flag removal."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one bigint id that may be broadcast; about 32 MB on each executor.
BROADCAST_IDS = 2_000_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns renamed by place, so that none can clash with a name of an operator, and the new name of each.

    A name is matched as it is, else in any case. ``df.columns`` has the old names, in the same order.
    """
    names = df.columns

    def of(name: str) -> str:
        at = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
        if len(at) != 1:
            raise ValueError(f"no column, or several, are called {name}: {names}")
        return f"_in{at[0]}"

    return df.toDF(*[f"_in{i}" for i in range(len(names))]), of


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode one made here where it is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.shardquill.scratch", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="shardquill-")
        spark.conf.set("spark.shardquill.scratch", where)
    return where


class Scratch:
    """Tables written to the shared folder to cut lineage, so that lost executors cost no more than a reread.

    ``keep`` writes a DataFrame and reads it back; ``drop`` removes tables that no later step reads. What a returned
    DataFrame still reads is left in the folder for its owner to clear.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/shardquill/{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")  # the shuffle files of this job go with it; nothing reads them later
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    if not package.is_dir():
        return  # imported from an archive, which was shipped already
    archive = Path(tempfile.mkdtemp(prefix="shardquill-")) / "shardquill_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, new: list[tuple[str, str, pa.DataType]], make: Callable[[], Callable[[list], list]], text: str = "text", chars: int = 1 << 20) -> DataFrame:
    """``df`` with new columns computed by Python from its text column, in slices of bounded size.

    ``make()`` runs once in each task and returns a function from a list of texts to one list for each new column.
    Columns of ``df`` that carry a new column's name are replaced.
    """
    names = {n.lower() for n, _, _ in new}
    inner, of = aside(df)
    out = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    at = int(of(text)[3:])
    if at not in out:  # it is replaced itself: read under another name
        inner = inner.withColumn("_text", F.col(f"_in{at}"))
    inner = inner.select(*[f"_in{i}" for i in out], *(["_text"] if at not in out else []))
    at = inner.columns.index(f"_in{at}") if at in out else len(out)
    schema = ", ".join([f"{c} {inner.schema[c].dataType.simpleString()}" for c in inner.columns[: len(out)]] + [f"_new{k} {ddl}" for k, (_, ddl, _) in enumerate(new)])
    types = [t for _, _, t in new]
    header = [*inner.columns[: len(out)], *(f"_new{k}" for k in range(len(new)))]
    final = [df.columns[i] for i in out] + [n for n, _, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for lo, hi in slices(batch.column(at), chars):
                part = batch.slice(lo, hi - lo)
                cols = fn(part.column(at).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(out))] + arrays, names=header)
        del fn
        release()

    return map_arrow(inner, run, schema).toDF(*final)


def release() -> None:
    """Give freed memory back to the system; a worker that stays for other tasks would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose texts come to at most ``limit`` bytes; a longer text runs alone."""
    lo, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(column):
        yield lo, len(column)


def sized(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, flagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``flagged`` (a written table of one id column). Null keys stay."""
    ids = flagged.select(F.col(key).alias("flagged")).where(F.col("flagged").isNotNull()).distinct()
    inner, of = aside(docs)
    return inner.join(sized(ids), F.col(of(key)) == F.col("flagged"), "left_anti").toDF(*docs.columns)


def fold(column, folds: int):
    """The remainder that splits rows into learning and held-out ones: crc32 of the id as text."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def one_per_id(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with one row for each id that is not null: of an id's texts the smallest that is not null."""
    rows = docs.select(key, text).where(F.col(key).isNotNull())
    repeated = scratch.keep(rows.groupBy(key).count().where("count > 1").select(key))
    if repeated.isEmpty():
        return rows
    again = rows.join(sized(repeated), key, "left_semi").groupBy(key).agg(F.min(text).alias(text))
    return without(rows, repeated, key).unionByName(again)
