"""Near duplicates among embeddings: sign hashes of random hyperplanes, exact cosines, connected components.

Each of several tables gives a vector a code, the signs of its products with random hyperplanes. Vectors with the same
label that share a code in any table meet twice. First their signs of all tables meet, without the vectors: the number
of signs in which a pair differs is binomial, with a mean that follows from its angle, so a pair that differs in more
than ``most_differing`` is none at the threshold, but for one in a million. Only vectors that have a fitting partner in
a group, and share no earlier table with it, are sent to that group, and there compared exactly, in double precision.
Equal vectors are compared once, with their number as weight. A bucket over ``BLOCK`` vectors is split into blocks, and
every pair of blocks is a group of its own, so no task holds more than two blocks. A pair is counted only in the first
table whose codes agree; a group emits sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, sized
from .graph import components

THRESHOLD, RECALL, BLOCK, SEED = 0.93, 0.9995, 1024, 20_26
#: Vectors of one label that a bucket should hold; it sets the bits of a code.
BUCKET = 64
#: Chance that a pair at the threshold differs in more signs than its group lets pass.
LOSS = 1e-6
#: Copies beyond which a class of equal vectors is joined to its members without a shuffle by class.
MANY = 4096
_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}
FITTING = pa.schema([("g", pa.int64()), ("table", pa.int32()), ("own", pa.int32()), ("same", pa.bool_()), ("rep", pa.int64())])
FOUND = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits and tables for ``n`` vectors of one label: codes longer with n, and tables enough that a pair at the threshold is missed with probability 1 - recall at most."""
    bits = max(8, min(24, round(math.log2(max(n, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def most_differing(signs: int, threshold: float, loss: float = LOSS) -> int:
    """The number of signs that a pair at the threshold exceeds with probability ``loss`` at most."""
    p, chance, most = min(max(math.acos(threshold) / math.pi, 1e-12), 1 - 1e-12), 0.0, signs
    while most > 0:
        chance += math.exp(math.lgamma(signs + 1) - math.lgamma(most + 1) - math.lgamma(signs - most + 1) + most * math.log(p) + (signs - most) * math.log1p(-p))
        if chance > loss:
            break
        most -= 1
    return most


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", label: str = "label", recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each id.

    Two vectors are linked if their labels are equal and not null, their lengths are equal and their cosine is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. n_links
    counts all other ids linked directly, copies included; component_id is the smallest id reachable. Repeated rows of
    an id are one vector, the smallest by label and components; a null id keeps its row, with no links and no component.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    repeated = scratch.keep(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")))
    if not repeated.isEmpty():
        ids, same_id = sized(repeated), F.col("id").eqNullSafe(F.col("again"))
        least = rows.join(ids, same_id, "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
        rows = rows.join(ids, same_id, "left_anti").unionByName(least)
    rows = scratch.keep(rows)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0.0))
    copy = F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit("v"), "label", "v").alias("b"))
    marked = usable.select("id", copy.alias("copy"))
    classes = scratch.keep(marked.groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    reps = usable.join(classes, usable["id"] == classes["rep"]).select("rep", "m", "label", F.size("v").alias("dim"), "v")
    most = reps.groupBy("label", "dim").count().agg(F.max("count")).collect()[0][0] or 0
    bits, tables = plan(most, threshold, recall)

    coded = scratch.keep(_coded(reps, bits, tables))
    sizes = coded.select("label", "dim", F.posexplode("codes").alias("table", "code")).groupBy("label", "dim", "table", "code").agg(F.count("*").alias("n"))
    large = scratch.keep(sizes.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    spread = coded.select("label", "dim", "rep", "signs", F.posexplode("codes").alias("table", "code")).join(sized(large, 500_000), ["label", "dim", "table", "code"], "left")
    spread = spread.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(F.xxhash64("label", "dim", "table", "code", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "table", "own", (F.col("own") == F.col("other")).alias("same"), "rep", "signs")
    fitting = scratch.keep(_by_group(spread, ["g", "table", "own", "same", "rep", "signs"], partial(_fitting, bits=bits, tables=tables, most=most_differing(bits * tables, threshold)), FITTING))
    grouped = sized(fitting).join(coded.select("rep", "m", "v", "signs"), "rep")
    found = scratch.keep(_by_group(grouped, ["g", "table", "own", "same", "rep", "m", "v", "signs"], partial(_group, bits=bits, tables=tables, threshold=threshold), FOUND))
    degree = found.groupBy("rep").agg(F.sum("n").alias("n"))
    links = found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    ids = components(links, scratch)
    per_class = classes.join(degree, "rep", "left").join(ids, F.col("rep") == F.col("id"), "left").select("copy", "m", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    per_class = scratch.keep(per_class)
    hot, rest = sized(per_class.where(F.col("m") > MANY)), per_class.where(F.col("m") <= MANY)
    linked = marked.join(hot, "copy").unionByName(marked.join(hot, "copy", "left_anti").join(rest, "copy")).select("id", "n", "component")
    out = rows.select("id").join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _coded(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for batch in batches:
            dims, vectors = batch.column(3).to_numpy(), batch.column(4)
            codes = np.zeros((len(batch), tables), dtype=np.int32)
            signs = np.zeros((len(batch), -(-bits * tables // 64) * 8), dtype=np.uint8)
            for dim in set(dims.tolist()):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).standard_normal((dim, bits * tables))
                at = np.flatnonzero(dims == dim)
                x = vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                on = x @ planes[dim] > 0
                codes[at] = (on.reshape(len(at), tables, bits) * powers).sum(axis=2)
                packed = np.packbits(on, axis=1)
                signs[at, : packed.shape[1]] = packed
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), _lists(codes), _lists(signs.view(np.int64))], names=["rep", "m", "label", "dim", "v", "codes", "signs"])

    kind = reps.schema["label"].dataType.simpleString()
    return map_arrow(reps, run, f"rep bigint, m bigint, label {kind}, dim int, v array<double>, codes array<int>, signs array<bigint>")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _by_group(rows: DataFrame, names: list[str], one: Callable, schema: pa.Schema) -> DataFrame:
    """``one`` of the batches of each group ``g``, the first column; a group's rows meet in one task, which holds one group."""
    grouped = rows.select(*names).repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if held and held[0].column(0)[0].as_py() != g[lo]:
                    out.append(one(held))
                    held = []
                held.append(part)
            yield _joined(out, schema)
        yield _joined([one(held)] if held else [], schema)

    return map_arrow(grouped, run, ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema))


def _joined(parts: list, schema: pa.Schema) -> pa.RecordBatch:
    parts = [p for p in parts if p is not None]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]) if parts else [], f.type) for i, f in enumerate(schema)], schema=schema)


def _column(parts: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts])


def _matrix(parts: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([p.column(i).flatten().to_numpy() for p in parts]).reshape(sum(map(len, parts)), -1)


def _signs(parts: list[pa.RecordBatch], i: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The signs as zeros and ones, and each table's code."""
    on = np.unpackbits(np.ascontiguousarray(_matrix(parts, i)).view(np.uint8), axis=1)[:, : bits * tables]
    return on, (on.reshape(len(on), tables, bits) * (1 << np.arange(bits))).sum(axis=2)


def _fitting(parts: list[pa.RecordBatch], bits: int, tables: int, most: int):
    """The rows of a group that have a partner there which few enough signs tell apart, and no earlier table in common."""
    n = sum(map(len, parts))
    if n < 2:
        return None
    own, same, rep = (_column(parts, i) for i in (2, 3, 4))
    on, codes = _signs(parts, 5, bits, tables)
    x = on.astype(np.float32) * 2 - 1
    a, b = np.nonzero(np.triu(x @ x.T >= bits * tables - 2 * most, 1))
    if not same.all():
        across = own[a] != own[b]
        a, b = a[across], b[across]
    table, fits = parts[0].column(1)[0].as_py(), np.zeros(n, dtype=bool)
    for lo in range(0, len(a), 200_000):
        p, q = a[lo : lo + 200_000], b[lo : lo + 200_000]
        new = ~(fits[p] & fits[q])
        p, q = p[new], q[new]
        first = (codes[p] == codes[q]).argmax(axis=1) == table
        fits[p[first]] = fits[q[first]] = True
    at = np.flatnonzero(fits)
    return (np.full(len(at), parts[0].column(0)[0].as_py()), np.full(len(at), table), own[at], same[at], rep[at]) if len(at) else None


def _group(parts: list[pa.RecordBatch], bits: int, tables: int, threshold: float):
    """(rep, n, root): links of a vector found in one group, and its root in the group's spanning forest."""
    if sum(map(len, parts)) < 2:
        return None
    own, same, rep, m, v = *(_column(parts, i) for i in (2, 3, 4, 5)), _matrix(parts, 6)
    n, codes = len(v), _signs(parts, 7, bits, tables)[1]
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
    if not same.all():
        across = own[a] != own[b]
        a, b = a[across], b[across]
    if not len(a):
        return None
    first = np.empty(len(a), dtype=bool)
    for lo in range(0, len(a), 200_000):
        x, y = a[lo : lo + 200_000], b[lo : lo + 200_000]
        exact = (scaled[x] * scaled[y]).sum(axis=1) / np.sqrt((scaled[x] ** 2).sum(axis=1) * (scaled[y] ** 2).sum(axis=1))
        first[lo : lo + 200_000] = ((codes[x] == codes[y]).argmax(axis=1) == parts[0].column(1)[0].as_py()) & (exact >= threshold)
    a, b = a[first], b[first]
    links = np.bincount(a, m[b], n) + np.bincount(b, m[a], n)
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (before == root).all():
            break
    at = np.flatnonzero(links)
    return rep[at], links[at].astype(np.int64), rep[root[at]]
