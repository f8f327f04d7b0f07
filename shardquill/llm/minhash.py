"""Near-duplicate documents by DartMinHash (Christiani, 2020) with banded joining and exact verification.

A document is a weighted set of five-word shingles. Each shingle owns a region of the plane weight x rank, cut into cells
of fixed bounds; a hash of shingle and cell throws a Poisson number of darts into a cell, each with a rank, a weight and
one of K coordinates. A dart counts if its weight is below the shingle's. Each coordinate keeps its earliest dart by
rank, so two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Cells are taken
in order of rank until every coordinate has a dart, about K ln K darts a document however many shingles it has.

Coordinates are joined in BANDS bands of ROWS. Documents with equal shingle sets are one class and take part once. The
members of a bucket are compared with one of them (the pivot), not all with all. Then components are formed, and
buckets whose members are in one component are done. In the others, members of all components but the largest become
pivots in turn, more in each round, and are compared with the bucket's members in other components, except pairs that
their sizes or the triangle inequality of the Jaccard distance rule out, or whose signatures agree in too few of all K
coordinates for a similarity at the threshold (0.9998 of pairs at the threshold agree in enough), or whose sets differ too
much by their bitmaps: each bit that one set's shingles leave and the other's do not stands for a shingle that only one
has, so counts of such bits bound the similarity from above, with no chance in it. A pair is looked at in the
first bucket that it shares, and a pivot leaves its bucket. So every pair that shares a bucket is either compared, or
ruled out, or already in one component.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, aside, map_texts, sized, without
from .graph import components

WORDS, THRESHOLD = 5, 0.8
#: 1 - (1 - 0.8 ** 5) ** 28 = 0.99998: the chance that a pair at the threshold shares a band.
BANDS, ROWS = 28, 5
K = BANDS * ROWS
#: The first rank cell is [0, FIRST), each next one doubles the bound.
FIRST = 2.0**-3
#: Pivots of a bucket in the second round; each next round has GROWTH times more.
PIVOTS, GROWTH = 32, 16
#: Bits of each coordinate that are kept to count agreements; standard deviations below the mean that still count.
BITS, SLACK = 4, 3.5
CACHE = 200_000
#: Bits of the bitmap of a shingle set.
MAP = 4096

_WORD = re.compile(r"\w+")
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Shingler:
    """Hashes of a text's shingles; the words' hashes are cached."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        if len(self.cache) > CACHE:
            self.cache.clear()
        known = list(map(self.cache.get, found))
        if None in known:
            for i, x in enumerate(known):
                if x is None:
                    known[i] = self.cache.setdefault(found[i], xxhash.xxh3_64_intdigest(found[i]) >> 1)
        return np.array(known, dtype=np.int64).view(np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """One hash for each run of WORDS words; a text of fewer words has one shingle, all its words; none has none."""
        words = self.words(text)
        n = min(WORDS, len(words))
        if not n:
            return words
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
        return out


def sketch(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k dart ids: the earliest dart of each coordinate for each of n weighted sets.

    ``owner`` says which set an element (key, weight) belongs to. Sets without elements keep zeros.
    """
    out = np.zeros((n, k), dtype=np.uint64)
    filled = np.zeros((n, k), dtype=bool)
    open_ = np.bincount(owner[weights > 0], minlength=n) > 0
    top = float(weights.max(initial=0.0))
    level, low, high = 0, 0.0, FIRST
    while open_.any():
        at = np.flatnonzero(open_[owner])
        darts: list[tuple[np.ndarray, ...]] = []
        cell, left, right = 0, 0.0, 1.0
        while left < top:
            own = at[weights[at] > left]
            area = (right - left) * (high - low)
            base = mix(keys[own] + np.uint64((level * 64 + cell + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            chances = np.cumsum(np.exp([i * math.log(area) - area - math.lgamma(i + 1) for i in range(int(area + 10 * math.sqrt(area) + 20))]))
            count = np.searchsorted(chances, uniform(mix(base)))
            some = np.flatnonzero(count)
            rep = np.repeat(some, count[some])
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            dart = mix(base[rep] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            element = own[rep]
            ok = left + (right - left) * uniform(mix(dart ^ np.uint64(0xA0761D6478BD642F))) < weights[element]
            dart, element = dart[ok], element[ok]
            rank = uniform(mix(dart ^ np.uint64(0xE7037ED1A0B428DB)))
            coordinate = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            darts.append((owner[element] * k + coordinate, rank, dart))
            cell, left, right = cell + 1, right, right * 2
        slot, rank, dart = (np.concatenate([d[i] for d in darts]) for i in range(3))
        bits = max(1, 63 - int(n * k).bit_length())
        order = np.argsort(slot.astype(np.uint64) << np.uint64(bits) | (rank * 2.0**bits).astype(np.uint64), kind="stable")
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, dart = slot[first], dart[first]
        new = ~filled.ravel()[slot]
        out.ravel()[slot[new]] = dart[new]
        filled.ravel()[slot[new]] = True
        open_ &= ~filled.all(axis=1)
        level, low, high = level + 1, high, high * 2
    return out


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of coordinates, different between bands."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r :: rows][:, :bands])
    return out


def planes_of(signatures: np.ndarray) -> np.ndarray:
    """BITS bits of each coordinate, as BITS planes of one bit a coordinate, packed in 64-bit words."""
    words = -(-signatures.shape[1] // 64)
    out = np.zeros((len(signatures), BITS, words * 64), dtype=np.uint8)
    for b in range(BITS):
        out[:, b, : signatures.shape[1]] = (signatures >> np.uint64(b)) & np.uint64(1)
    return np.packbits(out.reshape(len(signatures), -1), axis=1).view(np.int64)


def least_agreement(threshold: float, k: int = K) -> int:
    """Coordinates in which pairs at the threshold agree, less SLACK standard deviations; by chance BITS bits agree too."""
    p = threshold + (1 - threshold) / 2**BITS
    return math.floor(k * p - SLACK * math.sqrt(k * p * (1 - p)))


def _agreement(x: str, y: str, k: int = K) -> Column:
    words = -(-k // 64)
    differ = F.lit(0)
    for w in range(words):
        bits = F.lit(0).cast("bigint")
        for b in range(BITS):
            bits = bits.bitwiseOR(F.col(x)[b * words + w].bitwiseXOR(F.col(y)[b * words + w]))
        differ = differ + F.bit_count(bits)
    return F.lit(k) - differ


def signatures(docs: DataFrame, weighting: str = "set", text: str = "text") -> DataFrame:
    """``docs`` without the text, with n (distinct shingles), fa and fb (128 bits of the weighted set), bands and planes.

    ``weighting``: "set" gives each shingle weight 1, so that similarity is that of shingle sets; "count" its number of
    occurrences.
    """

    def make():
        shingler = Shingler()

        def run(texts: list[str | None]) -> list:
            sets = [np.unique(shingler.shingles(t), return_counts=True) for t in texts]
            sizes = np.array([len(s[0]) for s in sets])
            keys = np.concatenate([s[0] for s in sets])
            counts = np.concatenate([s[1] for s in sets])
            weights = np.ones(len(keys)) if weighting == "set" else counts.astype(np.float64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            found = sketch(keys, weights, owner, len(sets))[sizes > 0]
            bands, planes = bands_of(found).view(np.int64), planes_of(found)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            prints = []
            for salt in (1, 2):
                total = np.zeros(len(sets), dtype=np.uint64)
                np.add.at(total, owner, mix(mix(keys + np.uint64(salt)) + weights.astype(np.uint64)))
                prints.append(pa.array(total.view(np.int64)))
            lists = [pa.ListArray.from_arrays(pa.array(offsets // BANDS * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel())) for x in (bands, planes)]
            return [pa.array(sizes, pa.int32()), *prints, *lists]

        return run

    whole = map_texts(docs, [("n", "int", pa.int32()), ("fa", "bigint", pa.int64()), ("fb", "bigint", pa.int64()), ("bands", "array<bigint>", pa.list_(pa.int64())), ("planes", "array<bigint>", pa.list_(pa.int64()))], make, text=text)
    return whole.drop(text)


def bitmap(keys: np.ndarray) -> np.ndarray:
    """MAP bits, in 64-bit words, of which each shingle sets one."""
    bits = np.zeros(MAP, dtype=np.uint8)
    bits[(mix(keys) % np.uint64(MAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _most_similar() -> Column:
    """No less than the Jaccard similarity of two sets of ``lo`` and ``x_lo`` shingles, from their bitmaps."""
    alone = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda total, n: total + n)
    p, q = F.col("lo") - alone("map", "x_map"), F.col("x_lo") - alone("x_map", "map")  # each bounds what both have
    both = F.least(p, q)
    return both / (F.col("lo") + F.col("x_lo") - both)


def shingle_sets(docs: DataFrame, weighting: str = "set", text: str = "text") -> DataFrame:
    """``docs`` without the text, with s: its sorted shingle hashes (under "count" one entry for each occurrence), and map: their bitmap."""

    def make():
        shingler = Shingler()

        def run(texts: list[str | None]) -> list:
            out = []
            for t in texts:
                keys, counts = np.unique(shingler.shingles(t), return_counts=True)
                if weighting != "set":
                    rep = np.repeat(keys, counts)
                    keys = mix(rep + (np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64))
                out.append(keys.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            maps = np.concatenate([bitmap(x.view(np.uint64)) for x in out]) if out else np.zeros(0, np.int64)
            each = np.arange(0, len(out) * (MAP // 64) + 1, MAP // 64, dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))), pa.ListArray.from_arrays(pa.array(each), pa.array(maps))]

        return run

    return map_texts(docs, [("s", "array<bigint>", pa.list_(pa.int64())), ("map", "array<bigint>", pa.list_(pa.int64()))], make, text=text).drop(text)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept) for each id: class_id is the smallest id linked to it through similar documents.

    Two documents are linked if the Jaccard similarity of their five-word shingles (lower case, punctuation ignored) is
    at least ``threshold``. A text of one to four words has one shingle, all its words; a text without words, or null,
    is in a class of its own. Repeated rows of an id are one document (if their texts differ, it is linked through
    each); rows with a null id are left out. An empty table gives an empty result. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    sigs = scratch.keep(signatures(texts, weighting))
    classes = scratch.keep(sigs.where("n > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep")))
    reps = classes.select("rep", "fa", "fb")
    banded = sigs.withColumnsRenamed({"fa": "__fa", "fb": "__fb"}).join(reps, (F.col("doc_id") == F.col("rep")) & (F.col("__fa") == F.col("fa")) & (F.col("__fb") == F.col("fb"))).dropDuplicates(["rep", "fa", "fb"])
    buckets = scratch.keep(banded.select("rep", F.explode("bands").alias("bucket")).distinct())
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = scratch.keep(buckets.join(shared, "bucket"))
    scratch.drop(buckets)
    # the pivot is the member whose buckets are largest: near the middle of its group, it rules out most later pairs
    scored = crowded.select("bucket", "rep").join(crowded.groupBy("rep").agg(F.sum("n").alias("score")), "rep")
    pivots = scored.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("rep")).alias("rep"))).alias("p")).select("bucket", (-F.col("p.rep")).alias("pivot"))
    members = scratch.keep(crowded.select("bucket", "rep").join(pivots, "bucket"))
    scratch.drop(crowded)
    ids = scratch.keep(members.select(F.col("rep").alias("doc_id")).distinct())
    wanted = texts.join(sized(ids), "doc_id", "left_semi")
    # an id with several texts is compared by each of them
    sets = scratch.keep(shingle_sets(wanted, weighting).distinct())
    links = [sigs.where("n > 0").join(classes, ["fa", "fb"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))]
    # round 1: all members with their bucket's pivot
    compared = _compared(members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), sets, scratch)
    links.append(scratch.keep(compared.where(F.col("j") >= threshold).select("a", "b")))
    near = members.join(compared.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "j"), ["rep", "pivot"])
    size = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.size("s")).alias("lo"), F.max(F.size("s")).alias("hi"), (F.count("*") > 1).alias("many"))
    marks = sigs.where("n > 0").groupBy(F.col("doc_id").alias("rep")).agg(F.flatten(F.collect_list("bands")).alias("bands"), F.first("planes").alias("planes"))
    maps = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.first("map").alias("map"))
    left = near.select("bucket", "rep", "j").join(size, "rep")
    each = PIVOTS
    while True:
        found = scratch.keep(components(_all(links[1:]), scratch))
        placed = left.join(found, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep")).drop("id")
        groups = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        largest = groups.groupBy("bucket").agg(F.count("*").alias("groups"), F.max(F.struct("k", "component")).alias("most")).where("groups > 1").select("bucket", F.col("most.component").alias("largest"))
        open_ = placed.join(largest, "bucket")
        open_ = scratch.keep(open_ if "bands" in left.columns else open_.join(marks, "rep").join(maps, "rep"))
        if open_.isEmpty():
            break
        # about ``each`` pivots of a bucket by a hash, so that no bucket is sorted in one task; the last ones all at once
        small = open_.where("component <> largest").groupBy("bucket").agg(F.ceil(F.count("*") / each).alias("share"))
        turn = F.pmod(F.xxhash64("rep", "bucket", F.lit(each)), F.col("share")) == 0
        pivots = scratch.keep(open_.where("component <> largest").join(small, "bucket").where(turn).drop("share", "largest"))
        x, y = pivots.select("bucket", *[F.col(c).alias(f"x_{c}") for c in ("rep", "j", "lo", "hi", "many", "component", "bands", "planes", "map")]), open_
        pairs = x.join(y, "bucket").where("component <> x_component")
        # an id with several texts has no one distance to the pivot
        pairs = pairs.where((F.col("many") | F.col("x_many") | (F.abs(F.col("j") - F.col("x_j")) <= 1 - threshold + 1e-9)) & (F.col("hi") >= threshold * F.col("x_lo")) & (F.col("x_hi") >= threshold * F.col("lo")))
        pairs = pairs.where((F.col("many") | F.col("x_many") | (_agreement("planes", "x_planes") >= least_agreement(threshold))) & (F.array_min(F.array_intersect("bands", "x_bands")) == F.col("bucket")))
        pairs = pairs.where(F.col("many") | F.col("x_many") | (_most_similar() >= threshold - 1e-9))
        pairs = pairs.select(F.greatest("rep", "x_rep").alias("a"), F.least("rep", "x_rep").alias("b")).distinct()
        compared = _compared(pairs, sets, scratch)
        links.append(scratch.keep(compared.where(F.col("j") >= threshold).select("a", "b")))
        left = scratch.keep(open_.join(pivots.select("bucket", "rep"), ["bucket", "rep"], "left_anti").select("bucket", "rep", "j", "lo", "hi", "many", "bands", "planes", "map"))
        each *= GROWTH
    found = components(_all([links[0], found.select(F.col("id").alias("a"), F.col("component").alias("b"))]), scratch)
    ids = sigs.select("doc_id").distinct()
    class_id = F.coalesce("component", "doc_id")
    return ids.join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", class_id.alias("class_id"), (class_id == F.col("doc_id")).alias("kept"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _compared(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, j): the Jaccard similarity of each pair of documents, the largest if they have several sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), "s"), "a")
    counted = both.select("a", "b", F.size("s").alias("p"), F.size("t").alias("q"), F.size(F.array_intersect("s", "t")).alias("c"))
    return scratch.keep(counted.groupBy("a", "b").agg(F.max(F.col("c") / (F.col("p") + F.col("q") - F.col("c"))).alias("j")))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document, that with the smallest id, of each class of near duplicates.

    Rows with a null id stay. Of several rows with one id one stays.
    """
    scratch = Scratch(docs.sparkSession)
    inner, of = aside(docs)
    key, text = of(key), of(text)
    gone = scratch.keep(near_duplicates(inner, threshold, weighting, key, text).where("not kept").select(F.col("doc_id").alias(key)))
    repeated = inner.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    repeated = scratch.keep(repeated)
    left = without(inner, gone, key)
    if not repeated.isEmpty():
        again = left.join(sized(repeated), key, "left_semi").dropDuplicates([key])
        left = without(left, repeated, key).unionByName(again)
    return left.toDF(*docs.columns)
