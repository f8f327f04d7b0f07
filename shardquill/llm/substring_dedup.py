"""Passages that repeat across documents, by compact windows over token min-hashes, joined on their roots.

Tokens are hashes of five-word shingles. Under a hash function the Cartesian tree of a text has the smallest hash of all
as its root, and the trees of the parts before and after it as branches; the smallest hash of any sequence is the lowest
node that holds both its ends. So all sequences whose smallest hash is at c form one compact window (l, c, r): they
start in l..c and end in c..r. Of those with LENGTH tokens the first ones start in max(l, c - LENGTH + 1) and the last
ones in min(c, r - LENGTH + 1), and these are the starts whose sliding minimum over LENGTH hashes is at c: sliding
minima give the tree's windows of that length, without the tree (a test holds them against it).

Windows of FUNCTIONS functions are joined on their root's hash. Two near-duplicate sequences, which agree in at least
THRESHOLD of their tokens, share the root under one function with that probability, so under any of them nearly always.
The join is one of intervals: each window is laid around its root and holds only the tokens of its own sequences, so two
windows can agree only in sequences that both intervals hold. Agreement is then verified token by token, on 16 bits of
each token's hash, with a shift by one for a word put in or left out.

No group is compared pair by pair unless it has at most FEW different windows. In a larger one equal sequences are found
by hashes of all sequences that start at one place; the commonest of them give pivots, with which all windows are
compared; and what is left, of windows with enough tokens that some other one has at that place, is compared where it
shares a token that is not the commonest of its place, again with pivots if many do. A key with over BLOCK windows is
dealt in blocks; the blocks' pivots meet under the key again, and its windows under each token that is not the commonest
of its place, so that work stays in proportion to the windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, one_per_id, release, sized, slices, without
from .graph import components
from .minhash import WORDS, Shingler, _all, mix

#: Words of the shortest passage, and what that is in tokens.
PASSAGE = 50
LENGTH = PASSAGE - WORDS + 1
THRESHOLD, FUNCTIONS = 0.8, 3
#: Tokens before a root that a sequence with it can start at, and tokens around it in all.
BEFORE = LENGTH - 1
AROUND = BEFORE + LENGTH
#: Windows of a key in one group, different ones that are all compared, pairs compared at a time, windows read at a time.
BLOCK, FEW, PAIRS, CHUNK = 65_536, 48, 1 << 13, 16_384
_BITS = 24
_ODD = np.random.default_rng(46).integers(1, 2**63, AROUND).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def roots(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each start the place of the smallest hash among ``length``: the first one on ties."""
    bits = max(_BITS, int(len(hashes)).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= length:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < length:
        best = np.minimum(best[: len(best) - (length - width)], best[length - width :])
    return (best & low).astype(np.int64)


def windows(tokens: np.ndarray, owner: np.ndarray, length: int = LENGTH, functions: int = FUNCTIONS) -> list[tuple[np.ndarray, ...]]:
    """(owner, root, first start, last start) of all compact windows of several texts, laid end to end, by function."""
    if len(tokens) < length:
        return []
    inside = owner[: len(owner) - length + 1] == owner[length - 1 :]
    out = []
    for f in range(functions):
        root = roots(hashed(tokens, f), length)
        change = np.ones(len(root), dtype=bool)
        change[1:] = (root[1:] != root[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(root)) - 1
        ok = inside[first]
        out.append((owner[first[ok]], root[first[ok]], first[ok], last[ok]))
    return out


def hashed(tokens: np.ndarray, f: int) -> np.ndarray:
    return mix(tokens + np.uint64((f + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _windows(texts: DataFrame) -> DataFrame:
    """(doc_id, n, tokens, windows) of texts with a window: tokens has 16 bits of each, windows key, c, lo, hi, more.

    key is the root's hash under its function, c its place among the tokens, lo and hi the first and last starts. A
    window that a text has again, as one that repeats a phrase, stands once, with the roots' other places in ``more``.
    """
    kind = pa.struct([("key", pa.int64()), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("more", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start, end in slices(batch.column(1), 2 << 20):
                part = batch.slice(start, end - start)
                found = [shingler.shingles(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(t) for t in found])
                at = np.concatenate([[0], np.cumsum(sizes)])
                tokens = np.concatenate(found)
                parts = windows(tokens, np.repeat(np.arange(len(sizes)), sizes)) or [(np.zeros(0, dtype=np.int64),) * 4]
                owner, root, first, last = (np.concatenate([p[k] for p in parts]) for k in range(4))
                key = np.concatenate([hashed(tokens[p[1]], f) for f, p in enumerate(parts)])
                one, other, of = once(tokens, owner, key, root, first, last)
                places = [(v - at[owner]).astype(np.int32) for v in (root, first, last)]
                short = (tokens >> np.uint64(48)).astype(np.uint16)
                some = np.flatnonzero(sizes >= LENGTH)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[one], minlength=len(sizes))[some])]).astype(np.int32)
                ends = np.cumsum(np.bincount(of, minlength=len(one)))
                more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(places[0][other]), mask=pa.array(np.diff(ends, prepend=0) == 0))
                rows = pa.StructArray.from_arrays([pa.array(key[one].view(np.int64)), *(pa.array(v[one]) for v in places), more], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some)), pa.array(sizes[some], pa.int32()), pa.array([short[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), rows)],
                    names=["doc_id", "n", "tokens", "windows"],
                )
        release()

    return map_arrow(texts.select("doc_id", "text"), run, "doc_id bigint, n int, tokens binary, windows array<struct<key:bigint,c:int,lo:int,hi:int,more:array<int>>>")


def once(tokens: np.ndarray, owner: np.ndarray, key: np.ndarray, root: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of windows, those whose tokens their text does not have as a window before, by text; then the others, and the number of the one that each repeats."""
    odd, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.ones((2, len(tokens) + 1), dtype=np.uint64)
    np.cumprod(np.full(len(tokens), odd), out=powers[0, 1:])
    np.cumprod(np.full(len(tokens), back), out=powers[1, 1:])
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(tokens) * powers[0, :-1], dtype=np.uint64)])
    print_ = mix((sums[last + LENGTH] - sums[first]) * powers[1, first] + key)
    print_ = mix(print_ + ((root - first) * AROUND + last - first).astype(np.uint64))
    _, one, of = np.unique(mix(print_ + owner.astype(np.uint64) * odd), return_index=True, return_inverse=True)
    order = one.argsort(kind="stable")
    order = order[owner[one[order]].argsort(kind="stable")]
    place = np.empty(len(one), dtype=np.int64)
    place[order] = np.arange(len(one))
    again = np.ones(len(owner), dtype=bool)
    again[one] = False
    other = np.flatnonzero(again)
    other = other[place[of[other]].argsort(kind="stable")]
    return one[order], other, place[of[other]]


def near(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of ``a`` and ``b`` (tokens around a root, negative and different where there is none) hold near-duplicate sequences, and the spans of these in either."""
    need = needed(threshold)
    equal, after, before = a == b, a[:, 1:] == b[:, :-1], a[:, :-1] == b[:, 1:]
    hits = [equal.copy(), equal]
    hits[0][:, 1:] |= after
    hits[0][:, :-1] |= before
    hits[1][:, :-1] |= after
    hits[1][:, 1:] |= before
    some = np.flatnonzero((hits[0].sum(axis=1) >= need) & (hits[1].sum(axis=1) >= need))
    good = [(_sums(h[some]) >= need) & (_sums(x[some] >= 0) == LENGTH) for x, h in zip((a, b), hits, strict=True)]
    ok = good[0].any(axis=1) & good[1].any(axis=1)
    some, spans = some[ok], []
    for h, g in zip(hits, good, strict=True):
        h, g, at = h[some], g[ok], np.arange(len(some))
        lo, hi = g.argmax(axis=1), g.shape[1] - 1 - g[:, ::-1].argmax(axis=1) + LENGTH
        while len(off := at[~h[at, lo]]):
            lo[off] += 1
        while len(off := at[~h[at, hi - 1]]):
            hi[off] -= 1
        spans.append(np.stack([lo, hi], axis=1))
    return some, spans[0], spans[1]


def needed(threshold: float) -> int:
    """Tokens that two sequences of LENGTH must share."""
    return math.ceil(2 * LENGTH * threshold / (1 + threshold) - 1e-9)


def _sums(hit: np.ndarray) -> np.ndarray:
    """For each row and start how many of the next LENGTH places are hits."""
    sums = np.zeros((len(hit), AROUND + 1), dtype=np.int16)
    np.cumsum(hit, axis=1, out=sums[:, 1:])
    return sums[:, LENGTH:] - sums[:, :-LENGTH]


def pairs_of(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of places within runs that start at ``starts`` and have ``sizes`` places."""
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(m, 1)
        of = starts[sizes == m]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(of), step):
            at = of[k : k + step, None]
            yield (at + i).ravel(), (at + j).ravel()


class Matcher:
    """Near-duplicate sequences among windows: rows of ``x``, of a document each, of several if ``many``.

    ``lo`` and ``hi`` bound what was found in a row (hi is 0 if nothing), ``label`` is the first row it is linked to.
    """

    def __init__(self, x: np.ndarray, doc: np.ndarray, many: np.ndarray, threshold: float = THRESHOLD):
        self.x, self.doc, self.many, self.threshold = x, doc, many, threshold
        self.lo, self.hi, self.label = np.full(len(x), AROUND), np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        valid = x >= 0
        self._cover(np.flatnonzero(many), valid.argmax(axis=1)[many], AROUND - valid[:, ::-1].argmax(axis=1)[many])

    def _cover(self, rows: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> None:
        np.minimum.at(self.lo, rows, lo)
        np.maximum.at(self.hi, rows, hi)

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(off := np.flatnonzero(label[i] != label[j])):
            a, b = label[i[off]], label[j[off]]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]

    def look(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare pairs of rows."""
        ok = (i != j) & ((self.doc[i] != self.doc[j]) | self.many[i] | self.many[j])
        i, j, linked = i[ok], j[ok], []
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            some, in_a, in_b = near(self.x[a], self.x[b], self.threshold)
            self._cover(a[some], in_a[:, 0], in_a[:, 1])
            self._cover(b[some], in_b[:, 0], in_b[:, 1])
            linked.append((a[some], b[some]))
        if linked:
            self._link(*map(np.concatenate, zip(*linked, strict=True)))

    def small(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Small groups, pair by pair."""
        for i, j in pairs_of(starts, sizes):
            self.look(i, j)

    def _equal(self, rows: np.ndarray) -> np.ndarray:
        """Cover and link equal sequences; the pivots: for each start a row with the commonest sequence, the one that has most of these."""
        x = self.x[rows]
        sums = np.zeros((len(rows), AROUND + 1), dtype=np.uint64)
        np.cumsum(x.astype(np.uint64) * _ODD, axis=1, out=sums[:, 1:])
        whole = _sums(x >= 0) == LENGTH
        common, score = [], np.zeros(len(rows), dtype=np.int64)
        for s in range(LENGTH):
            ok = np.flatnonzero(whole[:, s])
            if len(ok) < 2:
                continue
            _, first, of, count = np.unique((sums[ok, s + LENGTH] - sums[ok, s]), return_index=True, return_inverse=True, return_counts=True)
            at = rows[ok]
            several = np.bincount(of, weights=(self.doc[at] != self.doc[at[first]][of]) | self.many[at]) > 0
            hit = several[of]
            self._cover(at[hit], s, s + LENGTH)
            self._link(at[hit], at[first[of]][hit])
            if count.max() > 1:
                common.append(ok[of == count.argmax()])
                score[common[-1]] += 1
        return np.unique([rows[c[score[c].argmax()]] for c in common]).astype(np.int64)

    def large(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One large group; its pivots, and the (row, code) of all tokens that are not the commonest of their place."""
        pivots = self._equal(rows)
        for p in pivots:
            self.look(rows, np.full(len(rows), p))
        x = self.x[rows]
        row, place = np.nonzero(x >= 0)
        code = place.astype(np.int64) << 16 | x[row, place]
        known, of, count = np.unique(code, return_inverse=True, return_counts=True)
        best = np.lexsort((count, known >> 16))
        best = best[np.append(np.diff(known[best] >> 16) > 0, True)]  # the commonest of each place
        mode = np.zeros(len(known), dtype=bool)
        mode[best] = count[best] > 1
        beside = [np.isin(known + step, known, assume_unique=True) for step in (1 << 16, -(1 << 16))]
        held = np.zeros(x.shape, dtype=bool)
        held[row, place] = ((count > 1) | beside[0] | beside[1])[of]
        starts = np.arange(LENGTH)
        open_ = (starts < self.lo[rows, None]) | (starts + LENGTH > self.hi[rows, None])
        left = ((_sums(held) >= needed(self.threshold)) & (_sums(x >= 0) == LENGTH) & open_).any(axis=1)
        rare = ~mode[of]
        if left.any():
            useful = (count > 1) & ~mode & (np.bincount(of, weights=left[row], minlength=len(known)) > 0)
            take = np.flatnonzero(useful[of])
            take = take[np.argsort(of[take], kind="stable")]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(of[take])) + 1, [len(take)]]) if len(take) else np.zeros(1, dtype=np.int64)
            sizes, who = np.diff(bounds), row[take]
            seen = [np.zeros(0, dtype=np.int64)]
            for i, j in pairs_of(bounds[:-1][sizes <= FEW], sizes[sizes <= FEW]):
                a, b = who[i], who[j]
                ok = left[a] | left[b]
                seen.append(np.unique(a[ok].astype(np.int64) << 32 | b[ok]))
                if sum(map(len, seen)) > PAIRS * 64:
                    seen = [self._seen(rows, seen)]
            self._seen(rows, seen)
            solved: list[np.ndarray] = []
            for k in np.argsort(-sizes, kind="stable"):
                if sizes[k] <= FEW:
                    break
                part = np.unique(who[bounds[k] : bounds[k + 1]])
                if len(part) < len(rows) and not any(s[part].all() for s in solved):
                    solved.append(np.bincount(part, minlength=len(rows)) > 0)
                    self.large(rows[part])
        return pivots, rows[row[rare]], code[rare]

    def _seen(self, rows: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        each = np.unique(np.concatenate(pairs))
        self.look(rows[each >> 32], rows[each & 0xFFFFFFFF])
        return np.zeros(0, dtype=np.int64)


def _matched(rows: DataFrame, threshold: float) -> DataFrame:
    """Of windows dealt by key and block: spans lo..hi of doc_id, linked to ``other``; of keys in blocks also windows to compare again, under new keys."""
    names = ["key", "block", "blocks", "doc_id", "c", "lo", "hi", "context", "more"]

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        key, block, blocks, doc, c, lo, hi = (t.column(k).to_numpy() for k in range(7))
        context, more = t.column(7).chunk(0), t.column(8).combine_chunks()
        n = len(key)
        sizes = hi - lo + LENGTH
        x = np.repeat(-1 - np.arange(n, dtype=np.int32)[:, None], AROUND, axis=1)
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (lo - c + BEFORE)[row]
        flat = np.frombuffer(context.buffers()[2], dtype=np.uint16)
        begin = np.frombuffer(context.buffers()[1], dtype=np.int32)[context.offset] // 2
        x[row, place] = flat[begin : begin + len(row)]
        order = np.lexsort((doc, block, key))
        key, block, blocks, doc, c, lo, hi, x = (v[order] for v in (key, block, blocks, doc, c, lo, hi, x))
        new = np.ones(n, dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(new) - 1
        # equal windows are one
        print_ = np.zeros(n, dtype=np.uint64)
        for k in range(AROUND):
            print_ += np.maximum(x[:, k], -1).astype(np.uint64) * _ODD[k]
        _, first, of = np.unique(mix(print_ + group.astype(np.uint64) * _ODD[0]), return_index=True, return_inverse=True)
        by = np.argsort(first)  # in order of groups
        first, of = first[by], np.argsort(by)[of]
        many = np.bincount(of, weights=doc != doc[first[of]]) > 0
        found = Matcher(x[first], doc[first], many, threshold)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group[first])) + 1, [len(first)]])
        each, split = np.diff(bounds), blocks[first[bounds[:-1]]] > 1
        small = (each <= FEW) & ~split
        again: list[tuple[np.ndarray, np.ndarray]] = []
        found.small(bounds[:-1][small], each[small])
        for k in np.flatnonzero(~small):
            pivots, at, code = found.large(np.arange(bounds[k], bounds[k + 1]))
            if split[k]:
                again.append((pivots, key[first[pivots]]))
                at = np.concatenate([at, np.repeat(pivots, AROUND)])
                code = np.concatenate([code, (np.arange(AROUND) << 16 | found.x[pivots]).ravel()])
                ok = code & 0xFFFF == np.where(found.x[at, code >> 16] >= 0, code & 0xFFFF, -1)
                again.append((at[ok], mix(key[first[at[ok]]].view(np.uint64) + mix(code[ok].astype(np.uint64))).view(np.int64)))
        at = np.flatnonzero(found.hi[of] > 0)
        yield told(doc[at], found.doc[found.label[of[at]]], *(v[of[at]] + c[at] - BEFORE for v in (found.lo, found.hi)), None, None)
        times = pc.fill_null(pc.list_value_length(more), 0).to_numpy()[order]
        if times.any():  # the same in the other places of a text
            which = np.repeat(np.arange(n), times)
            places = pc.list_flatten(more.take(pa.array(order))).to_numpy(zero_copy_only=False)
            ok = found.hi[of[which]] > 0
            at, places = which[ok], places[ok]
            yield told(doc[at], found.doc[found.label[of[at]]], *(v[of[at]] + places - BEFORE for v in (found.lo, found.hi)), None, None)
        for which, under in again:
            for k in range(0, len(which), CHUNK):
                r = first[which[k : k + CHUNK]]
                texts = [x[i, BEFORE + lo[i] - c[i] : BEFORE + hi[i] - c[i] + LENGTH].astype(np.uint16).tobytes() for i in r]
                yield told(doc[r], None, lo[r], hi[r], under[k : k + CHUNK], (c[r], texts, more.take(pa.array(order[r]))))

    def told(doc, other, lo, hi, key, more) -> pa.RecordBatch:
        n = len(doc)
        null = lambda kind: pa.nulls(n, kind)
        cols = [pa.array(doc, pa.int64()), null(pa.int64()) if other is None else pa.array(other, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
        cols += [null(pa.int64()), null(pa.int32()), null(pa.binary()), null(pa.list_(pa.int32()))] if more is None else [pa.array(key, pa.int64()), pa.array(more[0].astype(np.int32)), pa.array(more[1], pa.binary()), more[2]]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "other", "lo", "hi", "key", "c", "context", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if sum(map(len, held)) >= CHUNK:
                key, block = (batch.column(k).to_numpy() for k in (0, 1))
                last = held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()
                other = np.flatnonzero((key != last[0]) | (block != last[1]))
                cut = int(other[0]) if len(other) else len(batch)
                held.append(batch.slice(0, cut))
                if cut == len(batch):
                    continue
                yield from solve(held)
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from solve(held)
        del held
        release()

    dealt = rows.select(*names).repartition("key", "block").sortWithinPartitions("key", "block")
    return map_arrow(dealt, run, "doc_id bigint, other bigint, lo int, hi int, key bigint, c int, context binary, more array<int>")


def _shared(keys: DataFrame) -> DataFrame:
    """(key, blocks) of keys that several documents have; counts are summed in each task first."""
    found = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a <> b")
    return found.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def _first_rows(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The windows of keys that several documents have, with their tokens."""
    shared = scratch.keep(_shared(found.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.key")))
    context = F.substring("tokens", F.col("w.lo") * 2 + 1, (F.col("w.hi") - F.col("w.lo") + LENGTH) * 2).alias("context")
    small = sized(shared)
    if small is shared:  # too many keys to broadcast: documents get their shared windows back before these take their tokens along
        slim = found.select("doc_id", F.explode("windows").alias("w")).join(shared, F.col("w.key") == F.col("key"))
        marked = slim.groupBy("doc_id").agg(F.collect_list(F.struct("w", "blocks")).alias("x"))
        each = marked.join(found.select("doc_id", "tokens"), "doc_id").select("doc_id", "tokens", F.explode("x").alias("x")).select("doc_id", "tokens", "x.w", "x.blocks")
    else:
        each = found.select("doc_id", "tokens", F.explode("windows").alias("w")).join(small, F.col("w.key") == F.col("key"))
    return _dealt(each.select("doc_id", "w.key", "w.c", "w.lo", "w.hi", "w.more", "blocks", context))


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, class_id): passages of 50 words or more that other documents repeat.

    Words are runs of letters and digits in lower case, counted from 0; end_word is the first one after the passage.
    Passages of a document that touch or overlap are one row. class_id is the smallest id among the documents linked
    through passages. Passages repeated only within one document are not reported; neither are texts under 50 words,
    null texts and null ids. Equal texts take part once, and each of their documents is one passage. Of an id with
    several texts the smallest is taken. An empty table gives an empty result. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession)
    texts = one_per_id(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), scratch).where("text is not null")
    prints = texts.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b"))
    equal = prints.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    copies = scratch.keep(prints.join(equal, ["a", "b"]).select("doc_id", "rep"))
    found = scratch.keep(_windows(without(texts, copies.where("doc_id <> rep").select("doc_id"))))
    whole = found.join(sized(copies.select("rep").distinct()), F.col("doc_id") == F.col("rep")).select("rep", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    whole = scratch.keep(whole)
    rows, parts = _first_rows(found, scratch), [whole.select(F.col("rep").alias("doc_id"), F.col("rep").alias("other"), "lo", "hi")]
    while True:
        out = scratch.keep(_matched(rows, threshold))
        parts.append(out.where("key is null").select("doc_id", "other", "lo", "hi"))
        again = out.where("key is not null").drop("other")
        if again.isEmpty():
            break
        rows = _dealt(again.join(sized(scratch.keep(_shared(again))), "key"))
    spans = _all(parts)
    classes = components(spans.select(F.col("doc_id").alias("a"), F.col("other").alias("b")), scratch)
    by = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "lo", "hi").withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("lo")).cast("int"))
    merged = marked.withColumn("nth", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    merged = merged.select("doc_id", F.col("doc_id").alias("rep"), "lo", "hi").union(copies.where("doc_id <> rep").join(whole, "rep").select("doc_id", "rep", "lo", "hi"))
    end = F.col("hi") + (WORDS - 1)
    out = merged.join(classes, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("lo").alias("start_word"), end.alias("end_word"), (end - F.col("lo")).alias("n_words"), F.coalesce("component", "rep").alias("class_id"))
