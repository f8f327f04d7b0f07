"""Toxicity scores behind a noisy channel: disguised words are restored, then scored.

A word written with stand-in characters (``1d10t``), marks between its letters (``i.d.i.o.t``), letters set apart
(``i d i o t``) or letters repeated (``idiooot``) is a lattice: each character may be itself, a letter it stands for, or
noise. Viterbi decoding finds the reading that costs least under the channel and a character language model (4-grams
with backoff) counted over all words of the corpus. Restored words are scored by weights of words and word beginnings,
learned from labelled rows; a logistic function of the largest and of the summed weight gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_texts

#: Labelled rows of each class that weights are fitted on (the first by a hash of their id).
SAMPLE = 10_000
#: A feature needs this many toxic rows, and this log odds, to count.
LEAST_ROWS, LEAST_ODDS = 4, 3.0
PREFIXES = (4, 5, 6, 7, 8)
ORDER = 4
#: Words kept in a worker's cache.
CACHE = 200_000

#: Letters that a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "¥": "y", "§": "s",
}
#: Costs, in nats: a stand-in read as a letter, a repeated character dropped, a mark dropped, a digit dropped, a gap closed, a gap kept.
LEET, REPEAT, MARK, DIGIT, JOIN, GAP = 0.7, 0.4, 0.3, 2.5, 0.3, 1.0

_EDGE = re.compile(r"^[^\w@$!|+(€£¡¢¥§]+|[^\w@$|+€£¢¥§]+$|([^\w])\1{2,}$|^([^\w])\2{2,}|_+$|^_+")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_MARKS = ".,;:!?\"'()[]{}*"
#: Those that stand for no letter: at a token's start the others may be its first letter.
_BEFORE = "".join(c for c in _MARKS if c not in STANDS_FOR)


class CharModel:
    """Log probabilities of a character after up to three others, with stupid backoff; ``^`` begins a word, ``$`` ends it."""

    def __init__(self, grams: dict[str, int]):
        self.counts: dict[str, int] = {}
        contexts: Counter = Counter()
        for gram, n in grams.items():
            for k in range(ORDER):
                piece = gram[k:]
                self.counts[piece] = self.counts.get(piece, 0) + n
                contexts[piece[:-1]] += n
        self.contexts = dict(contexts)
        self.known: dict[tuple[str, str], float] = {}

    def cost(self, context: str, char: str) -> float:
        if (known := self.known.get((context, char))) is not None:
            return known
        cost, ctx = 0.0, context
        while True:
            n = self.counts.get(ctx + char)
            if n:
                cost -= math.log(n / self.contexts[ctx])
                break
            if not ctx:
                cost += 12.0
                break
            ctx, cost = ctx[1:], cost + 0.9
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[context, char] = cost
        return cost


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each character of a token (with blanks between set-apart letters) what it may be read as."""
    out, before = [], ""
    for c in token:
        options: list[tuple[str, float]] = []
        if c == " ":
            options = [("", JOIN), (" ", GAP)]
        elif c.isalpha():
            options = [(c, 0.0)]
        else:
            options = [(x, LEET) for x in STANDS_FOR.get(c, "")] + [("", DIGIT if c.isalnum() else MARK)]
        if c == before:
            options.append(("", REPEAT))
        out.append(options)
        before = c
    return out


def decode(token: str, model: CharModel) -> str:
    """The cheapest reading of a token: words, with a blank between them where a gap is kept.

    A state is the last three characters read; of all readings that end in one the cheapest is kept, so nothing that
    could win is dropped, and the states are bounded by the lattice's letters, not by the token's length.
    """
    start = "^" * (ORDER - 1)
    states: dict[str, tuple[float, tuple]] = {start: (0.0, ())}
    for options in readings(token):
        after: dict[str, tuple[float, tuple]] = {}
        for context, (cost, path) in states.items():
            for char, price in options:
                if char == "":
                    key, total, way = context, cost + price, path
                elif char == " ":
                    key, total, way = start, cost + price + model.cost(context, "$"), (path, " ")
                else:
                    key, total, way = context[1:] + char, cost + price + model.cost(context, char), (path, char)
                if key not in after or total < after[key][0]:
                    after[key] = total, way
        states = after
    _, (_, path) = min(states.items(), key=lambda x: (x[1][0] + model.cost(x[0], "$"), x[0]))
    chars = []
    while path:
        path, char = path
        chars.append(char)
    return "".join(reversed(chars))


class Restorer:
    def __init__(self, model: CharModel):
        self.model, self.cache = model, {}

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a token reads as: itself if it is plain, none if it holds no letter."""
        if (known := self.cache.get(token)) is not None:
            return known
        if len(self.cache) > CACHE:
            self.cache.clear()
        bare, last = token.lstrip(_BEFORE).rstrip(_MARKS), None
        if not bare.isalpha():
            bare = token
        while bare != last and not bare.isalpha():
            bare, last = _EDGE.sub("", bare), bare
        if bare.isalpha() and not _TRIPLE.search(bare):
            out = (bare,)
        elif not any(c.isalpha() for c in bare):
            out = ()
        else:
            out = tuple(decode(bare, self.model).split())
        self.cache[token] = out
        return out

    @staticmethod
    def tokens(text: str | None) -> tuple[set[str], list[str]]:
        """A text's different tokens, and its runs of three or more single characters, each to be read together."""
        if not text:
            return set(), []
        if not text.isascii():
            text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        tokens = text.lower().split()
        runs, singles = [], [i for i, t in enumerate(tokens) if len(t) == 1]
        if len(singles) > 2:
            first = last = singles[0]
            for i in [*singles[1:], -1]:
                if i != last + 1:
                    if last - first > 1:
                        runs.append(" ".join(tokens[first : last + 1]))
                    first = i
                last = i
        return set(tokens), runs

    def distinct(self, text: str | None) -> set[str]:
        """All different words of a text, restored."""
        tokens, runs = self.tokens(text)
        out: set[str] = set()
        for token in (*tokens, *runs):
            out.update(self.words(token))
        return out


def features(word: str) -> list[str]:
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) >= n]


class Model:
    """Weights of features, and the logistic function's three parameters (None: nothing was learned)."""

    def __init__(self, chars: CharModel, weights: dict[str, float], logistic: tuple[float, float, float] | None):
        self.chars, self.weights, self.logistic = chars, weights, logistic


class Scorer:
    def __init__(self, model: Model):
        self.model, self.restorer, self.cache, self.tokens = model, Restorer(model.chars), {}, {}

    def weight(self, word: str) -> float:
        if (known := self.cache.get(word)) is not None:
            return known
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.model.weights.get
        out = max(get(f, 0.0) for f in features(word))
        if not out and _DOUBLE.search(word):
            out = max(get(_DOUBLE.sub(r"\1", word) + "$", 0.0), get(decode(word, self.model.chars) + "$", 0.0))
        self.cache[word] = out
        return out

    def weighed(self, token: str) -> tuple[tuple[str, float], ...]:
        """The words of a token that have a weight, with it; kept for the next texts."""
        out = tuple((word, w) for word in self.restorer.words(token) if (w := self.weight(word)))
        if len(self.tokens) > CACHE:
            self.tokens.clear()
        self.tokens[token] = out
        return out

    def evidence(self, text: str | None) -> tuple[float, float]:
        tokens, runs = self.restorer.tokens(text)
        every = [*tokens, *runs]
        known = list(map(self.tokens.get, every))
        if None in known:
            known = [self.weighed(t) if k is None else k for t, k in zip(every, known, strict=True)]
        weights = dict(pair for k in known if k for pair in k).values()
        return (max(weights), math.log1p(sum(sorted(weights)))) if weights else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        if self.model.logistic is None:
            return 0.0
        a, b, c = self.model.logistic
        most, total = self.evidence(text)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * most + c * total))))


def fit_characters(docs: DataFrame, text: str = "text") -> CharModel:
    """The character model of all words of all documents: n-gram counts summed in each task, then over all; it has all that occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: Counter = Counter()

        def spill():
            for word, n in words.items():
                if not word.isalpha():
                    word = word.strip(".,;:!?\"'()[]*")
                    if not word.isalpha():
                        continue
                padded = "^" * (ORDER - 1) + word + "$"
                for i in range(len(padded) - ORDER + 1):
                    grams[padded[i : i + ORDER]] += n
            words.clear()

        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    words.update(value.as_py().lower().split())
                if len(words) > CACHE:
                    spill()
        spill()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "count"])

    found = map_arrow(docs.select(text), count, "gram string, count bigint").groupBy("gram").agg(F.sum("count").alias("count"))
    return CharModel(dict(map(tuple, found.orderBy(F.desc("count"), "gram").collect())))


def fit(docs: DataFrame, labels: DataFrame, learn, text: str = "text", key: str = "doc_id") -> Model:
    """Weights and calibration from labelled rows where ``learn`` (a boolean column of the id) holds.

    ``labels``: one id column named ``key`` and ``toxic``; of an id with several labels the largest counts, null labels
    and ids are ignored, and equal texts count once. At most ``SAMPLE`` rows of each class are used, chosen by a hash of
    the id, and all features of theirs that pass are kept. The calibration is fitted on evidence from weights of the other half of the sample. Without rows of both
    classes nothing is learned, and all scores are 0.
    """
    chars = fit_characters(docs, text)
    judged = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & learn).groupBy(key).agg(F.max("toxic").alias("toxic"))
    pick = lambda c: judged.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit("toxic"), key), key).limit(SAMPLE)
    chosen = F.broadcast(pick(1).unionByName(pick(0)).select(F.col(key).alias("__id"), F.col("toxic").alias("__toxic")))
    sample = docs.join(chosen, docs[key] == F.col("__id")).select(F.col(text).alias("text"), F.col("__toxic").alias("toxic")).where("text is not null")
    sample = sample.dropDuplicates(["text"]).select("text", "toxic", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int").alias("half"))
    held = docs.sparkSession.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(held.value)
        found: list[Counter] = [Counter() for _ in range(4)]
        for batch in batches:
            for value, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found[2 * half + toxic].update({f for w in restorer.distinct(value.as_py()) for f in features(w)} | {""})
        names = list(set().union(*found))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())] + [pa.array([c[n] for n in names], pa.int64()) for c in found], names=["feature", "c0", "t0", "c1", "t1"])

    counted = map_arrow(sample, count, "feature string, c0 bigint, t0 bigint, c1 bigint, t1 bigint").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    top = counted.where((F.col("t0") + F.col("t1") >= LEAST_ROWS) & (F.col("t0") + F.col("t1") > F.col("c0") + F.col("c1")) | (F.col("feature") == ""))
    rows = {r[0]: r[1:] for r in map(tuple, top.collect())}
    c0, t0, c1, t1 = rows.pop("", (0, 0, 0, 0))
    if not (c0 + c1 and t0 + t1):
        return Model(chars, {}, None)

    def weights(pairs: dict, clean: int, toxic: int) -> dict[str, float]:
        odds = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, (c, t) in pairs.items() if t >= LEAST_ROWS}
        return {f: x for f, x in odds.items() if x >= LEAST_ODDS}

    whole = weights({f: (a + c, b + d) for f, (a, b, c, d) in rows.items()}, c0 + c1, t0 + t1)
    halves = [weights({f: (c, d) for f, (_, _, c, d) in rows.items()}, c1, t1), weights({f: (a, b) for f, (a, b, _, _) in rows.items()}, c0, t0)]
    others = docs.sparkSession.sparkContext.broadcast(halves)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(Model(held.value, w, None)) for w in others.value]
        for batch in batches:
            toxic = batch.column(1)
            seen = [scorers[half].evidence(value.as_py()) for value, half in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([toxic, pa.array([s[0] for s in seen], pa.float64()), pa.array([s[1] for s in seen], pa.float64())], names=["toxic", "most", "total"])

    seen = np.array([tuple(r) for r in map_arrow(sample, weigh, "toxic int, most double, total double").collect()], dtype=float)
    return Model(chars, whole, logistic(seen[:, 1:], seen[:, 0]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Newton's method for an intercept and two slopes, with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    keep = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + keep, design.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null and empty texts score as texts without evidence. Texts of any length are read whole; each row gets one row, and
    equal texts get equal scores. Columns called score or predicted are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)

        def run(texts: list[str | None]) -> list[list]:
            found = [scorer.score(t) for t in texts]
            return [found, [int(s >= 0.5) for s in found]]

        return run

    return map_texts(docs, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], make, text=text)
