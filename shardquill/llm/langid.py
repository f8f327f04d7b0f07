"""Language identification by words first, with backoff to shorter and shorter character n-grams.

A word known in any language scores by its log relative frequency in each (a penalty where it is unknown). An unknown
word scores by the mean over its longest known n-grams: those of five characters, else of four, and so on. A document's
score for a language is the sum over all its words. The model has every word and n-gram of its sample, by 64 bits of
their hash, each with the languages that have it; so its size is that of the sample, whatever the number of languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_texts, release, sized

#: Documents of each language that the model is fitted on.
SAMPLE = 8_000
LONGEST = 5
#: Languages that may be broadcast with their shares.
LANGUAGES = 100_000
#: Words kept in a worker's cache, and numbers in all for them (one a language).
CACHE, NUMBERS = 200_000, 8_000_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def hash_of(item: str) -> int:
    return xxhash.xxh3_64_intdigest(item)


class Model:
    """For words (0) and n-grams of each length: sorted hashes, and the log frequencies in those languages that have them."""

    def __init__(self, lang: Sequence[str], n: np.ndarray, item: np.ndarray, count: np.ndarray):
        """From one entry for each language, length and item (a hash)."""
        self.langs = sorted(set(lang))
        at = {x: i for i, x in enumerate(self.langs)}
        column = np.array([at[x] for x in lang], dtype=np.int32)
        self.items, self.starts, self.columns, self.logs, self.rest = [], [], [], [], []
        for length in range(LONGEST + 1):
            own = np.flatnonzero(n == length)
            own = own[np.argsort(item[own], kind="stable")]
            items, first = np.unique(item[own], return_index=True)
            total = 1 + np.bincount(column[own], weights=count[own], minlength=len(self.langs))
            self.items.append(items)
            self.starts.append(np.append(first, len(own)))
            self.columns.append(column[own])
            self.logs.append(np.log(count[own] / total[column[own]]).astype(np.float32))
            self.rest.append(np.log(0.1 / total).astype(np.float32))

    def rows(self, words: list[str]) -> np.ndarray:
        """For each word its log frequency in each language: of the word, else the mean over its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        left = np.arange(len(words))
        for n in (0, *range(LONGEST, 0, -1)):
            each = [grams_of(words[i], n) if n else [words[i]] for i in left]
            owner = np.repeat(left, [len(x) for x in each])
            hashes = np.fromiter((hash_of(x) for part in each for x in part), dtype=np.uint64, count=len(owner))
            items = self.items[n]
            at = np.minimum(items.searchsorted(hashes), max(len(items) - 1, 0))
            known = np.flatnonzero(items[at] == hashes) if len(items) else np.zeros(0, dtype=np.int64)
            owner, at = owner[known], at[known]
            count = np.bincount(owner, minlength=len(words))
            found = np.flatnonzero(count)
            out[found] = self.rest[n] * count[found, None]  # a penalty where a language does not have it
            sizes = self.starts[n][at + 1] - self.starts[n][at]
            entry = np.arange(sizes.sum()) + np.repeat(self.starts[n][at] - np.cumsum(sizes) + sizes, sizes)
            column = self.columns[n][entry]
            np.add.at(out, (np.repeat(owner, sizes), column), self.logs[n][entry] - self.rest[n][column])
            out[found] /= count[found, None]
            left = left[count[left] == 0]
        return out

    def word(self, word: str) -> np.ndarray:
        return self.rows([word])[0]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.most = max(1024, min(CACHE, NUMBERS // max(1, len(model.langs))))
        self.rows = np.zeros((0, len(model.langs)), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        """Look up all words that are not known yet, at once."""
        if len(self.cache) + len(words) > self.most:
            self.cache, self.rows = {}, self.rows[:0]
        new = list(words.difference(self.cache))
        if new:
            self.rows = np.concatenate([self.rows[: len(self.cache)], self.model.rows(new)])
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The language of a text with these words, which are all known."""
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = self.rows[list(map(self.cache.__getitem__, words))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def fit(docs: DataFrame, learn, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """The model of the rows where ``learn`` (a boolean column) holds, from about ``SAMPLE`` documents a language.

    The rows of a language are sampled by a hash of their key, at the share that gives SAMPLE of them. Null languages
    and texts teach nothing. All languages, words and n-grams of the sample are learned.
    """
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit("lang"), key), F.lit(1_000_000)).alias("at"))
    shares = rows.groupBy("lang").count().select("lang", (F.lit(1_000_000.0) * SAMPLE / F.col("count")).alias("share"))
    sample = rows.join(sized(shares, LANGUAGES), "lang").where(F.col("at") < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang_, counted in words.items():
                for n in range(LONGEST + 1):
                    found: Counter = Counter()
                    for w, c in counted.items():
                        for item in grams_of(w, n) if n else (w,):
                            found[item] += c
                    hashes = np.array([hash_of(x) for x in found], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(hashes), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "item", "count"])
            words.clear()

        for batch in batches:
            for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(lang_, Counter()).update(words_of(text_.as_py()))
            if sum(map(len, words.values())) > CACHE:
                yield from told()
        yield from told()
        release()

    found = map_arrow(sample, count, "lang string, n int, item bigint, count bigint").groupBy("lang", "n", "item").agg(F.sum("count").alias("count")).toArrow()
    cols = {c: found.column(c).combine_chunks() for c in found.column_names}
    return Model(cols["lang"].to_pylist(), cols["n"].to_numpy(), cols["item"].to_numpy().view(np.uint64), cols["count"].to_numpy())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: the language's share of the likelihood).

    Texts that are null, empty or without a letter get ``und`` and 0; so does everything under a model without
    languages. Of equal languages the first by name wins. Texts of any length are read whole; each row gets one row.
    """
    held, model_langs = docs.sparkSession.sparkContext.broadcast(model), bool(model.langs)

    def make():
        scorer = Scorer(held.value)

        def run(texts: list[str | None]) -> list[list]:
            words = [words_of(t) for t in texts]
            if model_langs:
                scorer.learn(set().union(*words))
            found = [scorer.predict(w) for w in words]
            return [[f[0] for f in found], [f[1] for f in found]]

        return run

    return map_texts(docs, [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())], make, text=text)
