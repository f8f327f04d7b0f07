"""BPE encoding and decoding with a byte-level vocabulary file.

A text is cut at added tokens, then into words by the vocabulary's pattern. A word's bytes are a doubly linked list of
symbols; a priority queue holds the merges of neighbours by rank, then place; entries whose symbols have meanwhile
changed are stale and skipped. Encoded words are cached up to ``CACHE`` entries, after which the cache starts anew.
Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Words kept in a worker's cache, about 200 bytes each.
CACHE = 200_000

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = byte_characters(), spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.byte_ids = [0] * 256
        for c, b in byte_of.items():
            self.byte_ids[b] = vocab[c]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.cache: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        symbols = [self.byte_ids[b] for b in data]
        n, find = len(symbols), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(hit[0], i, hit[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (hit := find((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := find((made, symbols[k])):
                    heapq.heappush(queue, (hit[0], i, hit[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (hit := find((symbols[h], made))):
                heapq.heappush(queue, (hit[0], h, hit[1], symbols[h], made))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, word = self.cache.get, self.word
        if self.cut is None or not any(x in text for x in self.added):
            return b"".join([get(w) or word(w) for w in self.split.findall(text)])
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(struct.pack("<I", self.added[part]))
            elif part:
                out += [get(w) or word(w) for w in self.split.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit) and decoded (the ids decoded again).

    ``path``: the vocabulary file, at the same place on every executor; by default that of the installed package. Null
    texts count as empty and give no ids; an added token's string in a text becomes that token. Each row gets one row,
    repeated rows and null ids too; texts of any length are encoded whole. Columns called ids or decoded are replaced.
    """
    path = path or default_path()

    def make():
        t = tokenizer(path)

        def run(texts: list[str | None]) -> list[list]:
            ids = [t.encode(x or "") for x in texts]
            return [ids, [t.decode(x) for x in ids]]

        return run

    return map_texts(docs, [("ids", "binary", pa.binary()), ("decoded", "string", pa.string())], make, text=text)
