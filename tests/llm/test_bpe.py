import hashlib
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardquill.llm import bpe

PATH = bpe.default_path()
OURS, THEIRS = bpe.Tokenizer(PATH), Tokenizer.from_file(PATH)


def same(text):
    ids = list(struct.unpack(f"<{len(OURS.encode(text)) // 4}I", OURS.encode(text)))
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids, repr(text)
    assert OURS.decode(OURS.encode(text)) == THEIRS.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", " the", "'s", "'LL", "  ", "\n\n", "\t", "<|endoftext|>", "<|endof", "é", "ß", "日本", "12", "½", "…", " ", " ", "\x1c", "\x85", "aaaa", "!?", "👍🏽"]), max_size=20).map("".join))
def test_mixed_pieces(text):
    same(text)


def test_long_words_stay_whole():
    same("ab" * 20_000)
    same(" " * 5000 + "x")


def test_table(spark):
    rows = [(1, "Hello  world<|endoftext|>\n"), (2, None), (3, ""), (1, "Hello  world<|endoftext|>\n"), (None, "x" * 50_000)]
    got = bpe.encode_decode(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = THEIRS.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == (r.text or "")
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    from shardquill.llm.queries import op8_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = THEIRS.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
