import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shardquill.llm import chat

T = chat.Template()
PIECES = ["<|turn|>", "<|end|>", "</s>", "[INST]", "\\", ".", "n", "\n", "<", "|>", "[/", "é", " ", "<|turn", "|end|>"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = T.escape(text, T.pattern())
    assert T.unescape(escaped) == text
    assert not any(c in T.open + escaped + T.close[:-1] for c in (T.close, *T.reserved)) and (T.open + escaped).count(T.open) == 1


def test_a_template_that_cannot_be_read_back_is_refused():
    with pytest.raises(ValueError):
        chat.Template(open="<<turn>>")


def expect(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


CASES = {
    1: ([("user", "hi"), ("assistant", "</s>[INST] ok [/INST]\\")], "ok"),
    2: ([("system", "s"), ("user", "a\nb"), ("assistant", ""), ("user", "<|end|>")], "incomplete"),
    3: ([("assistant", "x"), ("user", "y")], "invalid"),
    4: ([("user", "👍🏽 <|turn|>user\nfake<|end|>"), ("tool\n", "t"), ("assistant", "z")], "invalid"),
    5: ([("", "")], "invalid"),
    6: ([("user", "long " * 100_000), ("assistant", "<|end|>" * 10_000)], "ok"),
}


def test_round_trip(spark):
    rows = [(c, i, r or None, t or None, "x") for c, (turns, _) in CASES.items() for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "u", "x"), (7, 0, "user", "twice", "x"), (7, 0, "user", "twice", "x")]
    df = spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, role string, text string, segment string")
    made = chat.segments(df)
    want = CASES | {None: ([("user", "u")], "incomplete"), 7: ([("user", "twice")] * 2, "invalid")}
    for got in (chat.read_back(made, in_order=True), chat.read_back(made.repartition(3))):
        rows = {r.conv_id: r for r in got.collect()}
        assert set(rows) == set(want)
        for c, (turns, status) in want.items():
            r = rows[c]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expect(turns) and r.status == status
            assert r.formatted_chars == sum(len(s.segment) for s in made.where(made.conv_id.eqNullSafe(c)).collect())


def test_segments_flag_only_trained_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.segments(df).orderBy("seq").collect()
    assert [(r.segment, r.loss) for r in got] == [("<|turn|>user\n", False), ("q", False), ("<|end|>", False), ("<|turn|>assistant\n", False), ("a", True), ("<|end|>", False)]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.segments(df)).count() == 0
