import math
import random
from itertools import product

import pytest

from shardquill.llm import toxicity
from shardquill.llm.common import fold

CLEAN = ["the", "garden", "river", "stone", "walks", "over", "little", "morning", "paper", "window", "idea", "lost", "it", "a", "i"]


def grams(words):
    out = {}
    for word, n in words.items():
        padded = "^^^" + word + "$"
        for i in range(len(padded) - 3):
            out[padded[i : i + 4]] = out.get(padded[i : i + 4], 0) + n
    return out


@pytest.fixture(scope="module")
def chars():
    return toxicity.CharModel(grams({w: 50 for w in CLEAN} | {"idiot": 20, "trash": 20, "stupid": 20}))


@pytest.mark.parametrize("written,word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("tr@sh", "trash"), ("tra$h", "trash"), ("i d i o t", "idiot"), ("idiooooot!!", "idiot"), ("$tup1d", "stupid"), ("garden,", "garden"), ("***river***", "river"), ("s-t-u-p-i-d", "stupid")])
def test_restores(chars, written, word):
    assert word in toxicity.Restorer(chars).words(written)



@pytest.mark.parametrize("token", ["1d!0t", "tr@$h", "i1.o", "oo0o"])
def test_viterbi_finds_the_cheapest_reading(chars, token):
    best = None
    for choice in product(*toxicity.readings(token)):
        context, cost = "^^^", 0.0
        for c, price in choice:
            cost += price + (chars.cost(context, c) if c else 0)
            context = context[1:] + c if c else context
        cost += chars.cost(context, "$")
        if best is None or cost < best[0] - 1e-9:
            best = (cost, "".join(c for c, _ in choice))
    assert toxicity.decode(token, chars) == best[1]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(30)] = rng.choice(["idiot", "trash", "stupid"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_and_scores_disguised_words(spark):
    docs, labels = corpus()
    docs += [(1000, "the river 1d10t over stone"), (1001, "the i d i o t walks"), (1002, None), (1003, ""), (1004, "?? !! 12 34"), (1005, "the river walks"), (1006, "garden " * 50_000 + "tr4sh"), (None, "stupid paper"), docs[0]]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels + [(0, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, lab, fold(lab["doc_id"], 5) != 0)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(docs)
    got = {r.doc_id: r for r in out}
    truth = dict(labels)
    assert all(got[i].predicted == t for i, t in truth.items())
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, None)] == [1, 1, 0, 0, 0, 0, 1, 1]
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a stupid idea")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [tuple(r) for r in toxicity.score(d, toxicity.fit(d, none, fold(none["doc_id"], 5) != 0)).select("score", "predicted").collect()] == [(0.0, 0)]
    empty = d.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, none, fold(none["doc_id"], 5) != 0)).count() == 0


def test_held_out_accuracy(spark):
    from shardquill.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.01"
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)


def test_held_out_recall_and_precision(spark):
    """Most texts are clean, so agreement alone says little; sf0.1 has enough toxic ones to tell."""
    from shardquill.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit, said, true = (sum(f(r) for r in got) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert true > 50 and hit >= 0.9 * true and hit >= 0.9 * said


def test_character_model_has_no_cap(spark):
    """160,000 words of four letters of their own: more n-grams than were once kept."""
    words = ["".join(chr(0x4E00 + (i // 400**k) % 400) for k in range(2)) + "ab" for i in range(160_000)]
    rows = [(" ".join(words[k : k + 1000]),) for k in range(0, len(words), 1000)]
    model = toxicity.fit_characters(spark.createDataFrame(rows, "text string"))
    assert all(model.counts.get(w) for w in words)


def test_marks_that_are_letters_and_single_doubled_letters():
    chars = toxicity.CharModel(grams({w: 50 for w in CLEAN} | {"idiot": 20, "asshole": 20}))
    assert toxicity.Restorer(chars).words("!diot") == ("idiot",)
    scorer = toxicity.Scorer(toxicity.Model(chars, {"asshole$": 5.0}, None))
    assert scorer.weight("asshhole") == 5.0 and scorer.weight("garden") == 0.0


def test_weights_and_scores_against_brute_force(spark):
    """Features' log odds counted over whole texts, and the score from the largest and the summed weight."""
    docs, labels = corpus(200, seed=9)
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(d, lab, lab["doc_id"] >= 0)
    text, toxic = dict(docs), dict(labels)
    texts = {t: toxic[i] for i, t in text.items()}
    seen = {t: set().union(*(toxicity.features(w) for w in t.split())) for t in texts}
    n = [sum(v == k for v in texts.values()) for k in (0, 1)]
    odds = {}
    for f in set().union(*seen.values()):
        c, t = (sum(f in seen[x] and v == k for x, v in texts.items()) for k in (0, 1))
        value = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        if t >= toxicity.LEAST_ROWS and t > c and value >= toxicity.LEAST_ODDS:
            odds[f] = value
    assert model.weights == pytest.approx(odds) and odds
    a, b, c = model.logistic
    for r in toxicity.score(d, model).collect():
        found = {w: x for w in set(r.text.split()) if (x := max(odds.get(f, 0.0) for f in toxicity.features(w)))}
        most, total = (max(found.values()), math.log1p(sum(found.values()))) if found else (0.0, 0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * most + c * total))))


def test_viterbi_with_many_states():
    """A token of digits that may each be a letter or nothing has many states; the cheapest reading is still found."""
    chars = toxicity.CharModel(grams({"bigbigsize": 30, "gigabits": 30}))
    token = "b616616161"
    cost = {}
    for choice in product(*toxicity.readings(token)):
        word = "".join(c for c, _ in choice)
        cost[word] = min(cost.get(word, math.inf), _cost(choice, chars))
    assert len({("^^^" + w)[-3:] for w in cost}) > 30
    assert cost[toxicity.decode(token, chars)] == pytest.approx(min(cost.values()))


def _cost(choice, chars):
    context, cost = "^^^", 0.0
    for c, price in choice:
        cost += price + (chars.cost(context, c) if c else 0)
        context = context[1:] + c if c else context
    return cost + chars.cost(context, "$")
