import math
import random
from collections import Counter, defaultdict

import numpy as np

from shardquill.llm import langid
from shardquill.llm.common import fold


def corpus():
    rng = random.Random(6)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["str", "ing", "est", "ole"], "cc": ["éa", "ñu", "ça", "lü"]}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(20)), lang))
    return rows


def model_of(rows):
    lang, n, item, count = zip(*rows, strict=True)
    return langid.Model(lang, np.array(n), np.array([langid.hash_of(x) for x in item], dtype=np.uint64), np.array(count))


def test_words_then_ngrams():
    model = model_of([("x", 0, "known", 10), ("y", 0, "known", 1), ("x", 0, "other", 9), ("y", 3, "kno", 5), ("x", 1, "k", 1)])
    assert model.langs == ["x", "y"]
    assert model.word("known")[0] == max(model.word("known"))
    assert model.word("knot")[1] == max(model.word("knot"))  # the longest known n-gram is y's
    assert model.word("k")[0] == max(model.word("k")) and not model.word("???").any()
    assert abs(float(model.word("other")[0]) - math.log(9 / 20)) < 1e-6


def test_accuracy_and_odd_texts(spark):
    rows = corpus()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 ?! ²", "cc"), (903, "kato" * 30_000, "aa"), (904, "KATOMI, rumi!", None), (None, "string est", "bb"), rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id bigint, text string, lang string, score string")
    model = langid.fit(df, fold(df["doc_id"], 3) != 1)
    out = langid.identify(df.drop("lang"), model).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r.doc_id: r for r in out}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[902].score == 0
    assert got[903].lang_pred == got[904].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(df, fold(df["doc_id"], 3) != 1)
    assert [tuple(r) for r in langid.identify(df, model).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_held_out(spark):
    from shardquill.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    got = op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def brute(rows, texts):
    """The definition in plain Python: log frequencies of words, else of the longest known n-grams, summed over all words."""
    counts = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang in rows:
        for w in langid.words_of(text):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(langid.grams_of(w, n))
    langs = sorted(counts[0])
    value = lambda n, lang, x: math.log(max(counts[n][lang][x], 0.1) / (1 + sum(counts[n][lang].values())))
    known = lambda n, x: any(counts[n][lang][x] for lang in langs)
    out = []
    for text in texts:
        total = dict.fromkeys(langs, 0.0)
        for w in langid.words_of(text):
            items = [(0, w)] if known(0, w) else next((f for n in range(5, 0, -1) if (f := [(n, g) for g in langid.grams_of(w, n) if known(n, g)])), [])
            for lang in langs if items else []:
                total[lang] += sum(value(n, lang, x) for n, x in items) / len(items)
        best = max(langs, key=lambda x: total[x])
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)))
    return out


def test_against_brute_force(spark):
    """Scores and predictions by the definition, with more languages than words of any and words known once."""
    rows = corpus()[:60] + [(1000 + i, f"only{i} of language{i % 7}", f"l{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, fold(df["doc_id"], 3) != 7)
    assert len(model.langs) == 603
    texts = ["kato string", "éañu kamix", "only599 unknownword", "zzz 12", "of", "language3 only17"]
    want = brute(rows, texts)
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, want, strict=True):
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == lang or score < 0.6), r
