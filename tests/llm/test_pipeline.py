import hashlib
import random
import struct

import corpus_pipeline as p
from tests.llm.test_native import shingles


def corpus(path, spark):
    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = make(20)
    docs = [(i, "menu line\n" + make(60), "en", "site", None, 7) for i in range(60)]
    docs += [(100 + i, make(50) + " stupid " + make(10), "en", "other", 5, 7) for i in range(12)]
    docs += [(200, docs[3][1] + " end", "en", "site", 5, 7), (201, docs[3][1], "en", "site", 5, 7)]
    docs += [(300, make(400) + " " + item.upper() + " " + make(5), "en", "other", 5, 7), (301, None, "en", "other", 0, 7), (302, "", None, None, 0, 7), (None, "no id at all", "en", "x", 5, 7), docs[5]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 200)) for i in [*range(0, 50), *range(100, 109)]], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, item


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs, item = corpus(str(tmp_path), spark)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        after = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert after.columns == now.columns and after.dtypes == now.dtypes
        after.write.parquet(str(tmp_path / name))
        seen[name] = (now.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        now = spark.read.parquet(str(tmp_path / name))
    ids = lambda rows: sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    before, after = seen["toxicity"]
    assert ids(after) == [i for i in ids(before) if i is None or not 100 <= i < 200]
    before, after = seen["line_dedup"]
    assert ids(before) == ids(after) and not any("menu line" in (r.text or "") for r in after)
    assert all(r.n_chars == len(r.text) for r in after if r.source == "site") and all(r.score == 7 for r in after)
    before, after = seen["minhash_dedup"]
    assert set(ids(after)) == set(ids(before)) - {200, 201}
    assert len(after) == len(set(ids(after)))
    before, after = seen["decontamination"]
    assert ids(after) == [i for i in ids(before) if i != 300] and not any(shingles(item) <= shingles(r.text) for r in after)
    before, after = seen["bpe"]
    texts = {r.doc_id: r.text or "" for r in before}
    assert ids(after) == ids(before)
    for r in after:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)))
    whole = p.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, after))


def test_empty_documents(spark, tmp_path):
    corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
