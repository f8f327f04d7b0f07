import random

import numpy as np

from shardquill.llm import substring_dedup as sd


def test_roots_are_cartesian_tree_roots():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    h[50] = h[60]
    for length in (1, 2, 7, 46):
        assert sd.roots(h, length).tolist() == [i + int(np.argmin(h[i : i + length] >> np.uint64(24))) for i in range(300 - length + 1)]


def test_windows_cover_every_start_once():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 2**63, 500).astype(np.uint64)
    owner = np.repeat([0, 1, 2], [200, 30, 270])
    for own, root, first, last in sd.windows(tokens, owner, 46, 2):
        starts = sorted(i for lo, hi in zip(first, last, strict=True) for i in range(lo, hi + 1))
        assert starts == [*range(0, 155), *range(230, 500 - 45)]
        assert len(own) < 500 * 2 / 46 * 1.8 and (root >= last).all() and (root <= first + 45).all()


def text(rng, n, tag):
    return [f"{tag}{rng.randrange(10_000)}" for _ in range(n)]


def spans(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, key int")
    out = {}
    for r in sd.repeated_passages(df).collect():
        out.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.class_id, r.n_words))
    return {k: sorted(v) for k, v in out.items()}


def test_planted_passages(spark):
    rng = random.Random(7)
    passage, other = text(rng, 60, "p"), text(rng, 51, "q")
    near = list(passage)
    near[30] = "changed"
    short = text(rng, 40, "s")
    rows = []
    for i in range(12):
        rows.append((i, " ".join(text(rng, 80 + 7 * i, f"a{i}x") + passage + text(rng, 30, f"b{i}x"))))
    rows.append((20, " ".join(text(rng, 10, "c") + near + text(rng, 90, "d"))))
    rows.append((21, " ".join(other + text(rng, 200, "e"))))
    rows.append((22, " ".join(text(rng, 200, "f") + other).upper()))
    rows += [(23, " ".join(text(rng, 100, "g") + short)), (24, " ".join(text(rng, 100, "h") + short))]
    rows.append((25, " ".join(text(rng, 400, "i"))))
    within = text(rng, 70, "w")
    rows.append((26, " ".join(within + text(rng, 20, "j") + within)))
    rows += [(27, None), (28, ""), (None, " ".join(passage)), (29, " ".join(passage)), rows[2], (30, " ".join(text(rng, 60_000, "k") + passage))]
    got = spans(spark, rows)
    assert set(got) == {*range(12), 20, 21, 22, 29, 30}
    for i in range(12):
        assert got[i] == [(80 + 7 * i, 140 + 7 * i, 0, 60)]
    assert got[29] == [(0, 60, 0, 60)] and got[30] == [(60_000, 60_060, 0, 60)]
    assert got[21] == [(0, 51, 21, 51)] and got[22] == [(200, 251, 21, 51)]
    assert got[20][0][2] == 0


def test_empty(spark):
    assert spans(spark, []) == {}


def test_family_of_near_copies(spark):
    """Every token that agrees in a near-duplicate sequence of some other copy is reported, though all are linked early."""
    rng = random.Random(1)
    base = text(rng, 250, "w")
    copies = [[f"x{rng.randrange(10**6)}" if rng.random() < 0.05 else w for w in base] for _ in range(40)]
    tokens = np.array([sd.Shingler().shingles(" ".join(c)) for c in copies])
    got = spans(spark, [(i, " ".join(c)) for i, c in enumerate(copies)])
    for i in range(40):
        true = np.zeros(tokens.shape[1], dtype=bool)
        for j in range(40):
            equal = tokens[i] == tokens[j]
            for s in range(len(equal) - sd.LENGTH + 1):
                if i != j and equal[s : s + sd.LENGTH].sum() >= 41:
                    true[s : s + sd.LENGTH] |= equal[s : s + sd.LENGTH]
        said = np.zeros_like(true)
        for start, end, _, _ in got.get(i, []):
            said[start : end - 4] = True
        assert not (true & ~said).any()


def test_near_passage_around_a_common_phrase(spark):
    """The first documents of a key hold the phrase alone; near passages around it share no longer piece of text."""
    rng = random.Random(3)
    passage = text(rng, 50, "p")
    near = list(passage)
    near[25] = "changed"
    rows = [(i, " ".join(text(rng, 40, f"a{i}x") + passage[part : part + 22] + text(rng, 40, f"b{i}x"))) for part in (0, 3, 26, 28) for i in (part, part + 100)]
    rows = [(n, x[1]) for n, x in enumerate(rows)]
    rows += [(20, " ".join(text(rng, 60, "c") + passage + text(rng, 60, "d"))), (21, " ".join(text(rng, 60, "e") + near + text(rng, 60, "f")))]
    got = spans(spark, rows)
    assert set(got) == {20, 21} and got[20] == got[21] == [(60, 110, 20, 50)]


def test_passages_of_pieces_that_their_first_document_has_before(spark):
    rng = random.Random(4)
    rows = []
    for n in range(0, 40, 2):
        passage = text(rng, 54, f"p{n}x")
        alone = [w for start in (0, 6, 12) for w in passage[start : start + 42] + text(rng, 60, f"g{n}x{start}x")]
        rows += [(n, " ".join(alone + passage)), (n + 1, " ".join(text(rng, 70, f"h{n}x") + passage))]
    got = spans(spark, rows)
    for n in range(0, 40, 2):
        assert (306, 360, n, 54) in got[n] and got[n + 1] == [(70, 124, n, 54)]


def truth(copies):
    """Tokens that agree in near-duplicate sequences of two different texts, by brute force over all pairs of sequences at any shift."""
    tokens = [sd.Shingler().shingles(" ".join(c)) for c in copies]
    true = [np.zeros(len(t), dtype=bool) for t in tokens]
    for i, a in enumerate(tokens):
        for j, b in enumerate(tokens):
            if i == j or len(a) < sd.LENGTH or len(b) < sd.LENGTH:
                continue
            for s in range(len(a) - sd.LENGTH + 1):
                part = a[s : s + sd.LENGTH]
                if np.isin(part, b).sum() < 41:
                    continue
                where = np.flatnonzero(np.isin(b, part))
                if any(len(np.intersect1d(part, b[w : w + sd.LENGTH])) >= 41 for w in range(max(0, where[0] - 5), min(where[-1], len(b) - sd.LENGTH) + 1)):
                    true[i][s : s + sd.LENGTH] |= np.isin(part, b)
    return true


def edited(rng, words, kind, rate):
    out = []
    for w in words:
        if rng.random() >= rate:
            out.append(w)
        elif kind == "changed":
            out.append(f"x{rng.randrange(10**6)}")
        elif kind == "inserted":
            out += [w, f"x{rng.randrange(10**6)}"]
    return out


def test_recall_against_brute_force(spark):
    """Pairs of texts that share passages with words changed, put in and left out: at least 0.97 of all repeated tokens are reported."""
    rng = random.Random(11)
    texts = []
    for kind in ("changed", "inserted", "left out"):
        for n in (50, 55, 70, 120):
            for rate in (0.0, 0.015, 0.03):
                passage = text(rng, n, f"{kind[0]}{n}r{rate}x".replace(".", "_"))
                texts += [text(rng, 30, "a") + passage + text(rng, 30, "b"), text(rng, 45, "c") + edited(rng, passage, kind, rate) + text(rng, 20, "d")]
    got = spans(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    found = every = 0
    for i in range(0, len(texts), 2):
        for k, true in enumerate(truth(texts[i : i + 2])):
            said = np.zeros_like(true)
            for start, end, _, _ in got.get(i + k, []):
                said[start : end - 4] = True
            found, every = found + int((true & said).sum()), every + int(true.sum())
    assert every > 3000 and found >= 0.97 * every


def family(rng, m, rate, variants=3):
    base = rng.integers(0, 1 << 16, (variants, sd.AROUND))
    base[:, 30:60] = base[0, 30:60]
    x = base[rng.integers(0, variants, m)].astype(np.int32)
    for i in range(m):
        for at in np.flatnonzero(rng.random(sd.AROUND) < rate):
            if not at - 5 < sd.BEFORE < at + 5:
                x[i, at : at + 5] = rng.integers(0, 1 << 16, len(x[i, at : at + 5])) if rng.random() < 0.7 else (at * 7 + np.arange(len(x[i, at : at + 5])))
        cut = rng.integers(0, sd.LENGTH - 1)
        x[i, :cut] = -1 - i
        x[i, cut + sd.LENGTH + rng.integers(0, sd.LENGTH - cut) :] = -1 - i
    return x


def test_large_groups_find_what_all_pairs_find():
    """Coverage and classes of a group that is solved by hashes, pivots and rare tokens are those of comparing all pairs."""
    rng = np.random.default_rng(8)
    for rate in (0.0, 0.01, 0.03, 0.06):
        x = family(rng, 400, rate)
        doc, many = rng.integers(0, 300, 400), np.zeros(400, dtype=bool)
        pairs, group = sd.Matcher(x, doc, many), sd.Matcher(x, doc, many)
        pairs.small(np.array([0]), np.array([400]))
        group.large(np.arange(400))
        both = (group.hi > 0) & (pairs.hi > 0)
        assert both.sum() >= 0.99 * (pairs.hi > 0).sum() > 0 and not ((group.hi > 0) & (pairs.hi == 0)).any()
        assert (np.maximum(group.lo, pairs.lo)[both] - np.minimum(group.lo, pairs.lo)[both]).mean() < 0.5
        assert len(set(zip(group.label[both].tolist(), pairs.label[both].tolist(), strict=True))) <= len(set(pairs.label[both].tolist())) + 2


def test_keys_in_blocks(spark, monkeypatch):
    """A common line in all texts, passages and near copies: windows of a key dealt in blocks of 16 give the same passages."""
    rng = random.Random(12)
    line, passage = text(rng, 30, "l"), text(rng, 70, "p")
    rows = [(i, " ".join(text(rng, 40, f"a{i}x") + line + text(rng, 40, f"b{i}x"))) for i in range(80)]
    rows += [(100 + i, " ".join(text(rng, 40, f"c{i}x") + edited(rng, passage, "changed", 0.01) + text(rng, 20, f"d{i}x"))) for i in range(60)]
    mixed = line + text(rng, 25, "m")
    rows += [(200, " ".join(text(rng, 50, "e") + mixed)), (201, " ".join(mixed + text(rng, 50, "f")))]
    whole = spans(spark, rows)
    monkeypatch.setattr(sd, "BLOCK", 16)
    blocks = spans(spark, rows)
    assert {200, 201} < set(whole) and not set(range(80)) & set(whole) and len(whole) >= 61
    assert {k: [v[2] for v in x] for k, x in blocks.items()} == {k: [v[2] for v in x] for k, x in whole.items()}
    size = lambda got: sum(v[3] for x in got.values() for v in x)
    assert size(blocks) >= 0.99 * size(whole)


def test_a_phrase_repeated_many_times(spark):
    """Texts of one repeated phrase have few different windows; all their places are reported."""
    rng = random.Random(13)
    rows = [(i, " ".join(text(rng, 30 + i, f"a{i}x") + ["la", "lo"] * (200 + i) + text(rng, 30, f"b{i}x"))) for i in range(6)] + [(9, " ".join(["da", "di", "do"] * 300))]
    got = spans(spark, rows)
    assert got == {i: [(30 + i, 430 + 3 * i, 0, 400 + 2 * i)] for i in range(6)}
    tokens = sd.Shingler().shingles(rows[0][1])
    parts = sd.windows(tokens, np.zeros(len(tokens), dtype=np.int64))
    owner, root, first, last = (np.concatenate([p[k] for p in parts]) for k in range(4))
    key = np.concatenate([sd.hashed(tokens[p[1]], f) for f, p in enumerate(parts)])
    one, other, of = sd.once(tokens, owner, key, root, first, last)
    assert len(one) < 60 and len(one) + len(other) == len(root)
    for i, j in zip(other, one[of], strict=True):
        assert key[i] == key[j] and (tokens[first[i] : last[i] + sd.LENGTH] == tokens[first[j] : last[j] + sd.LENGTH]).all()


def test_names_of_other_columns(spark):
    rng = random.Random(14)
    passage = " ".join(text(rng, 60, "p"))
    df = spark.createDataFrame([(1, passage, 5, 5, "x"), (2, passage + " and more", 6, 6, "y"), (2, passage + " and more", 6, 6, "y")], "doc_id int, text string, lo int, KEY int, rep string")
    assert sorted(tuple(r) for r in sd.repeated_passages(df).collect()) == [(1, 0, 60, 60, 1), (2, 0, 60, 60, 1)]
