"""Threshold joins of vectors and texts, and groups with evidence, against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from sluicework.operators import text_join, vector_join

PAIR = "a long, b long, score_text double, score_solution double"


def _plain(ids, x, t):
    u = [(i, np.array(v, float)) for i, v in zip(ids, x, strict=True) if v is not None and None not in v and len(v) == 6 and np.isfinite(v).all() and np.any(v)]
    return {(a, b) for k, (a, p) in enumerate(u) for b, q in u[k + 1 :] if p @ q / np.linalg.norm(p) / np.linalg.norm(q) > t}


@pytest.mark.parametrize("threshold", [0.0, 0.95])
def test_threshold_join(spark, monkeypatch, threshold):
    for name, value in (("BLOCK", 16), ("TOGETHER", 2), ("SPREAD", 30)):
        monkeypatch.setattr(vector_join, name, value)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(9, 6))[rng.integers(0, 9, 400)] * 2 + rng.normal(size=(400, 6)) * 0.1).tolist()
    x[5:25] = [x[4]] * 20
    x += [None, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6]
    rows = list(enumerate(x))
    got, stats = vector_join.threshold_join(spark.createDataFrame([*rows, (None, x[0])], "id long, vector array<double>").repartition(5), threshold)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(_plain([k for k, _ in rows], x, threshold))
    s = stats.first()
    assert s.multiplied <= s.met <= s.blocks * (s.blocks + 1) // 2
    if threshold == 0.95:
        assert s.multiplied < 0.25 * s.blocks * (s.blocks + 1) / 2  # most pairs of blocks are passed over


def test_threshold_join_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    got, stats = vector_join.threshold_join(empty, 0.5)
    assert got.collect() == [] and tuple(stats.first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        vector_join.threshold_join(empty, 1.5)
    with pytest.raises(ValueError):
        vector_join.route_pairs(empty, -0.1, {"vector": "s"})


def test_routes_and_masks(spark):
    e, f = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, e, e), (2, e, f), (3, None, e), (4, f, None), (5, None, None)]
    got = vector_join.route_pairs(spark.createDataFrame(rows, "id long, text array<double>, solution array<double>"), 0.9, {"text": "score_text", "solution": "score_solution"})
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1.0, 0.0), (1, 3, None, 1.0)]


def _sent(spark, monkeypatch, join, n):
    """Rows that reach the tasks of a join's last step, for n blocks' worth of vectors."""
    seen = []
    frame = type(spark.range(1))
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (seen.append(self), deal(self, *a))[1])
    join(n).count()
    monkeypatch.undo()
    return seen[-1].count()


def test_blocks_are_sent_in_proportion(spark, monkeypatch):
    """Four times the vectors, in no clusters: four times the blocks sent, not sixteen times; and the same closure of links as of pairs."""
    from sluicework.operators import similarity
    from sluicework.operators.components import connected_components

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3200, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = lambda n: spark.createDataFrame(list(enumerate(x[:n].tolist())), "id long, vector array<double>").repartition(2)

    def cosine(n):
        monkeypatch.setattr(similarity, "BINS", 4)
        return similarity.cosine_pairs(df(n), 0.999, block=16)

    def pivot(n):
        for name, value in (("BLOCK", 16), ("SPREAD", 1600), ("GROUPS", 4)):
            monkeypatch.setattr(vector_join, name, value)
        return vector_join.threshold_join(df(n), 0.2)[0]

    for join in (cosine, pivot):
        assert _sent(spark, monkeypatch, join, 3200) < 6 * _sent(spark, monkeypatch, join, 800)
    few, many = similarity.cosine_pairs(df(800), 0.3, 16, links=True), similarity.cosine_pairs(df(800), 0.3, 16)
    assert few.count() < many.count() / 2
    assert set(connected_components(few, "a", "b").collect()) == set(connected_components(many, "a", "b").collect())


def test_links_stay_in_proportion_to_vectors(spark, monkeypatch):
    """Where bins are joined in themselves, two bins need one link: 600 vectors in 6 bins have few more links than vectors, with the closure of all pairs."""
    from sluicework.operators import similarity
    from sluicework.operators.components import connected_components

    monkeypatch.setattr(similarity, "BINS", 6)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3)) + np.where(np.arange(600) % 2 == 0, 4, -4)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>").repartition(2)
    few, many = similarity.cosine_pairs(df, 0.95, 16, links=True), similarity.cosine_pairs(df, 0.95, 16)
    assert few.count() < 900
    assert set(connected_components(few, "a", "b").collect()) == set(connected_components(many, "a", "b").collect())


def test_links_keep_closures_and_best_scores(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=3).tolist() if k % 7 else None, rng.normal(size=4).tolist() if k % 5 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, t array<double>, s array<double>").repartition(3)
    pairs, links = (vector_join.route_pairs(df, 0.985, {"t": "score_text", "s": "score_solution"}, links=c).toDF("a", "b", "score_text", "score_solution") for c in (False, True))
    meta = spark.createDataFrame([], "id long, topics array<string>, formulas array<string>")
    groups = [sorted(map(str, vector_join.evidence_groups(p, ["score_text", "score_solution"], meta).collect())) for p in (pairs, links)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    near = lambda p, q: p is not None and q is not None and unit(p) @ unit(q) > 0.985
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if near(a[1], b[1]) or near(a[2], b[2])]
    assert groups[0] == groups[1] and len(groups[0]) > 50


def test_evidence_groups(spark):
    pairs = [(1, 2, 0.97, None), (2, 3, None, 0.99), (7, 8, 0.95, 0.94)] + [(100, k, 0.96, 0.93) for k in range(101, 103)]
    meta = [(1, ["x", "y", "x"], ["f=1", "g=2"]), (2, ["x", "z"], ["g=2"]), (3, ["x"], None), (7, ["p"], ["h"]), (8, ["q"], ["k"]), (100, None, ["h"])]
    made = spark.createDataFrame(meta, "id long, topics array<string>, formulas array<string>")
    got = vector_join.evidence_groups(spark.createDataFrame(pairs, PAIR), ["score_text", "score_solution"], made).collect()
    rows = sorted((r.group_id, r.canonical, r.member, r["size"], r.score_text, r.score_solution, r.score_formula, r.shared, r.same_topic) for r in got)
    assert rows == [*[("DG-00001", 1, m, 3, 0.97, 0.99, 1.0, 1, True) for m in (1, 2, 3)], *[("DG-00002", 7, m, 2, 0.95, 0.94, 0.0, 0, False) for m in (7, 8)], *[("DG-00003", 100, m, 3, 0.96, 0.93, 0.0, 0, False) for m in (100, 101, 102)]]
    few = vector_join.evidence_groups(spark.createDataFrame(pairs, PAIR), ["score_text", "score_solution"], made, formula_limit=2).collect()
    assert {r["size"]: r.score_formula for r in few} == {3: None, 2: 0.0}
    assert vector_join.evidence_groups(spark.createDataFrame([], PAIR), ["score_text"], made).collect() == []
    with pytest.raises(ValueError):
        vector_join.evidence_groups(spark.createDataFrame([], PAIR), ["score_text"], made, formula_limit=1)


def test_coverage(spark):
    ids = spark.createDataFrame([(k,) for k in range(13)], "id long")
    v = spark.createDataFrame([(k, [1.0], [1.0] if k % 2 else None) for k in range(12)] + [(99, [1.0], None)], "id long, text array<double>, solution array<double>")
    assert tuple(vector_join.coverage(ids, v, ["text", "solution"]).first()) == (13, 12, 12, 6, 1, 1, 92.3)


def _texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgéß漢", k=rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(n)) for n in (2, 3, 5, 8, 20, 38, 40, 90, 200, 200)]
    rows = []
    for text in base:
        rows.append(text)
        for _ in range(4):
            c = list(text)
            for _ in range(rng.randint(0, max(1, len(c) // 60))):
                at = rng.randrange(len(c))
                c[at : at + rng.randint(0, 2)] = rng.choices("abxyz", k=rng.randint(0, 2))
            rows.append("".join(c))
    return [*rows, base[5].upper(), base[6] + "\n", None, "", " ", "a", "b", "ab"]


@pytest.mark.parametrize("least", [0.99, 0.9, 0.6])
def test_similar_texts(spark, least):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a")], "id long, text string").repartition(4)
    scored, keys = text_join.similar_texts(df, least)
    norm = {}
    for k, t in enumerate(texts):
        n = "".join((t or "").lower().split())
        if n:
            norm.setdefault(n, k)
    one = sorted((k, n) for n, k in norm.items())
    want = {(a, b): r for i, (a, x) in enumerate(one) for b, y in one[i + 1 :] if (r := SequenceMatcher(None, x, y).ratio()) >= least}
    assert {(r.a, r.b): r.score for r in scored.collect()} == want and len(want) > 1
    assert {r.id: r.key for r in keys.collect()} == {k: norm[n] for k, t in enumerate(texts) if (n := "".join((t or "").lower().split()))}


def test_lexical_groups(spark):
    rows = [(1, "x" * 300 + "abc"), (2, "x" * 300 + "abd"), (3, "X" * 300 + " abc"), (4, "other"), (5, "other "), (6, "alone" * 40)]
    got = text_join.lexical_groups(spark.createDataFrame(rows, "id long, text string"), 0.99).collect()
    assert sorted((r.canonical, r.member, r["size"], r.score_lexical) for r in got) == [(1, 1, 3, 1.0), (1, 2, 3, 1.0), (1, 3, 3, 1.0), (4, 4, 2, 1.0), (4, 5, 2, 1.0)]
    assert text_join.lexical_groups(spark.createDataFrame([], "id long, text string")).collect() == []
    with pytest.raises(ValueError):
        text_join.similar_texts(spark.createDataFrame(rows, "id long, text string"), 0.3)


def _syllables(rng, n):
    return "".join(rng.choices("th an er the in on re ha es or ti st en at nd ing ed tion ly wh".split(), k=n))


@pytest.mark.parametrize("block", [7, 512])
def test_blocks_of_like_lengths(spark, monkeypatch, block):
    """Texts of one language share most grams: hardly any but near copies are compared, and none of these is lost."""
    rng = random.Random(11)
    texts = [_syllables(rng, rng.choice([30, 60, 160, 300])) for _ in range(90)]
    for k in range(0, 90, 3):
        c = list(texts[k])
        for _ in range(rng.randint(1, max(1, len(c) // 14))):
            at = rng.randrange(len(c))
            c[at : at + rng.randint(0, 2)] = rng.choices("aeiouxyz", k=rng.randint(0, 2))
        texts.append("".join(c))
    texts = list(dict.fromkeys(texts))
    want = {(a, b): r for a, x in enumerate(texts) for b, y in list(enumerate(texts))[a + 1 :] if 2 * min(len(x), len(y)) >= 0.9 * (len(x) + len(y)) and (r := SequenceMatcher(None, x, y).ratio()) >= 0.9}
    asked = []
    monkeypatch.setattr(text_join, "SequenceMatcher", lambda none, x, y: asked.append((x, y)) or SequenceMatcher(none, x, y))
    monkeypatch.setattr(text_join, "TOGETHER", 0)
    rows = pa.RecordBatch.from_pylist([{"cell": 1, "home": True, "own": True, "key": k, "text": t} for k, t in enumerate(texts)])
    found = {(r["a"], r["b"]): r["score"] for b in text_join._blocks_scored(0.9)(iter([rows])) for r in b.to_pylist()}
    assert found == want and len(want) > 10 and len(asked) < 60
    monkeypatch.undo()
    monkeypatch.setattr(text_join, "BLOCK", block)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    assert {(r.a, r.b): r.score for r in text_join.similar_texts(df, 0.9)[0].collect()} == want


def test_common_characters():
    assert [text_join.common_characters(x, y) for x, y in (("", "a"), ("abcde", "xaxcxe"), ("aab", "aba"), ("漢a", "a漢"))] == [0, 3, 2, 1]


def test_texts_are_dealt_to_many_tasks(spark, monkeypatch):
    """The texts that are marked, and the pairs that are compared, are dealt to tasks whatever their bytes."""
    dealt = {}
    monkeypatch.setattr(text_join, "written", lambda df, tag, f=text_join.written: dealt.update({tag: df.rdd.getNumPartitions()}) or f(df, tag))
    text_join.similar_texts(spark.createDataFrame([(k, "x" * 200 + "abc"[k]) for k in range(3)], "id long, text string"))
    assert min(dealt["text-ones"], dealt["text-scores"]) >= text_join.LEAST_TASKS


def test_blocks_look_up_grams():
    """Texts of few syllables, so of like counts: those that share too few grams near their places are not gone through, and no near one is lost."""
    rng = random.Random(5)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    texts = ["".join(rng.choices(syllables, k=150)) for _ in range(60)]
    for k in range(20):
        t = list(texts[k])
        for _ in range(rng.randint(0, 45)):
            t[rng.randrange(len(t))] = rng.choice("aeiou")
        texts.append("".join(t[rng.randint(0, 9) :]))
    texts += ["ab" * 150, "ab" * 149 + "b"]  # grams that repeat
    block = text_join._Block(0.9)
    block.filled(list(range(len(texts))), texts)
    got = {(k, j) for j, t in enumerate(texts[:80]) for k in block.near(t)}
    assert got == {(k, j) for j, t in enumerate(texts[:80]) for k, x in enumerate(texts) if 2 * text_join.common_characters(x, t) >= 0.9 * (len(x) + len(t)) - 1e-6}
    assert len(got) > 80 and block.q == 5 and not block.depth  # beginnings were not gone through for the whole block
    assert (80, 81) in {(k, 81) for k in block.near(texts[81])}
