"""Collocations, language model and whitening against plain versions, on odd tables and with small blocks and buckets."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.llm import collocations, language_model, ngrams, registry, whitening

SCHEMA = "doc_id long, text string, lang string, id string, ids string, score string"


def _docs():
    rng = random.Random(11)
    words = ["the", "of", "New", "York", "é", "漢字", "a", "b", "c.d", "x;y", "😀"] + [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "fr", None])) for k in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "new york " * 3000, "en"), (203, "a a a\ta\x0ba\x1fa\r\nb", "fr"), (204, "...", "de"), (205, "x" * 5000, "de"), (None, "new york city", "en"), (206, "a", "und")]
    rows += [rows[3], rows[3], rows[130 - 8]]
    return [(*r, "i", "j", "k") for r in rows]


DOCS = _docs()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def docs(spark, monkeypatch):
    """Documents, to be counted in small blocks and buckets."""
    for name, value in (("TOKENS", 256), ("UNIT", 16), ("WORDS", 40), ("KEYS", 512), ("STRIDE", 4), ("SAMPLED", 2)):
        monkeypatch.setattr(ngrams, name, value)
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def _plain_phrases(least=10, top=2000):
    f, n = {}, Counter()
    for _, text, lang, *_ in DOCS:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in c.items():
            if any(100 * b >= 50 * a for q, b in c.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, lf, rt, n[lang], -s) for k, (s, a, p, lf, rt) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_collocations(docs):
    got = collocations.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _plain_phrases()


def test_collocations_sql(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["op11_collocations"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(c.execute(collocations.SQL).fetchall()) == got == _plain_phrases()


def test_score_is_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**13 + 7, 4 * 10**13 + 1, 5 * 10**13 + 3
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")).first()
    assert row[0] == 1000000 * a * a // (left * right)


def test_longer_phrases(spark):
    rows = [(1, "a b c d e. " * 12, "en"), (2, "a b c. " * 30, "en")]
    got = {r["phrase"]: r["a"] for r in collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), longest=5, top=2).collect()}
    assert got == {"a b c d e": 12, "a b c": 42}  # the second occurs more than twice as often as the first, its own parts don't


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def _plain_scores(order):
    texts = [(i, _held(i), re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]) for i, t, *_ in DOCS]
    count = Counter()
    for _, held, w in texts:
        if not held:
            p = [None, *w]
            count.update((x,) for x in w)
            count.update((m, *p[i - m + 1 : i + 1]) for m in range(2, order + 1) for i in range(1, len(p)) if i - m + 1 >= 0)
    grams = [{k[1:]: v for k, v in count.items() if k[0] == m and len(k) == m + 1} for m in range(order + 1)]
    grams[1] = {k: v for k, v in count.items() if len(k) == 1}
    total, distinct = sum(grams[1].values()), len(grams[1])
    discounts, follow = {}, {}
    for m in range(2, order + 1):
        once, twice = (sum(v == c for v in grams[m].values()) for c in (1, 2))
        discounts[m] = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
        follow[m] = Counter(k[:-1] for k in grams[m])

    def p(history, w):
        if not history:
            return (grams[1].get((w,), 0) + 1) / (total + distinct + 1)
        m, c = len(history) + 1, grams[len(history)].get(history, 0)
        low = p(history[1:], w)
        return low if not c else max(grams[m].get((*history, w), 0) - discounts[m], 0) / c + discounts[m] * follow[m][history] / c * low

    out = []
    for i, held, w in texts:
        path = [None, *w]
        score = sum(math.log10(p(tuple(path[max(0, k - order + 1) : k]), path[k])) for k in range(1, len(path)))
        base = sum(math.log10((grams[1].get((x,), 0) + 1) / (total + distinct + 1)) for x in w)
        out.append((i, held, len(w), sum((x,) in grams[1] for x in w), total, base, score))
    assert not grams[1] or abs(sum(p((None,), w) for (w,) in grams[1]) + p((None,), "unseen") - 1) < 1e-9
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, order):
    got = language_model.scored(docs, lambda i: F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(7)) == 2, order=order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(_plain_scores(order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_language_model_in_one_block(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).coalesce(1)
    got = language_model.scored(df, lambda i: F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(7)) == 2, order=4).collect()
    np.testing.assert_allclose(sorted(r.score for r in got), sorted(r[6] for r in _plain_scores(4)), rtol=1e-9)


def test_language_model_of_nothing(spark):
    none = language_model.scored(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), lambda i: i > 0).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).collect() == []
    assert language_model.scored(empty, lambda i: i > 0).collect() == []
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_radix_order():
    rng = np.random.default_rng(3)
    for high in (3, 1 << 20, 1 << 40):
        columns = [rng.integers(0, high, 5000).astype(np.uint64) for _ in range(3)]
        assert (ngrams.radix_order(columns) == np.lexsort(columns[::-1])).all()
    assert (ngrams.unpack(ngrams.pack(np.array([0, 7, 1 << 33]))) == [0, 7, 1 << 33]).all()


def _coded(n, rng):
    """A block of n tokens in units of 50, of which the first two are read before the unit's own, and every seventh unit is held out."""
    tokens = np.minimum(rng.zipf(1.4, n), 5000).astype(np.int32)
    tokens[rng.random(n) < 0.02] = 0
    tokens[50::51] = 0
    _, tokens = np.unique(np.append(tokens, 0), return_inverse=True)
    tokens, place = tokens[:n].astype(np.int32), np.arange(n)
    weight = ((place % 51 >= 2) & (place // 51 % 7 > 0)).astype(np.uint8)
    ids, units = np.append(0, np.arange(tokens.max()) * 3 + 5).astype(np.uint64), np.full(n // 51, 50)
    return ngrams.Coded(1, None, ids, np.bincount(tokens), 0, tokens, weight, units, units * 0 + 2, np.arange(len(units)), np.arange(len(units)) % 7 == 0, list(range(len(units))), np.bincount(tokens)[tokens], [])


@pytest.mark.parametrize(("order", "shortest"), [(1, 1), (2, 1), (3, 1), (3, 2), (4, 2), (4, 1)])
def test_keys_of_a_block(order, shortest):
    for n in (0, 1, 51 * 80):
        b = _coded(n, np.random.default_rng(n)) if n else ngrams.Coded(1, None, np.zeros(1, np.uint64), np.zeros(1, np.int64), 0, np.zeros(0, np.int32), np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 4, [], np.zeros(0, np.int64), [])
        columns, length, counts, index = b.keys(order, shortest)
        want, at = Counter(), {}
        for m in range(shortest, order + 1):
            for i in range(m - 1, n):
                gram = b.tokens[i - m + 1 : i + 1].tolist()
                if all(gram):
                    at[m, i] = (*gram, *[0] * (order - m))
                    want[at[m, i]] += int(b.weight[i]) if m > 1 else 0
        keys = list(zip(*(c.tolist() for c in columns), strict=True))
        assert keys == sorted(want) and counts.tolist() == [want[k] for k in keys] and length.tolist() == [sum(x > 0 for x in k) for k in keys]
        assert {(m, i): keys[k] for m, own in index.items() for i, k in enumerate(own.tolist()) if k >= 0} == at
        splitters = np.array([[int(b.ids[x]) for x in k] for k in keys[5::97]] + [[4] * order, [10**9] * order], np.uint64)
        as_ids = [tuple(int(b.ids[x]) for x in k) for k in keys]
        assert ngrams._cut(columns, b.ids, splitters).tolist() == [0, *[sum(k < tuple(s) for k in as_ids) for s in splitters.tolist()], len(keys)]


def test_memory_of_a_block():
    """Bytes a token that a block takes at most; where keys of all lengths were put in order at once these were 189 and 189."""
    n = 51 * 6000
    b = _coded(n, np.random.default_rng(1))
    for work, most in ((lambda: b.keys(3, 1), 80), (lambda: language_model.Automaton(b, 3, n, 5000, [0.5, 0.5], {}), 100)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * n, peak / n


def _plain_whitened(rows, k=4):
    """{id: (deviation, whitened)}, eigenvalues, trace of the vectors of one length; by the covariance matrix of centred vectors."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True)), np.array([(n * c - s) / n for c, s in zip(own, sums, strict=True)]) @ v / np.sqrt(e)) for i, own in x.items()}
    return n, out, e, np.trace(centred.T @ centred / n)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    vectors[40:80] = vectors[0]
    other = rng.normal(size=(60, 3)) * 1e6
    good = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows = [*good, *[(1000 + k, v.tolist()) for k, v in enumerate(other)], (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, []), (5, vectors[5].tolist())]
    got = whitening.whitened(spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(40)).collect()
    assert len(got) == 301 * 4 + 60 * 3
    for own, dim in ((good, 4), ([(1000 + k, v.tolist()) for k, v in enumerate(other)], 3)):
        n, want, e, trace = _plain_whitened(own, dim)
        mine = [r for r in got if r.id in want]
        assert {r.n for r in mine} == {n} and len({r.identity_error for r in mine}) == 1 and mine[0].identity_error < 1e-9
        sign = {}
        for r in mine:
            assert int(r.deviation) == want[r.id][0]
            w = want[r.id][1][r.component - 1]
            s = sign.setdefault(r.component, np.sign(w) * np.sign(r.whitened))
            assert abs(r.whitened - s * w) < 1e-8 and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9


def test_whitening_without_differences(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whitened(spark.createDataFrame([(k, [float(k), 5.0, 0.0]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and max(r.identity_error for r in line) < 1e-9
    big = whitening.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(big) == 4 and all(r.whitened is not None for r in big if r.component == 1)
