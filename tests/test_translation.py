"""Gates on translations, batches, units, ingest helpers and answer checks on small fixtures, against plain expectations."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import answers, batch_gate, contracts, ingest, planning, quality, similarity, translation


def test_english_gate(spark):
    rows = [
        ("", "fr", False), ("Not provided in the dataset.", "fr", False), ("We find the value of x.", "fr", False), ("证明 it", "en", True), ("α is an angle of the triangle", "fr", False),
        ("αβ", "en", True), ("x + y = \\sin z", "fr", False), ("Trouver les nombres", "en", True), ("une éclipse totale", "en", True), ("No solutions", "fr", False), ("Proof is omitted", "sl", False),
        ("Mojca Zupan", "sl", True), ("Mojca Zupan", "en-GB", False), ("$x$ {{ABC_0001}} ![a](b.png)", "fr", False), (None, None, False),
    ]
    df = spark.createDataFrame([(k, t, s, "old") for k, (t, s, _) in enumerate(rows)], "k int, body string, src string, lang string")
    got = translation.english_gate(df, "body", "src")
    assert got.columns == ["k", "body", "src", "lang", "prose", "mismatch"]
    assert {r.k: r.mismatch for r in got.collect()} == {k: want for k, (_, _, want) in enumerate(rows)}


@pytest.mark.parametrize(
    ("text", "letters", "wrong"),
    [
        ("求所有满足条件的正整数 x 和 y", 0, False), ("由 Cauchy 不等式得", 0, False), ("由 Cauchy and Schwarz 不等式得", 0, False), ("设 Find the value 为所求", 12, True),
        ("The answer is 所求", 11, True), ("令 Peter Paul Mary 为三人", 13, True), ("sin 与 cos 的 max", 0, False), ("答案 ответ", 0, True), ("", 0, False),
    ],
)
def test_chinese_gate(spark, text, letters, wrong):
    got = translation.chinese_gate(spark.createDataFrame([(1, text)], "k int, body string"), "body")
    assert got.columns == ["k", "body", "latin_letters", "mismatch"] and [tuple(r) for r in got.collect()] == [(1, text, letters, wrong)]


def test_chinese_gate_asks_the_document(spark):
    short, long = "求 only residue here", "求所有满足条件的正整数并证明存在无穷多个" * 5
    rows = [("求解 residual x", None), ("求解 residual x", long), (short, None), (None, None)]
    got = translation.chinese_gate(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, body string, whole string"), "body", "whole")
    assert [r.mismatch for r in got.orderBy("k").collect()] == [True, False, True, False]


def _residue(prose):
    """Letters that are left once whole name runs are taken out of the list of words."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+|[^\w\s]|[\d_]", prose)]
    han = lambda c: "㐀" <= c <= "䶿" or "一" <= c <= "鿿"
    latin = lambda w: w.isascii() and w.isalpha()
    title = lambda w: latin(w) and w[0].isupper() and not w.isupper() and w.lower() not in translation.STARTERS
    joins = lambda w: title(w) or (latin(w) and w.lower() in translation.CONNECTORS)
    counted = lambda w: len(w) if latin(w) and len(w) > 1 and w.lower() not in translation.SYMBOLS else 0
    total, k = 0, 0
    while k < len(words):
        if not joins(words[k][0]):
            total += counted(words[k][0])
            k += 1
            continue
        run, j = [], k
        while j < len(words) and (joins(words[j][0]) or not words[j][0].isalpha()):
            run += [j] if joins(words[j][0]) else []
            j += 1
        near = any(title(words[i][0]) and ((i and han(words[i - 1][0][-1])) or (i + 1 < len(words) and han(words[i + 1][0][0]))) for i in run)
        if not near or sum(title(words[i][0]) for i in run) > 2:
            total += sum(counted(words[i][0]) for i in run)
        k = j
    return total


def test_residual_letters(spark):
    rng = random.Random(6)
    parts = ["Cauchy", "Schwarz", "and", "van", "Let", "the", "求", "所有", "x", "sin", "AB", "proof", "12", "+", "柯西Cauchy", "Wang", "of"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(400)]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "k int, p string").orderBy("k").select(translation.residual_letters(F.col("p")).alias("n")).collect()]
    assert got == [_residue(t) for t in texts]


def test_translatable(spark):
    rows = [("the number", quality.ANSWER, True), ("x = \\sin y", quality.ANSWER, False), ("（数据集未提供）", "解法 1", False), ("（数据集未提供）", "题面", True), ("$x$ `a b`", "题面", False), ("证明", "题面", True)]
    df = spark.createDataFrame([(k, b, h) for k, (b, h, _) in enumerate(rows)], "k int, b string, h string")
    assert [r.ok for r in df.select("k", translation.translatable(F.col("b"), F.col("h")).alias("ok")).orderBy("k").collect()] == [w for *_, w in rows]


def test_anchors(spark):
    source = "Prove that for n = 2024 the Cauchy inequality holds for B. 求出 12 and 7."
    df = spark.createDataFrame([(0, source, "证明 2024 柯西 n B 求出 12"), (1, source, "2024 B n"), (2, source, None)], "k int, s string, t string")
    got = [r.m for r in df.select("k", translation.missing_anchors(F.col("s"), F.col("t"), "zh").alias("m")).orderBy("k").collect()]
    assert got[0] == [] and got[1] == ["12", "cauchy", "prove", "求出"] and got[2] == ["12", "2024", "B", "cauchy", "n", "prove", "求出"]


SOURCES = ["thereareinfinitelymanyprimesofthisform", "computetheareaofatrianglewithsidesgiven", "howmanywaystocolouraboardwithtwocolours", "findallpolynomialswithintegerroots"]


def _copies(spark, sources, targets, gate=translation.GATE):
    rows = [("b", "S", str(k), a, b) for k, (a, b) in enumerate(zip(sources, targets, strict=True))]
    return {int(r.key): (r.target_ratio, r.source_ratio) for r in batch_gate.boilerplate(spark.createDataFrame(rows, "batch string, section string, key string, a string, b string"), gate).collect()}


def test_boilerplate(spark):
    same = "wecompletetheproofbyasimplecalculation"
    assert set(_copies(spark, SOURCES, [same, same + "x", same, "adifferentanswerwithitsownwords"])) == {0, 1, 2}
    assert _copies(spark, [SOURCES[0]] * 3, [same] * 3) == {}  # one source, rightly translated alike
    assert _copies(spark, SOURCES[:2], [same] * 2) == {}  # too few
    assert _copies(spark, ["ab", "cd", "ef"], ["x", "x", "x"]) == {}  # too short to tell
    # Two templates of two near sources each: every item has a near peer, but the templates are far apart.
    kin = [SOURCES[0] + "a", SOURCES[0] + "b", SOURCES[1] + "a", SOURCES[1] + "b"]
    assert set(_copies(spark, kin, [same] * 4)) == {0, 1, 2, 3}
    assert _copies(spark, kin[:2] + [SOURCES[0] + "c"], [same] * 3) == {}
    assert set(_copies(spark, SOURCES, [None, "", "", ""])) == {0, 1, 2, 3}  # nothing is alike nothing
    assert _copies(spark, [], []) == {}


def test_boilerplate_of_many(spark):
    same = "wecompletetheproofbyasimplecalculation"
    gate = translation.Gate(limit=5)
    sources = [f"{SOURCES[k % 4]}{'abcdefghij'[k % 10] * 12}" for k in range(40)]
    assert set(_copies(spark, sources, [same] * 40, gate)) == set(range(40))
    assert _copies(spark, [SOURCES[0] + "ab"[k % 2] for k in range(40)], [same] * 40, gate) == {}


def test_boilerplate_of_a_large_team(spark):
    """A team beyond a block: near sources are met wherever they stand, so no item stands out and two templates of two sources each are the witness."""
    bases = [c * 20 + d * 18 for c, d in ("ap", "bq", "cr", "ds", "et", "fu")]
    found = _copies(spark, [b + x for b in bases for x in "xy"] + [bases[2] + "x"], ["wecompletetheproofbyasimplecalculation"] * 13, translation.Gate(limit=5))
    assert found.keys() == set(range(13)) and len(set(found.values())) == 1 and min(found.values())[0] == 1.0


def test_boilerplate_against_pairs(spark):
    """Batches and sections of near-copies, against a plain version over all pairs of each."""
    rng, gate, rows = random.Random(12), translation.GATE, []
    for batch in "pq":
        for section in "ST":
            bases = ["".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(3)]
            for k in range(14):
                target, source = list(rng.choice(bases)), list(rng.choice(SOURCES + bases[:1]))
                for text in (target, source):
                    for _ in range(rng.randint(0, 3)):
                        text[rng.randrange(len(text))] = rng.choice("xyz")
                rows.append((batch, section, f"{batch}{section}{k}", "".join(source), "".join(target)))
    got = {r.key: (round(r.target_ratio, 6), round(r.source_ratio, 6)) for r in batch_gate.boilerplate(spark.createDataFrame(rows, "batch string, section string, key string, a string, b string").coalesce(1)).collect()}
    ratio, want = lambda a, b: SequenceMatcher(None, a, b).ratio(), {}
    for part in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == part]
        teams = _joined(range(len(own)), lambda i, j: ratio(own[i][4], own[j][4]) >= gate.alike)  # noqa: B023
        for team in teams:
            if len(team) < gate.group or len({own[i][3] for i in team}) < 2:
                continue
            scores = {(i, j): (ratio(own[i][4], own[j][4]), ratio(own[i][3], own[j][3])) for i in team for j in team if i < j and own[i][3] != own[j][3]}
            found = {}
            for i in team:
                peers = [s for p, s in scores.items() if i in p]
                if peers:
                    t, s = max((p for p in peers if p[0] >= max(peers)[0] - gate.tolerance), key=lambda p: (p[1], p[0]))
                    found |= {i: (t, s)} if t - s >= gate.gap else {}
            if len(found) < gate.group:
                far = lambda p: p[0] - p[1] >= gate.gap
                parts = _joined(team, lambda i, j: own[i][3] == own[j][3] or (scores[i, j][0] >= gate.alike and not far(scores[i, j])))  # noqa: B023
                parts = [g for g in parts if len({own[i][3] for i in g}) >= 2]
                apart = [s for p, s in scores.items() if s[0] >= gate.alike and far(s) and any(p[0] in g and p[1] in h for g in parts for h in parts if g is not h)]
                found = dict.fromkeys(team, max(apart, key=lambda p: (p[0] - p[1], p[0]))) if apart and len(team) >= 4 else {}
            want |= {own[i][2]: (round(t, 6), round(s, 6)) for i, (t, s) in found.items()}
    assert got == want and want


def _joined(items, linked):
    groups = []
    for i in items:
        near = [g for g in groups if any(linked(j, i) for j in g)]
        groups = [g for g in groups if g not in near] + [sorted([i, *(x for g in near for x in g)])]
    return groups


def test_batch_signals(spark):
    same = "We complete the proof by a simple calculation of terms."
    rows = [("b", str(k), "S", s, same) for k, s in enumerate(SOURCES[:3])] + [("b", "9", "S", "Find the sum of 12345 and of all terms below it, with proof of the claim", "ok"), ("c", "0", "S", SOURCES[0], same)]
    found = batch_gate.batch_signals(spark.createDataFrame(rows, "batch string, key string, section string, source string, target string"), "en")
    got = {(r.batch, r.key, r.signal) for r in found.collect()}
    assert {(b, k) for b, k, s in got if s == "boilerplate"} == {("b", "0"), ("b", "1"), ("b", "2")}
    assert {("b", "9", "length"), ("b", "9", "anchors")} <= got and not {x for x in got if x[0] == "c"}
    assert {(r.batch, r.key) for r in batch_gate.blocked(found).collect()} == {("b", "0"), ("b", "1"), ("b", "2"), ("b", "9")}
    with pytest.raises(ValueError):
        translation.Gate(alike=1.5)
    with pytest.raises(ValueError):
        translation.GATE.ratio_bounds("fr")


def test_declared_languages(spark):
    text = "Prove that there are infinitely many such numbers for which the sum of all is positive."
    rows = [("English", "en", "high"), ("Spanish", "es", "low"), ("English; Español", "en", "medium"), ("español/francés", "es", "low"), ("", "en", "high"), (None, "en", "high"), ("klingon", "en", "high")]
    df = spark.createDataFrame([(k, text, d) for k, (d, *_) in enumerate(rows)], "k int, t string, d string")
    assert [(r.lang, r.conf) for r in quality.detect_language(df, "t", "d").orderBy("k").collect()] == [(a, b) for _, a, b in rows]
    many = [("pt", "Seja n um número inteiro. Determinar quanto mede o lado para todos os triângulos."), ("it", "Determinare tutti gli interi tale che la somma delle cifre sia uno dei numeri primi."), ("nl", "Bepaal alle gehele getallen waarvoor het getal niet deelbaar is door een priemgetal."), ("ro", "Determinați numerele întregi pentru care este adevărat, astfel încât să avem un număr."), ("sl", "Poišči vsa cela števila, za katera obstaja tako število, da je vsak člen naj bo pozitiven.")]
    got = quality.detect_language(spark.createDataFrame(many, "want string, t string"), "t").collect()
    assert all(r.lang == r.want for r in got), got
    clash = quality.detect_language(spark.createDataFrame([(text, "x", "y", "z")], "t string, conf string, _clean string, lang string"), "t")
    assert clash.columns == ["t", "conf", "_clean", "lang", "detected", "detected_conf"] and clash.first()[1:4] == ("x", "y", "z")


def test_modifiers_and_closure():
    assert ingest.compiled([("a", "=3"), ("b", "+1"), ("c", "-2"), ("d", "-0")]) == [("a", "set", 3), ("b", "delta", 1), ("c", "delta", -2), ("d", "noop", 0)]
    with pytest.raises(ValueError):
        ingest.compiled([("a", "up")])
    assert ingest.closure([("a", "b"), ("b", "c"), ("x", "a"), ("c", "d")]) == {"a": "d", "b": "d", "x": "a", "c": "d"}


def test_contest_names(spark):
    rows = [("  61st IMO — Shortlist, 2020 ", "imo shortlist"), ("XXV Olimpiada de Mayo/Nivel 2", "olimpiada de mayo nivel 2"), ("Cono_Sur-Olympiad 1999", "cono sur olympiad"), (None, None), ("2019", None), ("— , .", None)]
    df = spark.createDataFrame(rows, "n string, want string")
    assert all(r.got == r.want for r in df.select("want", T.norm_name(ingest.nfc("n")).alias("got")).collect())
    tiers = {"romanian master of mathematics": 5, "philippine mathematical olympiad": 3, "problems of ukrainian authors": 3, "south african mathematical olympiad third round": 3, "hmmt": 4}
    names = [("seventeenth romanian master of mathematics", None, 5, "high"), ("tenth philippine mathematical olympiad", None, 3, "high"), ("the south african mathematical olympiad third round", None, 3, "high"), ("hmmt invitational", None, 4, "mid"), ("junior tst", None, 1, "mid"), ("tst", None, 3, "mid"), ("booklet", None, 2, "low"), ("nothing", None, 2, "low"), (None, None, 2, "low"), ("tst final", "MCQ", 2, "mid"), ("hmmt", "MCQ", 2, "high")]
    mods = [("circle", "=2"), ("tst", "+1"), ("first round|junior", "-1"), ("booklet", "-0")]
    got = spark.createDataFrame([(k, n, t) for k, (n, t, *_) in enumerate(names)], "k int, n string, t string").select("k", ingest.grade(F.col("n"), F.col("t"), tiers, mods).alias("g")).orderBy("k").collect()
    assert [(r.g.est, r.g.conf) for r in got] == [(e, c) for *_, e, c in names]


def test_formulas(spark):
    text = r"so $\dfrac{1}{2} \le x$, $$a^2 + b^2$$ \(y_1 = 2\), \begin{align}p&=q\\ r &= s + t.\end{align} and \[ \left( u + v \right) \] $z$"
    assert set(spark.createDataFrame([(text,)], "t string").select(T.formulas(F.col("t"))).first()[0]) == {r"\frac{1}{2}\leqx", "a^2+b^2", "y_1=2", "p=q", "r=s+t", "(u+v)"}


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert sorted((r.x, r.n) for r in similarity.numbered(df, ["x"], "n").collect()) == [(k, k + 1) for k in range(1000)]


def test_sessions_and_plans(spark):
    assert planning.quotas({2: 3.0, 3: 2.0, 5: 0.1}, 10) == {2: 6, 3: 4, 5: 1}
    cases = [(True, None, 0, 5, 10, None), (True, True, 9, 99, 10, "solution_reconstructed"), (True, False, 0, 1, 10, "fail"), (False, None, 1, 10, 10, "independent_ok"), (False, None, 2, 1, 10, "hinted_ok"), (False, None, 0, 11, 10, "hinted_ok"), (False, None, 0, 11, None, "independent_ok")]
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k int, r boolean, t boolean, h int, m int, l int")
    assert [r.v for r in df.select("k", planning.verdict(F.col("r"), F.col("t"), F.col("h"), F.col("m"), F.col("l")).alias("v")).orderBy("k").collect()] == [c[5] for c in cases]
    paths = [("a/b/../c", True), ("a/../../b", False), ("/a", False), ("./a//b", True), ("..", False)]
    assert [r.ok for r in spark.createDataFrame(paths, "p string, w boolean").select(T.contained(F.col("p")).alias("ok")).collect()] == [w for _, w in paths]


def test_answer_checks(spark):
    def broken():
        raise RuntimeError("no")

    assert {r.status for r in answers.run(spark).collect()} == {"pass"} and len(answers.CHECKS) == 13
    got = {r.id: (r.status, r.note) for r in answers.run(spark, {"a": lambda: True, "b": lambda: False, "c": broken}).collect()}
    assert got == {"a": ("pass", None), "b": ("fail", None), "c": ("fail", "RuntimeError: no")}
    with pytest.raises(ValueError):
        answers.check("A-002")(lambda: True)


def test_rendered_header(spark):
    df = spark.createDataFrame([(["a", "b"], "Tags: x"), ([], "")], "tags array<string>, extra string")
    doc = ingest.rendered(F.lit("T"), F.lit("ok"), F.col("extra"), F.array(F.lit("s")), F.lit(None).cast("string"), F.col("tags"))
    got = df.select(doc.alias("d")).select("d", ingest.header_tags(F.col("d")).alias("t")).collect()
    assert got[0].t is None and got[1].t == [""] and "(not provided)" in got[1].d
    assert spark.range(1).select(ingest.quoted(F.lit('a "b"\n'))).first()[0] == '"a \\"b\\"\\n"'
    assert spark.range(1).select(ingest.safe_label(F.lit(' ..a/b:c*\n"d" . '))).first()[0] == "a-b-c-d-"


def test_lint_reads_null_front_matter(spark):
    rows = spark.createDataFrame([("p", "A-1.md", "A", None, "b"), ("q", "A-2.md", "A", {"id": "A-2"}, None)], "path string, file string, prefix string, fm map<string,string>, body string")
    none = spark.createDataFrame([], "ref string, id string, status string")
    got = [(r.path, r.message) for r in contracts.lint(rows, none.drop("status"), none).collect()]
    assert ("p", "front matter can't be read") in got and ("q", "missing title") in got and ("q", "difficulty is no whole number of 1 to 5") in got and not [m for p, m in got if p == "p"][1:]
