"""Boundary rows of text quality, session state, writers and graphs."""

import re

import pytest
from pyspark.sql import functions as F

from sluicework.operators import curation, quality, similarity
from sluicework.sources import sinks
from sluicework.streaming import sessions


@pytest.mark.parametrize(
    ("text", "said", "want"),
    [
        ("Find all positive integers n such that the sum is even.", None, ("en", "high")), ("Find $x$.", None, ("en", "high")), ("", None, ("und", "low")), (None, "fr", ("und", "low")),
        ("Montrer que les nombres entiers sont dans un ensemble pour tous", None, ("fr", "high")), ("Найдите все целые числа", None, ("und", "low")), ("Найдите все пары целых чисел", None, ("ru", "high")), ("Најди ги сите цели броеви, ќе", None, ("mk", "high")), ("бүх бүхэл тоо ол", None, ("mn", "high")), ("日本語のひらがな", None, ("und", "low")), ("漢字漢字漢字", None, ("und", "low")), ("证明所有正整数满足方程", None, ("zh", "high")),
        ("Find all positive integers n such that the sum is even.", "de", ("de", "low")), ("Find all positive integers n such that the sum is even.", "en", ("en", "high")),
        ("xyzzy qwerty plugh frobnicate", "fr", ("fr", "low")), ("xyzzy qwerty plugh frobnicate", "en", ("und", "low")), ("αβγ δεζη και", None, ("el", "high")),
    ],
)
def test_language(spark, text, said, want):
    df = spark.createDataFrame([(text, said)], "t string, said string")
    r = quality.detect_language(df, "t", "said").first()
    assert (r["lang"], r["conf"]) == want


def test_scores_of_long_texts(spark):
    """Against a plain count; a language's part of the plan goes through no text's words again."""
    texts = ["the " * 9 + "such that such thatthe der die der der der für alle fur alle ñ¿¡ äÖß ĳ zodat zodat le la", "", None, "les les el La LA la", "of " * 4000 + "und " * 2 + "tal que tal que"]
    df = quality.language_scores(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t")
    for r in df.select("k", "_scores", "_words").collect():
        text = texts[r.k] or ""
        fold = quality.folded_plain(text)
        assert r._words == re.findall(r"[^\W\d_]+", fold)
        for s in r._scores:
            words = [w for w in quality.WORDS[s.lang].split() if w in r._words]
            want = sum(min(3, r._words.count(w)) for w in words) + 2 * sum(fold.count(quality.folded_plain(p)) for p in quality.PHRASES[s.lang]) + 2 * sum(text.lower().count(c) for c in quality.CHARS.get(s.lang, ""))
            assert (s.score, s.distinct) == (want, len(words)), (r.k, s)
    plan = df.select("_scores")._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(_known#" in plan and "aggregate(array_distinct(filter(_words#" not in plan


SOURCE = "# T\n## A\nlet $x$ be\n## 最终答案\n$7$\n"


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("# T\n## A\nsoit $x$ un\n## 最终答案\n$7$\n", set()), ("", {("empty_translation", "文档")}), (None, {("empty_translation", "文档")}), (SOURCE, {("untranslated", "A")}),
        ("# T\n## A\nsoit $y$ un\n## 最终答案\n$7$\n", {("math_mismatch", "A")}), ("# U\n## A\nsoit $x$ un\n## 最终答案\n$8$\n", {("structure_mismatch", "H1"), ("math_mismatch", "最终答案"), ("final_answer_mismatch", "最终答案")}),
        ("# T\n## B\nsoit $x$ un\n## 最终答案\n$7$\n", {("structure_mismatch", "H2")}), ("# T\n## A\nAs an AI, soit $x$ un\n## 最终答案\n$7$\n", {("model_meta_leak", "A")}),
    ],
)
def test_findings(spark, target, want):
    df = spark.createDataFrame([(1, SOURCE, target)], "k int, s string, t string")
    assert {(r.finding, r.section) for r in quality.translation_findings(df, "s", "t").collect()} == want


def test_protected_round_trip(spark):
    texts = ["a $x$ b ⟦0⟧ c ```\nq$\n``` ![i](u) `v`", "", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.protected("t").alias("p"))
    rows = df.select("t", "p.text", quality.restored("p.text", "p.spans").alias("back"), quality.restored(F.concat("p.text", F.lit("⟦9⟧")), "p.spans").alias("bad")).collect()
    assert [r.back for r in rows] == [t or "" for t in texts] and all(r.bad is None for r in rows) and "$" not in rows[0].text


def test_protected_spans_bounds_its_batches(spark):
    from sluicework.plans import catalog, quality  # noqa: F401
    from sluicework.session import BATCH

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    catalog.QUERIES["protected_spans"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == str(BATCH)


@pytest.mark.parametrize("name", ["edge_symmetric", "prereq_cycles", "machine_checks"])
def test_reads_a_given_table(spark, name):
    from sluicework.plans import catalog, quality, translation  # noqa: F401

    small, large = (catalog.QUERIES[name](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01"))
    assert 0 < 2 * small < large


def test_chunks_and_features(spark):
    assert quality.split_chunks("") == [] and quality.split_chunks("a\n b") == ["a b"]
    text = "\n\n".join("word " * 40 for _ in range(6))
    assert len(quality.split_chunks(text)) == 3 and " ".join(quality.split_chunks(text)) == " ".join(text.split())
    rows = {r.k: r for r in quality.encode_features(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, text)], "k int, t string"), "k", "t").collect()}
    assert rows[1].vector == rows[4].vector and abs(sum(x * x for x in rows[1].vector) - 1) < 1e-5 and not rows[2].present and set(rows[3].vector) == {0.0}


def test_lexical(spark):
    long = "abcdefghij" * 30
    texts = spark.createDataFrame([(1, long), (2, long + "x"), (3, "short"), (4, None), (5, ""), (6, "")], "id int, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6), (1, 9)], "a int, b int")
    kept, lost = quality.lexical_pairs(pairs, texts, 0.0)
    from difflib import SequenceMatcher

    got = {(r.a, r.b): r.lexical for r in kept.collect()}
    assert got == {(1, 2): SequenceMatcher(None, long, long + "x").ratio(), (1, 3): SequenceMatcher(None, long, "short").ratio(), (5, 6): 1.0}
    assert sorted(r.id for r in lost.collect()) == [4, 9]


LOG = [("a", 1, "start"), ("a", 2, "hint"), ("a", 3, "reveal"), ("a", 4, "reveal"), ("a", 5, "finish"), ("a", 6, "hint"), ("b", 1, "hint"), ("c", 1, "start"), ("c", 2, "abandon"), ("d", 3, "start"), ("d", 4, "odd"), (None, 1, "start"), ("e", None, "start")]
WANT = {("a", "finished", 1, True, 2), ("b", "none", 0, False, 1), ("c", "abandoned", 0, False, 0), ("d", "open", 0, False, 1)}


def test_fold(spark):
    log = spark.createDataFrame(LOG, "session string, seq long, event string")
    assert {tuple(r) for r in sessions.fold(log).collect()} == WANT
    assert sessions.fold(log.limit(0)).count() == 0


def test_fold_stream(spark, tmp_path):
    log = spark.createDataFrame(LOG, "session string, seq long, event string")
    log.where("seq <= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log.where("seq > 2 or seq is null").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("folded").collect():
        if r.session not in last or (r.hints + r.illegal + r.revealed, r.state != "open") >= (last[r.session].hints + last[r.session].illegal + last[r.session].revealed, last[r.session].state != "open"):
            last[r.session] = r
    assert {tuple(r) for r in last.values()} == WANT


def test_publish(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.current(spark, path) is None
    assert sinks.publish(rows, path) and not sinks.publish(rows.orderBy(F.desc("k")), path)
    assert sinks.publish(rows.where("k = 1"), path) and sinks.current(spark, path).count() == 1


def test_edges_and_updates(spark):
    edges = spark.createDataFrame([(1, 2, 0.5, "e"), (1, 1, 0.5, "e"), (1, 9, 0.5, "e"), (1, 2, 1.5, "e"), (1, 2, 0.5, " "), (None, 2, 0.5, "e"), (1, 2, None, "e")], "src int, dst int, confidence double, evidence string")
    good, bad = sinks.checked_edges(edges, spark.createDataFrame([(1,), (2,)], "id int"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["confidence", "confidence", "evidence", "loop", "missing end", "unknown"]
    out, lost = sinks.updated(spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int"), spark.createDataFrame([(1, "z"), (7, "q")], "k int, v string"), "k")
    assert {tuple(r) for r in out.collect()} == {(1, "z", 5), (2, "b", 6)} and [r.k for r in lost.collect()] == [7]


def test_cycles_and_checks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "e")], "src string, dst string")
    assert {tuple(r) for r in similarity.cycle_nodes(edges).collect()} == {("b", "cycle"), ("c", "cycle"), ("e", "loop")}
    one = spark.range(3)
    assert {tuple(r) for r in curation.checked([("n", one, F.expr("count(*) = 3")), ("null", one.limit(0), F.expr("max(id) > 1"))]).collect()} == {("n", True), ("null", False)}
    with pytest.raises(ValueError):
        curation.checked([("n", one, F.lit(True)), ("n", one, F.lit(True))])


def test_formula_overlap(spark):
    """Against plain Python over the smallest documents: extraction in order, each taking its spans, then one spelling."""
    import re

    from sluicework.plans import catalog

    def found(text):
        out, names = [], "equation|align|aligned|gather|multline|eqnarray|cases|array|split"
        for pattern in (rf"(?s)\\begin\{{(?:{names})\*?\}}(.*?)\\end\{{(?:{names})\*?\}}", r"(?s)\$\$(.*?)\$\$|\\\[(.*?)\\\]|\\\((.*?)\\\)", r"\$([^$\n]+)\$"):
            out += ["".join(x or "" for x in m.groups()) for m in re.finditer(pattern, text)]
            text = re.sub(pattern, " ", text)
        rows = [r for f in out for r in f.replace("&", "").split("\\\\")]
        for pattern, new in ((r"\\(?:left|right|bigg?|Bigg?|displaystyle|textstyle|limits|quad|qquad|,|;|:|!)(?![A-Za-z])", ""), (r"\\[dt]frac(?![A-Za-z])", r"\\frac"), (r"\\([lg])e(?![A-Za-z])", r"\\\1eq"), (r"[ \t\n\r\f\v]+", "")):
            rows = [re.sub(pattern, new, r) for r in rows]
        return {r.strip(".,;:") for r in rows if len(r.strip(".,;:")) >= 3}

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: found(" ".join([r.text, *(f for m, f in catalog._SPELT if r.doc_id % m == 0)])) for r in docs}
    want = {(a, a + 1): len(x & y) / min(len(x), len(y)) for a, x in sets.items() if (y := sets.get(a + 1)) and x}
    got = {(r.left, r.right): r.overlap for r in catalog.QUERIES["formula_overlap"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(0 < v for v in want.values())


def test_marks_are_looked_for_in_what_is_not_ascii(spark):
    """The class of all marking characters, slow for each character, meets no ASCII; scores stay, also where a mark is ASCII."""
    df = spark.createDataFrame([("¿Dónde está el niño? ÑÑ",), ("straße und äpfel",), ("plain text",), (None,)], "text string")
    scored = quality.language_scores(df, "text", words={"es": "el", "de": "und"}, phrases={})
    assert [[s.score for s in r._scores] for r in scored.collect()] == [[9, 0], [0, 5], [0, 0], [0, 0]]
    assert quality.ASCII in scored._jdf.queryExecution().optimizedPlan().toString()
    own = quality.language_scores(df, "text", words={"es": "el", "de": "und"}, phrases={}, chars={"es": "?", "de": "ß"})
    assert [[s.score for s in r._scores] for r in own.collect()] == [[3, 0], [0, 3], [0, 0], [0, 0]]


def test_scripts_behind_latin_are_still_found(spark):
    texts = ["a" * 50 + " β", "докажите что для всех натуральных чисел число", "να βρεθούν όλοι οι ακέραιοι", "abc", "— " * 3 + "let us prove that all integers", "12 34"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    got = {r.id: (r.lang, r.conf) for r in quality.detect_language(df, "text").collect()}
    assert [got[k][0] for k in range(6)] == ["und", "ru", "el", "und", "en", "und"]
