"""Sources, sinks and views on small files, against plain expectations."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sluicework.operators import workflow
from sluicework.sources import files, sinks


def test_listing_and_ledgers(spark, tmp_path):
    for name, text in {"a/A-001.md": "x", "a/A-2.md": "y", "stash/A-003.md": "z", "b/N-004.md": "w", "l/one.json": '[{"id": "1", "status": "pass"}]', "l/none.json": "[]", "l/bad.json": "[{", "l/odd.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.listed(spark, str(tmp_path), "*.md", ("stash",))
    assert {r.relative for r in found.collect()} == {"a/A-001.md", "a/A-2.md", "b/N-004.md"}
    assert {r.id for r in files.ids_of(found, r"([ANCG]-\d{3})\.md").collect()} == {"A-001", "N-004"}
    rows, bad = files.ledgers(spark, str(tmp_path / "l"), "*.json", S.StructType([S.StructField("id", S.StringType()), S.StructField("status", S.StringType())]))
    assert [(r.ref.split("/")[-1], r.id, r.status) for r in rows.collect()] == [("one.json", "1", "pass")]
    assert {r.ref.split("/")[-1] for r in bad.collect()} == {"bad.json", "odd.json"}


def test_registry(spark, tmp_path):
    (tmp_path / "r.yml").write_text("algebra:\n  ineq: [AM-GM]\n  func: []\ngeometry:\n  circle:\n")
    assert {tuple(r) for r in files.registry(spark, str(tmp_path / "r.yml")).collect()} == {("algebra", "ineq", "ineq"), ("algebra", "ineq", "AM-GM"), ("algebra", "func", "func"), ("geometry", "circle", "circle")}


def test_publishing(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(5)
    assert sinks.current(spark, path) is None and sinks.publish(rows, path) and not sinks.publish(rows.repartition(2), path)
    assert len(list((tmp_path / "t").glob("version-*"))) == 1 and sinks.publish(spark.range(6), path) and sinks.current(spark, path).count() == 6
    with pytest.raises(ValueError):
        sinks.publish(rows, path, partial=True)
    vectors = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "id long, vector array<double>")
    assert tuple(sinks.save_index(vectors, str(tmp_path), "bank", "m").first()) == ("bank", 2, 2, "m") and spark.read.json(str(tmp_path / "bank-config")).first().n == 2
    sinks.save_plan(spark.createDataFrame([(2, 20), (1, 10)], "place int, id long"), str(tmp_path / "plan"), "2024-W05", "even", 7)
    assert json.loads(next((tmp_path / "plan").glob("*.json")).read_text()) == {"week": "2024-W05", "target": "even", "seed": 7, "items": [10, 20]}
    both = files.stacked(vectors, vectors.drop("vector")).collect()
    assert sorted((r.id, r.corpus, r.vector is None) for r in both) == [(1, "bank", False), (1, "cand", True), (2, "bank", False), (2, "cand", True)]


def test_probes_take_a_fetcher(spark):
    def fetch(url):
        if "down" in url:
            raise OSError
        return 404 if "gone" in url else 200

    df = spark.createDataFrame([("http://a",), ("http://a",), ("http://gone",), ("http://down",), (None,)], "u string")
    assert {tuple(r) for r in workflow.probed(df, "u", fetch).collect()} == {("http://a", 200, True), ("http://gone", 404, False), ("http://down", None, False)}


def test_reindexing_and_restoring(spark):
    index = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, s string, t string")
    fresh = spark.createDataFrame([(1, "A"), (2, None), (9, "N")], "id long, s string")
    out, lost = workflow.reindexed(index, fresh, "id")
    assert sorted(map(tuple, out.collect())) == [(1, "A", "x"), (2, "b", "y")] and [r.id for r in lost.collect()] == [9]
    kept = workflow.restored(spark.createDataFrame([(1, "new/1")], "id long, path string"), spark.createDataFrame([(1, "s"), (5, "q")], "id long, sha string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "new/1", "s"), (5, None, "q")]


def test_spans_and_html(spark):
    lines = [('{"a": 1, "b": 2}', ["a", "b"]), ('{"a": 1, "a": 2}', None), ("[1]", None), ("{", None)]
    assert [r.k for r in spark.createDataFrame(lines, "l string, w array<string>").select(F.transform(workflow.value_spans(F.col("l")), lambda s: s["key"]).alias("k")).collect()] == [w for _, w in lines]
    text = "One <b>\nline\n\n- x\n- y & z\n\n1. a\n2、 b\n\n1. alone"
    want = "<p>One &lt;b&gt;\nline</p>\n<ul><li>x</li><li>y &amp; z</li></ul>\n<ol><li>a</li><li>b</li></ol>\n<p>1. alone</p>"
    got = spark.createDataFrame([(text,), ("  ",), (None,)], "t string").select(workflow.html(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [want, "", ""]


def test_forms_and_sessions(spark):
    sessions = spark.createDataFrame([("a", "open", 2, False, 100), ("b", "finished", 0, True, 0), ("c", "open", 0, True, 50)], "sid string, status string, hints int, revealed boolean, started_at long")
    forms = [("a", "2:false", 150, 200), ("a", "1:false", 150, 200), ("a", "2:false", 50, 200), ("a", "2:false", 250, 200), ("b", "0:true", None, 200), ("x", "0:true", None, 200), ("c", "0:true", None, 60)]
    got = workflow.accepted(spark.createDataFrame(forms, "sid string, token string, stopped_at long, now long"), sessions).collect()
    want = {("a", "2:false", 150): (None, 150), ("a", "1:false", 150): ("form is stale", None), ("a", "2:false", 50): (None, 200), ("a", "2:false", 250): (None, 200), ("b", "0:true", None): ("session is closed", None), ("x", "0:true", None): ("unknown session", None), ("c", "0:true", None): (None, 60)}
    assert {(r.sid, r.token, r.stopped_at): (r.error, r.ended_at) for r in got} == want
    gone = workflow.abandoned(sessions, spark.createDataFrame([("a",), ("b",), ("a",)], "sid string"))
    assert {r.sid: r.status for r in gone.collect()} == {"a": "abandoned", "b": "finished", "c": "open"}


def test_logs_and_ledgers(spark, tmp_path):
    good, bad = workflow.logged(spark.createDataFrame([(1, "ok"), (2, "ok"), (1, "what")], "id long, result string"), spark.createDataFrame([(1,)], "id long"), {"ok": "independent_ok", "hard": "hinted_ok"})
    assert [tuple(r) for r in good.collect()] == [(1, "ok", "independent_ok")] and sorted(map(tuple, bad.collect())) == [(1, "what"), (2, "ok")]
    rows = [("b", "pass"), ("a", "pass")]
    assert workflow.write_ledger(spark.createDataFrame(rows, "id string, status string"), str(tmp_path / "l")) == 2 and [r.id for r in spark.read.json(str(tmp_path / "l")).collect()] == ["a", "b"]
    for other in ([("a", "fail")], [("a", None)], []):
        with pytest.raises(ValueError):
            workflow.write_ledger(spark.createDataFrame(other, "id string, status string"), str(tmp_path / "m"))
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        workflow.guard_folder(spark, str(tmp_path / "own"))
    workflow.guard_folder(spark, str(tmp_path / "nowhere"))
    sinks.publish(spark.range(2), str(tmp_path / "mine"))
    workflow.guard_folder(spark, str(tmp_path / "mine"))


def test_runs():
    waits, calls = [], []

    def call(job):
        calls.append(job)
        if job == "stop":
            raise KeyboardInterrupt
        if job == "bad" or (job == "late" and calls.count("late") < 3):
            raise RuntimeError("down")
        return job.upper()

    got = workflow.dispatched(["a", "late", "bad", "known"], call, known={"known": 1}, sleep=waits.append)
    assert got == [("a", "done", "A"), ("late", "done", "LATE"), ("bad", "failed", "down"), ("known", "reused", 1)] and waits == [1.0, 2.0, 1.0, 2.0]
    assert workflow.dispatched(["bad", "a"], call, tries=1, strict=True) == [("bad", "failed", "down"), ("a", "skipped", None)]
    assert workflow.dispatched(["stop", "a"], call) == [("stop", "interrupted", None), ("a", "skipped", None)]


def test_directory_of_translations(spark):
    from sluicework.operators import translation

    source = "# T\n## Statement\nTrouver les nombres $x$.\n"
    sources = spark.createDataFrame([("a", source), ("b", source), ("c", source)], "path string, text string")
    targets = spark.createDataFrame([("a", "# T\n## Statement\nFind all the numbers $x$.\n"), ("b", "# T\n## Statement\nTrouver tous les nombres $y$.\n"), ("z", "")], "path string, text string")
    pairs = workflow.paired(sources, targets)
    found = translation.verified(pairs, "path", "en")
    assert sorted(map(tuple, found.collect())) == [("b", "math_mismatch", "Statement"), ("b", "target_language", "Statement"), ("c", "missing_file", "文档"), ("z", "extra_file", "文档")]
    assert {r["item"]: r.n for r in translation.report(found, pairs, "path").collect()} == {"total": 4, "passed": 1, "failed": 3, "math_mismatch": 1, "target_language": 1, "missing_file": 1, "extra_file": 1}
    states = spark.createDataFrame([("a", [("en", "translated", "s"), ("zh", "failed", None)])], "id string, variants array<struct<lang:string,mode:string,sha:string>>")
    inputs = workflow.batch_inputs(states, sources.withColumnRenamed("path", "id"), targets.select(F.col("path").alias("id"), F.lit("en").alias("lang"), "text"))
    got = workflow.verified_by_language(inputs, ["en", "zh"], lambda df, lang: df.select("id", F.lit(lang == "en").alias("ok"))).collect()
    assert [tuple(r) for r in got] == [("a", True, "en")]
