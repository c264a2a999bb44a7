"""Boundary rows of the library's operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import curation, learning, similarity
from sluicework.operators.components import connected_components
from sluicework.sources import files


@pytest.mark.parametrize(("mastery", "n", "want"), [(0.0, 0, "untested"), (0.39, 3, "weak"), (0.40, 3, "in progress"), (0.80, 1, "in progress"), (0.75, 2, "solid"), (0.90, 5, "solid")])
def test_status(spark, mastery, n, want):
    assert spark.range(1).select(learning.status(F.lit(mastery), F.lit(n))).first()[0] == want


def test_weighted_and_best(spark):
    rows = spark.createDataFrame([("a", 1.0, 1, dt.date(2024, 1, 1)), ("a", 0.0, 4, dt.date(2024, 1, 2))], "node string, value double, difficulty int, day date")
    r = learning.mastery(rows, "node").first()
    assert (round(r.mastery, 6), r.n, r.best, r.status) == (0.2, 2, 1, "weak")


def test_mastery_in_any_order(spark):
    """A mean of 0.4 as added doubles is 0.39999999999999997 in some orders of its rows."""
    worth = [0.3] * 6 + [0.6] * 3
    for values in (worth, worth[::-1]):
        rows = [("a", v, 1, dt.date(2024, 1, 1)) for v in values]
        r = learning.mastery(spark.createDataFrame(rows, "node string, value double, difficulty int, day date").coalesce(1), "node").first()
        assert (r.mastery, r.status) == (0.4, "in progress")

def test_mastery_in_the_order_of_events(spark):
    """With an order, doubles are added in it, whatever the partitions: 0.3 * 2 + 0.6 * 1 over 3 stays below 0.4, as in SQL."""
    rows = [(1, "a", 0.3, 2, dt.date(2024, 1, 1)), (2, "a", 0.6, 1, dt.date(2024, 1, 1))]
    rows += [(k, "b", v, d, dt.date(2024, 1, 1)) for k, (v, d) in enumerate([(0.3, 1), (0.0, 2), (1.0, 3), (0.3, 2), (0.6, 2), (0.3, 2), (0.0, 1), (0.6, 3)], 3)]
    for given in (rows, rows[::-1]):
        found = learning.mastery(spark.createDataFrame(given, "seq long, node string, value double, difficulty int, day date").repartition(3), "node", order="seq")
        got = {r.node: r for r in found.withColumn("shown", learning.rounded(F.col("mastery"))).collect()}
        assert got["a"].mastery == (0.3 * 2 + 0.6) / 3 < 0.4 and (got["a"].shown, got["a"].status) == (0.4, "weak")
        assert got["b"].mastery == 0.46874999999999994 and got["b"].shown == 0.4687
    assert [spark.range(1).select(learning.rounded(F.lit(v))).first()[0] for v in (None, 0.00005, 0.99995, 1.0)] == [None, 0.0001, 1.0, 1.0]



def test_graduated_and_due(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, "x", "independent_ok", day), (2, "x", "independent_ok", day), (3, "x", "fail", day), (4, "y", "independent_ok", day), (5, "y", "hinted_ok", day), (6, "z", "odd", day)]
    a = spark.createDataFrame(rows, "seq int, id string, result string, day date")
    assert [r.id for r in learning.graduated(a, "id").collect()] == ["x"]
    due = {r.id: r.due for r in learning.next_due(a, "id").collect()}
    assert due == {"x": dt.date(2024, 1, 3), "y": dt.date(2024, 1, 8), "z": None}
    assert [r.id for r in learning.review_queue(a, "2024-01-08", "id").collect()] == ["y"]


@pytest.mark.parametrize(("raw", "want"), [("  61st IMO — Shortlist, 2020 ", "imo shortlist"), ("Cono_Sur-Olympiad 1999", "cono sur olympiad"), ("2019", None), ("XIV", None), ("— , .", None), (None, None)])
def test_norm_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(T.norm_name(F.col("x"))).first()[0] == want


def test_sections_and_ladder(spark):
    body = "head\n## A\none\n## B\ntwo\n## A\nthree"
    r = spark.createDataFrame([(body, "1. x\n2. y\n")], "b string, h string").select(T.sections(F.col("b")), T.hint_ladder(F.col("h"))).first()
    assert r[0] == {"A": "three", "B": "two"} and r[1] == ["x", "y"]


def test_review_rules(spark):
    df = spark.createDataFrame([(2, 4, "agree", "clean", False, True), (2, 3, "agree", "clean", False, False), (2, 2, "wrong", "clean", False, True), (2, 2, "partial", "broken", False, True), (2, 2, "agree", "clean", True, True)], "e int, c int, t string, q string, f boolean, want boolean")
    assert df.where(curation.needs_review(*map(F.col, "ectqf")) != F.col("want")).count() == 0
    assert spark.range(1).select(curation.below_floor(F.lit(2), F.lit(1))).first()[0]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (None, 4), (1, 2)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    assert connected_components(edges.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    from pyspark.sql import types as S

    good, bad = files.json_lines(spark, str(tmp_path / "a.jsonl"), S.StructType([S.StructField("a", S.IntegerType())]))
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    (tmp_path / "x.md").write_text("---\nid: 1\n---\nbody\n")
    r = files.front_matter(spark, str(tmp_path)).first()
    assert r["head"] == "id: 1" and r.body == "body\n"


def test_depth_has_no_bound(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(53)] + [(0, 53), (60, 2)], "src int, dst int")
    assert {r.node: r.depth for r in similarity.depth(chain).collect()} == {60: 0} | {k: k for k in range(54)}
