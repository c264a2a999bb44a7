"""Curation: names, tiers, votes, verdicts, admission and numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.functions.text import key_form


def needs_review(estimate: Column, reviewed: Column, topics: Column, quality: Column, figure: Column) -> Column:
    return (F.abs(estimate - reviewed) >= 2) | (topics == "wrong") | (quality == "broken") | figure


def below_floor(estimate: Column, reviewed: Column, floor: int = 2) -> Column:
    return F.least(estimate, reviewed) < floor


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null where none does."""
    return F.coalesce(*[F.when(rule, name) for name, rule in rules])


def merged(pool: DataFrame, verdict: DataFrame, key: str = "id") -> DataFrame:
    """The pool with the verdicts' columns; rows without one stay."""
    return pool.join(verdict, key, "left")


def agreement(rows: DataFrame, estimate: str, reviewed: str) -> DataFrame:
    gap = F.abs(F.col(estimate) - F.col(reviewed))
    return rows.agg(F.count("*").alias("n"), F.count_if(gap == 0).alias("same"), F.count_if(gap == 1).alias("near"), F.count_if(gap >= 2).alias("far"), F.count_if(F.col("recommend") == "skip").alias("skipped"), F.count_if("needs_figure").alias("figures"))


def quota_numbered(rows: DataFrame, category: str, order: str, quota: int, start: DataFrame) -> DataFrame:
    """The first ``quota`` rows of each category, numbered on from ``start`` (category, last)."""
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy(category).orderBy(order))).where(F.col("turn") <= quota)
    return ranked.join(start, category, "left").withColumn("number", F.coalesce("last", F.lit(0)) + F.col("turn")).drop("last")


def vote(tags: DataFrame, item: str, category: str, ties: list[str]) -> DataFrame:
    """Per item the category with most tags; ties go to the one named first."""
    place = F.coalesce(*[F.when(F.col(category) == c, k) for k, c in enumerate(ties)], F.lit(len(ties)))
    counts = tags.groupBy(item, category).agg(F.count("*").alias("votes"))
    return counts.groupBy(item).agg(F.min_by(F.struct(category, "votes"), F.struct(-F.col("votes"), place, category)).alias("w")).select(item, f"w.{category}", "w.votes")


def resolved(tags: DataFrame, tables: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Tags with the first of several one-column tables that knows them, or unmapped."""
    out = tags
    for name, keys in tables:
        out = out.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct().withColumn(f"in_{name}", F.lit(name)), key, "left")
    return out.withColumn("kind", F.coalesce(*[F.col(f"in_{n}") for n, _ in tables], F.lit("unmapped"))).drop(*[f"in_{n}" for n, _ in tables])


def family(names: DataFrame, name: str, keys: DataFrame, key: str, least: int = 8) -> DataFrame:
    """Per name the longest key that it contains (ties: the first by code point).

    Names and keys meet by a shared word of the key, its first, so that no name is compared with every key.
    """
    words = names.select(name).distinct().withColumn("word", F.explode(F.array_distinct(F.split(name, " "))))
    known = keys.select(key).distinct().where(F.length(key) >= least).withColumn("word", F.split_part(F.col(key), F.lit(" "), F.lit(1)))
    met = words.join(known, "word").where(F.concat(F.lit(" "), name, F.lit(" ")).contains(F.concat(F.lit(" "), F.col(key), F.lit(" "))))
    return met.groupBy(name).agg(F.min_by(key, F.struct(-F.length(key), F.col(key))).alias(key))


def graded(base: Column, text: Column, rules: list[tuple[str, str, int]]) -> Column:
    """struct(est, conf): rules (pattern, kind, value) folded in order over a base grade.

    ``set`` fixes the grade and stops, ``delta`` moves it within 1 to 5 with confidence mid, ``noop`` lowers confidence.
    """
    kind = "struct<est:int,conf:string,stop:boolean>"
    state = F.struct(base.cast("int").alias("est"), F.lit("high").alias("conf"), F.lit(False).alias("stop")).cast(kind)

    def step(acc: Column, rule: tuple[str, str, int]) -> Column:
        pattern, what, value = rule
        new = {
            "set": F.struct(F.lit(value).alias("est"), F.lit("high").alias("conf"), F.lit(True).alias("stop")),
            "delta": F.struct(F.greatest(F.lit(1), F.least(F.lit(5), acc["est"] + value)).alias("est"), F.lit("mid").alias("conf"), F.lit(False).alias("stop")),
            "noop": F.struct(acc["est"].alias("est"), F.lit("low").alias("conf"), F.lit(False).alias("stop")),
        }[what].cast(kind)
        return F.when(~acc["stop"] & text.rlike(pattern), new).otherwise(acc)

    return reduce(step, rules, state)


def keyed(names: DataFrame, name: str) -> DataFrame:
    return names.withColumn("key", key_form(F.col(name)))


def topic_match(rows: DataFrame, topic: str, q: str, alias: DataFrame) -> DataFrame:
    """Rows whose topic contains q, or some name of a node that has a name containing q, whatever its case.

    ``alias`` is (node, alias, ...); the comparison runs over distinct topics, which then meet the rows by equality.
    """
    names = alias.select("node", F.col("alias").alias("name")).union(alias.select("node", "node")).distinct()
    hit = names.where(F.lower("name").contains(q.lower())).select("node").distinct()
    near = names.join(hit, "node").select("name").distinct()
    topics = rows.select(topic).distinct()
    met = topics.join(near, F.col(topic).contains(F.col("name")), "left_semi").union(topics.where(F.col(topic).contains(q))).distinct()
    return rows.join(met, topic, "left_semi")


def resolve_nodes(rows: DataFrame, category: str, topic: str, alias: DataFrame) -> DataFrame:
    """rows with the node of a topic: of its own category, else of the first other in the registry's order; null if unknown."""
    known = alias.select(F.col("alias").alias(topic), F.struct("node", "category").alias("_to"), "ord", F.col("category").alias("_c"))
    met = rows.join(known, topic, "left")
    best = F.min_by("_to", F.struct((F.col("_c") != F.col(category)).alias("far"), "ord"))
    return met.groupBy(*rows.columns).agg(best.alias("r")).select(*rows.columns, F.col("r.node").alias("node"), F.col("r.category").alias("category"))


def marked(marks: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, mark): the first of several marks, each a table of keys, that a key has."""
    rows = reduce(DataFrame.unionByName, [keys.select(key, F.lit(name).alias("mark"), F.lit(k).alias("p")) for k, (name, keys) in enumerate(marks)])
    return rows.groupBy(key).agg(F.min_by("mark", "p").alias("mark"))


def keyword_tags(rows: DataFrame, text: str, category: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows with a tag, once for each rule (category, pattern, tag) of its category that its text matches."""
    tags = F.array(*[F.when((F.col(category) == c) & F.col(text).rlike(p), tag) for c, p, tag in rules])
    return rows.withColumn("tag", F.explode(F.array_compact(tags)))


def contract_diff(want: DataFrame, got: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """Keys of either side whose values differ, a missing one being null."""
    return want.join(got, key, "full").where(~F.col(expected).eqNullSafe(F.col(actual)))


def checked(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(id, ok) of checks, each a condition on a table's aggregates; one that is null has failed. Ids must differ."""
    names = [n for n, _, _ in checks]
    if len(set(names)) < len(names):
        raise ValueError("a check's id is used twice")
    return reduce(DataFrame.unionByName, [df.agg(F.coalesce(rule, F.lit(False)).alias("ok")).select(F.lit(n).alias("id"), "ok") for n, df, rule in checks])
