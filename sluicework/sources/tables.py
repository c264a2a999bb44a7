"""Logical tables over the Parquet inputs: problems, verdicts, attempts and assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def problems(documents: DataFrame) -> DataFrame:
    """(id, category, node, difficulty 1 to 5 by length, n_chars, text)."""
    n = F.col("n_chars")
    star = F.when(n < 200, 1).when(n < 500, 2).when(n < 1500, 3).when(n < 5000, 4).otherwise(5)
    return documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("node"), star.alias("difficulty"), "n_chars", "text")


def verdicts(labels: DataFrame) -> DataFrame:
    """(id, recommend, needs_figure, quality, toxic)."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "claim").otherwise("skip").alias("recommend"), (F.col("toxic") == 1).alias("needs_figure"), "quality", "toxic")


def attempts(events: DataFrame) -> DataFrame:
    """(seq, student, id, result, day, at) of graded attempts."""
    result = F.create_map(*[F.lit(x) for x in ("purchase", "independent_ok", "click", "hinted_ok", "view", "solution_reconstructed", "error", "fail")])
    return events.where("event_type <> 'signup'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("student"), F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long").alias("id"), result[F.col("event_type")].alias("result"), F.to_date("ts").alias("day"), F.col("ts").alias("at"))


def assessments(events: DataFrame) -> DataFrame:
    """(seq, student, id, wave, day, score) of assessments; a wave is an ISO week."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return events.where("event_type = 'signup'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("student"), F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long").alias("id"), week.alias("wave"), F.to_date("ts").alias("day"), F.least(F.col("value") / 20, F.lit(1.0)).alias("score"))
