"""Writers: appended JSON lines, snapshots that are published whole (``commits``), partitioned exports, validated edges and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.sources.commits import current, digest, publish

__all__ = ["append_json", "checked_edges", "current", "digest", "export", "publish", "save_index", "save_plan", "topic_links", "updated"]


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_index(vectors: DataFrame, path: str, name: str, model: str) -> DataFrame:
    """Publishes vectors (id, vector) as an index and its row of configuration (name, n, dim, model), which is returned."""
    made = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).select(F.lit(name).alias("name"), "n", "dim", F.lit(model).alias("model"))
    publish(vectors, f"{path}/{name}")
    made.coalesce(1).write.mode("overwrite").json(f"{path}/{name}-config")
    return made


def save_plan(items: DataFrame, path: str, week: str, target: str, seed: int) -> None:
    """One JSON object for a week's plan: its items (place, id) in order, its target and seed. A plan is small by its quotas."""
    row = items.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("items"))
    row.select(F.lit(week).alias("week"), F.lit(target).alias("target"), F.lit(seed).alias("seed"), "items").coalesce(1).write.mode("overwrite").json(path)


def export(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet in a folder per value, each value written by as many tasks as its rows need."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def topic_links(rows: DataFrame, key: str, topics: str) -> DataFrame:
    """(key, topic, place): every topic of a row in order, the first being where it lives."""
    return rows.select(key, F.posexplode(topics).alias("place", "topic")).select(key, "topic", "place")


def checked_edges(edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad with a reason) of (src, dst, confidence, evidence): no loops, a known dst, confidence 0 to 1, some evidence."""
    ids = known.select(F.col(known.columns[0]).alias("dst")).distinct().withColumn("_known", F.lit(True))
    c = F.col("confidence")
    reason = (
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "missing end").when(F.col("src") == F.col("dst"), "loop").when(F.col("_known").isNull(), "unknown")
        .when(c.isNull() | ~c.between(0.0, 1.0), "confidence").when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "evidence")
    )
    rows = edges.join(ids, "dst", "left").withColumn("reason", reason).select(*edges.columns, "reason")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns of changes where these have a value, changes of unknown keys)."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    out = rows.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in rows.columns])
    return out, changes.join(rows.select(key), key, "left_anti")
