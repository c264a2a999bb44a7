"""Mixing sources to target weights by systematic sampling.

Within each source every document expects ``target / source_size`` copies. Their prefix sums, shifted by one
random offset, cross integer boundaries; a document is emitted once for each boundary that its own share
crosses. Documents are laid out by size within a source, so neighbours stand in for each other and the taken
words stay within about one document of the target.

Prefix sums come from one range sort: a document's place in its source is its position in its sort partition
plus the counts of the source in earlier partitions. No task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed-point bits of a rate and of an offset; sums stay whole numbers up to 2^38 documents a source.
BITS = 24


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), by_name: dict | None = None) -> DataFrame:
    """(source, source_size, target) for (source, source_size): one row a source.

    Sources take ``share`` of all sizes by weight: ``weights`` repeat over the sources in code-point order, null
    last, unless ``by_name`` names a source's own. No target is above ``cap`` times its source's size: the excess
    goes to the others by weight until none is above (the level at which that settles is the largest of the
    levels seen when sources are filled in order of cap per weight). The table has one row for each source, the
    unit at which weights are set, so it is small by construction and its windows run in one task.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    for name, own in (by_name or {}).items():
        w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(own))).otherwise(w)
    filled = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    return (
        sizes.withColumn("w", w)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("most").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(filled.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.max((F.col("all") - F.col("before")) / F.col("left")).over(W.partitionBy()))
        .select("source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))
    )


def mix_sources(df: DataFrame, size: Column, source: Column, tie: Column, seed: str = "mix", **how) -> DataFrame:
    """``row`` (a struct of all of df's columns), size, source_size, target, copies: one row for each of df.

    ``size`` counts a row's words; ``tie`` orders rows of one size, so that reruns agree whatever the order of
    input (rows equal in both are interchangeable up to their other columns). Keyword arguments are those of
    targets(). A null source is a source of its own; a source without words has target 0 and no copies. An empty
    table gives an empty result. Copies of a row never exceed ``cap`` rounded up.
    """
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), size.alias("size"), source.alias("source"), tie.alias("tie"))
    laid = rows.repartitionByRange(F.col("source"), F.col("size"), F.col("tie")).sortWithinPartitions("source", "size", "tie").withColumn("at", F.monotonically_increasing_id())
    laid = written(laid.select("row", "size", "source", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "mix")
    parts = laid.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    to = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))), 1, BITS // 4), 16, 10).cast("long")
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(1 << BITS)))).otherwise(0).cast("long")
    parts = parts.select("source", "part", (ahead - F.col("first")).alias("shift"))
    parts = parts.withColumnRenamed("source", "s").join(to, F.col("s").eqNullSafe(F.col("source"))).select(F.col("s").alias("p_source"), F.col("part").alias("p_part"), "shift", "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    k = F.col("place") + F.col("shift")
    crossed = F.shiftright((k + 1) * F.col("rate") + F.col("offset"), BITS) - F.shiftright(k * F.col("rate") + F.col("offset"), BITS)
    return laid.join(parts, (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source"))).select("row", "size", "source_size", "target", crossed.alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, size, source_size, target, taken for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(docs, F.col("size"), F.col("source"), F.col("doc_id"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
             source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w
      WINDOW o AS (ORDER BY most / w, source IS NULL, source)),
t AS (SELECT source, source_size, least(most, max(lv) OVER () * w) AS target,
             ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 6))::BIGINT AS off FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216.0::DOUBLE)::BIGINT ELSE 0 END AS rate FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target,
       (((k.k + 1) * r.rate + r.off) // 16777216 - (k.k * r.rate + r.off) // 16777216) * k.size AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""
