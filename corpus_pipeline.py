"""The corpus pipeline: documents without toxic ones, near copies and secrets, mixed to weights and encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again for the next. All stages but the last return docs' columns.

What may be odd in docs: a null text counts as an empty one to every stage and stays null until the last, which makes it
empty; a null id or source is a value of its own; very long texts are read whole; repeated rows are scored, scanned, mixed
and encoded each for itself, and are near copies of each other, of which one stays; an empty table gives an empty one; other
columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import mixing, pieces, secrets, shingles, simhash, toxicity
from sluicework.llm.batches import free_name
from sluicework.session import written


def _columns(docs: DataFrame) -> list:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it has that column, of its texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from those of docs that are labelled and not held out.

    Without labels of both classes all scores are alike: even odds without any label, so nothing is rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*_columns(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each group whose sets of 5-word shingles are similar by 0.8 or more.

    Groups of SimHash fingerprints are compared first, then MinHash finds what these leave apart. Texts without a word are one group. Of rows that repeat the smallest id any one stays.
    """
    return simhash.one_of_each(docs, groups=shingles.near_duplicates)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kinds of these; n_chars, if docs has it, is that of the new text."""
    return _measured(secrets.redacted(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none of a source without words, twice at most of any other."""
    mixed = mixing.mix_sources(docs, mixing.word_count(F.col("text")), F.col("source"), F.col("doc_id"))
    taken = mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*_columns(docs))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids and the number of these; the text is what the ids decode to.

    Where docs has a column n_tokens or ids, the new one gets a number after its name.
    """
    found = pieces.encode(docs, keep=[c for c in docs.columns if c != "text"])
    own = [F.col("decoded").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*own, F.size("ids").cast("long").alias(free_name("n_tokens", docs.columns)), F.col("ids").alias(free_name("ids", docs.columns)))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: A trained classifier and a tokenizer can't be expressed in SQL; tests/llm/test_queries.py holds the rows of each stage and of run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
