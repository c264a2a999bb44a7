"""Readers of JSON lines, front-matter documents and key-value files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.functions.text import one_json
from sluicework.session import if_few, written


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a JSON-lines file; blank lines are skipped."""
    both = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")
    return good, parsed.where("r is null or r._bad is not null").select(F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every line of text files with its number from 1, blank lines included.

    Files are read in splits by as many tasks as Spark likes. Within a split lines keep their order; the lines of a file's
    earlier splits are counted and added, so nothing is shuffled but one row for each split. Lines end with a newline; a
    carriage return before it is no part of the line.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    at = F.monotonically_increasing_id()
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), at.alias("at"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    splits = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = written(splits.select("path", "start", (ahead - F.col("first") + 1).alias("shift")), "line-splits")
    return rows.join(if_few(splits), ["path", "start"]).select("path", (F.col("at") + F.col("shift")).alias("line"), "value")


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(path, line and the fields of each object; path, line, value, error of each line that is none) of JSON-lines files; blank lines are skipped.

    A line must be valid JSON and an object whose values fit the schema; fields that it lacks are null, others are ignored.
    """
    both = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = (
        F.when(~one_json(F.col("value")), "not JSON").when(~F.ltrim("value").startswith("{"), "not an object")
        .when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "does not fit the schema")
    )
    told = parsed.withColumn("error", error)
    good = told.where("error is null").select("path", "line", *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])
    return good, told.where("error is not null").select("path", "line", "value", "error")


def json_lines_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(path, line, fields) of JSON-lines files; a line that json_rows() refuses fails the read, and the error names its file and number."""
    good, bad = json_rows(spark, path, schema)
    told = F.raise_error(F.concat(F.col("path"), F.lit(": line "), F.col("line").cast("string"), F.lit(" is "), F.col("error")))
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return good.unionByName(bad.select("path", F.coalesce(told.cast("long"), F.col("line")).alias("line"), *fields))


def latest_by_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key in file order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("r")).select("r.*")


def front_matter(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, head, body) of Markdown files with a block between --- lines at their top; without one head is null."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n(.*)\z"
    has = F.col("value").rlike(pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.when(has, F.regexp_extract("value", pattern, 1)).alias("head"), F.when(has, F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")).alias("body"))


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def listed(spark: SparkSession, root: str, glob: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, relative, bytes) of a folder's files of a name, without those below folders of the names to skip; links to folders are not followed, and Spark passes over empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.regexp_extract("path", rf"^(?:file:)?/*\Q{base}\E/(.*)$", 1)
    pruned = F.exists(F.split("relative", "/"), lambda p: p.isin(*skip)) if skip else F.lit(False)
    return files.withColumn("relative", relative).where(~pruned).select("path", "relative", "bytes")


def ids_of(files: DataFrame, pattern: str) -> DataFrame:
    """(id): what a pattern's first group takes from names of files that match it as a whole."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.where(name.rlike(f"^(?:{pattern})$")).select(F.regexp_extract(name, f"^(?:{pattern})$", 1).alias("id")).distinct()


def ledgers(spark: SparkSession, root: str, glob: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with ref, refs that can't be read) of files that each hold one JSON array of objects. A file without rows is read and has none."""
    raw = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("ref"), "value")
    shaped = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("[")
    rows = raw.where(shaped).select("ref", F.explode(F.from_json("value", T.ArrayType(schema))).alias("r")).select("ref", "r.*")
    return rows, raw.where(~shaped).select("ref")


def stacked(bank: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Vectors of the bank and, if there are any, of candidates, with the corpus that each is of; columns that one lacks are null."""
    own = bank.withColumn("corpus", F.lit("bank"))
    return own if candidates is None else own.unionByName(candidates.withColumn("corpus", F.lit("cand")), allowMissingColumns=True)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(category, node, alias) of a YAML file of categories, their nodes and these nodes' aliases; a node is its own first alias.

    The file is a dimension of some hundred nodes; Spark reads it, so it may lie in any store, and the driver parses it.
    """
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    rows = [(c, n, a) for c, nodes in (yaml.safe_load(text) or {}).items() for n, aliases in (nodes or {}).items() for a in [n, *(aliases or [])]]
    return spark.createDataFrame(rows, "category string, node string, alias string")
