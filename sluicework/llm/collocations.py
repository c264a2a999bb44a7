"""Phrase collocation mining: counts of all phrases of 2 to ``longest`` words, and how much more often they stand together than their parts.

Words that occur often enough are numbered by a dictionary; all others break pieces, for no phrase that is frequent enough
holds one. The ids of a phrase are packed to a key of fixed width; keys are dealt by range, put in order by a radix sort
and counted as runs (``ngrams``). What is left, frequent phrases only, is scored by joins of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.llm import ngrams
from sluicework.llm.batches import handing_back
from sluicework.session import if_few, written

SPACES, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
LONGEST, LEAST, TOP = 3, 10, 2000
#: Parts by which the cuts that share a word are dealt.
SALTS = 8


def _frequent(least: int):
    """A function for mapInArrow on rows of ngrams.asked(): phrases that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in ngrams.merged(batches):
            keep = np.flatnonzero(m.totals >= least)
            ids = np.stack([c[keep] for c in m.columns], axis=1).astype(np.int64)
            size = (ids > 0).sum(axis=1)
            row = np.searchsorted(np.cumsum(m.sizes), m.first[keep], "right").tolist()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(ids[ids > 0]))
            yield pa.RecordBatch.from_arrays([pa.array([m.rows[k]["name"] for k in row], pa.string()), lists, pa.array(m.totals[keep])], ["lang", "ids", "a"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            found = ngrams.unpack_words(r["words"], r["lengths"])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ngrams.unpack(r["ids"]).astype(np.int64)), found.cast(pa.large_string()).cast(pa.string()), pa.array(ngrams.unpack(r["totals"]).astype(np.int64))], ["id", "word", "f"])


def phrases(df: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: lang, ids, a; words: id, word, f; languages: lang, n), all written: what occurs ``least`` times, and all word occurrences.

    A null text is empty, a null language is ``und``; texts are split whole, however long. An empty table gives three empty ones.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    made = ngrams.blocks(df, ngrams.Split(SPACES, BREAKS, longest, ends=False), lang, F.lit(None), F.lit(False), F.col(f"`{text_col}`"))
    said = ngrams.words(made, least, keep=True)
    own = said.answers.where("block is null")
    at = ngrams.splitters(made, said, longest, 2)
    found = ngrams.asked(made, said, longest, 2, at).mapInArrow(handing_back(_frequent(least)), "lang string, ids array<long>, a long")
    words = own.select("words", "lengths", "ids", "totals").mapInArrow(handing_back(_listed), "id long, word string, f long")
    return written(found, "phrases"), written(words, "phrase-words"), written(own.groupBy(F.col("name").alias("lang")).agg(F.sum("total").alias("n")), "phrase-langs")


def collocations(df: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = 50, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase's score is the least, over its cuts into two parts of l and r occurrences, of floor(1000000 * a * a / (l * r)), in
    exact decimals; of equal scores the cut after fewer words counts. A phrase inside a longer one that occurs at least
    ``share`` percent as often is left out. Ties go to the more frequent phrase, then by UTF-8 bytes. See phrases() for nulls,
    long texts and empty tables; repeated rows count each; other columns are ignored.
    """
    found, words, langs = phrases(df, longest, least, text_col, lang_col)
    # Counts of parts: a word is looked for by all phrases that begin or end with it, so its cuts are dealt by salt.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    counts = words.select(F.array("id").alias("part"), F.col("f").alias("f"), salts).unionByName(found.select(F.col("ids").alias("part"), F.col("a").alias("f"), F.lit(0).alias("salt")))
    salt = lambda part, other: F.when(F.size(part) == 1, F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)
    cuts = found.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("lang", "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    for side, other, name in (("left", "right", "l"), ("right", "left", "r")):
        own = counts.select(F.col("part").alias(side), F.col("f").alias(name), "salt")
        cuts = cuts.withColumn("salt", salt(F.col(side), F.col(other))).join(own, [side, "salt"]).drop("salt")
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every shorter phrase inside a phrase, with the most that such a phrase occurs.
    inner = found.where(F.size("ids") > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    inner = inner.select("ids", "a", "m", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1)).alias("s"))
    inner = inner.groupBy(F.slice("ids", F.col("s"), F.col("m")).alias("ids")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    kept = kept.select("lang", "ids", "a", "cut.score", "cut.l", "cut.r")
    # Ties at the end of a language's list stay until their words are known.
    high = kept.withColumn("high", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("high") <= top).drop("high")
    high = written(high, "phrases-high")
    spelt = high.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")).select("ids", F.array_join("words.word", " ").alias("phrase"))
    ranked = high.join(spelt, "ids").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(if_few(langs), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the first 2000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
t AS (SELECT lang, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3 FROM w WHERE len(ws) > 0),
f1 AS (SELECT lang, w1, count(*) AS a FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
k AS (SELECT f2.lang, f2.w1, f2.w2, NULL AS w3, f2.a, 1 AS k, x.a AS l, y.a AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
      UNION ALL SELECT f3.lang, f3.w1, f3.w2, f3.w3, f3.a, 1, x.a, y.a FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
      UNION ALL SELECT f3.lang, f3.w1, f3.w2, f3.w3, f3.a, 2, x.a, y.a FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
i AS (SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
o AS (SELECT b.*, concat_ws(' ', b.w1, b.w2, b.w3) AS phrase FROM b LEFT JOIN i ON b.w3 IS NULL AND i.lang = b.lang AND i.w1 = b.w1 AND i.w2 = b.w2 WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
