"""Queries of the corpus: search with its counts, the listing of candidates, twice-encoded text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators import quality, search
from sluicework.plans.catalog import query
from sluicework.session import written

# A document's English variant: translated or failed by its labels; the file is there where its quality is good.
_INDEX = """i AS (SELECT d.doc_id AS id, 'c/' || d.source || '/' || d.doc_id || '/index.md' AS path, d.lang, d.text, CASE WHEN toxic = 1 THEN 'failed' WHEN quality IS NOT NULL THEN 'translated' END AS mode, coalesce(quality = 1, false) AS present
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang <> 'de'), s AS (SELECT *, CASE WHEN mode = 'failed' THEN 'failed' WHEN NOT present THEN 'missing' ELSE 'present' END AS state, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM i),
 h AS (SELECT *, position('with' IN lower(t)) AS hit FROM s), m AS (SELECT *, state = 'present' AND hit > 0 AS matched FROM h),
 n AS (SELECT count_if(state = 'missing')::BIGINT AS missing, count_if(state = 'failed')::BIGINT AS failed, 0::BIGINT AS invalid, count_if(matched)::BIGINT AS matched, greatest(count_if(matched) - 50, 0)::BIGINT AS truncated FROM m)"""  # fmt: skip


@query(f"""WITH {_INDEX} SELECT id::VARCHAR AS id, replace(path, 'index.md', 'index.en.md') AS path, CASE WHEN greatest(1, hit - 40) > 1 THEN '…' ELSE '' END || substring(t, greatest(1, hit - 40), least(length(t), hit + 119) - greatest(1, hit - 40) + 1) || CASE WHEN least(length(t), hit + 119) < length(t) THEN '…' ELSE '' END AS snippet, n.*
 FROM (SELECT * FROM m WHERE matched ORDER BY id LIMIT 50) m, n""")  # fmt: skip
def corpus_search(t):
    """The first 50 documents outside German whose English variant holds a word, with what the search passed over, counted in the same job."""
    docs = t("documents").join(t("labels").select("doc_id", "quality", "toxic").distinct(), "doc_id", "left")
    path = F.concat(F.lit("c/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/index.md"))
    mode = F.when(F.col("toxic") == 1, "failed").when(F.col("quality").isNotNull(), "translated")
    index = docs.select(F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("id"), path.alias("path"), "lang", F.when(mode.isNotNull(), F.create_map(F.lit("en"), mode)).otherwise(F.create_map().cast("map<string,string>")).alias("variants"))
    bodies = docs.where("quality = 1").select(F.replace(path, F.lit("index.md"), F.lit("index.en.md")).alias("path"), "text")
    shown, told = search.corpus_search(index, bodies, "en", where=F.col("lang") != "de", keyword="with", limit=50)
    rows = written(shown.drop("state"), "search")  # the one job that fills the counts
    return rows.select("*", *[F.lit(told.get[n]).cast("long").alias(n) for n in ("missing", "failed", "invalid", "matched", "truncated")])


_POOL = """p AS (SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'skip' ELSE 'ok' END AS status, contains(text, '|') AS has_images, CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'mid' END AS conf, d.lang AS category,
 CASE WHEN n_chars < 200 THEN 1 WHEN n_chars < 500 THEN 2 WHEN n_chars < 1500 THEN 3 WHEN n_chars < 5000 THEN 4 ELSE 5 END AS est, CASE WHEN d.doc_id % 10 > 0 THEN d.source END AS comp_norm, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) AS head FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
 m AS (SELECT *, status = 'ok' AND NOT has_images AND conf <> 'low' AND est BETWEEN 2 AND 4 AND regexp_matches(head, '(?i)th|re') AS hit FROM p), n AS (SELECT count_if(hit)::BIGINT AS matched, greatest(count_if(hit) - 200, 0)::BIGINT AS truncated FROM m)"""  # fmt: skip


@query(f"WITH {_POOL} SELECT id, est::INT AS est, conf, comp_norm, head, n.* FROM (SELECT * FROM m WHERE hit ORDER BY est, conf = 'high' DESC, comp_norm IS NULL, comp_norm, id LIMIT 200) m, n")
def candidate_listing(t):
    """The first 200 candidates by estimate, confidence, contest and id that status, pictures, confidence, estimate and a pattern let through, with how many there are."""
    d = t("documents").join(t("labels").select("doc_id", "quality", "toxic").distinct(), "doc_id", "left")
    n = F.col("n_chars")
    est = F.when(n < 200, 1).when(n < 500, 2).when(n < 1500, 3).when(n < 5000, 4).otherwise(5)
    pool = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "skip").otherwise("ok").alias("status"), F.col("text").contains("|").alias("has_images"), F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("mid").alias("conf"),
        F.col("lang").alias("category"), est.alias("est"), F.array("source").alias("topics"), F.col("source").alias("contest"), F.when(F.col("doc_id") % 10 > 0, F.col("source")).alias("comp_norm"), "lang", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 200).alias("head"),
    )
    shown, told = search.candidates(pool, difficulty=(2, 4), grep="th|re", limit=200)
    rows = written(shown.select("id", "est", "conf", "comp_norm", "head"), "candidates")
    return rows.select("*", F.lit(told.get["matched"]).cast("long").alias("matched"), F.lit(told.get["truncated"]).cast("long").alias("truncated"))


_TWICE = "array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: chr(('0x' || b)::INT)), '')"
_SQL_CLEAN = "x"
for _p in [quality.CODE, quality.MATH, quality.IMAGE, r"`[^`\n]+`", r"\{\{[A-Z]{2,5}_\d{4}\}\}", r"<[^>]+>"]:
    _SQL_CLEAN = f"regexp_replace({_SQL_CLEAN}, '{_p}', ' ', 'g')"


@query(f"WITH d AS (SELECT doc_id, 'once' AS kind, coalesce(text, '') AS x FROM documents UNION ALL SELECT doc_id, 'twice', coalesce({_TWICE}, '') FROM documents), c AS (SELECT doc_id, kind, {_SQL_CLEAN} AS x FROM d), n AS (SELECT *, len(regexp_extract_all(x, '{quality.MARKER}'))::INT AS markers FROM c) SELECT doc_id, kind, markers, len(regexp_extract_all(x, '{quality._ENCODED}'))::INT AS repaired, regexp_matches(x, '{quality.MOJIBAKE}') OR markers >= 3 AS wrong FROM n")
def mojibake(t):
    """Every document as it is and as if its bytes had been read as letters: marks of twice-encoded text, and runs that decoding backwards repairs."""
    docs = t("documents").select("doc_id", "text")
    twice = docs.select("doc_id", F.lit("twice").alias("kind"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return quality.mojibake(docs.select("doc_id", F.lit("once").alias("kind"), "text").unionByName(twice), "text").drop("text")
