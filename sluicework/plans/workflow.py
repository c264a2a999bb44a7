"""Registered queries of views, pairing and index upkeep, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators import workflow
from sluicework.plans.catalog import PROBLEM, _problems, query



@query("SELECT doc_id, l AS lang, CASE l WHEN 'orig' THEN 'by/' || lang || '/' || doc_id || '/index.md' ELSE 'by/' || lang || '/' || doc_id || '/index.' || l || '.md' END AS path FROM documents, (VALUES ('orig'), ('en'), ('zh')) v(l)")
def variant_paths(t):
    rows = t("documents").select("doc_id", F.concat(F.lit("by/"), "lang", F.lit("/"), "doc_id", F.lit("/index.md")).alias("source"), F.explode(F.array(F.lit("orig"), F.lit("en"), F.lit("zh"))).alias("lang"))
    return rows.select("doc_id", "lang", workflow.variant_path(F.col("source"), F.col("lang")).alias("path"))


_STATE = "CASE doc_id % 6 WHEN 0 THEN '{\"variants\": {\"en\": \"translated\"}}' WHEN 1 THEN '{\"variants\": {\"en\": {\"mode\": \"failed\"}}}' WHEN 2 THEN '{\"variants\": {\"en\": \"odd\"}}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{\"variants\": {' END"


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'translated' WHEN 1 THEN 'failed' ELSE 'missing' END AS status, doc_id % 6 < 3 AS readable FROM documents")
def variant_states(t):
    rows = t("documents").select("doc_id", workflow.readable_state(F.expr(_STATE)).alias("state"))
    return rows.select("doc_id", workflow.variant_status(F.col("state"), "en").alias("status"), F.col("state").isNotNull().alias("readable"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'und' WHEN toxic = 1 THEN NULL ELSE lang END AS source_lang, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN toxic = 1 THEN 'no language' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def source_languages(t):
    docs = t("documents").select("doc_id", "lang")
    value = F.when(F.col("toxic") == 1, '{"source_lang": ""}').when(F.col("quality") == 1, F.concat(F.lit('{"source_lang": "'), "lang", F.lit('", "source_lang_confidence": "high"}'))).otherwise(F.concat(F.lit('"'), "lang", F.lit('"')))
    known = docs.join(t("labels"), "doc_id").select("doc_id", value.alias("value"))
    return workflow.source_language(docs.select("doc_id"), "doc_id", known, ("und", "low"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS ok FROM events")
def zoned_times(t):
    k, at = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t("events").select("event_id", workflow.zoned_time(F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.lit("+05:30"))).when(k == 2, at).otherwise("soon")).alias("ok"))


@query("WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, 'x ' || text AS text FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'paired' END AS state, length(b.text) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def translation_pairs(t):
    docs = t("documents").select("doc_id", "text")
    found = workflow.paired(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 7 <> 0").withColumn("text", F.concat(F.lit("x "), "text")), "doc_id")
    return found.select("doc_id", "state", F.length("translated").cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN user_id % 4 < 2 THEN CASE WHEN user_id % 8 = 1 THEN NULL ELSE user_id + 1000 END END AS id, user_id % 4 < 2 AS known FROM events")
def remapped_ids(t):
    e = t("events").select("event_id", F.lit("round-1").alias("round"), F.col("user_id").alias("old"))
    table = e.select("round", "old").distinct().where("old % 4 < 2").withColumn("id", F.when(F.col("old") % 8 != 1, F.col("old") + 1000))
    return workflow.remapped(e, table, ["round", "old"]).select("event_id", "id", "known")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN upper(source) ELSE source END AS source, lang FROM documents")
def reindexed_rows(t):
    index = t("documents").select("doc_id", "source", "lang")
    fresh = index.where("doc_id % 3 = 0").select("doc_id", F.upper("source").alias("source"))
    return workflow.reindexed(index, fresh, "doc_id", index.where("doc_id % 2 = 0"))[0]


@query("WITH s AS (SELECT 'stash-' || doc_id % 2 AS root, doc_id % 100 AS id, md5(text) AS sha FROM documents UNION ALL SELECT 'live', doc_id, md5(text) FROM documents WHERE doc_id < 50) SELECT id, string_agg(DISTINCT root, ',' ORDER BY root) AS place, count(DISTINCT sha) AS n FROM s GROUP BY id HAVING count(DISTINCT sha) > 1")
def stash_conflicts(t):
    docs = t("documents").select("doc_id", F.md5("text").alias("sha"))
    stashes = docs.select(F.concat(F.lit("stash-"), F.col("doc_id") % 2).alias("root"), (F.col("doc_id") % 100).alias("id"), "sha")
    return workflow.stash_conflicts(stashes, docs.where("doc_id < 50").select(F.col("doc_id").alias("id"), "sha"))


@query(f"WITH {PROBLEM} SELECT node, count(*) FILTER (difficulty = 3 AND contains(lower(text), 'the')) AS shown, count(*) AS total, count(*) FILTER (difficulty = 3 AND contains(lower(text), 'the')) = 0 AS dim FROM problem GROUP BY node")
def map_view(t):
    return workflow.map_view(_problems(t), 3, "THE")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '?' WHEN o_orderkey % 3 = 0 THEN 'Cup ' || year(o_orderdate) ELSE 'Cup' END AS contest, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 <> 0 THEN year(o_orderdate)::INT END AS year FROM orders")
def contest_headings(t):
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    name = F.when(k % 5 == 0, "").when(k % 3 == 0, F.concat(F.lit("Cup "), year)).otherwise("Cup")
    return t("orders").select("o_orderkey", *workflow.heading_view(name, year))


_ESCAPED = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT doc_id, '<p>' || {_ESCAPED.format(c='source')} || ' &lt;b&gt;</p>' || chr(10) || '<ul><li>' || lang || '</li><li>two &amp; three</li></ul>' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '<ol><li>a</li><li>b</li></ol>' ELSE '<p>1. a</p>' END AS html FROM documents")
def web_texts(t):
    text = F.concat("source", F.lit(" <b>\n\n- "), "lang", F.lit("\n* two & three\n \n1. a"), F.when(F.col("doc_id") % 2 == 0, "\n2. b").otherwise(""))
    return t("documents").select("doc_id", workflow.html(text).alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang END AS declared FROM documents")
def declared_lines(t):
    text = F.concat(F.lit("# T\n- 来源: x\n"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("- 语言： "), "lang", F.lit("  \n"))).otherwise("语言 "), "text")
    return t("documents").select("doc_id", workflow.declared_line(text).alias("declared"))
