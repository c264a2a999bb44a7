"""Registered queries of ingest, filing and reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import ingest
from sluicework.plans.catalog import PROBLEM, _problems, query

PATHS = [("src1 > en > l'src1", "src1 > english"), ("src1 > english", "one"), ("src2 > fr > l'src2", "src2 > french"), ("one", "first"), ("src2 > french", "src2")]


def _sql_chain(c: str) -> str:
    for before, after in PATHS:
        c = "CASE WHEN ({0}) = '{1}' THEN '{2}' ELSE ({0}) END".format(c, before.replace("'", "''"), after.replace("'", "''"))
    return c


@query("WITH a AS (SELECT DISTINCT '  ' || source || '>' || lang || '  >  l’' || source AS raw FROM documents), b AS (SELECT raw, regexp_replace(regexp_replace(replace(replace(nfc_normalize(trim(raw)), '‘', ''''), '’', ''''), '\\s+', ' ', 'g'), '\\s*>\\s*', ' > ', 'g') AS path FROM a) SELECT raw, path, " + _sql_chain("path") + " AS rewritten FROM b")
def tag_paths(t):
    raw = F.concat(F.lit("  "), "source", F.lit(">"), "lang", F.lit("  >  l’"), "source")
    rows = t("documents").select(raw.alias("raw")).distinct().withColumn("path", ingest.tag_path(F.col("raw")))
    return rows.select("raw", "path", ingest.rewritten(F.col("path"), PATHS).alias("rewritten"))


# Contest names made of nations; the tiers that know some of them, and modifiers for the rest.
PREFIXES = ["", "the third ", "tenth ", "the ", "17th "]
SUFFIXES = [" olympiad 2019", " tst", " junior tst final", " first round tst", " circle", " booklet", " imo shortlist"]
KINDS = ["MCQ", "final answer only", "proof"]
TIERS = {"france olympiad": 5, "the germany olympiad": 3, "united states olympiad": 5, "japan tst": 4, "imo": 4, "third kenya circle": 3, "brazil first round tst": 2, "junior tst final": 4}
MODIFIERS = [("circle", "=2"), ("imo", "=4"), ("tst|shortlist|final", "+1"), ("first round|junior", "-1"), ("booklet", "-0")]


def _sql_grade() -> str:
    """The fold of modifiers as one column of state after the other."""
    pick = lambda n, xs, c: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(xs)) + " END"  # noqa: E731, ARG005
    ordinal = "|".join(T.ORDINALS)
    form = lambda c: f"CASE WHEN regexp_matches(regexp_replace({c}, '^the +', ''), '^({ordinal}) +(round|stage|selection|day|problem)') THEN regexp_replace({c}, '^the +', '') ELSE regexp_replace(regexp_replace({c}, '^the +', ''), '^({ordinal}) +', '') END"
    table = "tier(name, base) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in TIERS.items()) + ")"
    norm = "lower(nm)"
    for p in (r"\b(19|20)\d{2}\b", r"\b\d{1,3}(st|nd|rd|th)\b", r"\b[ivxl]{1,6}\b", r"[-–—_/,.#]"):
        norm = f"regexp_replace({norm}, '{p}', ' ', 'g')"
    out = [
        f"n AS (SELECT s_suppkey AS k, ({pick('p', PREFIXES, 's_suppkey % 5')}) || lower(n_name) || ({pick('s', SUFFIXES, '(s_suppkey // 5) % 7')}) AS nm, {pick('t', KINDS, 's_suppkey % 4')} AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
        f"m AS (SELECT *, nullif(trim(regexp_replace({norm}, '\\s+', ' ', 'g')), '') AS name FROM n)",
        f"v AS (SELECT *, regexp_replace(name, '^the +', '') AS v2, {form('name')} AS v3 FROM m)",
        table, f"forms AS (SELECT {form('name')} AS form, arg_min(base, rowid_) AS base FROM (SELECT *, row_number() OVER () AS rowid_ FROM tier) GROUP BY 1)",
        "h AS (SELECT v.*, coalesce(a.base, fa.base, b.base, c.base) AS hit FROM v LEFT JOIN tier a ON a.name = v.name LEFT JOIN forms fa ON fa.form = v.v3 LEFT JOIN tier b ON b.name = v.v2 LEFT JOIN tier c ON c.name = v.v3)",
        f"f AS (SELECT h.k, arg_max(t.base, length(t.name)) AS kin FROM h JOIN tier t ON regexp_matches(h.name, '(^|[^a-z])' || t.name || '([^a-z]|$)') AND (length(t.name) >= 8 OR t.name IN ({', '.join(repr(x) for x in ingest.SHORT_FAMILIES)})) GROUP BY h.k)",
        "s0 AS (SELECT h.*, kin, 2 AS est, NULL::VARCHAR AS conf, false AS done, false AS noop, false AS seen FROM h LEFT JOIN f USING (k))",
    ]
    for i, (p, effect) in enumerate(MODIFIERS):
        kind, n = effect[0], int(effect[1])
        hit = f"(regexp_matches(name, '{p}') AND NOT done)"
        skip = "regexp_matches(name, 'first round|junior')" if kind == "+" and "tst" in p else "false"
        shift = f"({hit} AND NOT {skip})" if kind in "+-" and n else "false"
        est = f"CASE WHEN {hit} THEN {n} ELSE est END" if kind == "=" else f"CASE WHEN {shift} THEN greatest(1, least(5, est {kind} {n})) ELSE est END" if n else "est"
        conf = f"CASE WHEN {hit if kind == '=' else shift} THEN 'mid' ELSE conf END"
        out.append(f"s{i + 1} AS (SELECT k, kind, name, hit, kin, {est} AS est, {conf} AS conf, done OR {hit if kind == '=' else 'false'} AS done, noop OR ({hit} AND {str(kind == '-' and not n).lower()}) AS noop, seen OR {hit} AS seen FROM s{i})")
    last = f"s{len(MODIFIERS)}"
    out.append(f"e AS (SELECT k, kind, name, coalesce(hit, kin, est) AS est, CASE WHEN name IS NULL THEN 'low' WHEN hit IS NOT NULL THEN 'high' WHEN kin IS NOT NULL THEN 'mid' ELSE coalesce(conf, CASE WHEN NOT seen OR noop THEN 'low' ELSE 'mid' END) END AS conf, CASE kind WHEN 'MCQ' THEN 2 WHEN 'final answer only' THEN 3 END AS cap FROM {last})")
    return "WITH " + ", ".join(out) + " SELECT k, name, CASE WHEN est > cap THEN cap ELSE est END AS est, CASE WHEN est > cap AND conf <> 'high' THEN 'mid' ELSE conf END AS conf FROM e"


@query(_sql_grade())
def grade_chain(t):
    of = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), c.cast("int"))
    k = F.col("s_suppkey")
    rows = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # a fixed dimension of 25 rows
    rows = rows.select(k.alias("k"), F.concat(of(PREFIXES, k % 5), F.lower("n_name"), of(SUFFIXES, F.floor(k / 5) % 7)).alias("nm"), of(KINDS, k % 4).alias("kind"))
    rows = rows.withColumn("name", T.norm_name(ingest.nfc("nm")))
    return rows.select("k", "name", ingest.grade(F.col("name"), F.col("kind"), TIERS, MODIFIERS).alias("g")).select("k", "name", "g.est", "g.conf")


@query("SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS part_chars, count(*) FILTER (role = 'assistant') AS n_parts, count(*) FILTER (contains(text, '!')) AS n_images, count(*) FILTER (contains(text, '!')) > 0 AS has_images FROM conversations GROUP BY conv_id")
def solution_sizes(t):
    some = lambda c: F.collect_list(F.when(c, F.col("text")))
    rows = t("conversations").groupBy("conv_id").agg(some(F.col("role") == "assistant").alias("parts"), some(F.col("text").contains("!")).alias("images"))
    return rows.select("conv_id", *ingest.sizes(F.col("parts"), F.col("images")))


HEAD = "substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, {n})"


@query(f"WITH h AS (SELECT doc_id, {HEAD.format(n=200)} AS head, regexp_replace({HEAD.format(n=120)}, '[\\x00-\\x1f<>:\"/\\\\|?*]+', '-', 'g') AS l FROM documents) SELECT doc_id, head, coalesce(nullif(regexp_replace(substring(regexp_replace(l, '^[. ]+|[. ]+$', '', 'g'), 1, 80), '[. ]+$', ''), ''), '_') AS label FROM h")
def text_heads(t):
    return t("documents").select("doc_id", ingest.head(F.col("text")).alias("head"), ingest.safe_label(ingest.head(F.col("text"), 120)).alias("label"))


REGISTRY = [("en", "src0"), ("en", "src3"), ("fr", "src1"), ("de", "src2"), ("de", "src7"), ("es", "src4")]


@query("WITH r(home, topic) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REGISTRY) + "), d AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN [NULL] ELSE [source, 'src' || (doc_id % 9), 'src' || (doc_id % 4)] END AS ts FROM documents), e AS (SELECT doc_id, lang, unnest(ts) AS topic, generate_subscripts(ts, 1) AS pos FROM d), m AS (SELECT e.*, home FROM e LEFT JOIN r USING (topic)) SELECT doc_id, coalesce(home, lang) AS category, CASE WHEN topic IS NULL THEN 'unspecified' WHEN home IS NULL THEN 'unclassified' ELSE topic END AS topic, row_number() OVER (PARTITION BY doc_id ORDER BY NOT coalesce(home = lang, false), pos)::INT AS place FROM m")
def placements(t):
    topics = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("source", F.concat(F.lit("src"), F.col("doc_id") % 9), F.concat(F.lit("src"), F.col("doc_id") % 4)))
    registry = t("region").sparkSession.createDataFrame(REGISTRY, "category string, node string")
    return ingest.placement(t("documents").select("doc_id", "lang", topics.alias("topics")), "doc_id", "lang", "topics", registry)


_PARTS = "CASE WHEN quality = 1 THEN chr(10) || chr(10) || '## Solution 1' || chr(10) || chr(10) || source || chr(10) || chr(10) || '## Solution 2' || chr(10) || chr(10) || lang WHEN quality = 0 THEN chr(10) || chr(10) || '## Solution' || chr(10) || chr(10) || source ELSE chr(10) || chr(10) || '## Solution' || chr(10) || chr(10) || '(not provided)' END"


@query(f"WITH d AS (SELECT d.doc_id, lang, source, trim(d.text) AS body, quality, CASE WHEN toxic = 1 THEN 'bad' WHEN toxic = 0 THEN 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)), r AS (SELECT doc_id, '# Item ' || doc_id || chr(10) || chr(10) || 'Tags: ' || lang || '; ' || source || CASE WHEN status = 'ok' THEN '' ELSE chr(10) || chr(10) || '> Status: ' || coalesce(status, 'unknown') END || chr(10) || chr(10) || '## Statement' || chr(10) || chr(10) || coalesce(nullif(body, ''), '(not provided)') || {_PARTS} || chr(10) || chr(10) || '## Final answer' || chr(10) || chr(10) || CASE WHEN toxic_ THEN '(not provided)' ELSE lang END AS doc, lang, source FROM (SELECT *, coalesce(status = 'bad', false) AS toxic_ FROM d)) SELECT doc_id, sha256(doc) AS digest, CASE WHEN len(regexp_extract_all(doc, '(?m)^Tags: ([^\\n]*)$', 1)) = 1 THEN lang || '|' || source END AS tags, '\"Item ' || doc_id || ' \\\"' || lang || '\\\"\"' AS title FROM r")
def rendered_rows(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "source", "text", "quality", F.when(F.col("toxic") == 1, "bad").when(F.col("toxic") == 0, "ok").alias("status"))
    solutions = F.when(F.col("quality") == 1, F.array("source", "lang")).when(F.col("quality") == 0, F.array("source"))
    title = F.concat(F.lit("Item "), F.col("doc_id").cast("string"))
    doc = ingest.rendered(title, F.col("status"), F.col("text"), solutions, F.when(F.col("status") == "bad", " ").otherwise(F.col("lang")), F.array("lang", "source"))
    rows = rows.withColumn("doc", doc)
    return rows.select("doc_id", F.sha2("doc", 256).alias("digest"), F.array_join(ingest.header_tags(F.col("doc")), "|").alias("tags"), ingest.quoted(F.concat(title, F.lit(' "'), "lang", F.lit('"'))).alias("title"))


@query("SELECT label, len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY ALL")
def list_lengths(t):
    return t("embeddings").groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 300 ORDER BY doc_id LIMIT 40")
def first_matching(t):
    """The first 40 matches in the order of ids, which each task keeps of its own rows: the feature is the limit."""
    return t("documents").where((F.col("lang") == "en") & (F.col("n_chars") > 300)).select("doc_id", "n_chars").orderBy("doc_id").limit(40)


@query("SELECT l.id, length(coalesce(d.text, ''))::INT AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 10000000 ELSE doc_id END AS id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.id")
def fulltext_lookup(t):
    ids = t("labels").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 10000000).otherwise(F.col("doc_id")).alias("doc_id"))
    return ids.join(t("documents").select("doc_id", "text"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("n"))


@query("WITH c AS (SELECT source AS name, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source), d AS (SELECT CASE WHEN l.quality = 1 THEN p.difficulty END AS star, count(*) AS n FROM (WITH " + PROBLEM + " SELECT * FROM problem) p LEFT JOIN labels l ON l.doc_id = p.id GROUP BY 1) SELECT 'source' AS report, name AS item, n, row_number() OVER (ORDER BY n DESC, first)::INT AS place FROM c QUALIFY place <= 12 UNION ALL SELECT 'difficulty', star::VARCHAR, n, row_number() OVER (ORDER BY star NULLS LAST)::INT FROM d")
def report_tables(t):
    """The twelve most common sources, ties by first appearance, and a histogram of difficulty with the unknown last."""
    sources = t("documents").groupBy(F.col("source").alias("item")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    top = sources.orderBy(F.desc("n"), "first").limit(12).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "first")))
    graded = _problems(t).join(t("labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left").groupBy(F.when(F.col("quality") == 1, F.col("difficulty")).alias("star")).agg(F.count("*").alias("n"))
    stars = graded.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("star"))))  # six rows at most
    return top.select(F.lit("source").alias("report"), "item", "n", "place").union(stars.select(F.lit("difficulty"), F.col("star").cast("string"), "n", "place"))


@query(f"WITH {PROBLEM} SELECT CASE grouping(category, difficulty) WHEN 0 THEN 'cell' WHEN 1 THEN 'category' WHEN 2 THEN 'difficulty' ELSE 'all' END AS level, category, difficulty, count(*) AS n, count(l.doc_id) AS reviewed, count(*) FILTER (l.toxic = 1) AS toxic, sum(n_chars)::BIGINT AS chars FROM problem p LEFT JOIN labels l ON l.doc_id = p.id GROUP BY GROUPING SETS ((category, difficulty), (category), (difficulty), ())")
def summary_report(t):
    rows = _problems(t).join(t("labels").select(F.col("doc_id").alias("id"), "toxic"), "id", "left")
    found = rows.groupingSets([["category", "difficulty"], ["category"], ["difficulty"], []], "category", "difficulty").agg(F.count("*").alias("n"), F.count("toxic").alias("reviewed"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.sum("n_chars").alias("chars"), F.grouping_id("category", "difficulty").alias("g"))
    level = F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, "category").when(F.col("g") == 2, "difficulty").otherwise("all")
    return found.select(level.alias("level"), "category", "difficulty", "n", "reviewed", "toxic", "chars")


ONLY = [3, 5, 8, 10**9, 13]


@query("SELECT o.id::BIGINT AS id, d.source, d.doc_id IS NOT NULL AS known FROM (VALUES " + ", ".join(f"({i})" for i in ONLY) + ") o(id) LEFT JOIN documents d ON d.doc_id = o.id")
def only_ids(t):
    """Rows asked for by id, those that don't exist reported beside them."""
    asked = F.broadcast(t("region").sparkSession.createDataFrame([(i,) for i in ONLY], "id long"))
    found = t("documents").select(F.col("doc_id").alias("id"), "source", F.lit(True).alias("known")).join(asked, "id", "left_semi")  # few, before anything is shuffled
    return asked.join(found, "id", "left").select("id", "source", F.coalesce("known", F.lit(False)).alias("known"))


def span(text: str) -> tuple[int, int]:
    """(least, most) of '3' or '2-3'."""
    low, _, high = text.partition("-")
    return int(low), int(high or low)


@query(f"WITH {PROBLEM} SELECT p.id, category, difficulty FROM problem p JOIN labels l ON l.doc_id = p.id WHERE difficulty BETWEEN 2 AND 4 AND toxic = 0 AND category = 'en' AND node <> 'src0' AND regexp_matches(text, 'the')")
def review_batch(t):
    low, high = span("2-4")
    fine = t("labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    rows = _problems(t).where(F.col("difficulty").between(low, high) & (F.col("category") == "en") & (F.col("node") != "src0") & F.col("text").rlike("the"))
    return rows.join(fine, "id").select("id", "category", "difficulty")


@query("WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 4 WHEN 0 THEN '/a/../../x' WHEN 1 THEN '/../../../..' WHEN 2 THEN '/./b//c' ELSE '' END AS path FROM pages), s AS (SELECT page_id, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS pos FROM u), d AS (SELECT page_id, sum(CASE part WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS deep FROM s) SELECT page_id, min(deep) >= 0 AS inside FROM d GROUP BY page_id")
def path_safety(t):
    end = F.get(F.array(F.lit("/a/../../x"), F.lit("/../../../.."), F.lit("/./b//c"), F.lit("")), (F.col("page_id") % 4).cast("int"))
    return t("pages").select("page_id", T.contained(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), end)).alias("inside"))
