"""Registered queries of contracts and incremental state, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators import contracts
from sluicework.plans.catalog import query

# Front matter made of documents, with each rule broken by some: text of the fields in both engines.
FIELDS = {
    "id": "CASE WHEN doc_id % 17 = 0 THEN 'X-' || doc_id WHEN doc_id % 19 = 0 THEN upper(substring(lang, 1, 1)) || '-' || (doc_id + 1) ELSE upper(substring(lang, 1, 1)) || '-' || doc_id END",
    "title": "CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'Item ' || doc_id END", "category": "lang", "source_ref": "CASE WHEN doc_id % 29 <> 0 THEN source END",
    "difficulty": "CASE doc_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN '7' ELSE '3' END",
    "topics": "CASE doc_id % 9 WHEN 0 THEN '[]' WHEN 1 THEN 'loose' WHEN 2 THEN '[\"a\",\"b\",\"c\",\"d\",\"e\"]' ELSE '[\"a\"]' END",
    "verification": "CASE doc_id % 5 WHEN 0 THEN 'sourced' WHEN 1 THEN 'guess' ELSE 'dataset-reviewed' END", "source_url": "CASE WHEN doc_id % 11 = 0 THEN 'ftp://x' ELSE 'http://x' END",
    "dataset_id": "CASE WHEN doc_id % 7 <> 0 THEN 'm' || (doc_id % 40) END", "review_ref": "CASE WHEN doc_id % 13 <> 0 THEN source END",
    "machine_check_ref": "CASE WHEN doc_id % 3 = 0 THEN source END", "colour": "CASE WHEN doc_id % 31 = 0 THEN 'red' END",
}
BODY = "'## 题面' || CASE WHEN doc_id % 6 = 0 THEN '' ELSE ' ## 答案' END || CASE WHEN doc_id % 10 = 0 THEN '' ELSE ' ## 解法要点' END"
_FM = "f AS (SELECT doc_id, lang, source, doc_id % 37 <> 0 AS readable, " + ", ".join(f"{v} AS {k}_" for k, v in FIELDS.items()) + f", {BODY} AS body, upper(substring(lang, 1, 1)) || '-' || doc_id || '.md' AS file FROM documents)"


def _lint_sql() -> str:
    has = lambda k: f"coalesce(trim({k}_) NOT IN ('', '[]', 'null'), false)"
    reviewed = "coalesce(verification_ = 'dataset-reviewed', false)"
    rules = [
        ("unknown fields", "colour_ IS NOT NULL"), *[(f"missing {k}", f"NOT {has(k)}") for k in contracts.REQUIRED],
        ("id differs from the file's name", "coalesce(id_, '') || '.md' <> file"), ("id of another category", "NOT starts_with(id_, upper(substring(lang, 1, 1)) || '-')"),
        ("difficulty is no whole number of 1 to 5", "NOT regexp_matches(difficulty_, '^[1-5]$')"), ("difficulty below the floor", "difficulty_ = '1'"),
        ("too many topics", "topics_ LIKE '%e\"]'"), ("topics are no list", "NOT starts_with(topics_, '[')"), ("source_url is no link", "NOT starts_with(source_url_, 'http')"),
        ("unknown verification", "verification_ = 'guess'"), ("reviewed without dataset_id", f"{reviewed} AND NOT {has('dataset_id')}"), ("reviewed without review_ref", f"{reviewed} AND NOT {has('review_ref')}"),
        ("review can't be read", f"{reviewed} AND {has('review_ref')} AND review_ref_ NOT IN (SELECT ref FROM r)"),
        ("review does not cover it", f"{reviewed} AND {has('review_ref')} AND {has('dataset_id')} AND review_ref_ IN (SELECT ref FROM r) AND review_ref_ || '/' || dataset_id_ NOT IN (SELECT ref || '/' || id FROM r)"),
        ("machine ledger can't be read", f"{has('machine_check_ref')} AND machine_check_ref_ NOT IN (SELECT ref FROM m)"),
        ("machine ledger does not pass it", f"{has('machine_check_ref')} AND machine_check_ref_ IN (SELECT ref FROM m) AND machine_check_ref_ || '/' || id_ NOT IN (SELECT ref || '/' || id FROM m WHERE status = 'pass')"),
        *[(f"section {s} is missing", f"NOT contains(body, '{s}')") for s in contracts.SECTIONS],
    ]
    found = " UNION ALL ".join("SELECT doc_id AS path, '{}' AS message FROM f WHERE readable AND {}".format(n.replace("'", "''"), c) for n, c in rules)
    r = "r AS (SELECT DISTINCT source AS ref, 'm' || (doc_id % 50) AS id FROM documents WHERE doc_id % 4 = 0), m AS (SELECT source AS ref, upper(substring(lang, 1, 1)) || '-' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM documents WHERE source <> 'src1')"
    return f"WITH {_FM}, {r} SELECT doc_id AS path, 'front matter can''t be read' AS message FROM f WHERE NOT readable UNION ALL {found}"


@query(_lint_sql())
def lint_all(t):
    docs = t("documents")
    fm = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*map(F.expr, FIELDS.values()))), lambda k, v: v.isNotNull())
    prefix = F.upper(F.substring("lang", 1, 1))
    rows = docs.select(F.col("doc_id").alias("path"), F.concat(prefix, F.lit("-"), "doc_id", F.lit(".md")).alias("file"), prefix.alias("prefix"), F.when(F.col("doc_id") % 37 != 0, fm).alias("fm"), F.expr(BODY).alias("body"))
    reviews = docs.where("doc_id % 4 = 0").select(F.col("source").alias("ref"), F.concat(F.lit("m"), F.col("doc_id") % 50).alias("id")).distinct()
    machines = docs.where("source <> 'src1'").select(F.col("source").alias("ref"), F.concat(prefix, F.lit("-"), "doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "pass").otherwise("fail").alias("status"))
    return contracts.lint(rows, reviews, machines)


@query("WITH a AS (SELECT lang AS category, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents), b AS (SELECT category, CASE WHEN k % 10 = 0 THEN k + 1000000 ELSE k END AS number FROM a), w AS (SELECT category, unnest(generate_series(1, count(*))) AS number FROM b GROUP BY category) SELECT category, number FROM w WHERE (category, number) NOT IN (SELECT category, number FROM b)")
def category_gaps(t):
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    ids = t("documents").select(F.col("lang").alias("category"), k.alias("k")).select("category", F.when(F.col("k") % 10 == 0, F.col("k") + 1000000).otherwise(F.col("k")).alias("number"))
    return contracts.gaps(ids, "category", "number")


FORBIDDEN = ["%%%", "Licensed", "||"]


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents) SELECT doc_id, line::INT AS line, word FROM l JOIN (VALUES " + ", ".join(f"('{w}')" for w in FORBIDDEN) + ") v(word) ON contains(body, word)")
def forbidden_lines(t):
    return contracts.forbidden_lines(t("documents"), "doc_id", "text", FORBIDDEN)


@query("WITH s AS (SELECT 'map' AS section, source AS key, CASE WHEN source IN ('src3', 'src4') THEN 'nowhere' ELSE lang END AS target FROM (SELECT source, min(lang) AS lang FROM documents WHERE doc_id % 2 = 0 GROUP BY source) UNION ALL SELECT 'ignore', source, NULL FROM (SELECT DISTINCT source FROM documents WHERE n_chars > 9000)) SELECT key AS item, 'in several sections' AS problem FROM s GROUP BY key HAVING count(DISTINCT section) > 1 UNION ALL SELECT key, 'target is no node' FROM s WHERE target IS NOT NULL AND target NOT IN (SELECT lang FROM documents) UNION ALL SELECT n_name, 'tier outside 1 to 5' FROM nation WHERE n_nationkey % 8 NOT BETWEEN 1 AND 5")
def table_self_check(t):
    docs = t("documents")
    known = docs.where("doc_id % 2 = 0").groupBy(F.col("source").alias("key")).agg(F.min("lang").alias("target")).withColumn("target", F.when(F.col("key").isin("src3", "src4"), "nowhere").otherwise(F.col("target")))
    ignored = docs.where("n_chars > 9000").select(F.col("source").alias("key"), F.lit(None).cast("string").alias("target")).distinct()
    return contracts.self_check({"map": known, "ignore": ignored}, docs.select(F.col("lang").alias("node")), t("nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 8).alias("base")))


# Translation states made of documents: every rule is broken by some.
SOURCE_SHA = "CASE doc_id % 12 WHEN 0 THEN 'none' WHEN 1 THEN sha256(text || 'old') ELSE sha256(text) END"
_STATE = f"s AS (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN '' ELSE 'd' || doc_id END AS id, sha256(text) AS now, doc_id % 14 = 0 AS gone, {SOURCE_SHA} AS source_sha, CASE doc_id % 10 WHEN 0 THEN 'english' WHEN 1 THEN 'und' ELSE lang END AS source_lang, CASE doc_id % 6 WHEN 0 THEN 'sure' WHEN 1 THEN 'low' ELSE 'high' END AS conf, doc_id % 43 = 0 AS broken, doc_id % 47 = 0 AS none FROM documents)"
_VARIANT = "v AS (SELECT *, 'en' AS lang, CASE doc_id % 4 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'failed' WHEN 2 THEN 'translated' ELSE 'odd' END AS mode, CASE doc_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN sha256(id || 'e') ELSE now END AS sha, CASE WHEN doc_id % 15 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN sha256(id) ELSE now END END AS held FROM s WHERE NOT broken AND NOT none UNION ALL SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'fr' ELSE 'zh' END, 'translated', sha256(id), CASE WHEN doc_id % 16 <> 0 THEN sha256(id) END FROM s WHERE NOT broken AND NOT none)"


def _contract_sql() -> str:
    digest = lambda c: f"coalesce(regexp_matches({c}, '{contracts.SHA}'), false)"
    whole = [
        ("id is missing", "id = ''"), ("source_sha256 is no digest", f"NOT {digest('source_sha')}"), ("source_lang is no code", "source_lang = 'english'"), ("unknown confidence", "conf = 'sure'"),
        ("variants can''t be read", "broken"), ("no variants", "none AND NOT broken"), ("source is missing", "gone"), ("stale", f"NOT gone AND {digest('source_sha')} AND source_sha <> now"),
    ]
    live, legal = "mode IN ('passthrough', 'translated')", "lang IN ('en', 'zh')"
    own = [
        ("unknown language", f"NOT {legal}"), ("unknown mode", f"{legal} AND mode = 'odd'"), ("sha256 is no digest", f"{legal} AND mode <> 'odd' AND sha = 'x'"),
        ("passthrough is not allowed", f"{legal} AND mode = 'passthrough' AND NOT (source_lang = 'en' AND conf = 'high' AND lang = 'en')"), ("file is missing", f"{legal} AND {live} AND held IS NULL AND NOT gone"),
        ("file was changed", f"{legal} AND {live} AND NOT gone AND {digest('sha')} AND sha <> held"), ("passthrough differs from its source", f"{legal} AND mode = 'passthrough' AND NOT gone AND held <> now"),
    ]
    found = [f"SELECT id, '{n}' AS finding FROM s WHERE {c}" for n, c in whole] + [f"SELECT id, lang || ': {n}' FROM v WHERE {c}" for n, c in own]
    return f"WITH {_STATE}, {_VARIANT} SELECT id, finding, count(*) AS n FROM ({' UNION ALL '.join(found)}) GROUP BY ALL"


@query(_contract_sql())
def contract_check(t):
    # Ids that are missing are told apart by their row, so that the joins are those of a whole contract.
    s = t("documents").select("doc_id", F.when(F.col("doc_id") % 41 == 0, "").otherwise(F.concat(F.lit("d"), "doc_id")).alias("id"), F.sha2("text", 256).alias("now"), F.expr(SOURCE_SHA.replace("sha256(text || 'old')", "sha2(text || 'old', 256)").replace("sha256(text)", "sha2(text, 256)")).alias("source_sha"), F.when(F.col("doc_id") % 10 == 0, "english").when(F.col("doc_id") % 10 == 1, "und").otherwise(F.col("lang")).alias("source_lang"), F.when(F.col("doc_id") % 6 == 0, "sure").when(F.col("doc_id") % 6 == 1, "low").otherwise("high").alias("conf"))
    mode = F.expr("CASE doc_id % 4 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'failed' WHEN 2 THEN 'translated' ELSE 'odd' END")
    sha = F.expr("CASE doc_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN sha2(id || 'e', 256) ELSE now END")
    second = F.when(F.col("doc_id") % 9 == 0, "fr").otherwise("zh")
    variants = F.array(F.struct(F.lit("en").alias("lang"), mode.alias("mode"), sha.alias("sha")), F.struct(second.alias("lang"), F.lit("translated").alias("mode"), F.sha2("id", 256).alias("sha")))
    variants = F.when(F.col("doc_id") % 43 == 0, F.lit(None)).when(F.col("doc_id") % 47 == 0, F.slice(variants, 1, 0)).otherwise(variants)
    key = F.col("doc_id").cast("string").alias("id")
    states = s.select(key, "source_sha", "source_lang", "conf", variants.alias("variants"))
    files = s.select(key, F.lit("en").alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.sha2("id", 256)).otherwise(F.col("now")).alias("sha")).where("cast(id AS bigint) % 15 <> 0")
    files = files.unionByName(s.where("doc_id % 16 <> 0").select(key, second.alias("lang"), F.sha2("id", 256).alias("sha")))
    found = contracts.contract_findings(states, s.where("doc_id % 14 <> 0").select(key, F.col("now").alias("sha")), files)
    lost = contracts.contract_findings(states.where("cast(id AS bigint) % 41 = 0").withColumn("id", F.lit("")), s.select(F.lit("-").alias("id"), F.col("now").alias("sha")).limit(0), files.limit(0)).where("finding = 'id is missing'")
    named = F.when(F.col("id") == "", "").when(F.col("id").cast("long") % 41 == 0, "").otherwise(F.concat(F.lit("d"), "id"))
    return found.unionByName(lost).select(named.alias("id"), "finding").groupBy("id", "finding").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END AS status FROM labels UNION ALL SELECT 90000000 + n_nationkey, 'pass' FROM nation) SELECT id, 'unknown id' AS problem FROM l WHERE id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT id, 'row does not pass' FROM l WHERE status IS DISTINCT FROM 'pass' UNION ALL SELECT l.id, 'check fails' FROM l JOIN labels k ON k.doc_id = l.id WHERE toxic = 1 UNION ALL SELECT doc_id, 'reference without a row' FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT id FROM l)")
def ledger_errors(t):
    marks = t("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").alias("status"))
    ledger = marks.unionByName(t("nation").select((F.lit(90000000) + F.col("n_nationkey")).cast("long").alias("id"), F.lit("pass").alias("status")))
    bank = t("documents").select(F.col("doc_id").alias("id"))
    return contracts.ledger_errors(ledger, t("labels").select(F.col("doc_id").alias("id"), (F.col("toxic") != 1).alias("ok")), bank.where("id % 3 = 0"), bank)


@query("WITH n AS (SELECT lang AS name, count(*) AS n FROM documents GROUP BY lang), c(name, k, model) AS (VALUES ('en', 0, 'm'), ('fr', 5, 'm'), ('es', 0, NULL), ('old', 0, 'm')), b AS (SELECT c.name, model, CASE WHEN k = 0 THEN coalesce(n, 1) ELSE k END AS built FROM c LEFT JOIN n USING (name)) SELECT coalesce(n.name, b.name) AS name, CASE WHEN n.name IS NULL THEN 'leftover' WHEN b.name IS NULL THEN 'missing' WHEN model IS NULL THEN 'corrupt' ELSE 'stale' END AS issue FROM n FULL JOIN b ON n.name = b.name WHERE n.name IS NULL OR b.name IS NULL OR model IS NULL OR built <> n")
def index_freshness(t):
    now = t("documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")).withColumn("wanted", F.lit(True))
    config = t("region").sparkSession.createDataFrame([("en", 0, "m"), ("fr", 5, "m"), ("es", 0, None), ("old", 0, "m")], "name string, k long, model string")
    config = config.join(now.select("name", F.col("n").alias("c")), "name", "left").select("name", F.when(F.col("k") == 0, F.coalesce("c", F.lit(1))).otherwise(F.col("k")).alias("n"), "model")
    return contracts.freshness(config, now)


# ---- incremental state ---------------------------------------------------------------------------------------------

_LOG = "SELECT event_id AS seq, user_id % 50 AS id, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'zh' END AS target, event_type AS status, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE 'v' || (user_id % 50) % 3 END AS sha FROM events"
_SOURCES = "SELECT range AS id, 'v' || range % 3 AS sha, 'p' || range AS path FROM range(40)"


def _log(t):
    own = F.col("user_id") % 50
    return t("events").select(F.col("event_id").alias("seq"), own.alias("id"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("zh").alias("target"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 5 == 0, "old").otherwise(F.concat(F.lit("v"), own % 3)).alias("sha"))


def _sources(t):
    return t("region").sparkSession.range(40).select("id", F.concat(F.lit("v"), F.col("id") % 3).alias("sha"), F.concat(F.lit("p"), "id").alias("path"))


def _reconciled_sql(full: bool) -> str:
    keep = "s.id IS NOT NULL AND l.sha = s.sha" + ("" if full else " OR s.id IS NULL")
    return f"SELECT {str(full).lower()} AS full_scan, target, CASE WHEN status = 'view' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM l LEFT JOIN s ON s.id = l.id WHERE {keep} GROUP BY ALL"


@query(f"WITH l AS ({_LOG}), s AS ({_SOURCES}) {_reconciled_sql(True)} UNION ALL {_reconciled_sql(False)}")
def reconciled_progress(t):
    log = _log(t).withColumn("status", F.when(F.col("status") == "view", "running").otherwise(F.col("status")))
    one = lambda full: contracts.reconciled(log, _sources(t), full).groupBy(F.lit(full).alias("full_scan"), "target", "status").agg(F.count("*").alias("n"))
    return one(True).unionByName(one(False))


@query(f"WITH l AS ({_LOG}), s AS ({_SOURCES}) SELECT l.seq AS id, target AS lang, CASE status WHEN 'error' THEN 'failed' ELSE 'translated' END AS mode FROM l JOIN s ON l.id = s.id AND l.sha = s.sha WHERE status = 'error' OR seq % 7 <> 0")
def kept_variants(t):
    log = _log(t)
    states = log.select(F.col("seq").alias("id"), F.col("target").alias("lang"), F.when(F.col("status") == "error", "failed").otherwise("translated").alias("mode"), F.lit("x").alias("sha"), F.col("sha").alias("source_sha"))
    sources = log.join(_sources(t).select("id", F.col("sha").alias("now")), "id").select(F.col("seq").alias("id"), F.col("now").alias("sha"))
    files = log.select(F.col("seq").alias("id"), F.col("target").alias("lang"), F.when(F.col("seq") % 7 == 0, "y").otherwise("x").alias("sha"))
    return contracts.kept_variants(states, sources, files)


@query(f"WITH l AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN NULL ELSE seq // 2 END AS id, 'p' || CASE WHEN seq % 11 = 0 THEN -1 ELSE seq // 2 END AS path, sha FROM ({_LOG})), s AS (SELECT range AS id, 'v' || range % 3 AS sha, 'p' || range AS path FROM range(300)), r AS (SELECT l.*, s.sha AS now, s.path AS place, row_number() OVER (PARTITION BY l.id ORDER BY seq) AS k FROM l LEFT JOIN s ON s.id = l.id) SELECT CASE WHEN id IS NULL THEN 'no id' WHEN k > 1 THEN 'repeated id' WHEN now IS NULL THEN 'unknown id' WHEN path <> place THEN 'another path' WHEN sha IS DISTINCT FROM now THEN 'stale' END AS error, count(*) AS n, sum(seq)::BIGINT AS seqs FROM r GROUP BY 1")
def applied_records(t):
    own = F.when(F.col("seq") % 97 == 0, F.lit(None)).otherwise(F.floor(F.col("seq") / 2)).cast("long")
    path = F.concat(F.lit("p"), F.when(F.col("seq") % 11 == 0, F.lit(-1)).otherwise(F.floor(F.col("seq") / 2)).cast("long"))
    records = _log(t).select(F.col("seq").alias("line"), own.alias("id"), path.alias("path"), "sha")
    sources = t("region").sparkSession.range(300).select("id", F.concat(F.lit("v"), F.col("id") % 3).alias("sha"), F.concat(F.lit("p"), "id").alias("path"))
    return contracts.applied(records, sources).groupBy("error").agg(F.count("*").alias("n"), F.sum("line").alias("seqs"))


@query(f"WITH l AS ({_LOG}) SELECT id, target, arg_max(status, seq) AS error FROM l GROUP BY ALL HAVING arg_max(status, seq) IN ('error', 'view')")
def open_failures(t):
    return contracts.open_failures(_log(t).withColumn("error", F.when(F.col("status").isin("error", "view"), F.col("status"))))


@query(f"WITH l AS ({_LOG}), s AS ({_SOURCES}) SELECT l.id, target, arg_max(status, seq) AS status, count(*) AS tries FROM l JOIN s ON l.id = s.id AND l.sha = s.sha GROUP BY ALL")
def target_progress(t):
    return contracts.target_progress(_log(t), _sources(t))


@query("WITH v AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'fr' WHEN doc_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, CASE doc_id % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'failed' WHEN 2 THEN 'passthrough' ELSE 'translated' END AS mode, CASE WHEN doc_id % 4 = 0 THEN 'e' ELSE ' ' END AS broken, CASE WHEN doc_id % 3 = 0 THEN 'm' END AS model, doc_id % 7 AS units, lang AS source_lang, CASE WHEN doc_id % 8 = 0 THEN 'low' ELSE 'high' END AS conf FROM documents), e AS (SELECT id, lang, CASE WHEN lang = 'fr' THEN 'unknown language' WHEN mode = 'odd' THEN 'unknown mode' WHEN mode = 'failed' AND trim(broken) = '' THEN 'failed without an error' WHEN mode = 'passthrough' AND model IS NOT NULL THEN 'passthrough with a model' WHEN mode = 'passthrough' AND NOT (source_lang = 'en' AND conf = 'high' AND lang = 'en') THEN 'passthrough is not allowed' WHEN mode = 'translated' AND model IS NULL THEN 'translated without a model' WHEN mode = 'translated' AND units = 0 THEN 'translated without units' END AS error FROM v) SELECT * FROM e WHERE error IS NOT NULL")
def variant_errors(t):
    d = F.col("doc_id")
    mode = F.expr("CASE doc_id % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'failed' WHEN 2 THEN 'passthrough' ELSE 'translated' END")
    units = F.slice(F.array(*[F.lit("u")] * 7), F.lit(1), (d % 7).cast("int"))
    rows = t("documents").select(d.alias("id"), F.when(d % 9 == 0, "fr").when(d % 2 == 0, "en").otherwise("zh").alias("lang"), mode.alias("mode"), F.when(d % 4 == 0, "e").otherwise(" ").alias("broken"), F.when(d % 3 == 0, "m").alias("model"), units.alias("units"), F.col("lang").alias("source_lang"), F.when(d % 8 == 0, "low").otherwise("high").alias("conf"))
    return contracts.variant_errors(rows)


@query("WITH p AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS a FROM documents), q AS (SELECT doc_id, a, CASE doc_id % 4 WHEN 0 THEN list_reverse(a) WHEN 1 THEN a[2:] WHEN 2 THEN list_sort(a) ELSE a END AS b FROM p) SELECT doc_id, list_sort(a) = list_sort(b) AND list_filter(a, lambda x: starts_with(x, 'Th')) = list_filter(b, lambda x: starts_with(x, 'Th')) AS same FROM q")
def placeholder_check(t):
    a = F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))
    b = F.when(F.col("doc_id") % 4 == 0, F.reverse("a")).when(F.col("doc_id") % 4 == 1, F.slice("a", F.lit(2), F.greatest(F.size("a"), F.lit(1)))).when(F.col("doc_id") % 4 == 2, F.array_sort("a")).otherwise(F.col("a"))
    rows = t("documents").select("doc_id", a.alias("a")).withColumn("b", b)
    return rows.select("doc_id", contracts.placeholders_match(F.col("a"), F.col("b"), "Th").alias("same"))


@query("WITH r AS (SELECT doc_id, lang, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 25 + 1 AS batch FROM documents) SELECT lang, batch, count(*) AS n, sha256('[' || string_agg('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}', ',' ORDER BY doc_id) || ']') AS digest FROM r GROUP BY ALL")
def batch_payloads(t):
    made = contracts.payloads(t("documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id", ["n_chars"], 25)
    return made.select("lang", "batch", "n", F.sha2("payload", 256).alias("digest"))
