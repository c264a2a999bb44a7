"""Every registered query of the library's own operators, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import curation, learning, similarity
from sluicework.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "mastery_status"

# The logical tables of sluicework.sources.tables in DuckDB SQL.
PROBLEM = "problem AS (SELECT doc_id AS id, lang AS category, source AS node, CASE WHEN n_chars < 200 THEN 1 WHEN n_chars < 500 THEN 2 WHEN n_chars < 1500 THEN 3 WHEN n_chars < 5000 THEN 4 ELSE 5 END AS difficulty, n_chars, text FROM documents)"
VERDICT = "verdict AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'claim' ELSE 'skip' END AS recommend, toxic = 1 AS needs_figure, quality, toxic FROM labels)"
ATTEMPT = "attempt AS (SELECT event_id AS seq, user_id AS student, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS id, CASE event_type WHEN 'purchase' THEN 'independent_ok' WHEN 'click' THEN 'hinted_ok' WHEN 'view' THEN 'solution_reconstructed' ELSE 'fail' END AS result, ts::DATE AS day, ts AS moment FROM events WHERE event_type <> 'signup')"
ASSESSED = "assessed AS (SELECT event_id AS seq, user_id AS student, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS id, strftime(ts, '%G-W%V') AS wave, ts::DATE AS day, least(value / 20, 1.0::DOUBLE) AS score FROM events WHERE event_type = 'signup')"
EVIDENCE = f"{PROBLEM}, {ATTEMPT}, evidence AS (SELECT a.seq, a.student, a.id, p.category, p.node, p.difficulty, CASE result WHEN 'independent_ok' THEN 1.0 WHEN 'hinted_ok' THEN 0.6 WHEN 'solution_reconstructed' THEN 0.3 ELSE 0.0 END::DOUBLE AS value, day FROM attempt a JOIN problem p ON a.id = p.id)"
STATUS = "CASE WHEN {n} = 0 THEN 'untested' WHEN {m} < 0.40::DOUBLE THEN 'weak' WHEN {m} >= 0.75::DOUBLE AND {n} >= 2 THEN 'solid' ELSE 'in progress' END"
EDGES = [("src0", "src1"), ("src1", "src2"), ("src0", "src3"), ("src3", "src2"), ("src2", "src4"), ("src5", "src6"), ("src6", "src7"), ("src4", "src7"), ("src8", "src9")]
RULES = [(r"\bof the\b", "delta", 1), (r"!!", "noop", 0), (r"\|", "delta", -1), (r"%%%", "set", 2), (r"\bwith\b", "delta", 1)]
TODAY = "2024-01-31"


def query(sql: str | None = None):
    """Registers a function of (tables by name) under its own name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: tables.table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _problems(t):
    return tables.problems(t("documents"))


def _attempts(t):
    return tables.attempts(t("events"))


def _evidence(t):
    return learning.evidence(_attempts(t), _problems(t))


def _r(c: str, name: str | None = None):
    return F.round(c, 4).alias(name or c)


MASTERY = "sum(value * difficulty) / sum(difficulty)"


@query(f"WITH {EVIDENCE}, m AS (SELECT student, {MASTERY} AS m, count(*) AS n, coalesce(max(CASE WHEN value >= 0.999 THEN difficulty END), 0) AS best, max(day) AS last_day FROM evidence GROUP BY student) SELECT student, round(m, 4) AS mastery, n, best::INT AS best, last_day, {STATUS.format(m='m', n='n')} AS status FROM m")
def mastery_status(t):
    return learning.mastery(_evidence(t), "student", order="seq").select("student", learning.rounded(F.col("mastery")).alias("mastery"), "n", "best", "last_day", "status")


@query(f"WITH {EVIDENCE}, g AS (SELECT DISTINCT category, node FROM problem), m AS (SELECT category, node, {MASTERY} AS m, count(*) AS n, coalesce(max(CASE WHEN value >= 0.999 THEN difficulty END), 0) AS best, max(day) AS last_day FROM evidence GROUP BY ALL) SELECT g.category, g.node, round(m, 4) AS mastery, coalesce(n, 0) AS n, coalesce(best, 0)::INT AS best, last_day, {STATUS.format(m='m', n='coalesce(n, 0)')} AS status FROM g LEFT JOIN m ON g.category = m.category AND g.node = m.node")
def node_mastery_full(t):
    return learning.node_table(_evidence(t), _problems(t)).select("category", "node", _r("mastery"), "n", "best", "last_day", "status")


@query(f"WITH {PROBLEM}, {ASSESSED}, x AS (SELECT wave, category, sum(score * difficulty) / sum(difficulty) AS m, count(*) AS n, min(day) AS d FROM assessed a JOIN problem p ON a.id = p.id GROUP BY ALL) SELECT wave, category, round(m, 4) AS mastery, n, min(d) OVER (PARTITION BY wave) AS first_day FROM x")
def wave_baseline(t):
    assessed = tables.assessments(t("events")).join(_problems(t).select("id", "category", "difficulty"), "id")
    return learning.waves(assessed).select("wave", "category", _r("mastery"), "n", "first_day")


@query(f"WITH {EVIDENCE} SELECT category, round({MASTERY}, 4) AS mastery, count(*) AS n FROM evidence GROUP BY category")
def current_by_category(t):
    return learning.mastery(_evidence(t), "category").select("category", _r("mastery"), "n")


@query(f"WITH {EVIDENCE}, g AS (SELECT DISTINCT category, node FROM problem), m AS (SELECT category, node, {MASTERY} AS m, count(*) AS n FROM evidence GROUP BY ALL) SELECT g.category, count(n) AS tested, count(*) AS total, count(*) FILTER (m >= 0.75 AND n >= 2) AS solid FROM g LEFT JOIN m ON g.category = m.category AND g.node = m.node GROUP BY g.category")
def coverage_by_category(t):
    table = learning.node_table(_evidence(t), _problems(t))
    return table.groupBy("category").agg(F.count_if(F.col("n") > 0).alias("tested"), F.count("*").alias("total"), F.count_if(F.col("status") == "solid").alias("solid"))


@query(f"WITH {EVIDENCE} SELECT category, node, count(*) AS n, count(*) FILTER (value >= 0.75) AS high, count(*) FILTER (value <= 0.40) AS low FROM evidence GROUP BY ALL HAVING count(*) >= 6 AND count(*) FILTER (value >= 0.75) >= 2 AND count(*) FILTER (value <= 0.40) >= 2")
def split_suggestions(t):
    return learning.split_suggestions(_evidence(t), "category", "node")


@query(f"WITH {ATTEMPT} SELECT seq, student, id, result, row_number() OVER (PARTITION BY student, id ORDER BY day, seq) AS turn FROM attempt")
def attempt_history(t):
    return learning.history(_attempts(t), "student", "id").select("seq", "student", "id", "result", "turn")


@query(f"WITH {ATTEMPT}, x AS (SELECT student, id, result, lag(result) OVER (PARTITION BY student, id ORDER BY day, seq) AS prior FROM attempt) SELECT DISTINCT student, id FROM x WHERE result = 'independent_ok' AND prior = 'independent_ok'")
def graduated_keys(t):
    return learning.graduated(_attempts(t), "student", "id")


DUE = "due AS (SELECT student, id, arg_max(result, (day, seq)) AS result, max(day) AS last FROM attempt GROUP BY ALL), dued AS (SELECT student, id, result, (last + CASE result WHEN 'independent_ok' THEN 21 WHEN 'hinted_ok' THEN 7 WHEN 'solution_reconstructed' THEN 3 ELSE 2 END)::DATE AS due FROM due)"


@query(f"WITH {ATTEMPT}, {DUE} SELECT * FROM dued")
def next_due(t):
    return learning.next_due(_attempts(t), "student", "id")


@query(f"WITH {ATTEMPT}, {DUE}, x AS (SELECT student, id, result, lag(result) OVER (PARTITION BY student, id ORDER BY day, seq) AS prior FROM attempt) SELECT * FROM dued d WHERE due <= DATE '{TODAY}' AND NOT EXISTS (SELECT 1 FROM x WHERE x.student = d.student AND x.id = d.id AND x.result = 'independent_ok' AND prior = 'independent_ok')")
def review_queue(t):
    return learning.review_queue(_attempts(t), TODAY, "student", "id").select("student", "id", "result", "due")


@query(f"WITH {ATTEMPT}, d AS (SELECT DISTINCT student, day FROM attempt), i AS (SELECT student, day, day - (row_number() OVER (PARTITION BY student ORDER BY day))::INT AS g FROM d), r AS (SELECT student, g, count(*) AS n, max(day) AS last FROM i GROUP BY ALL) SELECT student, max(n) AS longest, coalesce(max(n) FILTER (last = DATE '2024-01-30'), 0) AS current FROM r GROUP BY student")
def streak_days(t):
    return learning.streaks(_attempts(t), "2024-01-30", "student")


@query(f"WITH {ATTEMPT} SELECT strftime(day, '%G-W%V') AS week, count(*) AS n FROM attempt GROUP BY ALL")
def iso_week_counts(t):
    return _attempts(t).groupBy(T.iso_week(F.col("day")).alias("week")).agg(F.count("*").alias("n"))


@query(f"WITH {ATTEMPT}, x AS (SELECT student, seq, (epoch_us(moment) - epoch_us(lag(moment) OVER (PARTITION BY student ORDER BY moment, seq))) / 60000000.0::DOUBLE AS m FROM attempt) SELECT student, seq, round(m, 4) AS minutes, coalesce(m < 15, false) AS early FROM x")
def hint_gap_early(t):
    return learning.early_hints(_attempts(t), "student").select("student", "seq", _r("minutes"), "early")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def latest_per_session(t):
    return t("conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'finished' ELSE 'open' END AS state FROM conversations GROUP BY conv_id")
def session_state(t):
    c = t("conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"), F.when(F.max_by("role", "turn") == "assistant", "finished").otherwise("open").alias("state"))


@query(f"WITH {PROBLEM} SELECT id, node, difficulty::INT AS difficulty FROM problem WHERE category = 'en' AND difficulty = 3 AND contains(lower(text), 'the')")
def query_filter(t):
    return _problems(t).where("category = 'en' AND difficulty = 3").where(F.lower("text").contains("the")).select("id", "node", "difficulty")


@query(f"WITH {PROBLEM} SELECT difficulty::INT AS difficulty, category, count(*) AS n FROM problem GROUP BY CUBE (difficulty, category)")
def difficulty_pivot_margins(t):
    return _problems(t).cube("difficulty", "category").agg(F.count("*").alias("n"))


@query(f"WITH {PROBLEM} SELECT id, category, difficulty::INT AS difficulty, n_chars FROM problem WHERE difficulty BETWEEN 2 AND 5 ORDER BY difficulty, n_chars DESC, id LIMIT 20")
def candidate_browse(t):
    return _problems(t).where("difficulty BETWEEN 2 AND 5").orderBy("difficulty", F.desc("n_chars"), "id").select("id", "category", "difficulty", "n_chars").limit(20)


@query(f"WITH {PROBLEM} SELECT count(*) AS matched, greatest(count(*) - 20, 0) AS truncated FROM problem WHERE difficulty BETWEEN 2 AND 5")
def candidate_count_truncated(t):
    return _problems(t).where("difficulty BETWEEN 2 AND 5").agg(F.count("*").alias("matched"), F.greatest(F.count("*") - 20, F.lit(0).cast("long")).alias("truncated"))


@query(f"WITH {PROBLEM}, {VERDICT} SELECT CASE WHEN least(p.difficulty, 1 + v.quality * 2) < 2 THEN 'dropped' ELSE 'kept' END AS side, count(*) AS n FROM problem p JOIN verdict v ON p.id = v.id GROUP BY ALL")
def floor_split(t):
    rows = _problems(t).join(tables.verdicts(t("labels")), "id")
    return rows.groupBy(F.when(curation.below_floor(F.col("difficulty"), 1 + F.col("quality") * 2), "dropped").otherwise("kept").alias("side")).agg(F.count("*").alias("n"))


@query(f"WITH {PROBLEM}, {VERDICT} SELECT p.category, p.node, count(DISTINCT v.id) AS bank, count(*) AS cand, count(*) FILTER (difficulty <= 3) AS easy, count(DISTINCT v.id) <= 2 AS thin FROM problem p LEFT JOIN verdict v ON p.id = v.id AND v.recommend = 'claim' GROUP BY ALL")
def supply_gap_report(t):
    claimed = tables.verdicts(t("labels")).where("recommend = 'claim'").select("id", F.col("id").alias("v"))
    rows = _problems(t).join(claimed, "id", "left").groupBy("category", "node").agg(F.countDistinct("v").alias("bank"), F.count("*").alias("cand"), F.count_if(F.col("difficulty") <= 3).alias("easy"))
    return rows.withColumn("thin", F.col("bank") <= 2)


@query(f"WITH {PROBLEM} SELECT node, string_agg(difficulty || ':' || n, ',' ORDER BY difficulty) AS stars FROM (SELECT node, difficulty, count(*) AS n FROM problem GROUP BY ALL) GROUP BY node")
def node_star_map(t):
    counts = _problems(t).groupBy("node", "difficulty").agg(F.count("*").alias("n"))
    return counts.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("difficulty", "n"))), lambda x: F.concat_ws(":", x["difficulty"], x["n"])), ",").alias("stars"))


@query(f"WITH {PROBLEM}, {VERDICT} SELECT p.id, (abs(p.difficulty - (1 + 2 * v.quality)) >= 2 OR v.needs_figure) AS review, least(p.difficulty, 1 + 2 * v.quality) < 2 AS low FROM problem p JOIN verdict v ON p.id = v.id")
def review_flags(t):
    rows = _problems(t).join(tables.verdicts(t("labels")), "id")
    reviewed = 1 + 2 * F.col("quality")
    return rows.select("id", curation.needs_review(F.col("difficulty"), reviewed, F.lit("agree"), F.lit("clean"), F.col("needs_figure")).alias("review"), curation.below_floor(F.col("difficulty"), reviewed).alias("low"))


@query(f"WITH {PROBLEM}, {VERDICT} SELECT p.id, p.category, coalesce(v.recommend, 'unreviewed') AS recommend FROM problem p LEFT JOIN verdict v ON p.id = v.id")
def verdict_merge(t):
    return curation.merged(_problems(t), tables.verdicts(t("labels"))).select("id", "category", F.coalesce("recommend", F.lit("unreviewed")).alias("recommend"))


@query(f"WITH {PROBLEM}, {VERDICT} SELECT count(*) AS n, count(*) FILTER (g = 0) AS same, count(*) FILTER (g = 1) AS near, count(*) FILTER (g >= 2) AS far, count(*) FILTER (recommend = 'skip') AS skipped, count(*) FILTER (needs_figure) AS figures FROM (SELECT abs(p.difficulty - (1 + 2 * v.quality)) AS g, v.* FROM problem p JOIN verdict v ON p.id = v.id)")
def agreement_stats(t):
    rows = _problems(t).join(tables.verdicts(t("labels")), "id").withColumn("reviewed", 1 + 2 * F.col("quality"))
    return curation.agreement(rows, "difficulty", "reviewed")


@query(f"WITH {PROBLEM}, {VERDICT} SELECT p.id, CASE WHEN v.id IS NULL THEN 'missing' WHEN v.recommend = 'skip' THEN 'skip' WHEN v.needs_figure THEN 'review' WHEN p.difficulty < 2 THEN 'floor' WHEN regexp_matches(p.text, '[|]') THEN 'render' ELSE 'accepted' END AS reason FROM problem p LEFT JOIN verdict v ON p.id = v.id")
def admission_reasons(t):
    rows = curation.merged(_problems(t), tables.verdicts(t("labels")))
    reason = curation.first_reason(("missing", F.col("recommend").isNull()), ("skip", F.col("recommend") == "skip"), ("review", F.col("needs_figure")), ("floor", F.col("difficulty") < 2), ("render", F.col("text").contains("|")))
    return rows.select("id", F.coalesce(reason, F.lit("accepted")).alias("reason"))


@query(f"WITH {PROBLEM}, {VERDICT}, last AS (SELECT category, count(*) AS last FROM problem WHERE id % 7 = 0 GROUP BY category), r AS (SELECT p.id, p.category, row_number() OVER (PARTITION BY p.category ORDER BY p.id) AS turn FROM problem p JOIN verdict v ON p.id = v.id WHERE v.recommend = 'claim') SELECT r.id, r.category, coalesce(last, 0) + turn AS number FROM r LEFT JOIN last ON r.category = last.category WHERE turn <= 5")
def quota_numbering(t):
    p = _problems(t)
    last = p.where("id % 7 = 0").groupBy("category").agg(F.count("*").alias("last"))
    rows = p.join(tables.verdicts(t("labels")).where("recommend = 'claim'"), "id")
    return curation.quota_numbered(rows, "category", "id", 5, last).select("id", "category", "number")


TIES = ["R", "A", "N"]


@query("WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, votes FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1")
def vote_category(t):
    return curation.vote(t("lineitem"), "l_orderkey", "l_returnflag", TIES)


@query("WITH x AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY p, l_returnflag) AS tags FROM x GROUP BY l_orderkey")
def ordered_distinct_tags(t):
    first = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("p"))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "l_returnflag"))), lambda x: x["l_returnflag"]), ",").alias("tags"))


@query("SELECT p_type AS tag, count(*) AS n, CASE WHEN p_type IN ('ECONOMY') THEN 'map' WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'board' ELSE 'unmapped' END AS kind FROM part GROUP BY ALL")
def tag_map_priority(t):
    part = t("part").select(F.col("p_type").alias("tag"))
    spark = part.sparkSession
    known = [("map", spark.createDataFrame([("ECONOMY",)], "k string")), ("board", spark.createDataFrame([("STANDARD",), ("ECONOMY",)], "k string"))]
    return curation.resolved(part.groupBy("tag").agg(F.count("*").alias("n")), known, "tag")


NORM = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\b(19|20)\d{{2}}\b', ' ', 'g'), '\b\d{{1,3}}(st|nd|rd|th)\b', ' ', 'g'), '\b[ivxl]{{1,6}}\b', ' ', 'g'), '[-–—_/,.#]', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query("WITH x AS (SELECT s_suppkey AS id, s_name || ' 2019, 3rd XIV-cup' AS raw FROM supplier) SELECT id, " + NORM.format(c="raw") + r" AS name, regexp_extract(raw, '\b((?:19|20)\d{2})\b', 1)::INT AS year FROM x")
def norm_names(t):
    raw = F.concat("s_name", F.lit(" 2019, 3rd XIV-cup"))
    return t("supplier").select(F.col("s_suppkey").alias("id"), T.norm_name(raw).alias("name"), T.year_of(raw).alias("year"))


@query("SELECT p_partkey AS id, list_distinct(['the third ' || p_name, 'third ' || p_name, p_name]).len() AS n, p_name AS plain FROM part")
def name_variants(t):
    v = T.name_variants(F.concat(F.lit("the third "), "p_name"))
    return t("part").select(F.col("p_partkey").alias("id"), F.size(v).cast("long").alias("n"), F.element_at(v, -1).alias("plain"))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key FROM part UNION SELECT DISTINCT p_name FROM part), m AS (SELECT name, key FROM n JOIN k ON contains(' ' || name || ' ', ' ' || key || ' ') WHERE length(key) >= 4) SELECT name, arg_min(key, (-length(key), key)) AS key FROM m GROUP BY name")
def family_longest_match(t):
    part = t("part")
    keys = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).union(part.select("p_name"))
    return curation.family(part.select(F.col("p_name").alias("name")), "name", keys, "key", least=4)


def _grade_sql() -> str:
    steps = [f"g0 AS (SELECT doc_id, text, 2 AS e, 'high' AS c, false AS s FROM documents)"]
    for k, (pattern, kind, value) in enumerate(RULES):
        hit = f"(NOT s AND regexp_matches(text, '{pattern}'))"
        e = {"set": str(value), "delta": f"greatest(1, least(5, e + {value}))", "noop": "e"}[kind]
        c = {"set": "high", "delta": "mid", "noop": "low"}[kind]
        s = "true" if kind == "set" else "false"
        steps.append(f"g{k + 1} AS (SELECT doc_id, text, CASE WHEN {hit} THEN {e} ELSE e END AS e, CASE WHEN {hit} THEN '{c}' ELSE c END AS c, CASE WHEN {hit} THEN {s} ELSE s END AS s FROM g{k})")
    return f"WITH {', '.join(steps)} SELECT doc_id, e::INT AS est, c AS conf FROM g{len(RULES)}"


@query(_grade_sql())
def grade_fold(t):
    g = curation.graded(F.lit(2), F.col("text"), RULES)
    return t("documents").select("doc_id", g["est"].alias("est"), g["conf"].alias("conf"))


@query("WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT doc_id, t, position('with' IN lower(t)) AS hit FROM d) SELECT doc_id, CASE WHEN greatest(1, hit - 40) > 1 THEN '…' ELSE '' END || substring(t, greatest(1, hit - 40), least(length(t), hit + 119) - greatest(1, hit - 40) + 1) || CASE WHEN least(length(t), hit + 119) < length(t) THEN '…' ELSE '' END AS snippet FROM h WHERE hit > 0")
def search_snippet(t):
    return t("documents").select("doc_id", T.snippet(F.col("text"), "with").alias("snippet")).where("snippet IS NOT NULL")


NORMALISED = "regexp_replace(lower(text), '\\s+', '', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {NORMALISED}")
def search_dedup_first(t):
    return t("documents").groupBy(F.sha2(F.regexp_replace(F.lower("text"), r"\s+", ""), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(f"WITH g AS (SELECT min(doc_id) AS canonical, count(*) AS size FROM documents GROUP BY {NORMALISED} HAVING count(*) > 1) SELECT printf('DG-%05d', row_number() OVER (ORDER BY canonical)) AS group_id, canonical, size FROM g")
def dup_groups_exact(t):
    return similarity.exact_groups(t("documents"), "doc_id", "text")


@query("SELECT item_id, text[:30] AS head, len(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: w IN ('the','of','and','to','in','is','that','for','with','as','are','be','by','this','from','it','on','at','an','was'))) AS votes FROM benchmark")
def stopword_vote(t):
    return t("benchmark").select("item_id", F.substring("text", 1, 30).alias("head"), T.english_votes(F.col("text")).alias("votes"))


@query("SELECT doc_id, " + ", ".join(rf"len(regexp_extract_all(text, '\p{{{s}}}')) AS {s.lower()}" for s in ("Latin", "Cyrillic", "Greek", "Han")) + " FROM documents")
def script_evidence(t):
    return t("documents").select("doc_id", *[c.alias(k) for k, c in T.script_counts(F.col("text")).items()])


@query(r"SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def pages_links(t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))


@query(r"WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href FROM l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE regexp_replace(p.url, '^https?://[^/]+', '') = href)")
def dead_links(t):
    pages = t("pages")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    return links.join(pages.select(F.regexp_replace("url", "^https?://[^/]+", "").alias("href")).distinct(), "href", "left_anti")


_NUMBERS = r"SELECT DISTINCT {k}, unnest(regexp_extract_all(text, '\d{{2,}}')) AS token FROM {t}"


@query(f"WITH d AS ({_NUMBERS.format(k='doc_id', t='documents')}), b AS ({_NUMBERS.format(k='item_id', t='benchmark')}) SELECT doc_id, count(*) AS n FROM d WHERE token IN (SELECT token FROM b) GROUP BY doc_id")
def leak_tokens(t):
    """How many of the benchmark's numbers, of two digits or more, stand in a document."""
    held = t("benchmark").select(F.explode(T.numbers(F.col("text"))).alias("token")).distinct()
    return t("documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("token")).join(held, "token", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH x AS (SELECT conv_id, turn, regexp_extract_all(text || ' ' || (conv_id * 7 + turn % 3), '\\d{{2,}}') AS ns, turn = min(turn) OVER w AS first, turn = max(turn) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id)), k AS (SELECT DISTINCT conv_id, first, last, unnest(ns) AS token FROM x), a AS (SELECT conv_id, token FROM k WHERE last EXCEPT SELECT conv_id, token FROM k WHERE first) SELECT conv_id, string_agg(token, ',' ORDER BY token) AS leaked FROM a SEMI JOIN (SELECT * FROM k WHERE NOT first AND NOT last) h USING (conv_id, token) GROUP BY conv_id")
def hint_leaks(t):
    """Numbers of a conversation's last turn, but not of its first, that a turn between gives away."""
    w = W.partitionBy("conv_id")
    text = F.concat("text", F.lit(" "), (F.col("conv_id") * 7 + F.col("turn") % 3).cast("string"))
    x = t("conversations").select("conv_id", "turn", T.numbers(text).alias("ns"), (F.col("turn") == F.min("turn").over(w)).alias("first"), (F.col("turn") == F.max("turn").over(w)).alias("last"))
    k = x.select("conv_id", "first", "last", F.explode("ns").alias("token"))
    of = lambda c: k.where(c).select("conv_id", "token").distinct()
    found = of("last").join(of("first"), ["conv_id", "token"], "left_anti").join(of("not first and not last"), ["conv_id", "token"], "left_semi")
    return found.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("leaked"))


@query(f"WITH {PROBLEM} SELECT id, unnest(list_filter([CASE WHEN n_chars < 20 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN n_chars <> length(text) THEN 'length' END], lambda x: x IS NOT NULL)) AS message FROM problem")
def lint_rules(t):
    rules = F.array(F.when(F.col("n_chars") < 20, "short"), F.when(F.col("text").contains("|"), "table"), F.when(F.col("text").contains("!!"), "shouting"), F.when(F.col("n_chars") != F.length("text"), "length"))
    return _problems(t).select("id", F.explode(F.array_compact(rules)).alias("message"))


@query("WITH n AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size), s AS (SELECT unnest(generate_series(1, (SELECT count(*) FROM n))) AS i) SELECT i::INT AS i FROM s WHERE i NOT IN (SELECT p_size FROM n)")
def number_gaps(t):
    sizes = t("part").select("p_size").distinct()
    want = sizes.agg(F.count("*").alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return want.join(sizes, F.col("i") == F.col("p_size"), "left_anti")


@query("(SELECT n_name AS name, 'unused' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) UNION ALL (SELECT n_name, 'used' FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))")
def tree_drift(t):
    used = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit("used"))
    return t("nation").join(used, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.coalesce("hit", F.lit("unused")).alias("side"))


@query(f"WITH {PROBLEM}, {VERDICT}, a AS (SELECT id FROM problem WHERE difficulty >= 4), b AS (SELECT id FROM verdict WHERE quality = 1) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'unchecked' WHEN a.id IS NULL THEN 'orphan' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.id = b.id")
def ledger_full_outer(t):
    a = _problems(t).where("difficulty >= 4").select("id", F.lit(True).alias("l"))
    b = tables.verdicts(t("labels")).where("quality = 1").select("id", F.lit(True).alias("r"))
    return a.join(b, "id", "full").select("id", F.when(F.col("r").isNull(), "unchecked").when(F.col("l").isNull(), "orphan").otherwise("ok").alias("state"))


COSINE = "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("SELECT b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 20")
def vector_topk(t):
    return similarity.top_similar(_vectors(t), 0).select("id", _r("score"))


@query(f"{COSINE} SELECT a, b, round(s, 4) AS score FROM p WHERE s > 0.40")
def cosine_pairs(t):
    return similarity.cosine_pairs(_vectors(t), 0.40).select("a", "b", _r("score"))


@query(COSINE.replace("WITH p", "WITH RECURSIVE p") + ", e AS (SELECT a, b FROM p WHERE s > 0.40 UNION SELECT b, a FROM p WHERE s > 0.40), w(node, other) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY node")
def dup_components(t):
    return similarity.duplicate_components(_vectors(t), 0.40)


VALUES = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
DEPTH = f"e(src, dst) AS (VALUES {VALUES}), r AS (SELECT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)), w(node, depth) AS (SELECT DISTINCT node, 0 FROM r UNION ALL SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node), depths AS (SELECT node, max(depth) AS depth FROM w GROUP BY node)"


def _edges(t):
    return t("nation").sparkSession.createDataFrame(EDGES, "src string, dst string")


@query(f"WITH RECURSIVE {DEPTH} SELECT node, depth::INT AS depth FROM depths")
def prereq_depth(t):
    return similarity.depth(_edges(t))


@query(f"WITH RECURSIVE {EVIDENCE}, {DEPTH}, g AS (SELECT DISTINCT category, node FROM problem), m AS (SELECT category, node, {MASTERY} AS m, count(*) AS n FROM evidence GROUP BY ALL), s AS (SELECT g.category, g.node, {STATUS.format(m='m', n='coalesce(n, 0)')} AS status FROM g LEFT JOIN m ON g.category = m.category AND g.node = m.node), f AS (SELECT category, node, id, row_number() OVER (PARTITION BY category, node ORDER BY difficulty, id) AS r FROM problem WHERE id NOT IN (SELECT id FROM attempt)), c AS (SELECT category, node, string_agg(id, ',' ORDER BY r) AS picks FROM f WHERE r <= 2 GROUP BY ALL) SELECT s.category, s.node, s.status, coalesce(d.depth, 0)::INT AS depth, coalesce(c.picks, '') AS picks, row_number() OVER (ORDER BY s.category, CASE s.status WHEN 'weak' THEN 0 ELSE 1 END, coalesce(d.depth, 0), s.node) AS rank FROM s LEFT JOIN depths d ON d.node = s.node LEFT JOIN c ON c.category = s.category AND c.node = s.node WHERE s.status IN ('weak', 'untested')")
def gap_queue(t):
    return learning.gap_queue(learning.node_table(_evidence(t), _problems(t)), similarity.depth(_edges(t)), _problems(t), _attempts(t))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 50")
def hash_sample(t):
    return t("documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))).limit(50)


@query(f"WITH {PROBLEM}, w AS (SELECT difficulty, count(*) AS w FROM problem GROUP BY difficulty) SELECT difficulty::INT AS difficulty, greatest(1, round_even(30.0 * w / sum(w) OVER (), 0))::BIGINT AS quota FROM w")
def plan_quota(t):
    counts = _problems(t).groupBy("difficulty").agg(F.count("*").alias("w"))
    return counts.select("difficulty", F.greatest(F.lit(1.0), F.bround(F.col("w") * 30.0 / F.sum("w").over(W.partitionBy()), 0)).cast("long").alias("quota"))


@query(f"WITH {PROBLEM}, r AS (SELECT id, difficulty, category, row_number() OVER (PARTITION BY difficulty, category ORDER BY md5('w:' || id), id) AS rn FROM problem) SELECT id, difficulty::INT AS difficulty, category FROM r QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY rn, md5('c:' || category)) <= 6")
def plan_week(t):
    hashed = lambda p, c: F.md5(F.concat(F.lit(p), F.col(c).cast("string")))
    r = _problems(t).select("id", "difficulty", "category").withColumn("rn", F.row_number().over(W.partitionBy("difficulty", "category").orderBy(hashed("w:", "id"), "id"))).where("rn <= 6")
    return r.withColumn("turn", F.row_number().over(W.partitionBy("difficulty").orderBy("rn", hashed("c:", "category")))).where("turn <= 6").select("id", "difficulty", "category")


@query("WITH r AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 25 AS batch, role FROM conversations) SELECT role, batch, count(*) AS n, sha256(string_agg(conv_id || '/' || turn, ',' ORDER BY conv_id, turn)) AS batch_id FROM r GROUP BY ALL")
def batches_of_25(t):
    r = similarity.numbered(t("conversations").select("conv_id", "turn", "role"), ["role", "conv_id", "turn"], "k")
    first = r.groupBy("role").agg(F.min("k").alias("first"))  # one row a role
    r = r.join(F.broadcast(first), "role").withColumn("batch", F.floor((F.col("k") - F.col("first")) / 25).cast("long"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn"))), lambda x: F.concat_ws("/", x["conv_id"], x["turn"]))
    return r.groupBy("role", "batch").agg(F.count("*").alias("n"), F.sha2(F.array_join(items, ","), 256).alias("batch_id"))


@query("WITH n AS (SELECT doc_id, sha256(text) AS sha FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN sha256(sha || '-') ELSE sha END AS old FROM n WHERE doc_id % 11 <> 0) SELECT doc_id, CASE WHEN old IS NULL THEN 'new' WHEN old <> sha THEN 'changed' ELSE 'same' END AS state FROM n LEFT JOIN b USING (doc_id)")
def incremental_diff(t):
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    before = docs.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("sha", F.lit("-")), 256)).otherwise(F.col("sha")).alias("old"))
    return docs.join(before, "doc_id", "left").select("doc_id", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha"), "changed").otherwise("same").alias("state"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'failed' WHEN bool_and(o_orderstatus = 'O') THEN 'completed' ELSE 'remaining' END AS state FROM orders GROUP BY o_custkey")
def progress_rollup(t):
    s = F.col("o_orderstatus")
    return t("orders").groupBy("o_custkey").agg(F.when(F.bool_or(s == "F"), "failed").when(F.bool_and(s == "O"), "completed").otherwise("remaining").alias("state"))


@query("WITH x AS (SELECT conv_id, turn, length(text) / nullif(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0)::DOUBLE AS r FROM conversations) SELECT conv_id, turn, round(r, 4) AS ratio FROM x WHERE r < 0.18 OR r > 4.0")
def length_ratio_outliers(t):
    n = F.length("text")
    r = F.try_divide(n.cast("double"), F.lag(n).over(W.partitionBy("conv_id").orderBy("turn")))
    return t("conversations").select("conv_id", "turn", r.alias("r")).where("r < 0.18 OR r > 4.0").select("conv_id", "turn", _r("r", "ratio"))


#: Formulas in several spellings, put after the text of some documents, so that there are some to share.
_SPELT = [(2, r"$\dfrac{1}{2} \le x$"), (3, r"$$\frac{1}{2}\leq x,$$"), (5, r"\(a^2 + b^2\)"), (7, r"\begin{align}a^2+b^2&\\x_1 = 2\end{align}")]


def _sql_formulas() -> str:
    """Lists of formulas by the same steps; RE2 can't look ahead, so what follows a macro is taken and put back."""
    text = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN doc_id % {m} = 0 THEN '{f}' END" for m, f in _SPELT) + ")"
    macro = [(r"\\(?:left|right|bigg?|Bigg?|displaystyle|textstyle|limits|quad|qquad|,|;|:|!)([^A-Za-z]|$)", r"\1"), (r"\\[dt]frac([^A-Za-z]|$)", r"\\frac\1"), (r"\\le([^A-Za-z]|$)", r"\\leq\1"), (r"\\ge([^A-Za-z]|$)", r"\\geq\1"), (r"\s+", ""), (r"^[.,;:]+|[.,;:]+$", "")]
    norm = "y"
    for pattern, new in macro:
        norm = f"regexp_replace({norm}, '{pattern}', '{new}', 'g')"
    inner = " || ".join(f"regexp_extract(m, '{T.DISPLAY}', {k})" for k in (1, 2, 3))
    return (
        f"a AS (SELECT doc_id, {text} AS s FROM documents), b AS (SELECT doc_id, regexp_extract_all(s, '{T.ENVIRONMENTS}', 1) AS e, regexp_replace(s, '{T.ENVIRONMENTS}', ' ', 'g') AS s FROM a), "
        f"c AS (SELECT doc_id, e || list_transform(regexp_extract_all(s, '{T.DISPLAY}'), lambda m: {inner}) || regexp_extract_all(regexp_replace(s, '{T.DISPLAY}', ' ', 'g'), '{T.INLINE}', 1) AS l FROM b), "
        f"f AS (SELECT doc_id, list_distinct(list_filter(list_transform(flatten(list_transform(l, lambda x: string_split(replace(x, '&', ''), '\\\\'))), lambda y: {norm}), lambda z: length(z) >= 3)) AS f FROM c)"
    )


@query(f"WITH {_sql_formulas()} SELECT a.doc_id AS \"left\", b.doc_id AS \"right\", len(list_intersect(a.f, b.f)) / least(len(a.f), len(b.f))::DOUBLE AS overlap FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 WHERE len(a.f) > 0 AND len(b.f) > 0")
def formula_overlap(t):
    """Shared formulas of pairs of candidates, each a document and the next, over their whole texts and what is put after some."""
    some = [F.when(F.col("doc_id") % m == 0, f) for m, f in _SPELT]
    docs = t("documents").select("doc_id", T.formulas(F.concat_ws(" ", "text", *some)).alias("f")).where(F.size("f") > 0)
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("f").alias("g"))
    return docs.join(after, "doc_id").select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"), T.overlap(F.col("f"), F.col("g")).alias("overlap"))
