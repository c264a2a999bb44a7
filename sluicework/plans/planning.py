"""Registered queries of planning, sessions and profiles, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import learning, planning
from sluicework.plans.catalog import ASSESSED, ATTEMPT, EVIDENCE, MASTERY, PROBLEM, STATUS, TODAY, _attempts, _evidence, _problems, query
from sluicework.sources import tables


def _session(t):
    return t("region").sparkSession


@query(f"WITH {ATTEMPT}, {ASSESSED}, a AS (SELECT student, count(*) AS n FROM attempt GROUP BY student), b AS (SELECT student, count(*) AS n, count(DISTINCT wave) AS waves FROM assessed GROUP BY student) SELECT coalesce(a.student, b.student) AS student, coalesce(a.n, 0) AS attempts, coalesce(b.n, 0) AS assessments, coalesce(waves, 0) AS waves FROM a FULL JOIN b ON a.student = b.student")
def students(t):
    return planning.students(_attempts(t), tables.assessments(t("events")))


NAMES = [("ann", 1), ("ann", 11), ("ben", 2), ("cid", 3), ("cid", 23), ("cid", 24)]


@query(f"WITH {PROBLEM}, {ATTEMPT}, n(person, student) AS (VALUES " + ", ".join(f"('{p}', {s})" for p, s in NAMES) + ") SELECT person, count(p.id) AS kept, count(*) - count(p.id) AS skipped FROM attempt a JOIN n USING (student) LEFT JOIN problem p ON p.id = a.id GROUP BY person")
def own_evidence(t):
    return planning.own_evidence(_attempts(t), _problems(t), _session(t).createDataFrame(NAMES, "person string, student long"))


STARS = [2, 3, 4]
_LEDGER = "ledger AS (SELECT source AS node, CASE WHEN sum(n_chars) % 2 = 0 THEN 'weak' ELSE 'untested' END AS status, CASE WHEN source <> 'src3' THEN dense_rank() OVER (ORDER BY source) END AS rank, [min(doc_id), max(doc_id), min(doc_id) + 1] AS picks FROM documents GROUP BY source)"
_PICKS = f"e AS (SELECT status <> 'weak' AS later, rank, generate_subscripts(picks, 1) AS pos, unnest(picks) AS id FROM ledger WHERE rank IS NOT NULL), f AS (SELECT id, min((later, rank, pos)) AS turn FROM e GROUP BY id), picks AS (SELECT row_number() OVER (ORDER BY turn) AS place, id, difficulty FROM f JOIN problem USING (id) WHERE difficulty IN (2, 3, 4) AND id NOT IN (SELECT id FROM attempt WHERE result = 'independent_ok'))"


def _picks(t):
    ledger = t("documents").groupBy("source").agg(F.sum("n_chars").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    rank = F.when(F.col("source") != "src3", F.dense_rank().over(W.orderBy("source")))  # one row a source
    ledger = ledger.select(F.when(F.col("n") % 2 == 0, "weak").otherwise("untested").alias("status"), rank.alias("rank"), F.array("a", "b", F.col("a") + 1).alias("picks"))
    return planning.gap_picks(ledger, _problems(t), _attempts(t).where("result = 'independent_ok'"), STARS, 100)


@query(f"WITH {PROBLEM}, {ATTEMPT}, {_LEDGER}, {_PICKS} SELECT place::INT AS place, id, difficulty::INT AS difficulty FROM picks")
def gap_picks(t):
    return _picks(t)


PROFILE, SIZE, WEEKS = {2: 3.0, 3: 2.0, 4: 1.0}, 14, 2


def _weeks_sql() -> str:
    quota = planning.quotas(PROFILE, SIZE)
    limit = "CASE difficulty " + " ".join(f"WHEN {d} THEN {k}" for d, k in quota.items()) + " END"
    share = max(1, round(SIZE * planning.GAP_SHARE))
    out, left = [PROBLEM, ATTEMPT, _LEDGER, _PICKS, "pool0 AS (SELECT id, difficulty, category FROM problem WHERE difficulty IN (2, 3, 4))"], "pool0"
    for w in range(1, WEEKS + 1):
        out += [
            f"o{w} AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY place) AS k FROM picks WHERE id IN (SELECT id FROM {left}) QUALIFY k <= {limit})",
            f"g{w} AS (SELECT id, difficulty FROM o{w} QUALIFY row_number() OVER (ORDER BY place) <= {share})",
            f"t{w} AS (SELECT id, difficulty, category, row_number() OVER (PARTITION BY difficulty, category ORDER BY md5('w:' || id), id) AS k FROM {left} WHERE id NOT IN (SELECT id FROM g{w}) QUALIFY k <= {limit})",
            f"r{w} AS (SELECT id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY k, md5('w:' || category)) AS turn FROM t{w} QUALIFY turn <= {limit} - (SELECT count(*) FROM g{w} WHERE g{w}.difficulty = t{w}.difficulty))",
            f"w{w} AS (SELECT {w} AS week, id, difficulty, true AS gap FROM g{w} UNION ALL SELECT {w}, id, difficulty, false FROM r{w})", f"pool{w} AS (SELECT * FROM {left} WHERE id NOT IN (SELECT id FROM w{w}))",
        ]
        left = f"pool{w}"
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT week, id, difficulty::INT AS difficulty, gap FROM w{w}" for w in range(1, WEEKS + 1))


@query(_weeks_sql())
def weeks_with_gaps(t):
    pool = _problems(t).where(F.col("difficulty").isin(STARS)).select("id", "difficulty", "category")
    return planning.weeks(pool, _picks(t), PROFILE, SIZE, WEEKS)


@query("WITH s AS (SELECT ts::DATE || '-' || user_id || '-' || (event_id % 4 + 1) AS session FROM events WHERE event_type = 'click'), m AS (SELECT regexp_extract(session, '^(.*)-([0-9]+)$', 1) AS stem, max(regexp_extract(session, '-([0-9]+)$', 1)::BIGINT) AS n FROM s GROUP BY 1), a AS (SELECT DISTINCT ts::DATE AS day, user_id AS pid FROM events WHERE event_type = 'view') SELECT day, pid, day || '-' || pid || '-' || (coalesce(n, 0) + 1) AS session FROM a LEFT JOIN m ON m.stem = day || '-' || pid")
def session_ids(t):
    e = t("events").withColumn("day", F.to_date("ts"))
    sessions = e.where("event_type = 'click'").select(F.concat_ws("-", F.col("day").cast("string"), "user_id", (F.col("event_id") % 4 + 1).cast("string")).alias("session"))
    return planning.next_session_id(sessions, e.where("event_type = 'view'").select("day", F.col("user_id").alias("pid")).distinct())


_SPENT = "greatest(1, round_even((epoch_us(b) - epoch_us(a)) / 60e6, 0))::BIGINT"


@query(f"WITH s AS (SELECT user_id AS id, min(ts) AS a, min(ts) + INTERVAL 1 SECOND * (sum(event_id) % 7201)::INT AS b, count(*) FILTER (event_type = 'click') % 4 AS hints, user_id % 3 = 0 AS revealed, CASE user_id % 6 WHEN 0 THEN true WHEN 3 THEN false END AS retold, CASE WHEN user_id % 5 <> 0 THEN 45 END AS lim FROM events GROUP BY user_id), v AS (SELECT *, {_SPENT} AS spent FROM s) SELECT id, spent, CASE WHEN revealed THEN CASE WHEN user_id9 THEN NULL WHEN retold THEN 'solution_reconstructed' ELSE 'fail' END WHEN hints <= 1 AND NOT coalesce(spent > lim, false) THEN 'independent_ok' ELSE 'hinted_ok' END AS result FROM (SELECT *, id % 9 = 0 AS user_id9 FROM v)")
def finish_verdicts(t):
    u = F.col("user_id")
    a, second = F.min("ts").cast("timestamp"), F.make_dt_interval(secs=(F.sum("event_id") % 7201).cast("decimal(18,6)"))
    s = t("events").groupBy("user_id").agg(a.alias("a"), (a + second).alias("b"), (F.count_if(F.col("event_type") == "click") % 4).alias("hints"))
    retold = F.when(u % 9 == 0, F.lit(None).cast("boolean")).when(u % 6 == 0, True).otherwise(False)
    s = s.withColumn("spent", planning.minutes(F.col("a"), F.col("b")))
    return s.select(u.alias("id"), "spent", planning.verdict(u % 3 == 0, retold, F.col("hints"), F.col("spent"), F.when(u % 5 != 0, F.lit(45))).alias("result"))


@query(f"WITH {ATTEMPT}, bank AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0), x AS (SELECT id, result, lag(result) OVER (PARTITION BY id ORDER BY day, seq) AS prior FROM attempt), g AS (SELECT DISTINCT id FROM x WHERE result = 'independent_ok' AND prior = 'independent_ok'), l AS (SELECT id, arg_max(result, (day, seq)) AS result, max(day) AS day FROM attempt GROUP BY id), d AS (SELECT id, (day + CASE result WHEN 'independent_ok' THEN 21 WHEN 'hinted_ok' THEN 7 WHEN 'solution_reconstructed' THEN 3 ELSE 2 END)::DATE AS due FROM l) SELECT 'graduated' AS kind, id, NULL::DATE AS due FROM g WHERE id IN (SELECT id FROM bank) AND id % 5 <> 0 UNION ALL SELECT 'due', id, due FROM d WHERE due <= DATE '{TODAY}' AND id NOT IN (SELECT id FROM g) AND id IN (SELECT id FROM bank)")
def review_report(t):
    bank = t("documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    return planning.review_report(_attempts(t), bank, bank.where("id % 5 = 0"), TODAY)


@query("SELECT doc_id, source FROM documents WHERE NOT contains(text, '1. ') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def hint_batch(t):
    wanted = t("labels").where("quality = 1").select("doc_id")
    return t("documents").where(~F.col("text").contains("1. ")).select("doc_id", "source").join(wanted, "doc_id", "left_semi")


@query("SELECT doc_id, 'Statement' AS heading, trim(lang || ' ' || source) AS body FROM documents UNION ALL SELECT doc_id, 'Hints', n_chars::VARCHAR FROM documents WHERE doc_id % 2 = 0")
def cards(t):
    d = F.col("doc_id")
    body = F.concat(F.lit("# T\n## Statement\n"), "lang", F.lit(" "), "source", F.lit("\n\n## Answer\nsecret "), "source", F.when(d % 2 == 0, F.concat(F.lit("\n## Hints\n"), "n_chars")).otherwise(""))
    return planning.cards(t("documents"), "doc_id", T.sections(body), ["Statement", "Hints"])


@query("WITH e AS (SELECT event_id AS seq, user_id % 300 AS ref, CASE WHEN event_id % 13 = 0 THEN -value ELSE value / 20 END AS score, event_id % 3 = 0 AS bare FROM events WHERE event_type = 'signup') SELECT seq, CASE WHEN NOT coalesce(score BETWEEN 0 AND 1, false) THEN 'score outside 0 to 1' ELSE 'item needs category, difficulty and topics' END AS error FROM e WHERE NOT coalesce(score BETWEEN 0 AND 1, false) OR (bare AND ref NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0))")
def assess_entries(t):
    bare = F.col("event_id") % 3 == 0
    rows = t("events").where("event_type = 'signup'").select(F.col("event_id").alias("seq"), (F.col("user_id") % 300).alias("ref"), F.when(F.col("event_id") % 13 == 0, -F.col("value")).otherwise(F.col("value") / 20).alias("score"), F.when(~bare, "en").alias("category"), F.lit(3).alias("difficulty"), F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("topics"))
    return planning.entry_errors(rows, t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")))


@query(f"WITH {EVIDENCE} SELECT category, node, seq, round(value, 2) AS value, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY category, node ORDER BY day DESC, seq DESC) AS turn FROM evidence) WHERE turn <= 10")
def profile_cases(t):
    return planning.newest(_evidence(t), ["category", "node"]).select("category", "node", "seq", F.round("value", 2).alias("value"), "turn")


@query("WITH s AS (SELECT user_id AS id, min(ts) AS a, max(ts) FILTER (event_type = 'click') AS h, max(ts) AS n FROM events GROUP BY user_id) SELECT id, greatest(0, floor((epoch_us(n) - epoch_us(a)) / 1e6))::BIGINT AS elapsed, greatest(0, 900 - floor((epoch_us(n) - epoch_us(coalesce(h, a))) / 1e6))::BIGINT AS cooldown FROM s")
def cooldowns(t):
    at = lambda c: c.cast("timestamp")
    s = t("events").groupBy(F.col("user_id").alias("id")).agg(at(F.min("ts")).alias("a"), at(F.max(F.when(F.col("event_type") == "click", F.col("ts")))).alias("h"), at(F.max("ts")).alias("n"))
    return s.select("id", planning.elapsed(F.col("a"), F.col("n")).alias("elapsed"), planning.cooldown(F.col("a"), F.col("h"), F.col("n")).alias("cooldown"))


@query("SELECT c_custkey, greatest(3, least(20, coalesce(try_cast(CASE c_custkey % 4 WHEN 0 THEN 'many' WHEN 1 THEN '' ELSE (c_custkey % 31)::VARCHAR END AS INT), 10)))::INT AS n FROM customer")
def plan_sizes(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", planning.plan_size(F.when(k % 4 == 0, "many").when(k % 4 == 1, "").otherwise((k % 31).cast("string"))).alias("n"))


@query(f"WITH {EVIDENCE}, w(student) AS (VALUES (1), (2), (-1)), m AS (SELECT student, node, {MASTERY} AS m, count(*) AS n FROM evidence GROUP BY ALL) SELECT w.student::BIGINT AS student, node, round(m, 4) AS mastery, CASE WHEN node IS NOT NULL THEN {STATUS.format(m='m', n='n')} END AS status FROM w LEFT JOIN m ON m.student = w.student")
def student_layers(t):
    """The layer of mastery over the map for each student asked for: one empty row where there is no evidence."""
    asked = _session(t).createDataFrame([(1,), (2,), (-1,)], "student long")
    found = learning.mastery(_evidence(t), "student", "node", order="seq").select("student", "node", learning.rounded(F.col("mastery")).alias("mastery"), "status")
    return asked.join(found, "student", "left")


@query("SELECT e.doc_id AS id, CASE WHEN e.doc_id % 4 = 0 THEN NULL ELSE l.doc_id IS NOT NULL END AS in_pool FROM documents e LEFT JOIN labels l ON l.doc_id = e.doc_id")
def pool_membership(t):
    """Whether a candidate is in its pool; null where that pool can't be read."""
    pools = t("labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("hit"))
    return t("documents").select(F.col("doc_id").alias("id")).join(pools, "id", "left").select("id", F.when(F.col("id") % 4 != 0, F.coalesce("hit", F.lit(False))).alias("in_pool"))
