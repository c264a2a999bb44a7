"""More registered queries: text quality, registry contracts, planning and session state, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import curation, learning, quality, similarity
from sluicework.plans.catalog import ATTEMPT, EVIDENCE, MASTERY, PROBLEM, STATUS, TODAY, VALUES, _attempts, _edges, _evidence, _problems, _vectors, query
from sluicework.session import small_batches
from sluicework.sources import tables
from sluicework.streaming import sessions

ALIASES = [("en", "src1", "alpha"), ("en", "src2", "beta"), ("fr", "src1", "src3"), ("de", "src2", "src4"), ("de", "src5", "src1"), ("es", "src6", "src6")]
ALIAS_SQL = "alias(ord, category, node, alias) AS (VALUES " + ", ".join(f"({k}, '{c}', '{n}', '{a}')" for k, (c, n, a) in enumerate(ALIASES)) + ")"
# A word's bounds are spelt out, for the engines' own \b differ beyond ASCII.
KEYWORDS = [(c, rf"(^|[^\p{{L}}]){w}([^\p{{L}}]|$)" if w.isalpha() else w, tag) for c, w, tag in [("en", "the", "article"), ("de", "und", "joined"), ("fr", "dans", "inside"), ("es", "para", "aim"), ("en", r"\d{4}", "year")]]
PROFILES = [("gentle", 1, 2), ("gentle", 2, 30), ("even", 2, 15), ("even", 3, 15), ("steep", 4, 20), ("steep", 5, 500)]


def _inline(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


def _aliases(t):
    return _inline(t, [(k, *a) for k, a in enumerate(ALIASES)], "ord int, category string, node string, alias string")


def _sql_clean(c: str) -> str:
    for p in quality.NOISE:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return c


def _sql_score(lang: str) -> str:
    hits = ", ".join(f"'{w}'" for w in quality.WORDS[lang].split())
    terms = [f"list_sum(list_transform([{hits}], lambda w: least(3, len(list_filter(words, lambda x: x = w)))))"]
    terms += [f"2 * len(regexp_extract_all(folded, '{p}'))" for p in quality.PHRASES[lang]]
    if lang in quality.CHARS:
        terms.append(f"2 * len(regexp_extract_all(lower(clean), '[{quality.CHARS[lang]}]'))")
    return f"({' + '.join(terms)})::BIGINT AS {lang}, len(list_filter([{hits}], lambda w: list_contains(words, w))) AS d_{lang}"


LANGS = list(quality.WORDS)
SCORED = (
    f"a AS (SELECT doc_id, lang AS declared, {_sql_clean('text')} AS clean FROM documents), b AS (SELECT *, replace(translate(lower(clean), '{quality.ACCENTED}', '{quality.PLAIN}'), 'ß', 'ss') AS folded FROM a), "
    + r"c AS (SELECT *, regexp_extract_all(folded, '\p{L}+') AS words FROM b), "
    + f"scored AS (SELECT doc_id, declared, clean, words, {', '.join(_sql_score(x) for x in LANGS)} FROM c)"
)


@query(f"WITH {SCORED} SELECT doc_id, {', '.join(LANGS)} FROM scored")
def latin_language_score(t):
    rows = quality.language_scores(t("documents"), "text")
    return rows.select("doc_id", *[F.get("_scores", F.lit(k))["score"].cast("long").alias(x) for k, x in enumerate(LANGS)])


_BEST = "greatest(" + ", ".join(LANGS) + ")"
_WON = "CASE " + " ".join(f"WHEN {x} = {_BEST} THEN '{x}'" for x in LANGS) + " END"
_DENSE = "CASE " + " ".join(f"WHEN {x} = {_BEST} THEN d_{x}" for x in LANGS) + " END"


@query(
    f"WITH {SCORED}, r AS (SELECT *, {_BEST} AS best, list_sort([{', '.join(LANGS)}], 'DESC')[2] AS second, {_WON} AS won, ({_DENSE})::DOUBLE / greatest(len(words), 1) AS density, "
    + r"length(regexp_replace(clean, '[^\p{L}]', '', 'g')) AS letters FROM scored), "
    + "v AS (SELECT declared, CASE WHEN letters < 4 THEN 'und:low' WHEN best < 3 OR best - second < 2 THEN CASE WHEN won = 'en' AND len(words) <= 3 AND list_has_any(words, ['find', 'let', 'prove']) AND best - second >= 1 AND density >= 0.5 THEN 'en:high' ELSE 'und:low' END "
    "WHEN density >= CASE WHEN won = 'en' THEN 0.4 ELSE 0.5 END OR (best >= 7 AND best - second >= 4) THEN won || ':high' ELSE won || ':medium' END AS v FROM r) "
    "SELECT declared, split_part(v, ':', 1) AS detected, split_part(v, ':', 2) AS conf, count(*) AS n FROM v GROUP BY ALL"
)
def detect_language_confusion(t):
    docs = t("documents").select("doc_id", F.col("lang").alias("declared"), "text")
    return quality.detect_language(docs, "text").groupBy("declared", F.col("lang").alias("detected"), "conf").agg(F.count("*").alias("n"))


def _turns(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.lag("text").over(w).alias("before"), "text").where("before is not null")


#: What is done to a document's translation, by its id, and what that has to be found as.
_SOURCE = "'# T' || chr(10) || chr(10) || '## Statement' || chr(10) || text || ' $x_1$ ![](a.png)' || chr(10) || chr(10) || '## 最终答案' || chr(10) || '$42$' || chr(10)"
_DONE = [
    ("translated", None), ("replace(r, '$x_1$', '$x_2$')", [("math_mismatch", "Statement")]), ("replace(r, '![](a.png)', '![](b.png)')", [("image_mismatch", "Statement")]),
    ("replace(r, '# T', '# U')", [("structure_mismatch", "H1")]), ("''", [("empty_translation", "文档")]), ("replace(r, '$42$', '$43$')", [("math_mismatch", "最终答案"), ("final_answer_mismatch", "最终答案")]),
    ("'```' || chr(10) || r || chr(10) || '```'", None), ("r || 'As an AI I write.'", [("model_meta_leak", "最终答案"), ("final_answer_mismatch", "最终答案")]),
]
_USED = [0, 1, 2, 3, 4, 5, 7]


@query("WITH d AS (SELECT doc_id FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS finding, '{section}' AS section FROM d WHERE doc_id % {len(_USED)} = {k}" for k, use in enumerate(_USED) for kind, section in _DONE[use][1] or []))
def translation_findings(t):
    # All documents; their own marks of formulas, code and headings become blanks, so that what is done to each is what there is to find.
    own = F.regexp_replace("text", r"[$`~\[\]\\#!]", " ")
    docs = t("documents").withColumn("text", F.coalesce(own, F.lit(""))).select("doc_id", F.expr(_SOURCE.replace("chr(10)", "'\\n'")).alias("s"))
    # The prose changes everywhere, so that only what was done to it can be found.
    r = F.regexp_replace("s", r"## Statement\n", "## Statement\nIndeed. ")
    done = F.lit(None).cast("string")
    for k, use in reversed(list(enumerate(_USED))):
        done = F.when(F.col("doc_id") % len(_USED) == k, F.col("r") if use == 0 else F.expr(_DONE[use][0].replace("chr(10)", "'\\n'"))).otherwise(done)
    pairs = docs.withColumn("r", r).select("doc_id", "s", done.alias("t"))
    return quality.translation_findings(pairs, "s", "t").select("doc_id", "finding", "section")


@query("WITH y AS (SELECT a.doc_id, list_filter(list_distinct(regexp_extract_all(a.text, '\\d{2,}')), lambda n: NOT list_contains(regexp_extract_all(b.text, '\\d{2,}'), n)) AS m FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, array_to_string(list_sort(m), ',') AS missing FROM y WHERE len(m) > 0")
def anchor_missing(t):
    docs = t("documents").select("doc_id", "text")
    rows = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after")), "doc_id")
    found = rows.select("doc_id", quality.missing_anchors(F.col("text"), F.col("after")).alias("m"))
    return found.where(F.size("m") > 0).select("doc_id", F.array_join("m", ",").alias("missing"))


NORM = "regexp_replace(lower({c}), '\\s+', '', 'g')"


@query(f"SELECT lang, sha256({NORM.format(c='text')}) AS digest, count(*) AS copies, count(DISTINCT source) AS sources FROM documents WHERE length(trim(text)) > 0 GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT source) >= 2")
def batch_boilerplate(t):
    return quality.boilerplate(t("documents"), "lang", "source", "text")


@query(f"WITH {PROBLEM}, f AS (SELECT unnest(list_filter([CASE WHEN n_chars < 20 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN n_chars <> length(text) THEN 'length' END], lambda x: x IS NOT NULL)) AS finding FROM problem) SELECT finding, count(*) AS n FROM f GROUP BY finding")
def finding_rollup(t):
    rules = F.array(F.when(F.col("n_chars") < 20, "short"), F.when(F.col("text").contains("|"), "table"), F.when(F.col("n_chars") != F.length("text"), "length"))
    return quality.rolled_up(_problems(t).select(F.explode(F.array_compact(rules)).alias("finding")))


@query()
def hashed_features(t):
    return quality.encode_features(t("documents"), "doc_id", "text")


_PROTECTED = r"⟦\d+⟧|(?s:```.*?```)|(?s:\$\$.*?\$\$)|(?s:\\\[.*?\\\])|\$[^$\n]+\$|(?s:\\\(.*?\\\))|!\[[^\]]*\]\([^\n)]*\)|`[^`\n]+`"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_PROTECTED}'))::INT AS n, sha256(text) AS restored_sha256 FROM documents")
def protected_spans(t):
    docs = t("documents")
    small_batches(docs.sparkSession)  # a worker holds one batch of texts, whatever the table's size
    kept = docs.select("doc_id", quality.protected("text").alias("p"))
    return kept.select("doc_id", F.size("p.spans").alias("n"), F.sha2(quality.restored("p.text", "p.spans"), 256).alias("restored_sha256"))


@query(f"WITH {ALIAS_SQL}, names AS (SELECT node, node AS name FROM alias UNION SELECT node, alias FROM alias) SELECT doc_id FROM documents d WHERE contains(source, 'beta') OR EXISTS (SELECT 1 FROM names n JOIN names m ON n.node = m.node WHERE contains(lower(n.name), 'beta') AND contains(d.source, m.name))")
def alias_query(t):
    return curation.topic_match(t("documents").select("doc_id", "source"), "source", "beta", _aliases(t)).select("doc_id")


@query(f"WITH {ALIAS_SQL}, p AS (SELECT DISTINCT lang, source FROM documents) SELECT p.lang, p.source, arg_min(a.node, (a.category <> p.lang, a.ord)) AS node, arg_min(a.category, (a.category <> p.lang, a.ord)) AS category FROM p LEFT JOIN alias a ON a.alias = p.source GROUP BY ALL")
def alias_resolve_fallback(t):
    return curation.resolve_nodes(t("documents").select("lang", "source").distinct(), "lang", "source", _aliases(t))


@query(f"WITH {ALIAS_SQL} SELECT source AS topic, count(*) AS n FROM documents WHERE source NOT IN (SELECT alias FROM alias UNION SELECT node FROM alias) GROUP BY source")
def unregistered_topics(t):
    known = _aliases(t).select(F.col("alias").alias("topic")).union(_aliases(t).select("node")).distinct()
    return t("documents").select(F.col("source").alias("topic")).join(known, "topic", "left_anti").groupBy("topic").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'passthrough' WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'stale' ELSE 'translated' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coverage_state(t):
    rows = t("documents").select("doc_id", "lang").join(t("labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", curation.first_reason(("passthrough", F.col("lang") == "en"), ("missing", F.col("hit").isNull()), ("failed", F.col("toxic") == 1), ("stale", F.col("quality") == 0), ("translated", F.lit(True))).alias("state"))


@query("WITH m AS (SELECT doc_id AS id, 'bank' AS mark, 0 AS p FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'reviewed-skip', 1 FROM labels WHERE toxic = 0) SELECT id, arg_min(mark, p) AS mark FROM m GROUP BY id")
def in_bank_priority(t):
    return curation.marked([("bank", t("labels").where("quality = 1").select(F.col("doc_id").alias("id"))), ("reviewed-skip", t("labels").where("toxic = 0").select(F.col("doc_id").alias("id")))], "id")


@query(" UNION ALL ".join(f"SELECT doc_id, '{tag}' AS tag FROM documents WHERE lang = '{c}' AND regexp_matches(text, '{p}')" for c, p, tag in KEYWORDS))
def keyword_recall(t):
    return curation.keyword_tags(t("documents"), "text", "lang", KEYWORDS).select("doc_id", "tag")


@query("WITH d AS (SELECT doc_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents) SELECT doc_id, 'A' AS heading, sha256(body) AS digest FROM d UNION ALL SELECT doc_id, 'B', sha256(source) FROM d")
def section_split(t):
    """Sections of whole documents; of a heading that repeats the last counts."""
    docs = t("documents")
    body = F.concat(F.lit("# T\n\n## A\nfirst\n## B\n"), "source", F.lit("\n\n## A\n"), "text")
    return docs.select("doc_id", F.explode(T.sections(body)).alias("heading", "body")).select("doc_id", "heading", F.sha2("body", 256).alias("digest"))


@query("WITH s AS (SELECT DISTINCT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT d.doc_id, CASE WHEN s.source IS NULL THEN 'unreadable' WHEN l.doc_id IS NULL THEN 'absent' ELSE 'covered' END AS state FROM documents d LEFT JOIN s ON d.source = s.source LEFT JOIN labels l ON d.doc_id = l.doc_id")
def credential_coverage(t):
    docs, marks = t("documents").select("doc_id", "source"), t("labels").select("doc_id", F.lit(True).alias("marked"))
    joined = docs.join(marks, "doc_id", "left")
    ledgers = joined.where("marked").select("source", F.lit(True).alias("readable")).distinct()
    return joined.join(ledgers, "source", "left").select("doc_id", F.when(F.col("readable").isNull(), "unreadable").when(F.col("marked").isNull(), "absent").otherwise("covered").alias("state"))


@query("WITH e(k, want) AS (VALUES ('en', 'a'), ('fr', 'b'), ('it', 'c')), a AS (SELECT lang AS k, CASE WHEN min(lang) = 'fr' THEN 'x' ELSE 'a' END AS got FROM documents GROUP BY lang) SELECT coalesce(e.k, a.k) AS k, want, got FROM e FULL JOIN a ON e.k = a.k WHERE want IS DISTINCT FROM got")
def contract_diff(t):
    actual = t("documents").select(F.col("lang").alias("k")).distinct().select("k", F.when(F.col("k") == "fr", "x").otherwise("a").alias("got"))
    return curation.contract_diff(_inline(t, [("en", "a"), ("fr", "b"), ("it", "c")], "k string, want string"), actual, "k", "want", "got")


def _steps(t):
    """Edges (src, dst) of the turns of a passage, eight of a conversation: from each to the next, and from the longest (of equals the first) back to where its passage begins.

    Passages bound the rounds in which turns are peeled, however long a conversation is.
    """
    w = W.partitionBy("conv_id", "part").orderBy("turn")
    turns = t("conversations").select("conv_id", F.floor(F.col("turn") / 8).alias("part"), "turn", F.length("text").alias("n"))
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    on = turns.withColumn("to", F.lead("turn").over(w)).where("to is not null").select(name("turn").alias("src"), name("to").alias("dst"))
    ends = turns.groupBy("conv_id", "part").agg(F.max_by("turn", F.struct("n", -F.col("turn"))).alias("top"), F.min("turn").alias("first"))
    return on.union(ends.select(name("top").alias("src"), name("first").alias("dst")))


_TURNS = "t AS (SELECT conv_id, turn // 8 AS part, turn, length(text) AS n FROM conversations), top AS (SELECT conv_id, part, arg_max(turn, (n, -turn)) AS top, min(turn) AS first FROM t GROUP BY conv_id, part)"
_STEPS = f"{_TURNS}, e AS (SELECT conv_id || ':' || turn AS src, conv_id || ':' || lead(turn) OVER (PARTITION BY conv_id, part ORDER BY turn) AS dst FROM t UNION ALL SELECT conv_id || ':' || top, conv_id || ':' || first FROM top)"


@query(f"WITH {_STEPS} SELECT src AS node, dst AS other, 'out' AS side FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 'in' FROM e WHERE dst IS NOT NULL")
def edge_symmetric(t):
    return similarity.symmetric(_steps(t))


@query(f"WITH {_TURNS} SELECT conv_id || ':' || turn AS node, CASE WHEN top = first THEN 'loop' ELSE 'cycle' END AS kind FROM t JOIN top USING (conv_id, part) WHERE turn <= top")
def prereq_cycles(t):
    """Turns that lie on the way from a passage's beginning to its longest turn and so back; a loop where that is the first."""
    return similarity.cycle_nodes(_steps(t))


STATES = f"e(src, dst) AS (VALUES {VALUES}), g AS (SELECT DISTINCT category, node FROM problem), m AS (SELECT category, node, {MASTERY} AS m, count(*) AS n FROM evidence GROUP BY ALL), s AS (SELECT g.category, g.node, {STATUS.format(m='m', n='coalesce(n, 0)')} AS status FROM g LEFT JOIN m ON g.category = m.category AND g.node = m.node)"


@query(f"WITH {EVIDENCE}, {STATES} SELECT s.category, s.node, string_agg(p.node, ',' ORDER BY p.node) AS blocked_by FROM s JOIN e ON e.dst = s.node JOIN s p ON p.node = e.src AND p.category = s.category WHERE s.status IN ('weak', 'untested') AND p.status IN ('weak', 'untested') GROUP BY ALL")
def blocked_by(t):
    return learning.blocked_by(learning.node_table(_evidence(t), _problems(t)), _edges(t))


@query(f"WITH {EVIDENCE}, {STATES}, b AS (SELECT p.category, p.node, count(*) AS bank FROM problem p JOIN labels l ON l.doc_id = p.id AND l.quality = 1 GROUP BY ALL), c AS (SELECT category, node, count(*) AS cand FROM problem GROUP BY ALL) SELECT s.category, s.node, s.status, coalesce(bank, 0) AS bank, coalesce(cand, 0) AS cand FROM s LEFT JOIN b ON s.category = b.category AND s.node = b.node LEFT JOIN c ON s.category = c.category AND s.node = c.node")
def gap_ledger(t):
    bank = _problems(t).join(tables.verdicts(t("labels")).where("recommend = 'claim'"), "id")
    return learning.gap_ledger(learning.node_table(_evidence(t), _problems(t)), bank, _problems(t))


PLAN = (80, 120)


@query(f"WITH {ATTEMPT}, h AS (SELECT id, bool_or(day >= date_trunc('week', DATE '{TODAY}')) AS done FROM attempt GROUP BY id), x AS (SELECT id, result, lag(result) OVER (PARTITION BY id ORDER BY day, seq) AS prior FROM attempt), g AS (SELECT DISTINCT id FROM x WHERE result = 'independent_ok' AND prior = 'independent_ok') SELECT p.range AS place, p.range AS id, CASE WHEN h.id IS NULL THEN 'fresh' ELSE 'review' END AS mode FROM range({PLAN[0]}, {PLAN[1]}) p LEFT JOIN h ON h.id = p.range WHERE NOT coalesce(h.done, false) AND p.range NOT IN (SELECT id FROM g)")
def plan_remaining(t):
    plan = t("region").sparkSession.range(*PLAN).select("id", F.col("id").alias("place"))
    return learning.plan_remaining(plan, _attempts(t), TODAY).select("place", "id", "mode")


PROFILE_SQL = "prof(target, difficulty, want) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in PROFILES) + ")"


@query(f"WITH {PROBLEM}, {PROFILE_SQL}, n AS (SELECT difficulty, count(*) AS n FROM problem GROUP BY difficulty) SELECT target, sum(want)::BIGINT AS want, sum(least(want, coalesce(n, 0)))::BIGINT AS got, bool_and(want <= coalesce(n, 0)) AS full_yield FROM prof LEFT JOIN n USING (difficulty) GROUP BY target")
def plan_yield_by_target(t):
    return learning.plan_yield(_problems(t), _inline(t, PROFILES, "target string, difficulty int, want int"))


LOG = "log AS (SELECT conv_id AS session, r AS seq, CASE WHEN r = 2 THEN 'start' WHEN r = 4 THEN 'reveal' WHEN contains(text, '?') OR r = 7 THEN 'finish' ELSE 'hint' END AS event FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations))"


@query(f"WITH {LOG}, a AS (SELECT *, min(seq) FILTER (event = 'start') OVER (PARTITION BY session) AS f FROM log), b AS (SELECT *, min(seq) FILTER (event = 'finish' AND seq > f) OVER (PARTITION BY session) AS e FROM a), c AS (SELECT *, f IS NOT NULL AND seq > f AND (e IS NULL OR seq < e) AS inside FROM b) SELECT session, CASE WHEN max(f) IS NULL THEN 'none' WHEN max(e) IS NOT NULL THEN 'finished' ELSE 'open' END AS state, count(*) FILTER (inside AND event = 'hint') AS hints, coalesce(bool_or(inside AND event = 'reveal'), false) AS revealed, count(*) FILTER (NOT coalesce(inside OR seq = f OR seq = e, false)) AS illegal FROM c GROUP BY session")
def session_fold(t):
    r = t("conversations").withColumn("seq", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    event = F.when(F.col("seq") == 2, "start").when(F.col("seq") == 4, "reveal").when(F.col("text").contains("?") | (F.col("seq") == 7), "finish").otherwise("hint")
    return sessions.fold(r.select(F.col("conv_id").alias("session"), "seq", event.alias("event")))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_windows(t):
    return sessions.activity(t("events"), "ts", "1 day", "2 days", "event_type").select(F.to_date("start").alias("day"), "event_type", "n")


#: Checks of the tables: name, table and a condition on its aggregates that both engines read.
CHECKS = [
    ("customers_unique", "customer", "count(DISTINCT c_custkey) = count(*)"), ("documents_unique", "documents", "count(DISTINCT doc_id) = count(*)"),
    ("discounts_in_range", "lineitem", "min(l_discount) >= 0 AND max(l_discount) <= 1"), ("five_regions", "region", "count(*) = 5"),
    ("nations_covered", "nation", "count(DISTINCT n_regionkey) = 5"), ("quantities_positive", "lineitem", "min(l_quantity) > 0"),
    ("toxic_is_flag", "labels", "min(toxic) = 0 AND max(toxic) <= 1"), ("documents_long", "documents", "min(n_chars) > 1000"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS id, {c} AS ok FROM {b}" for n, b, c in CHECKS))
def answer_checks(t):
    return curation.checked([(n, t(b), F.expr(c)) for n, b, c in CHECKS])
