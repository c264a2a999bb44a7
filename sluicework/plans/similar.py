"""Queries of similar vectors and texts: joins on two routes, groups with their evidence, alignment of ids and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.operators import text_join, vector_join
from sluicework.plans.catalog import query
from sluicework.session import if_few, written

# Two routes: the halves of an embedding, each masked for one label. Equal vectors are one class, named by its smallest id.
ROUTES = {"text": "score_text", "solution": "score_solution"}
THRESHOLD = 0.60
CLASSES = """c AS (SELECT min(vec_id) AS id, count(*) AS copies, CASE WHEN label <> 3 THEN embedding[1:32]::DOUBLE[] END AS t, CASE WHEN label <> 7 THEN embedding[33:64]::DOUBLE[] END AS s
 FROM embeddings GROUP BY embedding, label)"""
PAIRS = f"""{CLASSES}, p AS (SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b, list_cosine_similarity(a.t, b.t) AS score_text, list_cosine_similarity(a.s, b.s) AS score_solution
 FROM c a JOIN c b ON a.id < b.id), q AS (SELECT * FROM p WHERE score_text > {THRESHOLD}::DOUBLE OR score_solution > {THRESHOLD}::DOUBLE)"""


def _classes(t):
    v = F.col("embedding")
    half = lambda a: F.slice(v, a, 32)
    return t("embeddings").groupBy("embedding", "label").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("id", "copies", F.when(F.col("label") != 3, half(1)).alias("text"), F.when(F.col("label") != 7, half(33)).alias("solution"))


@query(f"WITH {PAIRS} SELECT a, b, copies_a, copies_b, round(score_text, 4) AS score_text, round(score_solution, 4) AS score_solution FROM q")
def vector_routes(t):
    """Pairs of classes of equal vectors whose cosine is above the threshold on either route, with both cosines."""
    classes = written(_classes(t), "routes")
    pairs = vector_join.route_pairs(classes, THRESHOLD, ROUTES)
    own = if_few(classes.select("id", "copies"))
    met = pairs.join(own.toDF("a", "copies_a"), "a").join(own.toDF("b", "copies_b"), "b")
    return met.select("a", "b", "copies_a", "copies_b", *[F.round(s, 4).alias(s) for s in ROUTES.values()])


@query(f"""WITH RECURSIVE {PAIRS}, m AS (SELECT e.vec_id AS id, c.id AS class FROM embeddings e JOIN (SELECT min(vec_id) AS id, embedding, label FROM embeddings GROUP BY embedding, label) c ON e.embedding = c.embedding AND e.label = c.label),
 edges AS (SELECT a, b, score_text, score_solution FROM q UNION ALL SELECT class, m.id, CASE WHEN t IS NOT NULL THEN 1.0::DOUBLE END, CASE WHEN s IS NOT NULL THEN 1.0::DOUBLE END FROM m JOIN c ON c.id = class WHERE class < m.id AND (t IS NOT NULL OR s IS NOT NULL)),
 e AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), w(node, other) AS (SELECT x, x FROM e UNION SELECT w.node, e.y FROM w JOIN e ON e.x = w.other),
 g AS (SELECT node, min(other) AS canonical, count(*) AS size FROM w GROUP BY node),
 best AS (SELECT canonical, max(score_text) AS score_text, max(score_solution) AS score_solution FROM edges JOIN g ON g.node = a GROUP BY canonical),
 tags AS (SELECT doc_id AS id, unnest([source, lang, 'len' || (n_chars // 1000)::VARCHAR]) AS topic FROM documents),
 shared AS (SELECT canonical, count(*) AS shared FROM (SELECT canonical, topic FROM g JOIN (SELECT DISTINCT id, topic FROM tags) x ON x.id = g.node GROUP BY canonical, topic, size HAVING count(*) = size) GROUP BY canonical),
 numbers AS (SELECT canonical, row_number() OVER (ORDER BY canonical) AS k FROM (SELECT DISTINCT canonical FROM g))
 SELECT printf('DG-%05d', k) AS group_id, g.canonical, node AS member, size, round(score_text, 4) AS score_text, round(score_solution, 4) AS score_solution, coalesce(shared, 0) AS shared, coalesce(shared, 0) > 0 AS same_topic
 FROM g JOIN best ON best.canonical = g.canonical LEFT JOIN shared ON shared.canonical = g.canonical JOIN numbers ON numbers.canonical = g.canonical""")  # fmt: skip
def evidence_groups(t):
    """Groups that the pairs of both routes connect, copies included, with the largest cosine of each route and what topics all members share."""
    classes = written(_classes(t), "routes")
    pairs = vector_join.route_pairs(classes, THRESHOLD, ROUTES, links=True)
    one = lambda c: F.when(F.col(c).isNotNull(), F.lit(1.0))
    keys = t("embeddings").groupBy("embedding", "label").agg(F.min("vec_id").alias("a"))
    copies = t("embeddings").join(keys, ["embedding", "label"]).select("a", F.col("vec_id").alias("b")).where("a < b")
    copies = copies.join(classes.select(F.col("id").alias("a"), one("text").alias("score_text"), one("solution").alias("score_solution")), "a").where("score_text is not null or score_solution is not null")
    topics = F.array(F.col("source"), F.col("lang"), F.concat(F.lit("len"), F.floor(F.col("n_chars") / 1000).cast("string")))
    meta = t("documents").select(F.col("doc_id").alias("id"), topics.alias("topics"), T.formulas(F.col("text")).alias("formulas"))
    pairs = written(pairs.unionByName(copies.select(pairs.columns)), "evidence-pairs")
    return vector_join.evidence_groups(pairs, list(ROUTES.values()), meta).drop("score_formula")


@query("""WITH i AS (SELECT DISTINCT doc_id AS id FROM documents), v AS (SELECT vec_id AS id, max(label <> 3) AS t, max(label <> 7) AS s FROM embeddings GROUP BY vec_id),
 m AS (SELECT i.id AS d, v.id AS e, t, s FROM i FULL JOIN v ON i.id = v.id)
 SELECT count(d) AS indexed, count_if(d IS NOT NULL AND e IS NOT NULL)::BIGINT AS covered, count_if(d IS NOT NULL AND t)::BIGINT AS with_text, count_if(d IS NOT NULL AND s)::BIGINT AS with_solution,
 count_if(d IS NOT NULL AND e IS NULL)::BIGINT AS without_vector, count_if(d IS NULL)::BIGINT AS not_indexed, round(count_if(d IS NOT NULL AND e IS NOT NULL) * 100.0::DOUBLE / count(d), 1) AS percent FROM m""")  # fmt: skip
def index_coverage(t):
    """How the ids of documents and of embeddings cover each other, on each route."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") != 3, F.slice("embedding", 1, 32)).alias("text"), F.when(F.col("label") != 7, F.slice("embedding", 33, 32)).alias("solution"))
    return vector_join.coverage(t("documents").select(F.col("doc_id").alias("id")), v, ["text", "solution"])


@query("""WITH i AS (SELECT DISTINCT doc_id AS id FROM documents), v AS (SELECT DISTINCT vec_id AS id FROM embeddings)
 SELECT coalesce(i.id, v.id) AS id, CASE WHEN v.id IS NULL THEN 'without vector' WHEN i.id IS NULL THEN 'not indexed' ELSE 'aligned' END AS state FROM i FULL JOIN v ON i.id = v.id""")
def index_alignment(t):
    """Each id of documents and embeddings with the side that lacks it."""
    left, right = t("documents").select(F.col("doc_id").alias("id")).distinct().withColumn("i", F.lit(True)), t("embeddings").select(F.col("vec_id").alias("id")).distinct().withColumn("v", F.lit(True))
    state = F.when(F.col("v").isNull(), "without vector").when(F.col("i").isNull(), "not indexed").otherwise("aligned")
    return left.join(right, "id", "full").select("id", state.alias("state"))


@query()
def dup_groups_lexical(t):
    """Groups of documents whose texts, lower-cased and without white space, match by 0.99 or more."""
    return text_join.lexical_groups(t("documents").select(F.col("doc_id").alias("id"), "text"))
