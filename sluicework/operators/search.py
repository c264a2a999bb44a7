"""Search of a corpus and of its candidates: rows and their counts in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluicework.functions.text import snippet, squeezed
from sluicework.operators.workflow import variant_path
from sluicework.session import written

# How sure an estimate of difficulty is, from least to most.
CONFIDENCE = ["low", "mid", "high"]


def confidence_rank(conf: Column) -> Column:
    """0 for low, 1 for mid, 2 for high; null for anything else."""
    return F.coalesce(*[F.when(conf == c, k) for k, c in enumerate(CONFIDENCE)])


def limited(rows: DataFrame, order: list[Column], limit: int, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The first rows with ``hit``, and an observation of what is counted over all rows, filled by the first action on them.

    To the counts come ``matched`` (rows with hit) and ``truncated`` (those beyond the limit). A limit of 0 shows all.
    """
    told = Observation()
    matched = F.count_if("hit")
    beyond = F.greatest(matched - limit, F.lit(0)) if limit else F.lit(0)
    seen = rows.observe(told, *[c.alias(n) for n, c in counts.items()], matched.alias("matched"), beyond.cast("long").alias("truncated"))
    if limit:
        return seen.where("hit").orderBy(*order).limit(limit), told
    # A full sort would read its input twice, to sample it first, and count it twice.
    return written(seen.where("hit"), "search-hits").orderBy(*order), told


def corpus_search(index: DataFrame, bodies: DataFrame, lang: str, where: Column | None = None, keyword: str | None = None, coverage: str | None = None, limit: int = 20, width: int = 120) -> tuple[DataFrame, Observation]:
    """((id, path, state, snippet) in the order of lines, observed counts: missing, failed, invalid, matched, truncated).

    ``index`` is (line, id, path, variants: map of language to mode, other columns that ``where`` may ask for), ``bodies`` (path, text). Rows
    without an id or path, or for which ``where`` does not hold, are passed over; of an id the first line counts. A path that
    leads out of the corpus is invalid. A variant whose state is failed is no hit, though a file may be there; one without a
    file is missing. With a keyword, hits are texts that hold it; without, all texts, and with ``coverage`` missing or failed these too.
    """
    rows = index.where(F.col("id").isNotNull() & (F.col("id").cast("string") != "") & F.col("path").isNotNull())
    if where is not None:
        rows = rows.where(where)
    first = rows.groupBy("id").agg(F.min_by(F.struct("line", "path", "variants"), "line").alias("r")).select("id", "r.*")
    mode = F.lit("passthrough") if lang == "orig" else F.get(F.filter(F.map_values(F.map_filter("variants", lambda k, _: k == lang)), lambda v: v.isNotNull()), F.lit(0))
    outside = F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda p: p == "..")
    named = first.select("id", "line", outside.alias("outside"), mode.alias("mode"), variant_path(F.col("path"), F.lit(lang)).alias("path"))
    met = named.join(bodies.select("path", "text"), "path", "left")
    state = F.when(F.col("outside"), "invalid").when(F.col("mode") == "failed", "failed").when(F.col("text").isNull(), "missing").otherwise("present")
    met = met.withColumn("state", state)
    head = F.concat(F.substring(squeezed(F.col("text")), 1, width), F.when(F.length(squeezed(F.col("text"))) > width, "…").otherwise(""))
    found = snippet(F.col("text"), keyword, width) if keyword else head
    listed = F.col("state") == coverage if coverage in ("missing", "failed") and not keyword else F.lit(False)
    met = met.withColumn("snippet", F.when(F.col("state") == "present", found)).withColumn("hit", ((F.col("state") == "present") & F.col("snippet").isNotNull()) | listed)
    counts = {s: F.count_if(F.col("state") == s) for s in ("missing", "failed", "invalid")}
    shown, told = limited(met, [F.col("line")], limit, counts)
    return shown.select("id", "path", "state", "snippet"), told


def candidates(pool: DataFrame, images: bool = False, conf: str = "mid", category: str | None = None, difficulty: tuple[int, int] = (2, 5), node: str | None = None, contest: str | None = None, lang: str | None = None, grep: str | None = None, limit: int = 20) -> tuple[DataFrame, Observation]:
    """(candidates, observed counts: matched, truncated) of a pool that all filters let through, the easiest and surest first.

    ``pool`` is (id, status, has_images, conf, category, est, topics, contest, comp_norm, lang, head). Only rows of status ok are
    looked at; ``node``, ``contest`` and ``lang`` are parts of names, the last two whatever their case, ``grep`` is a pattern for the head.
    Order: estimate, surest first, normalised contest (none last), id.
    """
    part = lambda c, q: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    rules = [F.col("status") == "ok", confidence_rank(F.col("conf")) >= confidence_rank(F.lit(conf)), F.col("est").between(*difficulty)]
    rules += [] if images else [~F.col("has_images")]
    rules += [F.col("category") == category] if category else []
    rules += [F.exists("topics", lambda t: F.contains(t, F.lit(node)))] if node else []
    rules += [part("contest", contest) | part("comp_norm", contest)] if contest else []
    rules += [part("lang", lang)] if lang else []
    rules += [F.col("head").rlike(f"(?i){grep}")] if grep else []
    hit = rules[0]
    for rule in rules[1:]:
        hit = hit & rule
    order = [F.col("est"), F.desc("rank"), F.col("comp_norm").isNull() | (F.col("comp_norm") == ""), F.col("comp_norm"), F.col("id")]
    rows = pool.withColumns({"hit": F.coalesce(hit, F.lit(False)), "rank": confidence_rank(F.col("conf"))})
    shown, told = limited(rows, order, limit, {})
    return shown.drop("hit", "rank"), told
