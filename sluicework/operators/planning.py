"""Planning and profiles: students, evidence of a person, gap picks, weeks, sessions, verdicts, cards and entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.operators import learning
from sluicework.session import if_few, written

# The share of a week for gaps, the least evidence for using them, minutes between hints.
GAP_SHARE, LEAST_EVIDENCE, COOLDOWN = 0.35, 10, 15


def students(attempts: DataFrame, assessed: DataFrame) -> DataFrame:
    """(student, attempts, assessments, waves) of everybody seen in either."""
    tried = attempts.groupBy("student").agg(F.count("*").alias("attempts"))
    measured = assessed.groupBy("student").agg(F.count("*").alias("assessments"), F.countDistinct("wave").alias("waves"))
    none = F.lit(0).cast("long")
    return tried.join(measured, "student", "full").select("student", *[F.coalesce(c, none).alias(c) for c in ("attempts", "assessments", "waves")])


def own_evidence(attempts: DataFrame, problems: DataFrame, aliases: DataFrame) -> DataFrame:
    """(person, kept, skipped): attempts of each person under any of their names (person, student), and those that count for nothing: an unknown problem or result."""
    own = attempts.join(if_few(aliases), "student")
    met = own.join(problems.select("id", F.lit(True).alias("known")), "id", "left")
    good = F.coalesce(F.col("known"), F.lit(False)) & learning.lookup(learning.WORTH, F.col("result")).isNotNull()
    return met.groupBy("person").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


def gap_picks(ledger: DataFrame, problems: DataFrame, excluded: DataFrame, stars: list[int], evidence: int) -> DataFrame:
    """(place, id, difficulty) of a ledger's picks (status, rank, picks: an array of ids): weak nodes first, then by rank and place; each id once; not excluded; of the profile's stars. Nothing below the least evidence."""
    each = ledger.where("rank is not null").select((F.col("status") != "weak").alias("later"), "rank", F.posexplode("picks").alias("at", "id"))
    first = each.groupBy("id").agg(F.min(F.struct("later", "rank", "at")).alias("turn"))
    known = problems.select("id", "difficulty").where(F.col("difficulty").isin(stars))
    kept = first.join(known, "id").join(excluded.select("id").distinct(), "id", "left_anti")
    kept = kept if evidence >= LEAST_EVIDENCE else kept.limit(0)
    return kept.select(F.row_number().over(W.orderBy("turn")).alias("place"), "id", "difficulty")  # a ledger has two picks a node


def quotas(profile: dict[int, float], n: int) -> dict[int, int]:
    """Items of each star in a week of n, by weight, halves to even, one at least."""
    return {d: max(1, round(n * w / sum(profile.values()))) for d, w in profile.items()}


def weeks(pool: DataFrame, gaps: DataFrame, profile: dict[int, float], n: int, count: int, seed: str = "w") -> DataFrame:
    """(week, id, difficulty, gap) of some weeks' plans from a pool (id, difficulty, category) and a queue of gaps (place, id, difficulty).

    Gaps take their share of a week first, in order, within the stars' quotas; the rest of each quota goes round the
    categories. What a week takes, later weeks don't. A week is small by its quotas; each is written.
    """
    quota = quotas(profile, n)
    left, out = pool, []
    hashed = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))
    limit = lambda c: F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])[c]
    for week in range(1, count + 1):
        open_ = gaps.join(left.select("id"), "id", "left_semi").withColumn("of", F.row_number().over(W.partitionBy("difficulty").orderBy("place"))).where(F.col("of") <= limit(F.col("difficulty")))
        share = open_.withColumn("k", F.row_number().over(W.orderBy("place"))).where(F.col("k") <= max(1, round(n * GAP_SHARE))).select("id", "difficulty")
        share = written(share, "week-gaps")
        used = share.groupBy("difficulty").agg(F.count("*").alias("used"))
        rest = left.join(share.select("id"), "id", "left_anti").withColumn("in_turn", F.row_number().over(W.partitionBy("difficulty", "category").orderBy(hashed("id"), "id"))).where(F.col("in_turn") <= limit(F.col("difficulty")))
        rest = rest.withColumn("turn", F.row_number().over(W.partitionBy("difficulty").orderBy("in_turn", hashed("category")))).join(used, "difficulty", "left")
        rest = rest.where(F.col("turn") <= limit(F.col("difficulty")) - F.coalesce("used", F.lit(0))).select("id", "difficulty")
        now = written(share.withColumn("gap", F.lit(True)).unionByName(rest.withColumn("gap", F.lit(False))).withColumn("week", F.lit(week)), "week")
        out.append(now.select("week", "id", "difficulty", "gap"))
        left = left.join(now.select("id"), "id", "left_anti")
    return reduce(DataFrame.unionByName, out)


def next_session_id(sessions: DataFrame, starts: DataFrame) -> DataFrame:
    """(day, pid, session): for each start (day, pid) the id day-pid-n, n one above the greatest that sessions (session) have."""
    taken = sessions.select(F.regexp_extract("session", r"^(.*)-(\d+)$", 1).alias("stem"), F.regexp_extract("session", r"-(\d+)$", 1).try_cast("long").alias("n")).groupBy("stem").agg(F.max("n").alias("n"))
    stem = F.concat_ws("-", F.col("day").cast("string"), F.col("pid").cast("string"))
    return starts.withColumn("stem", stem).join(taken, "stem", "left").select("day", "pid", F.concat_ws("-", "stem", (F.coalesce("n", F.lit(0)) + 1).cast("string")).alias("session"))


def minutes(start: Column, end: Column) -> Column:
    """Minutes between two times, rounded half to even, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.bround((F.unix_micros(end) - F.unix_micros(start)) / 60e6, 0).cast("long"))


def verdict(revealed: Column, retold: Column, hints: Column, spent: Column, limit: Column) -> Column:
    """The suggested result of a session: with the answer seen it depends on the retelling (null until that is known); else up to one hint within the limit is alone."""
    seen = F.when(retold.isNull(), F.lit(None).cast("string")).when(retold, "solution_reconstructed").otherwise("fail")
    return F.when(revealed, seen).when((hints <= 1) & ~F.coalesce((limit > 0) & (spent > limit), F.lit(False)), "independent_ok").otherwise("hinted_ok")


def elapsed(start: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(now) - F.unix_micros(start)) / 1e6).cast("long"))


def cooldown(start: Column, last_hint: Column, now: Column) -> Column:
    """Seconds until the next hint: from the last one, or else from the start."""
    return F.greatest(F.lit(0).cast("long"), F.lit(COOLDOWN * 60).cast("long") - F.floor((F.unix_micros(now) - F.unix_micros(F.coalesce(last_hint, start))) / 1e6).cast("long"))


def review_report(attempts: DataFrame, bank: DataFrame, listed: DataFrame, today: str) -> DataFrame:
    """(kind, id, due): bank ids that have graduated and are not yet listed, and those due by ``today``."""
    done = learning.graduated(attempts, "id").join(bank.select("id"), "id", "left_semi")
    fresh = done.join(listed.select("id"), "id", "left_anti").select(F.lit("graduated").alias("kind"), "id", F.lit(None).cast("date").alias("due"))
    due = learning.review_queue(attempts, today, "id").join(bank.select("id"), "id", "left_semi")
    return fresh.unionByName(due.select(F.lit("due").alias("kind"), "id", "due"))


def cards(documents: DataFrame, key: str, sections: Column, shown: list[str]) -> DataFrame:
    """(key, heading, body): only the sections that may leave the store."""
    return documents.select(key, F.explode(F.map_filter(sections, lambda k, v: k.isin(shown))).alias("heading", "body"))


def entry_errors(entries: DataFrame, bank: DataFrame) -> DataFrame:
    """(seq, error) of assessment entries (seq, ref, score, category, difficulty, topics) that can't be kept: a score outside 0 to 1, or an item of another source without its own category, difficulty and topics."""
    met = entries.join(bank.select(F.col("id").alias("ref"), F.lit(True).alias("known")), "ref", "left")
    outside = ~F.coalesce(F.col("score").between(0, 1), F.lit(False))
    bare = F.col("known").isNull() & (F.col("category").isNull() | F.col("difficulty").isNull() | (F.coalesce(F.size("topics"), F.lit(0)) <= 0))
    return met.select("seq", F.when(outside, "score outside 0 to 1").when(bare, "item needs category, difficulty and topics").alias("error")).where("error is not null")


def newest(cases: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """The newest cases of each group, by day and then by number, with their turn."""
    return cases.withColumn("turn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("day"), F.desc("seq")))).where(F.col("turn") <= most)


def plan_size(asked: Column) -> Column:
    """The number of items asked for, within 3 to 20; 10 where it can't be read."""
    return F.greatest(F.lit(3), F.least(F.lit(20), F.coalesce(asked.try_cast("int"), F.lit(10))))
