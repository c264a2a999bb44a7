"""Data-quality contracts: lint of front matter, document lint, tables' self-check, translation contracts, ledgers, freshness; and incremental state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.operators.similarity import numbered
from sluicework.session import if_few, written

# Fields of front matter, sections of a body, ways of verification, and the least difficulty.
REQUIRED = ["id", "title", "category", "source_ref", "difficulty", "topics", "verification", "source_url"]
ALLOWED = [*REQUIRED, "contest", "year", "difficulty_note", "dataset_id", "review_ref", "machine_check_ref"]
SECTIONS = ["## 题面", "## 答案", "## 解法要点"]
VERIFICATION = ["sourced", "independent-derivation", "dataset-reviewed"]
FLOOR, MOST_TOPICS = 2, 4
# What a translation state may hold.
CONFIDENCE, LANGUAGES, MODES = ["high", "medium", "low"], ["en", "zh"], ["passthrough", "translated", "failed"]
SHA = "^[0-9a-f]{64}$"


def messages(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, in order; a rule that is null does not."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))


def lint(rows: DataFrame, reviews: DataFrame, machines: DataFrame) -> DataFrame:
    """(path, message) of rows (path, file, prefix, fm, body); fm is a map of field to its YAML text, null if unreadable.

    reviews is (ref, id), machines (ref, id, status): the ledgers that can be read, one row for each entry; a ledger
    without entries has one of a null id. Rows of one number rule are told by ``gaps``.
    """
    fm = lambda k: F.col("fm")[k]
    has = lambda k: F.coalesce(F.trim(fm(k)).isin("", "[]", "null") == F.lit(False), F.lit(False))
    readable = lambda ledger: ledger.select(F.col("ref").alias("_ref"), F.lit(True).alias("_read")).distinct()
    review, machine = fm("review_ref"), fm("machine_check_ref")
    df = rows.join(readable(reviews).withColumnsRenamed({"_ref": "_r", "_read": "r_read"}), review == F.col("_r"), "left")
    covered = reviews.select(F.col("ref").alias("_c"), F.col("id").alias("_ci"), F.lit(True).alias("r_covers")).distinct()
    df = df.join(covered, (review == F.col("_c")) & (fm("dataset_id") == F.col("_ci")), "left")
    df = df.join(readable(machines).withColumnsRenamed({"_ref": "_m", "_read": "m_read"}), machine == F.col("_m"), "left")
    passed = machines.where("status = 'pass'").select(F.col("ref").alias("_p"), F.col("id").alias("_pi"), F.lit(True).alias("m_pass")).distinct()
    df = df.join(passed, (machine == F.col("_p")) & (fm("id") == F.col("_pi")), "left")
    whole = F.coalesce(fm("difficulty").rlike("^[1-5]$"), F.lit(False))
    listed = F.coalesce(fm("topics").startswith("["), F.lit(False))
    reviewed = F.coalesce(fm("verification") == "dataset-reviewed", F.lit(False))
    odd = F.array_sort(F.array_except(F.map_keys("fm"), F.array(*map(F.lit, ALLOWED))))
    rules = [
        ("unknown fields", F.size(odd) > 0), *[(f"missing {k}", ~has(k)) for k in REQUIRED],
        ("id differs from the file's name", F.concat(F.coalesce(fm("id"), F.lit("")), F.lit(".md")) != F.col("file")),
        ("id of another category", ~F.coalesce(fm("id").startswith(F.concat("prefix", F.lit("-"))), F.lit(False))),
        ("difficulty is no whole number of 1 to 5", ~whole), ("difficulty below the floor", whole & (fm("difficulty").try_cast("int") < FLOOR)),
        ("too many topics", listed & (F.size(F.from_json(fm("topics"), "array<string>")) > MOST_TOPICS)), ("topics are no list", fm("topics").isNotNull() & ~listed),
        ("source_url is no link", ~F.coalesce(fm("source_url").startswith("http"), F.lit(False))), ("unknown verification", ~F.coalesce(fm("verification").isin(VERIFICATION), F.lit(False))),
        ("reviewed without dataset_id", reviewed & ~has("dataset_id")), ("reviewed without review_ref", reviewed & ~has("review_ref")),
        ("review can't be read", reviewed & has("review_ref") & F.col("r_read").isNull()),
        ("review does not cover it", reviewed & has("review_ref") & has("dataset_id") & F.col("r_read") & F.col("r_covers").isNull()),
        ("machine ledger can't be read", has("machine_check_ref") & F.col("m_read").isNull()), ("machine ledger does not pass it", has("machine_check_ref") & F.col("m_read") & F.col("m_pass").isNull()),
        *[(f"section {s} is missing", ~F.coalesce(F.col("body").contains(s), F.lit(False))) for s in SECTIONS],
    ]
    found = F.when(F.col("fm").isNull(), F.array(F.lit("front matter can't be read"))).otherwise(messages(*rules))
    return df.select("path", F.explode(found).alias("message"))


def gaps(ids: DataFrame, category: str, number: str) -> DataFrame:
    """(category, number) of numbers that a category lacks: its n rows should be numbered 1 to n."""
    n = ids.groupBy(category).agg(F.count("*").cast("long").alias("n"))
    want = n.select(category, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias(number))
    return want.join(ids.select(category, F.col(number).cast("long").alias(number)).distinct(), [category, number], "left_anti")


def forbidden_lines(docs: DataFrame, path: str, text: str, words: list[str]) -> DataFrame:
    """(path, line, word): where a document's lines, counted from 1, hold a forbidden word."""
    lines = docs.select(path, F.posexplode(F.split(text, "\n")).alias("at", "body"))
    words = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("body"), w))
    return lines.select(path, (F.col("at") + 1).alias("line"), F.explode(words).alias("word"))


def self_check(sections: dict[str, DataFrame], nodes: DataFrame, tiers: DataFrame) -> DataFrame:
    """(item, problem): keys in two sections of a tag table, targets that are no node (sections have key and target), tiers (name, base) outside 1 to 5."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("section"), "key", "target") for name, df in sections.items()])
    twice = rows.groupBy("key").agg(F.countDistinct("section").alias("n")).where("n > 1").select(F.col("key").alias("item"), F.lit("in several sections").alias("problem"))
    lost = rows.where("target is not null").join(nodes.select(F.col("node").alias("target")).distinct(), "target", "left_anti").select(F.col("key").alias("item"), F.lit("target is no node").alias("problem"))
    wrong = tiers.where(~F.col("base").between(1, 5)).select(F.col("name").alias("item"), F.lit("tier outside 1 to 5").alias("problem"))
    return twice.unionByName(lost).unionByName(wrong)


def should_passthrough(lang: Column, conf: Column, target: Column) -> Column:
    """Only a source that is surely English may stand for its English version."""
    return F.coalesce((lang == "en") & (conf == "high") & (target == "en"), F.lit(False))


def contract_findings(states: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, finding) of translation states (id, source_sha, source_lang, conf, variants), checked against sources (id, sha) and files (id, lang, sha).

    variants is an array of struct(lang, mode, sha), null if it can't be read. Shapes are checked first; a digest that is
    well formed is compared with the source's or the file's; failed variants have no file.
    """
    digest = lambda c: F.coalesce(c.rlike(SHA), F.lit(False))
    df = states.join(sources.select("id", F.col("sha").alias("now")), "id", "left")
    whole = messages(
        ("id is missing", F.coalesce(F.trim("id"), F.lit("")) == ""), ("source_sha256 is no digest", ~digest(F.col("source_sha"))),
        ("source_lang is no code", ~F.coalesce(F.col("source_lang").rlike("^(?:[a-z]{2}|und)$"), F.lit(False))), ("unknown confidence", ~F.coalesce(F.col("conf").isin(CONFIDENCE), F.lit(False))),
        ("variants can't be read", F.col("variants").isNull()), ("no variants", F.size("variants") == 0), ("source is missing", F.col("now").isNull()),
        ("stale", digest(F.col("source_sha")) & (F.col("source_sha") != F.col("now"))),
    )
    each = df.select("id", "source_lang", "conf", "now", F.explode("variants").alias("v")).select("id", "source_lang", "conf", "now", "v.*")
    each = each.join(files.select("id", "lang", F.col("sha").alias("held")), ["id", "lang"], "left")
    legal, live = F.coalesce(F.col("lang").isin(LANGUAGES), F.lit(False)), F.coalesce(F.col("mode").isin("passthrough", "translated"), F.lit(False))
    known = F.coalesce(F.col("mode").isin(MODES), F.lit(False))
    of = lambda what: F.concat(F.coalesce("lang", F.lit("")), F.lit(f": {what}"))
    own = F.array_compact(F.array(
        F.when(~legal, of("unknown language")), F.when(legal & ~known, of("unknown mode")),
        F.when(legal & known & F.when(live, ~digest(F.col("sha"))).otherwise(F.col("sha").isNotNull() & ~digest(F.col("sha"))), of("sha256 is no digest")),
        F.when(legal & live & (F.col("mode") == "passthrough") & ~should_passthrough(F.col("source_lang"), F.col("conf"), F.col("lang")), of("passthrough is not allowed")),
        F.when(legal & live & F.col("held").isNull() & F.col("now").isNotNull(), of("file is missing")),
        F.when(legal & live & digest(F.col("sha")) & F.col("now").isNotNull() & (F.col("sha") != F.col("held")), of("file was changed")),
        F.when(legal & live & (F.col("mode") == "passthrough") & F.col("now").isNotNull() & (F.col("held") != F.col("now")), of("passthrough differs from its source")),
    ))
    return df.select("id", F.explode(whole).alias("finding")).unionByName(each.select("id", F.explode(own).alias("finding")))


def ledger_errors(ledger: DataFrame, checks: DataFrame, refs: DataFrame, bank: DataFrame) -> DataFrame:
    """(id, problem): ledger rows (id, status) of no bank id (id) or that do not pass, checks (id, ok) that fail now, references (id) without a ledger row."""
    told = lambda df, what: df.select("id", F.lit(what).alias("problem"))
    return reduce(DataFrame.unionByName, [
        told(ledger.join(bank, "id", "left_anti"), "unknown id"), told(ledger.where(~F.coalesce(F.col("status") == "pass", F.lit(False))), "row does not pass"),
        told(ledger.join(checks.where("not ok"), "id", "left_semi"), "check fails"), told(refs.join(ledger, "id", "left_anti"), "reference without a row"),
    ])


def freshness(config: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, issue) of indexes: config (name, n, model; one row for each built) against what there is now (name, n, wanted).

    missing: never built; corrupt: without a count or a model; stale: another count; leftover: built but not wanted.
    """
    met = rows.join(config.select("name", F.col("n").alias("built"), "model", F.lit(True).alias("there")), "name", "full")
    issue = (
        F.when(F.col("there") & ~F.coalesce("wanted", F.lit(False)), "leftover").when(~F.coalesce("wanted", F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("there").isNull(), "missing").when(F.col("built").isNull() | F.col("model").isNull(), "corrupt").when(F.col("built") != F.col("n"), "stale")
    )
    return met.select("name", issue.alias("issue")).where("issue is not null")


# ---- incremental state ---------------------------------------------------------------------------------------------


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    return log.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_turn = 1").drop("_turn")


def reconciled(progress: DataFrame, sources: DataFrame, full_scan: bool) -> DataFrame:
    """progress (id, target, status, sha) that still stands by sources (id, sha): of another digest goes, of a vanished source only after a full scan; what was running is interrupted."""
    met = progress.join(sources.select("id", F.col("sha").alias("_now")), "id", "left")
    keep = F.when(F.col("_now").isNull(), F.lit(not full_scan)).otherwise(F.coalesce(F.col("sha") == F.col("_now"), F.lit(False)))
    return met.where(keep).withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))).drop("_now")


def kept_variants(states: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, lang, mode) of variants (id, lang, mode, sha, source_sha) to keep: those of the present source that failed or whose file has their digest."""
    now = states.join(sources.select("id", F.col("sha").alias("source_sha")), ["id", "source_sha"], "left_semi")
    held = now.join(files.select("id", "lang", F.col("sha").alias("held")), ["id", "lang"], "left")
    return held.where((F.col("mode") == "failed") | (F.col("sha") == F.col("held"))).select("id", "lang", "mode")


def applied(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records (line, id, path, sha) with error, null where one may be applied: its id is not repeated by an earlier line, is known by sources (id, path, sha), with that path and digest."""
    turn = F.row_number().over(W.partitionBy("id").orderBy("line"))
    met = records.withColumn("_turn", turn).join(sources.select("id", F.col("path").alias("_path"), F.col("sha").alias("_sha")), "id", "left")
    error = F.when(F.col("id").isNull(), "no id").when(F.col("_turn") > 1, "repeated id").when(F.col("_sha").isNull(), "unknown id").when(F.col("path") != F.col("_path"), "another path").when(~F.coalesce(F.col("sha") == F.col("_sha"), F.lit(False)), "stale")
    return met.withColumn("error", error).drop("_turn", "_path", "_sha")


def open_failures(log: DataFrame) -> DataFrame:
    """(id, target, error) of keys whose last event in a log (seq, id, target, error) is a failure; a success clears it."""
    return latest(log, ["id", "target"], "seq").where("error is not null").select("id", "target", "error")


def target_progress(log: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, target, status, tries): the last status of each target among events (seq, id, target, status, sha) of the source's present digest; earlier digests count for nothing."""
    now = log.join(sources.select("id", "sha"), ["id", "sha"], "left_semi")
    return now.groupBy("id", "target").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("tries"))


def variant_errors(variants: DataFrame) -> DataFrame:
    """(id, lang, error) of prepared variants (id, lang, mode, error, model, units, source_lang, conf) that break a rule of their mode."""
    mode, has = F.col("mode"), lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    error = (
        F.when(~F.coalesce(F.col("lang").isin(LANGUAGES), F.lit(False)), "unknown language").when(~F.coalesce(mode.isin(MODES), F.lit(False)), "unknown mode")
        .when((mode == "failed") & ~has("broken"), "failed without an error").when((mode == "passthrough") & has("model"), "passthrough with a model")
        .when((mode == "passthrough") & ~should_passthrough(F.col("source_lang"), F.col("conf"), F.col("lang")), "passthrough is not allowed")
        .when((mode == "translated") & ~has("model"), "translated without a model").when((mode == "translated") & (F.coalesce(F.size("units"), F.lit(0)) <= 0), "translated without units")
    )
    return variants.select("id", "lang", error.alias("error")).where("error is not null")


def placeholders_match(expected: Column, found: Column, image: str = "IMG") -> Column:
    """Whether two arrays of placeholders hold the same ones, as often, with those of images in the same order."""
    images = lambda c: F.filter(c, lambda p: p.startswith(image))
    return (F.array_sort(expected) == F.array_sort(found)) & (images(expected) == images(found))


def payloads(rows: DataFrame, target: str, key: str, fields: list[str], most: int) -> DataFrame:
    """(target, batch, n, payload): rows of each target in the order of their key, ``most`` to a batch, as JSON. A batch is small by its bound.

    Places come from one range sort over targets and keys, so a target of very many rows is sorted by many tasks.
    """
    laid = written(numbered(rows.select(target, key, *fields), [target, key], "_n"), "payloads")
    first = if_few(written(laid.groupBy(F.col(target).alias("_target")).agg(F.min("_n").alias("_first")), "payload-targets"))
    dealt = laid.join(first, F.col(target).eqNullSafe(F.col("_target"))).withColumn("batch", F.floor((F.col("_n") - F.col("_first")) / most).cast("long") + 1)
    return dealt.groupBy(target, "batch").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct(key, *fields)))).alias("payload"))
