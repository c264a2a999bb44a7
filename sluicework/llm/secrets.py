"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds one row for each pair of
blob and rule version that has been scanned, with the spans found. A run looks up which pairs are new, reads one
copy of each blob that has any, scans it for just those rules, and joins the ledger's findings back to every path
that holds the blob. Everything is built of DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.session import shared_dir, written

#: Blobs with findings, and spans of all of these together, up to which they may be broadcast.
FINDINGS, SENT = 1 << 18, 1 << 20
#: Characters of the pieces that a text is cut to before spans are taken out of it.
SEGMENT = 1 << 12


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of the leftmost non-overlapping matches of ``pattern`` those are kept whose ``group`` has at least ``least`` characters; ``base`` rules are counted and hashed, others only add spans."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Public formats of credentials, in order of precedence at one start.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}"),
)
SPANS = "array<struct<start:bigint,end:bigint>>"


def rule_matches(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text, in order: the length of the gap before each, its own, and whether it is kept."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    size = lambda c: F.length(c).cast("long")
    parts = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), sized.alias("s")), lambda m: F.struct(size(m["g"]).alias("gap"), size(m["w"]).alias("size"), (F.length(m["s"]) >= rule.least).alias("kept")))
    return F.when(text.rlike(rule.pattern), parts)


def found_spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, spans) of texts (blob, text, pending), for pending rules that match; spans in code points, end exclusive.

    A match starts where the gaps and matches before it end, which is a running sum over a text's matches: a window, so work
    grows in proportion to matches however many a text has.
    """
    each = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("pending", r.key), rule_matches(F.col("text"), r)).alias("m")) for r in rules])
    hits = texts.select("blob", F.explode(F.filter(each, lambda x: x["m"].isNotNull())).alias("x")).select("blob", F.col("x.rule").alias("rule"), F.col("x.m").alias("all"))
    hits = hits.select("blob", "rule", F.posexplode("all").alias("place", "m"))  # apart, so that no match carries all others along
    hits = hits.groupBy("blob", "rule", "place").agg(F.first("m").alias("m"))  # copies of a blob have the same matches
    stop = F.sum(F.col("m.gap") + F.col("m.size")).over(W.partitionBy("blob", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    spans = hits.withColumn("end", stop).where("m.kept").select("blob", "rule", F.struct((F.col("end") - F.col("m.size")).alias("start"), "end").alias("span"))
    return spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def scan(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, entries).

    findings: path, blob and spans, an array of (start, end, kind, order) sorted by start and then by the rules'
    order, for each row of docs. entries: the ledger's new rows (blob, rule, spans), one for each pair of blob and
    rule version that neither the ledger nor an earlier copy had; append them to the ledger for the next run.

    A null text is scanned as an empty one. Repeated rows and null paths stay, each with its findings. An empty
    table gives empty results. Of equal blobs one is read, by its smallest path (nulls last); where all paths of
    a blob are null, the null rows are read and deduplicated by content. Other columns are ignored.
    """
    paths, by_blob, entries = _looked_up(docs, path_col, text_col, rules, ledger)
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return paths.join(_sent(by_blob), "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans")), entries


def redacted(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """docs with the secrets of its text column replaced by their kinds; the other columns and clean texts stay as they are.

    Blobs with findings go to the rows if they are few; otherwise rows and findings meet by blob.
    """
    _, by_blob, _ = _looked_up(docs, path_col, text_col, rules, ledger)
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.sha2(F.coalesce(docs[f"`{text_col}`"], F.lit("")), 256).alias("blob"))
    both = rows.join(_sent(_runs(by_blob)), "blob", "left")
    both = both.withColumn("segments", F.when(F.col("runs").isNotNull(), segments(text)))
    new = F.when(F.col("runs").isNotNull(), redact(text, F.col("runs"), F.col("segments"))).otherwise(text)
    return both.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _sent(by_blob: DataFrame) -> DataFrame:
    """A written table of blobs with arrays of spans, to be broadcast if there are few of both; otherwise as it is, to be shuffled."""
    n, spans = by_blob.agg(F.count("*"), F.coalesce(F.sum(F.size(by_blob.columns[1])), F.lit(0))).first()
    return F.broadcast(by_blob) if n <= FINDINGS and spans <= SENT else by_blob


def _runs(by_blob: DataFrame) -> DataFrame:
    """(blob, runs) of (blob, spans): overlapping spans as one, with the kind of the first."""
    order = W.partitionBy("blob").orderBy("place")
    each = by_blob.select("blob", F.posexplode("spans").alias("place", "s"))
    before = F.max("s.end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = before.isNull() | (F.col("s.start") >= before)
    marked = each.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy("blob", "run").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"), F.min_by("s.kind", "place").alias("kind"))
    return written(runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("runs")), "blob-runs")


def _looked_up(docs: DataFrame, path_col: str, text_col: str, rules: tuple[Rule, ...], ledger: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, blob) of every row, (blob, spans) of the blobs with any, and the ledger's new rows."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{path_col}`").alias("path"), text.alias("text"))
    paths = written(rows.select("path", F.sha2("text", 256).alias("blob")), "blob-paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    keys = [r.key for r in rules]
    if ledger is None:
        pending = blobs.withColumn("pending", F.array(*map(F.lit, keys)))
        known = None
    else:
        known = ledger.where(F.col("rule").isin(keys)).join(blobs.select("blob"), "blob", "left_semi")
        seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        pending = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("pending") > 0)
    pending = written(pending, "blob-pending")
    # One copy of each blob: its path leads to its text; the blob is checked again since a path may hold several versions.
    texts = rows.join(pending.withColumnRenamed("path", "p"), F.col("path").eqNullSafe(F.col("p"))).where(F.sha2("text", 256) == F.col("blob"))
    found = written(found_spans(texts.select("blob", "text", "pending"), rules), "blob-findings")
    entries = pending.select("blob", F.explode("pending").alias("rule")).join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    every = found if known is None else found.unionByName(known.select("blob", "rule", "spans").where(F.size("spans") > 0).dropDuplicates(["blob", "rule"]))
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    flat = every.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("order"), s["end"].alias("end"), F.split_part(F.col("rule"), F.lit("@"), F.lit(1)).alias("kind"))).alias("spans"))
    by_blob = written(flat.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "blob-spans")
    return paths, by_blob, entries


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def segments(text: Column) -> Column:
    """The text in pieces of ``SEGMENT`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{SEGMENT}}})"), F.lit(1))


def redact(text: Column, runs: Column, parts: Column) -> Column:
    """The text with each run (start, end, kind; in order, none overlapping) replaced by [its kind]; other characters stay.

    ``parts`` is a column that has the text's segments(): each piece is taken from those that it lies in, so no run reads the
    text anew.
    """

    def piece(a: Column, b: Column) -> Column:
        first, last = F.floor(a / SEGMENT), F.floor((b - 1) / SEGMENT)
        own = F.array_join(F.slice(parts, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.when(b > a, F.substring(own, (a % SEGMENT + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    start = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(runs, k - 1)["end"])
    done = F.transform(runs, lambda run, k: F.concat(piece(start(k), run["start"]), F.lit("["), run["kind"], F.lit("]")))
    rest = piece(F.get(runs, F.size(runs) - 1)["end"], F.length(text).cast("long"))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(done, ""), rest)).otherwise(text)


def kept_ledger(spark: SparkSession) -> tuple[str, DataFrame | None]:
    """(where the query's ledger is kept in the shared folder, the ledger; None before the first run)."""
    path = f"{shared_dir(spark)}/sluicework/secret-ledger"
    try:
        return path, spark.read.schema(f"blob string, rule string, spans {SPANS}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return path, None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document.

    Scans what the ledger in the session's shared folder does not have and adds it there; the result is the same with any ledger.
    """
    path, ledger = kept_ledger(spark)
    findings, entries = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger=ledger)
    entries.write.mode("append").parquet(path)
    base = [r.kind for r in RULES if r.base]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return findings.select(F.col("path").alias("doc_id"), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(told(of(*base)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        q = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, rid, '{r.kind}' AS kind, {k} AS ord, unnest(list_zip(string_split_regex(t, '{q}')[:-2], regexp_extract_all(t, '{q}'), regexp_extract_all(t, '{q}', {r.group}), generate_series(1, len(regexp_extract_all(t, '{q}'))))) AS x, {r.least} AS least FROM d WHERE regexp_matches(t, '{q}')""")
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT rid, kind, ord, x[3] AS sized, length(x[2]) AS size, least,
             sum(length(x[1]) + length(x[2])) OVER (PARTITION BY rid, kind ORDER BY x[4]) AS stop FROM m),
f AS (SELECT rid, kind, ord, (stop - size)::BIGINT AS a, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS s FROM p WHERE length(sized) >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(s, ',' ORDER BY a, ord) FILTER (kind IN ({base})) AS b, string_agg(s, ',' ORDER BY a, ord) AS spans FROM f GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.rid = g.rid
"""


SQL = _sql()
