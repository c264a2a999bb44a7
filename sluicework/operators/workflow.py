"""Views and files around a corpus: variants and their states, pairing, remaps, index upkeep, rendering for the web, probes."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.text import one_json, squeezed

# States that a variant may have.
STATES = ["passthrough", "translated", "failed"]


def variant_path(source: Column, lang: Column) -> Column:
    """Where a language's variant of a source file lies: the source itself for 'orig', else beside it."""
    return F.when(lang == "orig", source).otherwise(F.concat(F.regexp_extract(source, "^(.*/)?[^/]*$", 1), F.lit("index."), lang, F.lit(".md")))


def variant_status(state: Column, lang: str) -> Column:
    """The state of a language's variant in a JSON object, each a string or an object with a mode; missing for whatever can't be read or is unknown."""
    value = F.get_json_object(state, f"$.variants.{lang}")
    mode = F.coalesce(F.get_json_object(value, "$.mode"), value)
    return F.when(mode.isin(STATES), mode).otherwise("missing")


def readable_state(text: Column) -> Column:
    """A JSON text if it is an object; null for anything else."""
    return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text)


def source_language(rows: DataFrame, key: str, known: DataFrame, fallback: tuple[str, str]) -> DataFrame:
    """rows with source_lang, confidence and error, from known (key, value): a JSON string, or an object with source_lang and perhaps a confidence; without an entry the fallback. Neither may be empty."""
    met = rows.join(known.select(key, F.col("value").alias("_v")), key, "left")
    object_ = F.col("_v").startswith("{")
    lang = F.when(F.col("_v").isNull(), fallback[0]).when(object_, F.get_json_object("_v", "$.source_lang")).otherwise(F.regexp_extract("_v", r'^"([^"]*)"$', 1))
    conf = F.when(object_, F.coalesce(F.get_json_object("_v", "$.source_lang_confidence"), F.lit(fallback[1]))).otherwise(fallback[1])
    bad = (F.coalesce(lang, F.lit("")) == "") | (conf == "")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(~bad, lang).alias("source_lang"), F.when(~bad, conf).alias("confidence"), F.when(bad, "no language").alias("error"))


def declared_line(text: Column) -> Column:
    """The language that a document's list of metadata declares; null without such a line."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[-*+][ \t]+语言[：:][ \t]*([^\n]+?)[ \t]*$", 1)), F.lit(""))


def zoned_time(text: Column) -> Column:
    """Whether a text is an ISO 8601 time with its zone."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$"
    return F.coalesce(text.rlike(shape) & F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 16), "T", " "), F.lit("yyyy-MM-dd HH:mm")).isNotNull(), F.lit(False))


def paired(sources: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """(path, text, translated, state): files of two folders by their relative path; missing where only the source is, extra where only the target is."""
    a, b = sources.select(path, "text", F.lit(True).alias("_a")), targets.select(path, F.col("text").alias("translated"), F.lit(True).alias("_b"))
    return a.join(b, path, "full").select(path, "text", "translated", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("paired").alias("state"))


def remapped(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with id, the new id of their old key in a table (keys, id; null where retired), and known, whether the table has it."""
    return rows.join(table.select(*keys, "id", F.lit(True).alias("_known")), keys, "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def reindexed(index: DataFrame, fresh: DataFrame, key: str, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(index with fresh values for the chosen keys, or for all; chosen keys that the index lacks). Columns that fresh lacks stay."""
    new = fresh if selected is None else fresh.join(selected.select(key).distinct(), key, "left_semi")
    met = index.join(new.select(key, F.struct(*[c for c in fresh.columns if c != key]).alias("_new")), key, "left")
    out = met.select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fresh.columns and c != key else F.col(c) for c in index.columns])
    return out, (fresh if selected is None else selected).select(key).distinct().join(index.select(key), key, "left_anti")


def stash_conflicts(stashes: DataFrame, live: DataFrame) -> DataFrame:
    """(id, place, n): artefacts (root, id, sha) that lie in several stashes, or in one and live (id, sha), with different contents."""
    every = stashes.select("id", "root", "sha").unionByName(live.select("id", F.lit("live").alias("root"), "sha"))
    return every.groupBy("id").agg(F.countDistinct("sha").alias("n"), F.array_join(F.array_sort(F.collect_set("root")), ",").alias("place")).where("n > 1").select("id", "place", "n")


def restored(target: DataFrame, stash: DataFrame) -> DataFrame:
    """(id, path, sha) of stashed artefacts (id, sha) at their rows' present paths; those of vanished rows have a null path."""
    return stash.join(target.select("id", "path"), "id", "left").select("id", "path", "sha")


def map_view(rows: DataFrame, star: int | None, text: str, node: str = "node") -> DataFrame:
    """(node, shown, total, dim): how many items of each node have a star and hold a text, whatever its case; a node with none is dim."""
    hit = F.lit(True) if star is None else F.col("difficulty") == star
    hit = hit & F.lower("text").contains(text.lower())
    return rows.groupBy(node).agg(F.count_if(hit).alias("shown"), F.count("*").alias("total")).withColumn("dim", F.col("shown") == 0)


def heading_view(contest: Column, year: Column) -> list[Column]:
    """A contest's name, '?' without one, and its year unless the name has it."""
    name = F.coalesce(F.nullif(contest, F.lit("")), F.lit("?"))
    return [name.alias("contest"), F.when(~F.contains(name, year.cast("string")), year).alias("year")]


def html(text: Column) -> Column:
    """Paragraphs and lists of a simple Markdown text as HTML, everything else escaped; lines of a paragraph stay lines."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    blocks = F.split(F.regexp_replace(safe, r"\A\s+|\s+\z", ""), r"\n\s*\n")
    lines = lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, r"\s+$", ""))
    items = lambda b, p: F.array_join(F.transform(lines(b), lambda x: F.concat(F.lit("<li>"), F.regexp_replace(x, p, ""), F.lit("</li>"))), "")
    bullet, number = r"^\s*[-*]\s+", r"^\s*\d+[.、]\s+"

    def block(b: Column) -> Column:
        of = lambda p: F.forall(lines(b), lambda x: x.rlike(p))
        return (
            F.when(of(bullet), F.concat(F.lit("<ul>"), items(b, bullet), F.lit("</ul>"))).when((F.size(lines(b)) > 1) & of(number), F.concat(F.lit("<ol>"), items(b, number), F.lit("</ol>")))
            .otherwise(F.concat(F.lit("<p>"), F.array_join(lines(b), "\n"), F.lit("</p>")))
        )

    return F.when(F.coalesce(squeezed(text), F.lit("")) == "", "").otherwise(F.array_join(F.transform(blocks, block), "\n"))


SPANS = "array<struct<key:string,start:int,stop:int>>"
#: Every character of a JSON text is in one of these: a string, a mark, white space, a number or word.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[ \t\r\n]+|[^\s{}\[\],:"]+', re.S)


def _spans(line: str) -> list[dict] | None:
    """Of a valid JSON object the places of its own values; None if it names one twice."""
    out, depth, key, start, waits, end = [], 0, None, -1, False, 0
    for m in _TOKEN.finditer(line):
        token = m.group()
        if token[0] in " \t\r\n":
            continue
        if depth == 1 and token in (",", "}"):
            if key is not None:
                out.append({"key": key, "start": start, "stop": end})
            key = None
        elif depth == 1 and token == ":":
            waits = True
        elif depth == 1 and key is None:
            key = json.loads(token)
        elif waits:
            start, waits = m.start(), False
        depth += (token in "{[") - (token in "}]")
        end = m.end()
    return out if len({s["key"] for s in out}) == len(out) else None


def value_spans(line: Column) -> Column:
    """(key, start, stop) of the values of a JSON object's top level, in characters from 0, in order; null if it is no object or repeats a key."""
    spans = F.pandas_udf(lambda lines: lines.map(lambda x: None if x is None else _spans(x)), SPANS)
    valid = one_json(line) & F.startswith(F.ltrim(F.translate(line, "\t\r\n", "   ")), F.lit("{"))
    return spans(F.when(valid, line))


def patched(df: DataFrame, line: str, changes: dict[str, Column], to: str) -> DataFrame:
    """df with a column ``to``: its JSON objects with values (JSON texts) in the place of those of these keys; keys that one lacks follow its last; all other characters stay.

    A null value leaves its key as it is. The result is null where value_spans() is.
    """
    given = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in changes.items()]), lambda c: c["value"].isNotNull())
    rows = df.withColumns({"_spans": value_spans(F.col(line)), "_given": given})
    found, given = F.col("_spans"), F.col("_given")
    have = F.transform(found, lambda s: s["key"])
    old = F.filter(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.get(F.filter(given, lambda c: c["key"] == s["key"]), F.lit(0))["value"].alias("value"))), lambda e: e["value"].isNotNull())
    last = F.length(F.regexp_replace(line, r"\}\s*\z", ""))
    new = F.filter(given, lambda c: ~F.array_contains(have, c["key"]))
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    tail = F.concat(F.when((F.size(have) > 0) & (F.size(new) > 0), ", ").otherwise(""), F.array_join(F.transform(new, lambda c: F.concat(quoted(c["key"]), F.lit(": "), c["value"])), ", "))
    rows = rows.withColumn("_edits", F.concat(old, F.array(F.struct(last.alias("start"), last.alias("stop"), tail.alias("value")))))
    edits = F.col("_edits")
    # What stands before each edit, and the edit.
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(edits, k - 1)["stop"])
    part = lambda e, k: F.concat(F.substring(line, start(k) + 1, e["start"] - start(k)), e["value"])
    whole = F.concat(F.array_join(F.transform(edits, part), ""), F.substring(line, last + 1, F.length(line) - last))
    return rows.withColumn(to, F.when(found.isNotNull(), whole)).drop("_spans", "_given", "_edits")


def probed(urls: DataFrame, url: str, fetch: Callable[[str], int]) -> DataFrame:
    """(url, status, ok): what a fetcher says of each different address; below 400 is fine, and a fetcher that raises has no status."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int | None] = []
            for x in batch.column(0).to_pylist():
                try:
                    found.append(int(fetch(x)))
                except Exception:  # an address that can't be reached
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array([s is not None and s < 400 for s in found])], ["url", "status", "ok"])

    return urls.select(F.col(url).alias("url")).where("url is not null").distinct().mapInArrow(work, "url string, status int, ok boolean")


# ---- sessions, ledgers, folders and runs ---------------------------------------------------------------------------


def session_token(hints: Column, revealed: Column) -> Column:
    """What a form must send back: the number of hints and whether the answer was seen when it was made."""
    return F.concat_ws(":", hints.cast("string"), F.coalesce(revealed, F.lit(False)).cast("string"))


def accepted(forms: DataFrame, sessions: DataFrame) -> DataFrame:
    """forms (sid, token, stopped_at, now) with error and ended_at: of an unknown, closed or changed session a form is refused; a time to stop counts only from the session's start to now."""
    met = forms.join(sessions.select("sid", "status", "hints", "revealed", "started_at"), "sid", "left")
    error = F.when(F.col("status").isNull(), "unknown session").when(F.col("status") != "open", "session is closed").when(~F.coalesce(F.col("token") == session_token(F.col("hints"), F.col("revealed")), F.lit(False)), "form is stale")
    inside = F.coalesce(F.col("stopped_at").between(F.col("started_at"), F.col("now")), F.lit(False))
    return met.select(*forms.columns, error.alias("error"), F.when(error.isNull(), F.when(inside, F.col("stopped_at")).otherwise(F.col("now"))).alias("ended_at"))


def abandoned(sessions: DataFrame, chosen: DataFrame) -> DataFrame:
    """sessions with those chosen (sid) abandoned if they are open; no attempt comes of them."""
    met = sessions.join(chosen.select("sid", F.lit(True).alias("_gone")).distinct(), "sid", "left")
    return met.withColumn("status", F.when(F.col("_gone") & (F.col("status") == "open"), "abandoned").otherwise(F.col("status"))).drop("_gone")


def logged(entries: DataFrame, bank: DataFrame, results: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(entries of known ids with their result in today's words, entries of unknown ids or results)."""
    table = F.create_map(*[F.lit(x) for kv in results.items() for x in kv])
    met = entries.join(bank.select("id", F.lit(True).alias("_known")), "id", "left").withColumn("normal", table[F.col("result")])
    good = F.coalesce(F.col("_known"), F.lit(False)) & F.col("normal").isNotNull()
    return met.where(good).drop("_known"), met.where(~good).drop("_known", "normal")


def write_ledger(results: DataFrame, path: str) -> int:
    """Writes results (id, status, ...) as JSON lines and tells how many; an error, and nothing written, unless all pass and there are some."""
    n, bad = results.agg(F.count("*"), F.count_if(~F.coalesce(F.col("status") == "pass", F.lit(False)))).first()
    if not n or bad:
        raise ValueError(f"{bad} of {n} checks do not pass; no ledger is written")
    results.orderBy("id").coalesce(1).write.mode("overwrite").json(path)
    return n


def batch_inputs(states: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, lang, source, target) of the translated variants in states (id, variants: struct(lang, mode, sha)), with the texts of sources (id, text) and files (id, lang, text)."""
    each = states.select("id", F.explode("variants").alias("v")).where("v.mode = 'translated'").select("id", "v.lang")
    return each.join(sources.select("id", F.col("text").alias("source")), "id").join(files.select("id", "lang", F.col("text").alias("target")), ["id", "lang"])


def verified_by_language(inputs: DataFrame, langs: list[str], verify: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What a verifier, a function of (rows of one language, the language), finds, language by language."""
    out = None
    for lang in langs:
        found = verify(inputs.where(F.col("lang") == lang), lang).withColumn("lang", F.lit(lang))
        out = found if out is None else out.unionByName(found)
    return out


def guard_folder(spark, path: str) -> None:
    """An error if a folder has files but is none that this library publishes to: its contents would be lost."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    if files.where(F.col("path").contains("/published/")).isEmpty() and not files.isEmpty():
        raise ValueError(f"{path} has files of another origin")


def dispatched(jobs: list, call: Callable, tries: int = 3, wait: float = 1.0, most: float = 60.0, known: dict | None = None, strict: bool = False, sleep: Callable[[float], None] = time.sleep) -> list[tuple]:
    """(job, status, result or error) of jobs that call a service, in order, on the driver.

    A known result is reused. A call that raises is tried again after a wait that doubles up to a bound; after the last try
    the job has failed. With ``strict`` the first failure ends the run; what did not run is skipped, and an interruption
    marks the job that it met and ends the run.
    """
    out, over = [], False
    for job in jobs:
        if over:
            out.append((job, "skipped", None))
        elif known is not None and job in known:
            out.append((job, "reused", known[job]))
        else:
            for k in range(tries):
                try:
                    out.append((job, "done", call(job)))
                    break
                except KeyboardInterrupt:
                    out.append((job, "interrupted", None))
                    over = True
                    break
                except Exception as e:  # whatever the service raises is its failure
                    if k + 1 == tries:
                        out.append((job, "failed", str(e)))
                        over = strict
                    else:
                        sleep(min(most, wait * 2**k))
    return out
