"""Ingest: tag paths, contest names to tiers with modifiers and caps, rendered rows and their headers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sluicework.functions.text import LEADING, key_form, name_variants, squeezed
from sluicework.session import if_few

# Problem types whose difficulty is capped; family keys shorter than eight letters that count.
CAPS = {"MCQ": 2, "final answer only": 3}
SHORT_FAMILIES = ["aime", "apmo", "cmo", "egmo", "hmmt", "imo", "jbmo", "rmm", "tst", "usajmo", "usamo"]
FAMILY_LENGTH = 8


@F.pandas_udf(S.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def tag_path(text: Column) -> Column:
    """A tag path in one form: composed, straight quotes, single spaces, ' > ' between its parts."""
    straight = F.translate(nfc(F.trim(text)), "‘’", "''")
    return F.regexp_replace(F.regexp_replace(straight, r"\s+", " "), r"\s*>\s*", " > ")


def closure(rules: list[tuple[str, str]]) -> dict[str, str]:
    """Where each left side of an ordered chain of rewrites ends up: a rule's result goes on through the rules after it."""
    ends = {}
    for start, _ in rules:
        now = start
        for before, after in rules:
            now = after if now == before else now
        ends[start] = now
    return ends


def rewritten(path: Column, rules: list[tuple[str, str]]) -> Column:
    """A path through an ordered chain of rewrites, by one lookup in the chain's closure."""
    ends = closure(rules)
    table = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
    return F.coalesce(table[path], path) if ends else path


def compiled(modifiers: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(pattern, kind, value) of (pattern, effect): '=N' sets, '+N' and '-N' shift, '-0' only lowers confidence; anything else is an error."""
    out = []
    for pattern, effect in modifiers:
        m = re.match(r"(=|\+|-)(\d)", effect)
        if not m:
            raise ValueError(f"an effect that can't be read: {effect!r}")
        sign, n = m[1], int(m[2])
        out.append((pattern, "set", n) if sign == "=" else (pattern, "noop", 0) if sign == "-" and n == 0 else (pattern, "delta", n if sign == "+" else -n))
    return out


def family(name: Column, keys: list[str]) -> Column:
    """The longest key that stands in a name as whole words; short keys count only if they are known abbreviations."""
    usable = sorted((k for k in keys if len(k) >= FAMILY_LENGTH or k in SHORT_FAMILIES), key=lambda k: (-len(k), k))
    out = F.lit(None).cast("string")
    for k in reversed(usable):
        out = F.when(name.rlike(rf"(?<![a-z]){re.escape(k)}(?![a-z])"), k).otherwise(out)
    return out


def grade(name: Column, kind: Column, tiers: dict[str, int], modifiers: list[tuple[str, str]], default: tuple[int, str] = (2, "low")) -> Column:
    """struct(est, conf) of a normalised contest name and a problem type.

    A name's variants are looked up as they are and by key form (high), then its family (mid); otherwise modifiers apply in
    order to the default: one that sets ends it, shifts add up within 1 to 5, a shift up of a team-selection rule is
    passed over where a junior or first-round rule matches too. A null name takes the default. Types can only cap.
    """
    pick = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    exact, forms = pick(tiers), pick({_plain_form(k): v for k, v in reversed(tiers.items())})
    hit = F.get(F.filter(F.flatten(F.transform(name_variants(name), lambda v: F.array(exact[v], forms[key_form(v)]))), lambda x: x.isNotNull()), F.lit(0))
    kin = pick(tiers)[family(name, list(tiers))]
    rules = compiled(modifiers)
    matched = F.array_compact(F.array(*[F.when(name.rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(k == "delta" and v > 0 and "tst" in p).alias("tst"))) for p, k, v in rules]))
    young = [p for p, _, _ in rules if "junior" in p or "first round" in p]
    yields = F.coalesce(F.lit(False) if not young else name.rlike("|".join(f"(?:{p})" for p in young)), F.lit(False))
    start = F.struct(F.lit(default[0]).alias("est"), F.lit(None).cast("string").alias("conf"), F.lit(False).alias("done"), F.lit(False).alias("noop"))

    def step(s: Column, r: Column) -> Column:
        shift = (r["kind"] == "delta") & ~(r["tst"] & yields)
        put = lambda est, conf, done, noop: F.struct(est.alias("est"), conf.alias("conf"), done.alias("done"), noop.alias("noop"))
        no = F.lit(False)
        return (
            F.when(s["done"], s).when(r["kind"] == "set", put(r["value"], F.lit("mid"), F.lit(True), s["noop"]))
            .when(r["kind"] == "noop", put(s["est"], s["conf"], no, F.lit(True)))
            .when(shift, put(F.greatest(F.lit(1), F.least(F.lit(5), s["est"] + r["value"])), F.lit("mid"), no, s["noop"])).otherwise(s)
        )

    folded = F.aggregate(matched, start, step)
    loose = F.coalesce(folded["conf"], F.when((F.size(matched) == 0) | folded["noop"], "low").otherwise("mid"))
    est = F.when(name.isNull(), default[0]).when(hit.isNotNull(), hit).when(kin.isNotNull(), kin).otherwise(folded["est"])
    conf = F.when(name.isNull(), default[1]).when(hit.isNotNull(), "high").when(kin.isNotNull(), "mid").otherwise(loose)
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])[kind]
    over = F.coalesce(est > cap, F.lit(False))
    return F.struct(F.when(over, cap).otherwise(est).alias("est"), F.when(over & (conf != "high"), "mid").otherwise(conf).alias("conf"))


def _plain_form(name: str) -> str:
    return re.sub(LEADING, "", re.sub("^the +", "", name))


def sizes(parts: Column, images: Column) -> list[Column]:
    """part_chars, n_parts, n_images and has_images of an array of texts and an array of images."""
    chars = F.aggregate(F.coalesce(parts, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.length(p), F.lit(0)))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return [chars.alias("part_chars"), n(parts).alias("n_parts"), n(images).alias("n_images"), (n(images) > 0).alias("has_images")]


def head(text: Column, most: int = 200) -> Column:
    """The first characters of a text with its white space squeezed."""
    return F.substring(squeezed(text), 1, most)


def safe_label(name: Column, most: int = 80) -> Column:
    """A label that can name a file: no separators, control or reserved characters, no dots or spaces at the ends; '_' if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]+', "-"), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.regexp_replace(plain, r"^[. ]+|[. ]+$", ""), 1, most), r"[. ]+$", ""), F.lit("")), F.lit("_"))


def placement(df: DataFrame, key: str, category: str, topics: str, registry: DataFrame) -> DataFrame:
    """(key, category, topic, place): where a row is filed, by its topics (an array) in the registry (category, node).

    Topics of the row's own category come first, then the others, each in the order given; a topic that is not registered
    files under 'unclassified', a row without topics under 'unspecified'.
    """
    each = df.select(key, F.col(category).alias("own"), F.posexplode_outer(topics).alias("at", "topic"))
    known = registry.select(F.col("category").alias("home"), F.col("node").alias("topic"))
    met = each.join(if_few(known), "topic", "left")
    met = met.withColumn("category", F.coalesce("home", "own")).withColumn("topic", F.when(F.col("topic").isNull(), "unspecified").when(F.col("home").isNull(), "unclassified").otherwise(F.col("topic")))
    met = met.withColumn("turn", F.struct((~F.coalesce(F.col("home") == F.col("own"), F.lit(False))).alias("foreign"), "at", F.col("category").alias("c")))
    filed = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "category", "topic"))).alias("filed"))  # a row has few topics
    return filed.select(key, F.posexplode("filed").alias("place", "f")).select(key, "f.category", "f.topic", (F.col("place") + 1).alias("place"))


def rendered(title: Column, status: Column, statement: Column, solutions: Column, answer: Column, tags: Column) -> Column:
    """A row as a document: title, tags, a warning unless its status is ok, statement, numbered solutions and answer, with placeholders for what is missing."""
    none = F.lit("(not provided)")
    blank = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), none)
    many = F.size(solutions) > 1
    body = F.transform(solutions, lambda s, i: F.concat(F.when(many, F.concat(F.lit("## Solution "), (i + 1).cast("string"))).otherwise("## Solution"), F.lit("\n\n"), blank(s)))
    none_given = F.coalesce(F.size(solutions), F.lit(0)) <= 0
    return F.array_join(
        F.array_compact(F.array(
            F.concat(F.lit("# "), title), F.concat(F.lit("Tags: "), F.array_join(tags, "; ")), F.when(~F.coalesce(status == "ok", F.lit(False)), F.concat(F.lit("> Status: "), F.coalesce(status, F.lit("unknown")))),
            F.concat(F.lit("## Statement\n\n"), blank(statement)), F.when(none_given, F.concat(F.lit("## Solution\n\n"), none)).otherwise(F.array_join(body, "\n\n")), F.concat(F.lit("## Final answer\n\n"), blank(answer)),
        )), "\n\n",
    )


def header_tags(document: Column) -> Column:
    """The tags of a rendered document; null unless it has exactly one line of them."""
    lines = F.regexp_extract_all(document, F.lit(r"(?m)^Tags: ([^\n]*)$"), F.lit(1))
    return F.when(F.size(lines) == 1, F.split(F.get(lines, F.lit(0)), "; "))


def quoted(text: Column) -> Column:
    """A text as a quoted scalar, safe in JSON and YAML."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
