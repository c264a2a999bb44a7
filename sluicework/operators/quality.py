"""Text quality: source language, translation findings, batch signals, protected spans, chunks, lexical rechecks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sluicework.functions.text import excerpt, numbers, rest, stripped

# Function words (folded), phrases and characters that mark a language, one language a row. Others can be passed as parameters.
WORDS = {
    "en": "a all an and are be by determine each every equality equals find for from given has holds if in integers is let numbers of on only positive prove such that the then there to which with",
    "es": "cada con cual de del demostrar determine donde enteros es existe hallar las los numeros para por positivos que sea sean si tal todos una y",
    "pt": "ao aos as cada com da das de determinar demonstrar do dos e em existe inteiros nas no numeros o onde os para por positivos quanto que se seja sejam sao tal todos um uma",
    "fr": "avec dans de des determiner entiers est existe les montrer nombres ou par pour positifs que quel si soit soient tel tous trouver un une",
    "de": "alle auch das dass denen der die ein eine einem einen einer es folgende fur in ist man mit oder sei seien sind so und was wenn zeige",
    "it": "a ad al alla altre che come con da dal dei del della delle di e gli i il in la le loro nei nel o per possiamo sia siano sono tra tutti una uno",
    "nl": "als alle bepaal bewijs dat de deze dit door een elk er gegeven gehele getal getallen heeft het met niet op positieve voor waar waarvoor wordt zijn zodat",
    "ro": "aratati avem ca cand care cu daca demonstrati determinati este exista fie fiecare gasiti numar numarul numere pentru pozitive sunt toate toti un unei",
    "sl": "bo cela ce da doloci dokazi in je ki lahko naj obstaja poisci pozitivna stevila tako ter vsak za",
}
PHRASES = {
    "en": ["such that", "positive integers", "prove that", "let us"],
    "es": ["tal que", "numeros enteros", "para todo"],
    "pt": ["tais que", "tal que", "numeros inteiros", "quanto mede"],
    "fr": ["tels que", "tel que", "nombres entiers", "pour tout"],
    "de": ["so dass", "in denen", "zeige dass", "fur alle"],
    "it": ["in cui", "tale che", "in modo che", "uno dei", "una delle"],
    "nl": ["zodat", "voor alle", "gehele getallen", "bepaal alle", "bewijs dat"],
    "ro": ["astfel incat", "pentru toate", "numere intregi", "sa se arate"],
    "sl": ["tako da", "cela stevila", "naj bo"],
}
CHARS = {"es": "ñ¿¡", "pt": "ãõç", "fr": "œæëïÿ", "de": "äöüß", "it": "ìòù", "nl": "ĳ", "ro": "ăîșț", "sl": "čšž"}
# Names and codes under which a language is declared.
DECLARED = {
    "en": "en eng english anglais ingles", "es": "es spa spanish espanol castellano", "pt": "pt por portuguese portugues", "fr": "fr fra fre french francais",
    "sl": "sl slv slovenian slovene slovenscina", "ru": "ru rus russian russkii", "zh": "zh zho chi chinese mandarin", "de": "de deu ger german deutsch",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "ro": "ro ron rum romanian romana", "el": "el ell gre greek ellinika",
    "mn": "mn mon mongolian mongol", "mk": "mk mkd macedonian makedonski", "ar": "ar ara arabic",
}
SEPARATOR = r"(?i)\s*(?:;|,|/|\||\+|\band\b|\by\b)\s*"
TINY = ["find", "let", "prove"]
# Marks of Chinese, Russian, Mongolian and Macedonian.
CHINESE = "所有 满足 方程 正整数 证明 条件 每个 答案 设 其中 存在 性质 下列 所得 必定"
RUSSIAN = "все данное для докажите каждое которых натуральные найдите положительных решения свойством существует указанным уравнение целое целых чисел число что"
MONGOLIAN = "ав бүх бүхэл гэж натурал нотол олго ол тоо тоонууд шийд шийдийг эерэг"
MACEDONIAN = "број броеви бројот го докажи докажете за кои најди најдете позитивни сите цели дека земе земи"
ACCENTED, PLAIN = "áàâäãåăāąçćčďéèêëěęēíìîïīñńňóòôöõőřśšșşťțţúùûüůűūýÿźžż", "aaaaaaaaacccdeeeeeeeiiiiinnnoooooorsssstttuuuuuuuyyzzz"

# Environments of formulas, and patterns that are not prose, in the order in which they are removed.
_ENVIRONMENTS = r"(?:equation\*?|align\*?|aligned|gather\*?|multline\*?|displaymath|math|array|cases|matrix|[pbvBV]matrix)"
NOISE = [
    r"(?ms)^[ \t]*```.*?^[ \t]*```[ \t]*$", r"(?ms)^[ \t]*~~~.*?^[ \t]*~~~[ \t]*$", r"(?m)^(?: {4}|\t).*$", r"(?is)<img\b[^>]*>", r"!\[[^\]]*\]\([^\n)]*\)",
    r"(?m)^[ \t]*!\[[^\]]*\][ \t]*\[[^\]]*\][ \t]*$", r"(?m)^[ \t]*\[[^\]]+\]:[ \t]*\S+(?:[ \t]+.*)?$", rf"(?is)\\begin\{{{_ENVIRONMENTS}\}}.*?\\end\{{{_ENVIRONMENTS}\}}",
    r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]", r"\$[^$]*\$", r"(?s)\\\(.*?\\\)", r"`+[^`\n]*`+", r"\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}", r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", r"<[^>]+>",
]
#: What every text has one of that a pattern of NOISE changes.
NOISE_MARKS = r"[`<\\$\t]|~~~|!\[|\]:| {4}"
ASCII = r"[\x{0}-\x{7f}]+"
MATH = r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\$[^$\n]+\$|\\\(.*?\\\)"
IMAGE = r"!\[[^\]]*\]\([^\n)]*\)"
CODE = r"(?s)```.*?```"
# What a model says about itself or its work.
META = [r"以下(?:内容)?是(?:翻译|译文)", r"(?i)作为(?:一个)?\s*AI", r"(?i)\bhere (?:is|are) the translation\b", r"(?i)\bas an AI\b", r"(?i)\bI (?:have )?translated\b"]
WHOLE, ANSWER = "文档", "最终答案"


def stripped_noise(text: Column) -> Column:
    """Text without code, images, formulas, commands and tags. A text that has none of their marks is looked at once."""
    clean = text
    for pattern in NOISE:
        clean = F.regexp_replace(clean, pattern, " ")
    return F.when(text.rlike(NOISE_MARKS), clean).otherwise(text)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def folded(text: Column, lower: Column | None = None) -> Column:
    """Lower case without the accents of Latin letters; ``lower`` is the text in lower case, where that is at hand."""
    lower = F.lower(text) if lower is None else lower
    return F.when(_ascii(text), lower).otherwise(F.replace(F.translate(lower, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss")))


def capped_hits(known: str) -> tuple[Column, Column]:
    """_words that are among the known ones, and their number, each counted up to three times."""
    hits = F.filter("_words", lambda w: w.isin(*known.split()))
    return hits, F.aggregate(F.array_distinct(hits), F.lit(0), lambda s, w: s + F.least(F.lit(3), F.size(F.filter(hits, lambda x: x == w))))


def language_scores(df: DataFrame, text: str, words: dict[str, str] = WORDS, phrases: dict[str, list[str]] = PHRASES, chars: dict[str, str] = CHARS) -> DataFrame:
    """df with _clean, _words and _scores: for each language struct(score, distinct, lang).

    A word counts up to three times, a phrase or a marking character twice. All is computed within the row: no shuffle. A text's words
    are gone through once, for those that any language knows; each language then counts among what is left of these, three of a word
    at most, so the work of a language does not grow with the text.
    """
    known = sorted({w for line in words.values() for w in line.split()})
    df = df.withColumn("_clean", stripped_noise(F.coalesce(text, F.lit("")))).withColumn("_lower", F.lower("_clean")).withColumn("_folded", folded(F.col("_clean"), F.col("_lower")))
    df = df.withColumn("_words", F.regexp_extract_all("_folded", F.lit(r"(\p{L}+)"), F.lit(1)))
    df = df.withColumn("_known", F.sort_array(F.filter("_words", lambda w: w.isin(*known))))
    # In order, the fourth of a word has the same one three places before it.
    df = df.withColumn("_known", F.filter("_known", lambda w, k: (k < 3) | (F.get("_known", k - 3) != w)))
    if chars:
        # A class of many characters costs a comparison with each, so ASCII goes first, by its range, unless it holds a mark.
        kept = F.col("_lower") if any(c.isascii() for c in "".join(chars.values())) else F.regexp_replace("_lower", ASCII, "")
        df = df.withColumn("_marks", F.regexp_replace(kept, f"[^{''.join(chars.values())}]+", ""))

    def score(lang: str) -> Column:
        hits = F.filter("_known", lambda w: w.isin(*words[lang].split()))
        extra = [2 * _times("_folded", folded_plain(p)) for p in phrases.get(lang, [])]
        if lang in chars:
            extra.append(2 * F.regexp_count("_marks", F.lit(f"[{chars[lang]}]")))
        return F.struct(sum(extra, F.size(hits)).alias("score"), F.size(F.array_distinct(hits)).alias("distinct"), F.lit(lang).alias("lang"))

    return df.withColumn("_scores", F.array(*[score(lang) for lang in words])).drop("_known", "_marks", "_lower")


def _times(column: str, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps, from the left."""
    return F.floor((F.octet_length(column) - F.octet_length(F.replace(F.col(column), F.lit(phrase), F.lit("")))) / len(phrase.encode())).cast("int")


def folded_plain(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN)).replace("ß", "ss")


def declared_codes(text: Column) -> tuple[Column, Column]:
    """The known codes (distinct) that a declaration names, and whether it names several languages."""
    parts = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), SEPARATOR), lambda p: F.trim(p) != "")
    table = F.create_map(*[F.lit(x) for code, names in DECLARED.items() for n in names.split() for x in (n, code)])
    codes = F.array_distinct(F.array_compact(F.transform(parts, lambda p: table[F.regexp_replace(folded(p), "[^a-z]+", "")])))
    return codes, (F.size(parts) > 1) | (F.size(codes) > 1)


def detect_language(df: DataFrame, text: str, declared: str | None = None) -> DataFrame:
    """df with lang and conf (high, medium, low); und where the text does not say. They are called detected and detected_conf where df has such columns.

    Scripts come first (kana or Hangul: und; Han, Greek or Cyrillic: zh, el, mn, mk or ru by their marks, else und), then Latin function words with a
    lead of two over the next language, then what the source declares: agreement raises confidence, conflict lowers it
    and never decides for English. A null or empty text is und with low confidence.
    """
    own = df.columns
    kept = F.struct(*[df[f"`{c}`"] for c in own]).alias("_own")  # so that no column of df meets one of those below
    df = language_scores(df.select(kept, df[f"`{text}`"].alias("_text"), *([df[f"`{declared}`"].alias("_declared")] if declared else [])), "_text")
    declared = "_declared" if declared else None
    count = lambda p: F.regexp_count("_clean", F.lit(p))
    pair = lambda lang, conf: F.struct((lang if isinstance(lang, Column) else F.lit(lang)).alias("lang"), F.lit(conf).alias("conf"))
    # Whether there are 4 or 12 letters is all that is asked of their number, so no more than these are looked for.
    some = lambda n: F.col("_clean").rlike(rf"\A(?:[^\p{{L}}]*+\p{{L}}){{{n}}}")
    df = df.withColumn("_letters", F.when(some(12), 12).when(some(4), 4).otherwise(0))
    # Equal scores: the language named first leads, so the place in the list breaks ties.
    ranked = F.array_sort("_scores", lambda a, b: b["score"] - a["score"])
    df = df.withColumn("_ranked", ranked).withColumn("_best", F.get("_ranked", F.lit(0))).withColumn("_margin", F.col("_best.score") - F.get("_ranked", F.lit(1))["score"])
    density = F.col("_best.distinct") / F.greatest(F.size("_words"), F.lit(1))
    english, best = F.col("_best.lang") == "en", F.col("_best.lang")
    tiny = english & (F.size("_words") <= 3) & F.exists("_words", lambda w: w.isin(*TINY)) & (F.col("_margin") >= 1) & (density >= 0.5)
    latin = (
        F.when((F.col("_best.score") < 3) | (F.col("_margin") < 2), F.when(tiny, pair("en", "high")).otherwise(pair("und", "low")))
        .when(density >= F.when(english, 0.4).otherwise(0.5), pair(best, "high"))
        .when((F.col("_best.score") >= 7) & (F.col("_margin") >= 4), pair(best, "high"))
        .otherwise(pair(best, "medium"))
    )
    greek = F.regexp_extract_all("_clean", F.lit(r"([\x{370}-\x{3ff}\x{1f00}-\x{1fff}]{2,})"), F.lit(1))
    han, cyrillic = count(r"\p{IsHan}"), count(r"[\x{400}-\x{52f}]")
    marks = sum((F.col("_clean").contains(m).cast("int") for m in CHINESE.split()), F.lit(0))
    slavic = (
        F.when((capped_hits(MONGOLIAN)[1] >= 2) & F.col("_clean").rlike("[ӨөҮү]"), pair("mn", "high"))
        .when((capped_hits(MACEDONIAN)[1] >= 2) & F.col("_clean").rlike("[ЃѓЅѕЌќ]"), pair("mk", "high"))
        .when(capped_hits(RUSSIAN)[1] >= 3, pair("ru", "high"))
        .otherwise(pair("und", "low"))
    )
    found = (
        F.when((count(r"[\x{3040}-\x{30ff}]") >= 2) | (count(r"[\x{ac00}-\x{d7af}]") >= 2), pair("und", "low"))
        .when((han >= 4) & (han >= 2 * cyrillic), F.when(marks >= 2, pair("zh", "high")).otherwise(pair("und", "low")))
        .when((F.size(greek) >= 2) & (F.length(F.array_join(greek, "")) >= 6), pair("el", "high"))
        .when((cyrillic >= 6) & (cyrillic >= 2 * han), slavic)
        .otherwise(latin)
    )
    # Below the first of Greek there is none of these scripts: such a text is looked at once instead of once for each.
    found = F.when(_ascii(F.col("_clean")) | ~F.col("_clean").rlike(r"[^\x{0}-\x{36f}]"), latin).otherwise(found)
    df = df.withColumn("_found", F.when(F.col("_letters") < 4, pair("und", "low")).otherwise(found))
    lang, conf = F.col("_found.lang"), F.col("_found.conf")
    if declared:
        said, several = declared_codes(F.col(declared))
        df = df.withColumn("_said", said).withColumn("_several", several)
        said, several, one = F.col("_said"), F.col("_several"), F.get("_said", F.lit(0))
        other = F.get(F.array_sort(F.filter("_said", lambda c: c != "en")), F.lit(0))
        df = df.withColumn(
            "_found",
            F.when((F.col("_letters") < 4) | ((lang == "und") & (F.col("_letters") < 12)), F.col("_found"))
            .when(several & F.array_contains("_said", "en"), F.when(lang == "und", pair("und", "low")).when(lang != "en", pair(lang, "low")).otherwise(pair("en", "medium")))
            .when(F.size("_said") == 0, F.col("_found"))
            .when(F.size("_said") > 1, F.when((lang != "und") & F.array_contains("_said", lang), pair(lang, "low")).otherwise(pair(F.coalesce(other, F.lit("und")), "low")))
            .when(lang == "und", F.when(one == "en", pair("und", "low")).otherwise(pair(one, "low")))
            .when(lang == one, F.struct(lang.alias("lang"), F.when(conf.isin("high", "medium"), "high").otherwise("medium").alias("conf")))
            .when(lang == "en", pair(one, "low"))
            .otherwise(pair(lang, "low")),
        )
    named = "lang" if "lang" not in own else "detected"
    return df.select(F.col("_own.*"), lang.alias(named), conf.alias("conf" if "conf" not in own else f"{named}_conf"))


def parts(text: Column) -> Column:
    """Array of struct(heading, body): what precedes the first '## ' line (heading: the whole document), then each section."""
    pieces = F.split(text, r"(?m)^## ")
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            F.when(i == 0, F.lit(WHOLE)).otherwise(F.trim(F.regexp_extract(p, r"\A([^\n]*)", 1))).alias("heading"),
            F.when(i == 0, p).otherwise(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("body"),
        ),
    )


def _spans(sections: Column, pattern: str) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.transform(F.regexp_extract_all(s["body"], F.lit(pattern), F.lit(0)), lambda m: F.struct(s["heading"].alias("section"), m.alias("text")))))


def translation_findings(pairs: DataFrame, source: str, target: str, mode: str = "translated") -> DataFrame:
    """One row per finding of a source and its translation: pairs' other columns, finding, section, before, after.

    Formulas, code and images must be the same in order; H1 lines and headings must agree; no part may be empty; a
    section equal to its source with prose in it is untranslated; a final answer of symbols must stay; no fence around
    the whole and no talk of the model. Null texts count as empty.
    """
    own = [c for c in pairs.columns if c not in (source, target)]
    df = pairs.withColumn("_s", F.coalesce(source, F.lit(""))).withColumn("_t", F.coalesce(target, F.lit(""))).withColumn("_a", parts(F.col("_s"))).withColumn("_b", parts(F.col("_t")))

    def found(kind: str, section: Column, before: Column, after: Column) -> Column:
        text = lambda x: F.coalesce(excerpt(x), F.lit(""))
        return F.struct(F.lit(kind).alias("finding"), section.alias("section"), text(before).alias("before"), text(after).alias("after"))

    def sequence(kind: str, pattern: str) -> Column:
        both = F.arrays_zip(_spans(F.col("_a"), pattern).alias("x"), _spans(F.col("_b"), pattern).alias("y"))
        wrong = F.filter(both, lambda z: ~z["x"]["text"].eqNullSafe(z["y"]["text"]))
        return F.transform(wrong, lambda z: found(kind, F.coalesce(z["x"]["section"], z["y"]["section"]), z["x"]["text"], z["y"]["text"]))

    def when(rule: Column, item: Column) -> Column:
        return F.when(rule, F.array(item)).otherwise(F.array().cast("array<struct<finding:string,section:string,before:string,after:string>>"))

    lines = lambda c: F.regexp_extract_all(c, F.lit(r"(?m)^# [^\n]*"), F.lit(0))
    heads = lambda c: F.transform(rest(c), lambda s: s["heading"])
    empty = F.col("_t").rlike(r"\A\s*\z")
    bare = F.filter(rest(F.col("_b")), lambda s: s["body"].rlike(r"\A\s*\z"))
    zipped = rest(F.arrays_zip(F.col("_a").alias("x"), F.col("_b").alias("y")))
    same = F.filter(zipped, lambda z: (z["x"]["heading"] == z["y"]["heading"]) & (z["x"]["body"] == z["y"]["body"]) & stripped_noise(z["x"]["body"]).rlike(r"\p{L}{2}"))
    answer = lambda c: F.get(F.filter(c, lambda s: s["heading"] == ANSWER), F.lit(0))["body"]
    symbols = (stripped(answer(F.col("_a"))) != "") & ~F.regexp_replace(answer(F.col("_a")), r"\\[A-Za-z]+", "").rlike(r"\p{L}{2}")
    content = F.concat(
        sequence("math_mismatch", MATH), sequence("code_mismatch", CODE), sequence("image_mismatch", IMAGE),
        when(lines(F.col("_s")) != lines(F.col("_t")), found("structure_mismatch", F.lit("H1"), F.array_join(lines(F.col("_s")), "\n"), F.array_join(lines(F.col("_t")), "\n"))),
        when(heads(F.col("_a")) != heads(F.col("_b")), found("structure_mismatch", F.lit("H2"), F.array_join(heads(F.col("_a")), "\n"), F.array_join(heads(F.col("_b")), "\n"))),
        F.transform(bare, lambda s: found("empty_translation", s["heading"], F.lit(""), F.lit(""))),
        F.transform(same, lambda z: found("untranslated", z["x"]["heading"], z["x"]["body"], z["y"]["body"])) if mode == "translated" else when(F.lit(False), found("", F.lit(""), F.lit(""), F.lit(""))),
        when(F.coalesce(symbols & (answer(F.col("_a")) != answer(F.col("_b"))), F.lit(False)), found("final_answer_mismatch", F.lit(ANSWER), answer(F.col("_a")), answer(F.col("_b")))),
        when(stripped(F.col("_t")).rlike(r"(?s)\A(```|~~~)[^\n]*\n.*\n\1[ \t]*\z"), found("extra_code_fence", F.lit(WHOLE), F.col("_s"), F.col("_t"))),
        *[F.transform(_spans(F.col("_b"), p), lambda m: found("model_meta_leak", m["section"], F.lit(""), m["text"])) for p in META],
    )
    df = df.withColumn("_f", F.when(empty, F.array(found("empty_translation", F.lit(WHOLE), F.col("_s"), F.lit("")))).otherwise(content))
    return df.select(*own, F.explode("_f").alias("f")).select(*own, "f.*")


def rolled_up(findings: DataFrame) -> DataFrame:
    """How many findings there are of each type."""
    return findings.groupBy("finding").agg(F.count("*").alias("n"))


def missing_anchors(source: Column, target: Column) -> Column:
    """Numbers of two digits or more that the source has and the target lacks, sorted."""
    return F.array_sort(F.array_except(numbers(F.coalesce(source, F.lit(""))), numbers(F.coalesce(target, F.lit("")))))


def boilerplate(rows: DataFrame, batch: str, source: str, target: str, least: int = 2) -> DataFrame:
    """Equal targets (white space and case aside) of different sources in a batch: batch, digest, copies, sources."""
    norm = lambda c: F.sha2(F.regexp_replace(F.lower(c), r"\s+", ""), 256)
    groups = rows.where(F.length(F.trim(target)) > 0).groupBy(batch, norm(target).alias("digest")).agg(F.count("*").alias("copies"), F.countDistinct(norm(source)).alias("sources"))
    return groups.where((F.col("copies") >= least) & (F.col("sources") >= least))


@F.pandas_udf(S.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The standard library's sequence-matching ratio, of left against right; null texts count as empty."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def lexical_pairs(pairs: DataFrame, texts: DataFrame, least: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, ...) with lexical of at least ``least``, ids without a text, whose pairs are dropped).

    ``texts`` is (id, text). Lengths alone bound the ratio from above, so most pairs never reach Python.
    """
    x = texts.select(F.col("id").alias("a"), F.col("text").alias("_x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("_y"))
    met = pairs.join(x, "a", "left").join(y, "b", "left")
    ids = met.select(F.explode(F.array_compact(F.array(F.when(F.col("_x").isNull(), F.col("a")), F.when(F.col("_y").isNull(), F.col("b"))))).alias("id")).distinct()
    bound = 2.0 * F.least(F.length("_x"), F.length("_y")) / F.greatest(F.length("_x") + F.length("_y"), F.lit(1))
    both = met.where("_x is not null and _y is not null").where((bound >= least) | (F.length("_x") + F.length("_y") == 0))
    scored = both.withColumn("lexical", F.when(F.col("_x") == F.col("_y"), F.lit(1.0)).otherwise(ratio("_x", "_y")))
    return scored.where(F.col("lexical") >= least).drop("_x", "_y"), ids


_PROTECTED = re.compile(rf"{CODE}|{MATH}|{IMAGE}|`[^`\n]+`".replace("(?s)", ""), re.S)


@F.pandas_udf(S.StructType([S.StructField("text", S.StringType()), S.StructField("spans", S.ArrayType(S.StringType()))]))
def protected(text: pd.Series) -> pd.DataFrame:
    """Text with ⟦0⟧, ⟦1⟧, ... for its code, formulas and images, and these in order; brackets that look like one are protected too."""
    out, spans = [], []
    pattern = re.compile(rf"⟦\d+⟧|{_PROTECTED.pattern}", re.S)
    for t in text:
        kept: list[str] = []
        out.append(pattern.sub(lambda m: (kept.append(m.group(0)), f"⟦{len(kept) - 1}⟧")[1], t or ""))
        spans.append(kept)
    return pd.DataFrame({"text": out, "spans": spans})


@F.pandas_udf(S.StringType())
def restored(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Text with its placeholders replaced by their spans; null unless each occurs exactly once."""
    out = []
    for t, s in zip(text, spans, strict=True):
        seen = sorted(int(k) for k in re.findall(r"⟦(\d+)⟧", t or ""))
        out.append(re.sub(r"⟦(\d+)⟧", lambda m, s=s: s[int(m.group(1))], t or "") if seen == list(range(len(s))) else None)
    return pd.Series(out, dtype="object")


def split_chunks(text: str | None, target: int = 300, most: int = 3) -> list[str]:
    """One to ``most`` chunks of about equal length, cut between paragraphs, or between sentences of a single paragraph."""
    text = (text or "").strip()
    units = [u.strip() for u in re.split(r"\n\s*\n", text) if u.strip()]
    if len(text) <= target:
        return [" ".join(text.split())] if text else []
    if len(units) == 1:
        units = [s for s in re.split(r"(?<=[。．！？!?；;])", text) if s.strip()]
    wanted = min(most, max(2, -(-len(text) // target)))
    share = -(-sum(map(len, units)) // wanted)
    made = [units[0]]
    for unit in units[1:]:
        if len(made) < wanted and len(made[-1]) + len(unit) > share:
            made.append(unit)
        else:
            made[-1] += "\n" + unit
    return [" ".join(c.split()) for c in made]


def encode_features(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, vector, present): the unit-length sum of hashed character-trigram vectors of a text's chunks; zeros without a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, present = [], []
            for t in batch.column(1).to_pylist():
                total = np.zeros(dim)
                chunks = split_chunks(t)
                for chunk in chunks:
                    codes = np.array([zlib.crc32(chunk[k : k + 3].lower().encode("utf-8", "surrogatepass")) for k in range(max(1, len(chunk) - 2))])
                    one = np.bincount(codes % dim, np.where(codes >> 16 & 1, 1.0, -1.0), dim)
                    total += one / (np.linalg.norm(one) or 1.0)
                size = np.linalg.norm(total)
                vectors.append((total / size if size else total).astype(np.float32))
                present.append(bool(chunks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), pa.array(present, pa.bool_())], [key, "vector", "present"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<float>, present boolean")


# What twice-encoded text is told by at once, and a lead byte with a byte that goes on, both read as letters.
MOJIBAKE = r"\x{fffd}|\x{c3}[\x{80}-\x{bf}\x{2010}-\x{203a}]|\x{c2}[\x{80}-\x{bf} ]|\x{e2}[\x{80}-\x{bf}\x{2010}-\x{203a}\x{20ac}]{1,2}|\x{f0}[\x{80}-\x{bf}]{1,3}|\x{ef}[\x{bc}-\x{be}]"
MARKER = r"[\x{c2}-\x{ef}][\x{80}-\x{bf}]"
#: Runs that are UTF-8 if read as bytes: nothing overlong, no surrogates.
_ENCODED = r"(?:[\x{c2}-\x{df}][\x{80}-\x{bf}]|[\x{e0}-\x{ef}][\x{80}-\x{bf}]{2}|[\x{f0}-\x{f4}][\x{80}-\x{bf}]{3})+"


def decoded_back(text: Column) -> Column:
    """A text whose characters are bytes, as the text that these bytes encode; null where they encode none."""
    raw = F.encode(text, "ISO-8859-1")
    plain = ~text.rlike(r"[^\x{00}-\x{ff}]")  # a character beyond would become a question mark
    return F.when(plain & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def mojibake(df: DataFrame, text: str, least: int = 3) -> DataFrame:
    """df with markers, repaired and wrong: signs that a text was encoded twice.

    ``markers`` counts pairs of characters that look like bytes of UTF-8. ``repaired`` counts runs of such characters that decoding
    backwards turns into other text, which confirms them. ``wrong`` is said of a text with a signature or with ``least`` markers.
    Code, formulas, placeholders, images and tags don't count. Null has none.
    """
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    for p in [CODE, MATH, IMAGE, r"`[^`\n]+`", r"\{\{[A-Z]{2,5}_\d{4}\}\}", r"<[^>]+>"]:
        clean = F.regexp_replace(clean, p, " ")
    rows = df.withColumn("_clean", clean)
    runs = F.regexp_extract_all("_clean", F.lit(f"({_ENCODED})"), F.lit(1))
    back = F.size(F.filter(runs, lambda r: decoded_back(r).isNotNull()))
    n = F.regexp_count("_clean", F.lit(MARKER))
    return rows.withColumns({"markers": n, "repaired": back, "wrong": F.col("_clean").rlike(MOJIBAKE) | (n >= least)}).drop("_clean")
