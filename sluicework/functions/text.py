"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark English; spelled ordinals.
ENGLISH = "the of and to in is that for with as are be by this from it on at an was".split()
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth "
    "seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth"
).split()
#: A spelled ordinal at the start that no round or day follows.
LEADING = rf"^({'|'.join(ORDINALS)}) +(?!round|stage|selection|day|problem)"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def norm_name(name: Column) -> Column:
    """Lower case without years, ordinals, roman numbers and punctuation; null if nothing is left."""
    out = F.lower(name)
    for pattern in (r"\b(19|20)\d{2}\b", r"\b\d{1,3}(st|nd|rd|th)\b", r"\b[ivxl]{1,6}\b", r"[-–—_/,.#]"):
        out = F.regexp_replace(out, pattern, " ")
    return F.nullif(squeezed(out), F.lit(""))


def name_variants(name: Column) -> Column:
    """The name, without a leading 'the', and without a leading spelled ordinal that no round or day follows."""
    return F.array_distinct(F.array(name, F.regexp_replace(name, "^the +", ""), key_form(name)))


def key_form(name: Column) -> Column:
    """What a name and a table's key share: no leading 'the', no leading spelled ordinal."""
    return F.regexp_replace(F.regexp_replace(name, "^the +", ""), LEADING, "")


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def snippet(text: Column, word: str, width: int = 120, lead: int = 40) -> Column:
    """Text around the first hit of a word, whatever its case, with ellipses; null without a hit."""
    line = squeezed(text)
    at = F.locate(word.lower(), F.lower(line))
    start = F.greatest(F.lit(1), at - lead)
    stop = F.least(F.length(line), at - 1 + width)
    body = F.substring(line, start, stop - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(stop < F.length(line), "…").otherwise("")))


def english_votes(text: Column) -> Column:
    """How many of a text's words are marks of English."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z]+", " "), " ")
    return F.size(F.filter(words, lambda w: w.isin(*ENGLISH))).cast("long")


def looks_english(text: Column) -> Column:
    """At least one word in ten marks English, and under three letters are of other scripts."""
    words = F.size(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z]+", " "), " "), lambda w: w != ""))
    return (english_votes(text) * 10 >= words) & (F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsCyrillic}\p{IsGreek}]")) < 3)


def script_counts(text: Column) -> dict[str, Column]:
    return {s.lower(): F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).cast("long") for s in ("Latin", "Cyrillic", "Greek", "Han")}


# Environments that hold formulas, macros of layout, and spellings of one macro.
ENVIRONMENTS = r"(?s)\\begin\{(?:equation|align|aligned|gather|multline|eqnarray|cases|array|split)\*?\}(.*?)\\end\{(?:equation|align|aligned|gather|multline|eqnarray|cases|array|split)\*?\}"
DISPLAY = r"(?s)(?:\$\$(.*?)\$\$|\\\[(.*?)\\\]|\\\((.*?)\\\))"
INLINE = r"\$([^$\n]+)\$"
LAYOUT = [(r"\\(?:left|right|bigg?|Bigg?|displaystyle|textstyle|limits|quad|qquad|,|;|:|!)(?![A-Za-z])", ""), (r"\\[dt]frac(?![A-Za-z])", r"\\frac"), (r"\\le(?![A-Za-z])", r"\\leq"), (r"\\ge(?![A-Za-z])", r"\\geq"), (r"\s+", ""), (r"^[.,;:]+|[.,;:]+$", "")]


def norm_formula(formula: Column) -> Column:
    """A formula without layout and white space, with one spelling of its macros and no punctuation at its ends."""
    for pattern, new in LAYOUT:
        formula = F.regexp_replace(formula, pattern, new)
    return formula


def formulas(text: Column) -> Column:
    """Distinct formulas of three characters or more: of environments, then displayed, then inline; what one took is blank to the next. Rows of an environment count for themselves."""
    display = lambda t: F.transform(F.regexp_extract_all(t, F.lit(DISPLAY), F.lit(0)), lambda m: F.concat_ws("", F.regexp_extract(m, DISPLAY, 1), F.regexp_extract(m, DISPLAY, 2), F.regexp_extract(m, DISPLAY, 3)))
    rest_ = F.regexp_replace(text, ENVIRONMENTS, " ")
    last = F.regexp_replace(rest_, DISPLAY, " ")
    found = F.concat(F.regexp_extract_all(text, F.lit(ENVIRONMENTS), F.lit(1)), display(rest_), F.regexp_extract_all(last, F.lit(INLINE), F.lit(1)))
    rows = F.flatten(F.transform(found, lambda f: F.split(F.regexp_replace(f, "&", ""), r"\\\\")))
    return F.array_distinct(F.filter(F.transform(rows, norm_formula), lambda f: F.length(f) >= 3))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def rest(array: Column) -> Column:
    """An array without its first element."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1)))


def sections(body: Column) -> Column:
    """Map from '## ' heading to its text; of repeated headings the last."""
    parts = rest(F.split(body, r"(?m)^## "))
    entry = lambda p: F.struct(stripped(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("key"), stripped(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("value"))
    rows = F.transform(parts, entry)
    return F.map_from_entries(F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda y: y["key"] == x["key"])))


def hint_ladder(text: Column) -> Column:
    """Numbered items ('1. ' or '1、') in order."""
    return F.filter(F.transform(rest(F.split(text, r"(?m)^\s*\d+[.、]\s+")), stripped), lambda x: x != "")


def numbers(text: Column) -> Column:
    """Distinct numbers of two digits or more."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d{2,})"), F.lit(1)))


def percent(value: Column) -> Column:
    return F.floor(value * 100 + 0.5)


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def excerpt(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def contained(path: Column) -> Column:
    """Whether a relative path never leaves the folder that it starts from."""
    step = lambda p: F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("deep"), F.lit(True).alias("inside"))
    walked = F.aggregate(F.split(path, "/"), start, lambda s, p: F.struct((s["deep"] + step(p)).alias("deep"), (s["inside"] & (s["deep"] + step(p) >= 0)).alias("inside")))
    return walked["inside"] & ~path.startswith("/")


def one_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null counts as none."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))  # a parser may pass over what follows a value, but not inside of an array
    return F.coalesce(F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1), F.lit(False))
