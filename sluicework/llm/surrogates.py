"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

One regular expression finds the entities of a text; a name found in a document, behind a title or by its given name, is
then looked for in all of it, so mentions without a title count too. An entity has a canonical form (lower-cased, digits
only), so that all its spellings get one surrogate; a name is taken word by word, so a person keeps one name with any
title, by full name or by one part of it. The surrogate is drawn from SHA-512 of a secret key and the canonical form; it
keeps lengths, case, separators, check digits and a name's gender and script. All distinct entities meet in one table,
where a surrogate that two of them share, or that is itself a real entity, is drawn again: so different entities stay
different and equal ones equal, across the whole corpus. Everything is built of DataFrame functions; texts without
entities are not shuffled.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.llm.batches import free_name
from sluicework.session import written

#: Where a session holds the secret key of the query.
KEY_SETTING = "spark.sluicework.surrogates.key"
ROUNDS = 64
#: Attempts after which a surrogate may be one part longer, so that no format runs out.
LONGER = 8

# Honorifics by gender, and without; particles of family names; common given names by gender.
MALE = "Mr|Herr|Monsieur|Señor|Sr|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"
NEUTRAL = "Dr|Prof"
PARTICLES = "von|van|de|del|della|di|da|la|le|den|der|zu"
MEN = (
    "Alexander Andreas Andrew Anthony Antonio Benjamin Bernd Carlos Charles Christopher Daniel David Dieter Edward Eric Fernando François "
    "Friedrich George Hans Heinrich Henry Jacques James Javier Jean Jeffrey Johannes John Jonathan Jorge José Joseph Juan Jürgen Karl Kenneth "
    "Klaus Kevin Luis Manuel Matthew Michael Miguel Nicolas Pablo Patrick Pedro Peter Philippe Pierre Richard Robert Ronald Stefan Stephen "
    "Steven Thomas Timothy William Wolfgang Алексей Андрей Дмитрий Иван Михаил Николай Сергей"
).split()
WOMEN = (
    "Alice Amélie Ana Andrea Angela Anna Barbara Brigitte Camille Carmen Carolyn Catherine Céline Chantal Charlotte Claudia Deborah Donna "
    "Dorothy Elena Elizabeth Emily Emma Gabriele Hannah Heike Helen Ingrid Isabel Isabelle Jennifer Jessica Julia Karen Katharina Kimberly "
    "Laura Linda Lisa Lucía Margaret Maria María Marta Martina Mary Melissa Michelle Monika Nancy Nathalie Nicole Patricia Petra Rebecca Renate "
    "Sabine Sandra Sarah Sharon Sofía Sophie Stephanie Susan Sylvie Ursula Анна Елена Мария Наталья Ольга Татьяна"
).split()

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
# Layouts of phone numbers: two last groups of 3 or 4; groups by twos after a country's code, or 0 and a digit, or
# three digits; a country's code with an area and one last group, or all without separators; ten or eleven bare digits.
PHONES = [
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}",
    r"\+\d{1,3}[ .-]?(?:\(0\) ?)?\d{1,3}(?:[ .-]\d{2}){3,5}",
    r"0\d(?:[ .-]?\d{2}){4}",
    r"[6-9]\d{2}(?: \d{2}){3}",
    r"\+(?=(?:[ .()-]{0,2}\d){7,15}(?!\d))\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,5}\)|\d{1,5})[ .-]?\d{4,8}",
    r"(?:[2-9]\d{9}|0\d{9,10})(?!\.\d)",
]
TITLE = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? )"
WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
REST = rf"(?: (?:(?:{PARTICLES}) ){{0,2}}{WORD})"
KINDS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?:\d{4}[ -]?\d{6}[ -]?\d{5}|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7})(?![\p{L}\p{N}])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}])(?!\.\d)",
    "phone": rf"(?:{'|'.join(PHONES)})(?![\p{{L}}\p{{N}}])",
    "name": rf"(?:{TITLE}{{1,2}}{WORD}{REST}?|(?:{'|'.join(MEN + WOMEN)})(?: \p{{Lu}}\.)?{REST})",
}
ANY = r"(?<![\p{L}\p{N}_+.%@-])(?:" + "|".join(KINDS.values()) + ")|(?<=[^\\p{L}\\p{N}_+][.])(?:" + KINDS["name"] + ")"
SYLLABLES = {"latin": "ba be bo da de do ka ke la le lo ma me na no ra re ro sa se so ta te to va ve vi mi ni ri li ti".split(), "cyrillic": "ба бе бо да де до ка ке ла ле ло ма ме на но ра ре ро са се со та те то ва ве ви ми ни ри ли ти".split()}
ACCENTED, RUSSIAN = "àáâäçèéêëìíîïñòóôöùúûü", "абвгдежзиклмнопрстуфхцчшщэюя"


def kind_of(match: Column) -> Column:
    """The first kind whose format the whole match has; a repeated name alone has none and is a name."""
    out = F.lit("name")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(match.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def untitled(match: Column) -> Column:
    return F.regexp_replace(match, rf"^{TITLE}+", "")


def name_words(match: Column) -> Column:
    """The words of a name that are replaced: not its titles, particles and initials."""
    return F.regexp_extract_all(untitled(match), F.lit(WORD), F.lit(0))


def gender_of(match: Column) -> Column:
    """m, f or n, by the title or else by the given name."""
    title, first = F.regexp_extract(match, rf"^({TITLE}+)", 1), F.get(name_words(match), F.lit(0))
    return F.when(title.rlike(rf"(?:^| )(?:{MALE})\b"), "m").when(title.rlike(rf"(?:^| )(?:{FEMALE})\b"), "f").when(first.isin(*MEN), "m").when(first.isin(*WOMEN), "f").otherwise("n")


def canonical(kind: Column, match: Column) -> Column:
    """What all spellings of an entity that is no name share."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(match, r"\D", "")).when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(F.lower(match))


def units(kind: Column, match: Column) -> Column:
    """Array of struct(canonical, gender): one for an entity, one for each word of a name. Only a given name, the first of several words, has a gender."""
    words = name_words(match)
    given = lambda i: F.when((i == 0) & (F.size(words) > 1), gender_of(match)).otherwise("n")
    single = F.array(F.struct(canonical(kind, match).alias("canonical"), F.lit("n").alias("gender")))
    return F.when(kind == "name", F.transform(words, lambda w, i: F.struct(F.lower(w).alias("canonical"), given(i).alias("gender")))).otherwise(single)


def _drawn(stream: Column, i: Column, most: int) -> Column:
    """A number below ``most`` from the i-th four hexadecimal digits."""
    return F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % most


def _one_of(letters: str, stream: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _drawn(stream, i, len(letters)) + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), F.substring(turned, i, F.lit(1)).cast("int") + 1))) % 10


def drawn(kind: Column, text: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate in the given attempt. Late attempts of names and addresses have more letters."""
    blocks = F.floor(F.length(text) / 32).cast("int") + 1
    stream = F.array_join(F.transform(F.sequence(F.lit(0), blocks), lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, text, attempt.cast("string"), b.cast("string")), 512)), "")
    tld = F.length(F.substring_index(text, ".", -1))
    more = F.floor(attempt / LONGER).cast("int")

    def other(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        swapped = (
            F.when(c.rlike("[0-9]"), _one_of("0123456789", stream, i)).when(c.rlike("[a-z]"), _one_of("abcdefghijklmnopqrstuvwxyz", stream, i))
            .when(c.rlike("[A-Z]"), _one_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", stream, i)).when(c.rlike("[à-ü]"), _one_of(ACCENTED, stream, i)).when(c.rlike("[а-я]"), _one_of(RUSSIAN, stream, i)).otherwise(c)
        )
        kept = F.when(kind == "email", i > F.length(text) - tld).when(kind == "iban", i <= 2).when((kind == "ssn") | (attempt >= LONGER), F.lit(False)).otherwise(i <= 1)
        return F.when(kept, c).otherwise(swapped)

    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), other), "")
    letters = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), more), lambda i: i > 0), lambda i: _one_of("abcdefghijklmnopqrstuvwxyz", stream, i + 3)), "")
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    card = F.when((kind == "card") & (_luhn(text) == 0), F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))).otherwise(plain)
    ip = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (_drawn(stream, i, 254) + 1).cast("string")), ".")
    made = lambda s: F.array_join(F.transform(F.sequence(F.lit(0), 2 + more), lambda i: F.element_at(F.array(*map(F.lit, s)), _drawn(stream, i, len(s)) + 1)), "")
    slavic = text.rlike("[а-яё]")
    ending = F.when(gender == "f", F.when(slavic, "на").otherwise("na")).when(gender == "m", F.when(slavic, "н").otherwise("n")).otherwise("")
    name = F.concat(F.when(slavic, made(SYLLABLES["cyrillic"])).otherwise(made(SYLLABLES["latin"])), ending)
    return F.when(kind == "name", name).when(kind == "ip", ip).when(kind == "email", F.concat(letters, plain)).otherwise(card)


def laid_out(kind: Column, match: Column, surrogates: Column) -> Column:
    """Surrogates in the format of the text that they replace: a name's words in their places, otherwise one for the whole."""
    sign, one = r"[^0-9A-Z]", F.get(surrogates, F.lit(0))

    def at(i: Column) -> Column:
        c = F.substring(match, i, F.lit(1))
        k = F.length(F.regexp_replace(F.substring(match, F.lit(1), i), sign, ""))
        return F.when(c.rlike(sign), c).otherwise(F.substring(one, k, F.lit(1)))

    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), at), "")
    longer = F.length(one) - F.length(match)  # letters put before an address
    upper = lambda i: F.substring(match, i - longer, F.lit(1)).rlike(r"\p{Lu}") & (i > longer)
    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(one)), lambda i: F.when(upper(i), F.upper(F.substring(one, i, F.lit(1)))).otherwise(F.substring(one, i, F.lit(1)))), "")
    words = F.zip_with(name_words(match), surrogates, lambda w, s: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(s)).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))))
    gaps = F.split(untitled(match), WORD, -1)
    name = F.concat(F.regexp_extract(match, rf"^({TITLE}*)", 1), F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""))
    return F.when(kind == "name", name).when(kind == "email", cased).when(kind == "ip", one).otherwise(numbers)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical, and a name's gender); no two of a kind share a surrogate and none is an entity itself.

    A word that is seen with both genders has none. A surrogate that is taken is drawn again; each round keeps what is
    settled. Rows meet by surrogate, so no group is larger than its collisions.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    seen = entities.groupBy("kind", "canonical").agg(F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))
    open_ = written(seen.select("kind", "canonical", F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n").alias("gender"), F.lit(0).alias("attempt")), "pii-entities")
    real = open_.select("kind", F.col("canonical").alias("surrogate"))
    settled = None
    parts = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), entities.sparkSession.sparkContext.defaultParallelism)
    for _ in range(ROUNDS):
        spread = open_.repartition(parts, "kind", "canonical")  # the table is small and drawing is not
        tried = written(spread.withColumn("surrogate", drawn(F.col("kind"), F.col("canonical"), F.col("gender"), F.col("attempt"), key)), "pii-drawn")
        tried = tried.withColumn("turn", F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("canonical")))
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate"))
        tried = written(tried.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left"), "pii-tried")
        good = tried.where("turn = 1 and taken is null").select("kind", "canonical", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        left = tried.where("turn > 1 or taken").select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return settled
        open_ = written(left, "pii-entities")
    raise ValueError("a format of numbers has more entities than half of what it can write; no surrogates of that format are left")


def replace(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with its text column's entities replaced, and n_entities (long; with a number after its name if df has such a column).

    A null text stays null and has 0. Repeated rows stay and are replaced alike; very long texts are read whole. Equal
    entities have equal surrogates in all rows. An empty table gives an empty result. Other columns are kept as they are.
    """
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    text, count = F.col(f"row.`{text_col}`"), free_name("n_entities", df.columns)
    whole = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
    has = F.coalesce(text.rlike(ANY), F.lit(False))
    hit = rows.where(has).select("row", F.monotonically_increasing_id().alias("id"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("first"))
    names = F.array_distinct(F.flatten(F.transform(F.filter("first", lambda m: kind_of(m) == "name"), lambda m: F.transform(name_words(m), F.lower))))
    longest = F.array_sort(names, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    again = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_@.-])(?=\p{Lu})(?iu:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}_@])"))
    hit = written(hit.withColumn("pattern", F.when(F.size(names) > 0, again).otherwise(ANY)).drop("first"), "pii-texts")
    found = hit.select("id", F.posexplode(F.regexp_extract_all(text, F.col("pattern"), F.lit(0))).alias("at", "match")).withColumn("kind", kind_of(F.col("match")))
    found = written(found.select("id", "at", "match", "kind", F.posexplode(units(F.col("kind"), F.col("match"))).alias("k", "unit")).select("id", "at", "match", "kind", "k", "unit.*"), "pii-units")
    named = mapping(found.select("kind", "canonical", "gender"), key)
    put = found.join(named, ["kind", "canonical"]).select("id", "at", "match", "kind", "k", "surrogate").repartition("id")
    put = put.groupBy("id", "at", "match", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "surrogate"))), lambda x: x["surrogate"]).alias("surrogates"))
    put = put.select("id", F.struct("at", laid_out(F.col("kind"), F.col("match"), F.col("surrogates")).alias("put")).alias("put"))
    put = put.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("put")), lambda x: x["put"]).alias("puts"))
    new = F.array_join(F.zip_with(F.split(text, F.col("pattern"), -1), F.col("puts"), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    done = hit.join(put, "id").withColumn("row", F.col("row").withField(f"`{text_col}`", new)).select(*whole, F.size("puts").cast("long").alias(count))
    return rows.where(~has).select(*whole, F.lit(0).cast("long").alias(count)).unionByName(done)


def session_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, a random one that holds for this session and can't be guessed."""
    if spark.conf.get(KEY_SETTING, None) is None:
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: doc_id, text with surrogates, n_entities for every document, by the session's key."""
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
