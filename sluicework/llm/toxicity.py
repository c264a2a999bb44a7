"""Toxicity by a character n-gram linear classifier with naive Bayes features.

Features are the n-grams of 4 to 7 characters (code points, in lower case) present in a text. Each is scaled by its
naive Bayes log-count ratio between the toxic and the other training rows, and a logistic regression is fitted on top.
Its margins become chances by a second, one-dimensional regression on margins that were cross-fitted: half of the
training rows are scored by a model of the other half. Training reads at most ``SAMPLE`` labelled rows, chosen by a
hash of their id, and of these at most ``SAMPLE_BYTES``; the model that comes back has at most ``FEATURES`` weights,
whatever the size of the corpus. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.llm.batches import cuts, handing_back
from sluicework.session import small_batches

SAMPLE, SAMPLE_BYTES = 8000, 1 << 26
FEATURES = 1 << 14
LENGTHS = (4, 5, 6, 7)
HASH_BITS = 22
LEAST_ROWS = 4
PENALTY = 2.0
ROUNDS = 200
#: How much a toxic row counts against another in turning margins into chances; missing one costs more than a false alarm.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7
#: Characters that are hashed together, and bytes of text that are scored together.
CHUNK, SLICE = 1 << 18, 1 << 20
#: Texts that train together; features are numbered by 16 bits.
GROUP = 128
_PAD = np.zeros(max(LENGTHS), np.uint32)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, feature) of every n-gram that starts in a text, in chunks; a text longer than a chunk comes in overlapping pieces.

    What follows a text is zeros, never another text: so a text has the same n-grams whatever stands beside it. A piece
    that is not the last gives only the n-grams that the next does not.
    """
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def out() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        code = np.concatenate([x for _, c, _ in held for x in (c, _PAD)])
        sizes = np.array([len(c) + len(_PAD) for _, c, _ in held])
        begins = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(a, a + m) for a, (_, _, m) in zip(begins.tolist(), held, strict=True)])
        owner = np.repeat(np.array([k for k, _, _ in held], np.int32), [m for _, _, m in held])
        n = len(code) - len(_PAD)
        h = np.zeros(n, np.uint64)
        for k in range(max(LENGTHS)):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n] + np.uint64(1)
            if k + 1 in LENGTHS:
                own = h[starts]
                yield owner, ((own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)).astype(np.int32)

    for k, t in enumerate(texts):
        code = np.frombuffer(("\0" + t.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
        for i in range(0, len(code), CHUNK):
            part = code[i : i + CHUNK + max(LENGTHS) - 1]
            if held and size + len(part) > CHUNK:
                yield from out()
                held, size = [], 0
            held.append((k, part, min(CHUNK, len(part))))
            size += len(part)
    if held:
        yield from out()


def _present(texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted; only features marked in ``table`` if it is given."""
    keys = []
    for owner, feature in _grams(texts):
        if table is not None:
            hit = table[feature]
            owner, feature = owner[hit], feature[hit]
        keys.append(np.unique(owner.astype(np.int64) << HASH_BITS | feature))
    keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias. Without rows of both classes: no feature, and the log-odds of the counts plus one."""
    toxic = toxic.astype(bool)
    bias = float(np.log((toxic.sum() + 1) / ((~toxic).sum() + 1)))
    none = np.empty(0, np.int32), np.empty(0, np.float32), bias
    if toxic.all() or not toxic.any():
        return none
    counts = np.zeros((2, 1 << HASH_BITS), np.int32)
    for k in range(0, len(texts), GROUP):
        row, feature = _present(texts[k : k + GROUP])
        hit = toxic[k + row]
        np.add.at(counts[1], feature[hit], 1)
        np.add.at(counts[0], feature[~hit], 1)
    some = np.flatnonzero(counts[0] + counts[1] >= LEAST_ROWS)
    one, other = counts[1][some].astype(float), counts[0][some].astype(float)
    del counts
    ratio = np.log((one + 1) / (toxic.sum() + 2)) - np.log((other + 1) / ((~toxic).sum() + 2))
    firm = np.abs(ratio) / np.sqrt(1 / (one + 1) + 1 / (other + 1))  # in standard errors
    best = np.argsort(-firm, kind="stable")[:FEATURES]
    best = np.sort(best[firm[best] > 0])
    if not len(best):
        return none
    chosen, r = some[best].astype(np.int32), ratio[best]
    table = np.zeros(1 << HASH_BITS, bool)
    table[chosen] = True
    # What the texts have of the chosen features, group by group: two bytes each, and where each text's begin.
    held = []
    for k in range(0, len(texts), GROUP):
        row, feature = _present(texts[k : k + GROUP], table)
        held.append((np.searchsorted(chosen, feature).astype(np.uint16), np.bincount(row, minlength=len(texts[k : k + GROUP]))))
    y = toxic.astype(float)
    w, b, m, v = np.zeros(len(chosen)), bias, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, ROUNDS + 1):
        own, g, shift = w * r, np.zeros(len(chosen)), 0.0
        for k, (col, each) in enumerate(held):
            at = slice(k * GROUP, k * GROUP + len(each))
            sums = np.concatenate(([0.0], np.cumsum(own[col])))
            ends = np.cumsum(each)
            off = 1 / (1 + np.exp(-np.clip(sums[ends] - sums[ends - each] + b, -40, 40))) - y[at]
            g += np.bincount(col, np.repeat(off, each), len(chosen))
            shift += off.sum()
        g = np.append(g * r + PENALTY * w, shift)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (1 - step / (ROUNDS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return chosen, (w * r).astype(np.float32), float(b)


def margins(texts: list[str], model: tuple[np.ndarray, np.ndarray, float], tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    weight, marked = tables or _tables(model)
    row, feature = _present(texts, marked)
    return np.bincount(row, weight[feature], len(texts)) + model[2]


def _tables(model: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
    weight, marked = np.zeros(1 << HASH_BITS, np.float32), np.zeros(1 << HASH_BITS, bool)
    weight[model[0]], marked[model[0]] = model[1], True
    return weight, marked


def chances(z: np.ndarray, toxic: np.ndarray, weight: float = TOXIC_WEIGHT) -> tuple[float, float]:
    """Slope and shift that turn margins into log-odds: a logistic regression by damped Newton steps; (1, 0) without rows of both classes."""
    if not len(z) or toxic.all() or not toxic.any() or z.std() == 0:
        return 1.0, 0.0
    y, each = np.where(toxic, 1.0, -1.0), np.where(toxic, weight, 1.0)
    mean, size = z.mean(), z.std()
    x, c = (z - mean) / size, np.zeros(2)
    loss = lambda c: (each * np.logaddexp(0, -y * (c[0] * x + c[1]))).sum() + 0.001 * c[0] ** 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(c[0] * x + c[1], -40, 40)))
        off, bend = each * (p - (y > 0)), each * p * (1 - p) + 1e-6
        step = np.linalg.solve([[(bend * x * x).sum() + 0.002, (bend * x).sum()], [(bend * x).sum(), bend.sum()]], [(off * x).sum() + 0.002 * c[0], off.sum()])
        share = 1.0
        while loss(c - share * step) > loss(c) and share > 1e-6:
            share /= 2
        c = c - share * step
    slope = max(c[0] / size, 1e-3)  # a higher margin is never less toxic
    return float(slope), float(c[1] - slope * mean)


MODEL = "part int, features binary, weights binary, bias double, margins binary, toxic binary"


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, text, toxic, fold), sorted by part, to a model for each part: part 2 trains on all its rows, 0 and 1 on one fold and score the other."""
    texts, toxic, fold, held, size = [], [], [], None, 0

    def done() -> pa.RecordBatch:
        y, apart = np.array(toxic, bool), np.array(fold) == held
        model = fit([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart])
        z = margins([t for t, a in zip(texts, apart, strict=True) if a], model) if apart.any() else np.empty(0)
        row = [held], [model[0].tobytes()], [model[1].tobytes()], [model[2]], [z.astype(float).tobytes()], [y[apart].tobytes()]
        kinds = pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "features", "weights", "bias", "margins", "toxic"])

    for batch in batches:
        for part, text, label, own in zip(*(batch.column(k) for k in range(4)), strict=True):
            if held is not None and part.as_py() != held:
                yield done()
                texts, toxic, fold, size = [], [], [], 0
            held, t = part.as_py(), text.as_py() or ""
            if size + len(t) <= SAMPLE_BYTES:
                texts.append(t)
                toxic.append(label.as_py())
                fold.append(own.as_py())
                size += len(t)
    if held is not None:
        yield done()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from rows of docs (doc_id, text) labelled in labels (doc_id, toxic) that aren't held out.

    Rows with a null id or label don't train. An id labelled more than once is toxic if any of its labels says so; of
    rows of docs that repeat an id the least text trains. At most ``sample`` ids are read, the first by a hash of them, so
    that reruns agree; that table is small by this bound. Texts are read whole, and those left out that would bring
    their characters over ``SAMPLE_BYTES``. Without a row to train from all odds are even. Three tasks train: one on all
    rows, two on half of them each, whose scores of the other half (at most ``sample``) come to the driver to turn
    margins into chances.
    """
    usable = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic")).withColumn("turn", F.md5(F.col("doc_id").cast("string")))
    some = usable.orderBy("turn", "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(some), F.col("id") == F.col("doc_id"))
    own = own.groupBy("turn", "doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = own.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("fold", F.pmod(F.crc32(F.col("turn").cast("binary")), F.lit(2)).cast("int"))
    rows = rows.repartitionByRange(3, "part").sortWithinPartitions("part", "turn", "doc_id").select("part", "text", "toxic", "fold")
    found = {r["part"]: r for r in rows.mapInArrow(handing_back(_train), MODEL).collect()}  # three rows at most
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32), 0.0
    of = lambda name, kind: np.concatenate([np.frombuffer(found[k][name], kind) for k in (0, 1)])
    slope, shift = chances(of("margins", np.float64), of("toxic", bool))
    whole = found[2]
    return np.frombuffer(whole["features"], np.int32), (np.frombuffer(whole["weights"], np.float32) * np.float32(slope)), whole["bias"] * slope + shift


def held_out(doc_id: str):
    """Whether an id is kept from training: crc32 of its text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of df's columns, or of ``keep``) and score for every row.

    A null text is scored as an empty one, whose score is that of the bias alone. Equal texts have equal scores, whatever
    their other columns; repeated rows stay. Very long texts are read whole, in pieces. An empty table gives an empty
    result. Columns of any name can be kept, since they stay inside ``row``.
    """
    small_batches(df.sparkSession)
    own = df.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(model)
        for batch in batches:
            text, out = batch.column(1) if batch.num_columns > 1 else batch.column(0).field(own.index(text_col)), np.empty(batch.num_rows)
            for a, b in cuts(text, SLICE):
                z = margins([x or "" for x in text.slice(a, b - a).to_pylist()], model, tables)
                out[a:b] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["row", "score"])

    rows = df.select(F.struct(*[df[f"`{c}`"] for c in own]).alias("row"), *([] if text_col in own else [F.col(f"`{text_col}`").alias("text")]))  # a text travels once
    return rows.mapInArrow(handing_back(run), T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, held_out, score, predicted for every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, train(docs, labels), keep=["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
