"""Near-duplicates by the similarity (Jaccard) of two texts' sets of word shingles.

Texts with equal sets collapse to one first. Texts whose SimHash fingerprints are linked (``simhash.near_links``) are compared.
What fingerprints leave apart, which at this similarity differ in more bits than can be
searched, is found by MinHash: of ``BANDS`` bands of ``ROWS`` least
values, one at least is equal. A pair just at a similarity of 0.8 meets with probability 1 - (1 - 0.8^5)^24 = 0.99993,
more similar ones almost surely. Every link is confirmed by the exact similarity of the whole sets.

In a band's group, all members are compared with its least one first. Where these links leave several parts, the group's
members meet with their sets, a pair of blocks of at most ``BLOCK`` at a time, and give the links that join parts: fewer
than there are members. A pair whose sizes, or whose 512 parities of hashed shingles, already show that the sets differ in
too many shingles is passed over. Both are exact bounds, so no link is lost by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.operators.components import connected_components
from sluicework.llm import simhash
from sluicework.llm.batches import handing_back
from sluicework.llm.simhash import numbered
from sluicework.session import if_few, small_batches, written

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
BLOCK = 4096
STEP = 1 << 12
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(6).integers(0, 1 << 63, (BANDS, ROWS + 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 (seed 42) of a text's word shingles; one of all words if there are fewer. Only A-Z are lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = min(width, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + w]), 42) for i in range(len(words) - w + 1 if w else 0)), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band; sets that agree in a band share it."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), STEP):
        least = np.minimum(least, (found[k : k + STEP] * _FACTORS[:, None]).min(axis=1))
    mixed = (least.reshape(BANDS, ROWS) * _MIX[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _MIX[:, ROWS]
    return ((mixed ^ mixed >> np.uint64(29)) * _MIX[0, 0]).view(np.int64)


def _sketches(width: int):
    """A function for mapInArrow: the last column, the text, becomes its set's key, size, parities and bands, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, parities, banded = [], [], [], []
            for x in batch.columns[-1]:
                found = shingles(x.as_py(), width)
                keys.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                sizes.append(len(found))
                parities.append(np.packbits(np.bincount((found >> np.uint64(55)).astype(np.int64), minlength=512) & 1).tobytes())
                banded.append(bands(found) if len(found) else np.empty(0, np.int64))
            prints = [simhash.fingerprint(x.as_py()) for x in batch.columns[-1]]
            new = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "key", "n", "parities", "bands", "fp"])

    return run


def _confirmed(width: int, least: float):
    """A function for mapInArrow: of (a, b, text of a, text of b) the a and b that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(key: int, text: pa.Scalar) -> np.ndarray:
            if key not in held:
                if len(held) > 256:
                    held.clear()
                held[key] = shingles(text.as_py(), width)
            return held[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [similarity(of(x, s), of(y, t)) >= least for x, y, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def links_between(key: np.ndarray, part: np.ndarray, n: np.ndarray, parities: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links that join a group's parts: pairs of similar sets that nothing has joined before, so fewer than there are members.

    parities: k x 8 unsigned numbers. A pair whose sizes or parities show that it differs in too much is not looked at.
    """
    label = np.unique(part, return_inverse=True)[1]
    for i in range(len(key) - 1):
        most = (n[i] + n[i + 1 :]) * ((1 - least) / (1 + least)) + 1e-6  # that the sets may differ in
        near = (label[i + 1 :] != label[i]) & (np.abs(n[i + 1 :] - n[i]) <= most)
        near = np.flatnonzero(near) + i + 1
        near = near[np.bitwise_count(parities[i] ^ parities[near]).sum(axis=1) <= most[near - i - 1]]
        for j in near.tolist():
            if label[j] != label[i] and similarity(sets[i], sets[j]) >= least:
                yield min(key[i], key[j]), max(key[i], key[j])
                label[label == label[j]] = label[i]


def _sets(width: int):
    """A function for mapInArrow: of (key, text) the key and its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["key", "found"])

    return run


def _across(least: float):
    """A function for mapInArrow: of (cell, key, part, n, parities, found) sorted by cell, the links that join each cell's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            _, key, part, n, parities, found = zip(*held, strict=True)
            pairs = list(links_between(np.array(key), np.array(part), np.array(n), np.frombuffer(b"".join(parities), np.uint64).reshape(-1, 8), [np.frombuffer(x, np.uint64) for x in found], least))
            held.clear()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from done()
                held.append(row)
        if held:
            yield from done()

    return run


def _of_fingerprints(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: each key and the least one of its fingerprint fp, and the least keys of linked fingerprints. No more than links of numbers: their closure is not needed here."""
    prints = written(distinct.select("fp", "key").groupBy("fp").agg(F.min("key").alias("least")), "shingles-prints")
    one, two = (prints.toDF(k, f"of_{k}") for k in "ab")
    linked = simhash.near_links(prints.select("fp")).distinct().join(one, "a").join(two, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return distinct.select("key", "fp").join(prints, "fp").where("key != least").select(F.col("least").alias("a"), F.col("key").alias("b")).unionByName(linked)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, id, group, component) for every row.

    group is the same number for all of a group and component its smallest id; uid numbers the rows, by ``uid_col`` if df
    is a written table that has such a column. Groups are the closure of links between candidates whose sets of
    shingles of ``width`` words are at least that similar. Null and blank texts have the empty set and are one group.
    Very long texts are read whole. Rows with a null id keep their row and can join groups; they never name one.
    Repeated rows stay. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(df.sparkSession)
    rows = numbered(df, id_col, text_col, uid_col)
    marks = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("parities", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    marked = written(rows.select("uid", "id", "text").mapInArrow(handing_back(_sketches(width)), marks), "shingles-sketches")
    distinct = written(marked.groupBy("key").agg(F.min("id").alias("least"), F.min_by(F.struct("uid", "n", "parities", "bands", "fp"), "uid").alias("s")).select("key", "least", "s.*"), "shingles-distinct")
    banded = distinct.select(F.explode("bands").alias("band"), "key")
    # What a band's group needs is two numbers, so groups of any size meet in partial sums; then each row finds its own.
    roots = written(banded.groupBy("band").agg(F.min("key").alias("root"), F.max("key").alias("top")).where("root != top").select("band", "root"), "shingles-roots")
    met = written(banded.join(if_few(roots), "band").select("band", "key", "root"), "shingles-met")
    alike = written(_of_fingerprints(distinct), "shingles-alike")
    # Pairs of both kinds are confirmed together, so texts meet once and links are closed once before the bands are looked through.
    pairs = written(alike.unionByName(met.where("key != root").select(F.col("root").alias("a"), F.col("key").alias("b"))).distinct(), "shingles-pairs")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()  # each key of met is in such a pair
    first = written(distinct.join(ends, "key", "left_semi").select("key", "uid"), "shingles-first")
    texts = written(rows.select("uid", "text").join(if_few(first), "uid").select("key", "text"), "shingles-texts")
    of_a, of_b = (texts.select(F.col("key").alias(k), F.col("text").alias(f"of_{k}")) for k in "ab")
    both = of_b.join(if_few(pairs), "b").join(of_a, "a").select("a", "b", "of_a", "of_b")
    links = written(both.mapInArrow(handing_back(_confirmed(width, similarity)), "a long, b long"), "shingles-links")
    parts = written(met.select("band", "key").join(connected_components(links, "a", "b").withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("part")), "shingles-parts")
    ends = parts.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low != high")
    ends = written(ends.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "shingles-open")
    open_ = written(parts.join(if_few(ends), "band"), "shingles-open")
    sets = written(texts.join(if_few(written(open_.select("key").distinct(), "shingles-open")), "key", "left_semi").mapInArrow(handing_back(_sets(width)), "key long, found binary"), "shingles-sets")
    # A band of one block is one cell; a larger one has a cell for each pair of its blocks.
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "key", "part")
    whole = dealt.join(distinct.select("key", "n", "parities"), "key").join(sets, "key").select("cell", "key", "part", "n", "parities", "found")
    more = written(whole.repartition("cell").sortWithinPartitions("cell", "key").mapInArrow(handing_back(_across(similarity)), "a long, b long"), "shingles-links")
    group = connected_components(links.unionByName(more), "a", "b").withColumnRenamed("node", "key")
    known = distinct.join(group, "key", "left").select("key", "least", F.coalesce("component", "key").alias("group"))
    known = known.join(known.groupBy("group").agg(F.min("least").alias("component")), "group").select("key", "group", "component")
    return marked.select("uid", "id", "key").join(written(known, "shingles-groups"), "key").select("uid", "id", "group", "component")
