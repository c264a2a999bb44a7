"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two that differ in at most 3 bits differ in at most 1 bit in one of their 32-bit
halves. Each half is covered by anchors: the codewords of the perfect Hamming code on 31 bits with the last bit
free, a covering code of radius 1. A fingerprint is sent to every anchor no farther than its own nearest anchor
plus the threshold (at most covering radius plus threshold: 2 bits). If x and y are within the threshold and x is
no farther from its nearest anchor than y from its own, that anchor receives both, so no link is lost. A half has
16.5 anchors on average out of 2^27, so what meets at an anchor stays small.

Equal fingerprints collapse to one before anything is sent. At an anchor the links found are kept as stars
(a root and what it reaches), never as all pairs; an anchor with more than ``BLOCK`` fingerprints is dealt out
again as pairs of blocks, so no task holds more than two blocks of it at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.llm.batches import handing_back
from sluicework.operators.components import connected_components
from sluicework.session import if_few, small_batches, written

THRESHOLD = 3
SHINGLE = 3
BLOCK = 8192
STEP = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as a signed number, of a text's word shingles; 0 if it has no word.

    Only A-Z are lowered. Bit i is set if it is set in over half of the shingles' XXH64 (seed 42).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, len(words))
    n = len(words) - w + 1
    ones = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[w - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, STEP):
        h = np.array([digest(line[i:j], 42) for i, j in zip(a[k : k + STEP], b[k : k + STEP], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the text, becomes its fingerprint."""
    for batch in batches:
        prints = pa.array([fingerprint(x.as_py()) for x in batch.columns[-1]], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], [*batch.schema.names[:-1], "fp"])


def _anchor_masks() -> tuple[list[int], list[list[int]]]:
    """Parity masks of the Hamming code on bits 1 to 31, and by syndrome the flips that lead to each anchor."""
    parity = [sum(1 << i for i in range(1, 32) if i >> b & 1) for b in range(5)]
    flips = [[0, 1]]
    for s in range(1, 32):
        flips.append([1 << s, 1 << s | 1] + [1 << i | 1 << (i ^ s) for i in range(1, 32) if 0 < i ^ s < 32 and i < i ^ s])
    return parity, flips


def anchored(prints: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor of its halves within reach."""
    parity, flips = _anchor_masks()
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in flips])
    out = None
    for half in (0, 1):
        x = F.shiftrightunsigned("fp", 32) if half else F.col("fp").bitwiseAND(0xFFFFFFFF)
        syndrome = sum(((F.bit_count(F.col("x").bitwiseAND(m)) % 2) * (1 << b) for b, m in enumerate(parity)), F.lit(1))
        part = prints.select("fp", x.alias("x")).select("fp", "x", F.explode(F.element_at(table, syndrome.cast("int"))).alias("flip"))
        part = part.select(F.col("x").bitwiseXOR(F.col("flip")).bitwiseOR(half << 32).alias("anchor"), "fp")
        out = part if out is None else out.unionByName(part)
    return out


def stars(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Roots and members of the groups that links within ``threshold`` bits make of distinct unsigned fingerprints."""
    left, roots, members = fps, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], fps.dtype)
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                near |= (np.bitwise_count(front[k : k + 64, None] ^ left[None, :]) <= threshold).any(axis=0)
            front, left = left[near], left[~near]
            members.append(front)
            roots.append(np.full(len(front), root, fps.dtype))
    join = lambda x: np.concatenate(x) if x else np.empty(0, fps.dtype)
    return join(roots), join(members)


def _compare(most: int):
    """A function for mapInArrow: input sorted by anchor; output links (kind 0: root, member, 0) and, of anchors with more than ``most`` rows, the rows themselves (kind 1: anchor, fp, position)."""
    names = ["kind", "a", "b", "c"]

    def out(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, c))], names)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(at, len(keys)))
        two = at[n == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= THRESHOLD]
        a, b = [fps[two]], [fps[two + 1]]
        for k in np.flatnonzero(n > 2):
            x, y = stars(np.unique(fps[at[k] : at[k] + n[k]]))
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            yield out(0, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot, given = None, 0
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if hot is not None:
                n = int(np.searchsorted(keys, hot, "right"))
                if n:
                    yield out(1, keys[:n], fps[:n], given + np.arange(n))
                    given, keys, fps = given + n, keys[n:], fps[n:]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                hot = None
                yield from split(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if len(keys) > most:
                yield out(1, keys, fps, np.arange(len(keys)))
                hot, given, keys, fps = keys[0], len(keys), keys[:0], fps[:0]
        if len(keys):
            yield from split(keys, fps)

    def split(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(at, len(keys)))
        if most and (n > most).any():
            many = np.repeat(n > most, n)
            yield out(1, keys[many], fps[many], (np.arange(len(keys)) - np.repeat(at, n))[many])
            keys, fps = keys[~many], fps[~many]
        if len(keys):
            yield from links(keys, fps)

    return run


def near_links(prints: DataFrame, most: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose closure is that of all links within the threshold."""
    kinds = "kind int, a long, b long, c long"
    met = anchored(prints).repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = written(met.mapInArrow(handing_back(_compare(most)), kinds), "simhash-links")
    links = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select(F.col("a").alias("anchor"), F.col("b").alias("fp"), F.floor(F.col("c") / most).cast("long").alias("block"))
    if not hot.isEmpty():
        blocks = hot.groupBy("anchor").agg((F.max("block") + 1).alias("blocks"))
        dealt = hot.join(blocks, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select(F.xxhash64("anchor", F.least("block", "other"), F.greatest("block", "other")).alias("anchor"), "fp")
        again = dealt.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(handing_back(_compare(1 << 62)), kinds)
        links = links.unionByName(written(again, "simhash-links").select("a", "b"))
    return links


def numbered(df: DataFrame, id_col: str, text_col: str, uid_col: str | None) -> DataFrame:
    """(uid, id, text) of every row, written so that uid stays the same; df's own uid_col if it is named."""
    uid = F.monotonically_increasing_id() if uid_col is None else F.col(f"`{uid_col}`")
    rows = df.select(uid.alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows, "numbered") if uid_col is None else rows


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """(uid, id, fp, group, component) for every row.

    group is the same number for all of a group and component its smallest id; uid numbers the rows, by ``uid_col`` if df
    is a written table that has such a column. Groups are the closure of links within 3 bits; a null or blank text has
    fingerprint 0 and is linked like any other. Very long texts are read whole. Rows with a null id keep their row and
    can join groups; they never name one (a group of them alone has a null component). Repeated rows stay. An empty
    table gives an empty result. Other columns are ignored.
    """
    small_batches(df.sparkSession)
    uid = F.monotonically_increasing_id() if uid_col is None else F.col(f"`{uid_col}`")
    rows = df.select(uid.alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = written(rows.mapInArrow(handing_back(_fingerprints), "uid long, id long, fp long"), "simhash-prints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    group = connected_components(near_links(distinct.select("fp")), "a", "b")
    group = distinct.join(group.withColumnRenamed("node", "fp"), "fp")
    named = group.groupBy("component").agg(F.min("least").alias("name"))
    group = group.join(named, "component").select("fp", "name", F.col("component").alias("group"))
    known = distinct.join(group, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), F.when(F.col("group").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("component"))
    return marked.join(written(known, "simhash-groups"), "fp")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicates) -> DataFrame:
    """df with one row of each group of near-duplicates: that of the smallest id (null last; of rows that repeat it, any one).

    ``groups`` is a function like near_duplicates, which is taken unless another is passed. Rows are numbered once; what
    meets by group are numbers alone, never texts.
    """
    rows = written(df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")), "simhash-rows")
    of = rows.select("uid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    found = written(groups(of, "id", "text", uid_col="uid").select("uid", "id", "group"), "simhash-found")
    kept = written(found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")).select("first.uid"), "simhash-kept")
    gone = if_few(written(found.select("uid").join(kept, "uid", "left_anti"), "simhash-gone"))
    return rows.join(gone, "uid", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, fingerprint, component_id for every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
