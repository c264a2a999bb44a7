"""Vector neighbours, duplicate groups and prerequisite depth."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.operators.components import Forest, connected_components
from sluicework.session import if_few, written


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_similar(vectors: DataFrame, query_id: int, k: int = 20) -> DataFrame:
    """The k vectors of the largest inner product with one; ties go to the smaller id."""
    one = vectors.where(F.col("id") == query_id).select(F.col("vector").alias("q")).limit(1)
    rest = vectors.where(F.col("id") != query_id)
    return rest.join(F.broadcast(one)).select("id", dot(F.col("vector"), F.col("q")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Bins by which blocks of vectors meet, and blocks of a bin from which there are more bins.
BINS, HELD = 24, 1024


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = 256, links: bool = False) -> DataFrame:
    """(a, b, score), a < b, of unit vectors above a threshold; with ``links`` only pairs enough that their closure is the same.

    Vectors are packed in blocks and blocks dealt to ``BINS`` bins; two bins meet in one cell, where each pair of blocks is one
    matrix product. A block goes to as many cells as there are bins, so what is sent grows with the number of vectors (from ``HELD`` blocks
    a bin on, bins grow in number instead of size); a task holds one bin and a block. All pairs are computed, exactly: work grows with the
    square of the number of vectors. Pairs may be as many as there are. Links are found in the bins first; two bins then meet with what
    that has joined, so a cell gives fewer links than its bins have parts left, however many vectors and pairs there are.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, block) for b in batches for k in range(0, b.num_rows, block)):
            x = np.array(part.column(1).to_pylist(), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([x.tobytes()]), pa.array([x.shape[1]], pa.int32())], ["ids", "x", "dim"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, at, forest, first = [], None, Forest(), {}
        for r in (r for batch in batches for r in batch.to_pylist()):
            if r["cell"] != at:
                home, at, forest, first = [], r["cell"], Forest(), {}
            own = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.float32).reshape(-1, r["dim"]), None)
            if links:  # nodes are the parts of a bin
                if r["home"] not in first:
                    first[r["home"]] = forest.grown(r["parts"])
                own = (*own[:2], first[r["home"]] + np.frombuffer(r["part"], np.int64))
            if r["home"]:
                home.append(own)
            if r["own"] or not r["home"]:  # a bin's blocks meet one another in its own cell alone
                y = own[1].astype(np.float64)
                for h in home:
                    yield from map(pairs, found(h, own, y, forest))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of blocks sorted by bin: each bin's links, then its blocks with the part of each vector, numbered from 0 in the bin, and how many there are."""
        home, held, forest, at = [], [], Forest(), None

        def done() -> Iterator[pa.RecordBatch]:
            parts, part = np.unique(forest.roots(np.arange(forest.n)), return_inverse=True)
            for r, h in zip(held, home, strict=True):
                kept = pa.array([r["bin"]], pa.int32()), pa.array([r["ids"]]), pa.array([r["x"]]), pa.array([r["dim"]], pa.int32()), pa.array([part[h[2]].tobytes()]), pa.array([len(parts)], pa.int32())
                yield pa.RecordBatch.from_arrays([*kept, *none], names)

        names = ["bin", "ids", "x", "dim", "part", "parts", "a", "b", "score"]
        kinds = pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64()
        none = [pa.nulls(1, k) for k in kinds[6:]]
        for r in (r for batch in batches for r in batch.to_pylist()):
            if r["bin"] != at:
                yield from done()
                home, held, forest, at = [], [], Forest(), r["bin"]
            ids = np.frombuffer(r["ids"], np.int64)
            own = (ids, np.frombuffer(r["x"], np.float32).reshape(-1, r["dim"]), forest.grown(len(ids)) + np.arange(len(ids)))
            home.append(own)
            held.append(r)
            y = own[1].astype(np.float64)
            for h in home:
                for x in found(h, own, y, forest):
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(x[0]), k) for k in kinds[:6]), *map(pa.array, x)], names)
        yield from done()

    def pairs(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["a", "b", "score"])

    def found(h: tuple, own: tuple, y: np.ndarray, forest: Forest) -> Iterator[tuple]:
        s = h[1].astype(np.float64) @ y.T
        i, j = np.nonzero(s > threshold)
        a, b, score = h[0][i], own[0][j], s[i, j]
        keep = np.flatnonzero(a < b) if h is own else np.arange(len(a))
        if links:
            keep = keep[forest.joining(h[2][i[keep]], own[2][j[keep]])]
        if len(keep):
            a, b = a[keep], b[keep]
            yield np.minimum(a, b), np.maximum(a, b), score[keep]

    blocks = written(vectors.select("id", "vector").mapInArrow(pack, "ids binary, x binary, dim int").withColumn("at", F.monotonically_increasing_id()), "cosine-blocks")
    count = blocks.count()
    bins = max(1, min(count, max(BINS, math.ceil(count / HELD))))
    # Dealt in turn, so that bins are even; a row a block.
    places = if_few(written(blocks.select("at").withColumn("bin", ((F.row_number().over(W.orderBy("at")) - 1) % bins).cast("int")), "cosine-places"))
    met = blocks.join(places, "at").drop("at")
    if links:
        kinds = "bin int, ids binary, x binary, dim int, part binary, parts int, a long, b long, score double"
        joined = written(met.repartition(bins, "bin").sortWithinPartitions("bin").mapInArrow(within, kinds), "cosine-bins")
        met = joined.where("bin is not null").select("bin", "ids", "x", "dim", "part", "parts")
    # The lower bin of a cell is at home there, the other passes by.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    met = met.where("bin != other") if links else met
    cell = F.least("bin", "other") * bins + F.greatest("bin", "other")
    dealt = met.select(cell.alias("cell"), (F.col("bin") <= F.col("other")).alias("home"), (F.col("bin") == F.col("other")).alias("own"), "ids", "x", "dim", *(["part", "parts"] if links else []))
    out = dealt.repartition(bins * (bins + 1) // 2, "cell").sortWithinPartitions("cell", F.desc("home")).mapInArrow(multiply, "a long, b long, score double")
    return joined.where("a is not null").select("a", "b", "score").unionByName(out) if links else out


def duplicate_components(vectors: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of vectors above the threshold from another."""
    return connected_components(cosine_pairs(vectors, threshold, links=True), "a", "b")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 1, in an order; by one range sort and the counts of its parts, without a global window."""
    kept = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    parts = kept.groupBy(part).agg(F.count("*").alias("_n"))  # one row a partition of the sort
    ahead = parts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    met = kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(ahead), "_part")
    return met.withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_ahead")


def exact_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of two or more equal normalised texts: group id by canonical (smallest) key, canonical, size."""
    norm = F.regexp_replace(F.lower(text), r"\s+", "")
    groups = rows.groupBy(F.sha2(norm, 256).alias("h")).agg(F.min(key).alias("canonical"), F.count("*").alias("size")).where("size > 1").select("canonical", "size")
    return numbered(groups, ["canonical"], "_n").select(F.format_string("DG-%05d", "_n").alias("group_id"), "canonical", "size")


def depth(edges: DataFrame) -> DataFrame:
    """(node, depth): longest path from a root over (src, dst) edges of a graph without cycles.

    Level by level, nodes without open predecessors are peeled; each round is written, so that the plan does not grow.
    Nodes on or behind a cycle have no longest path and are left out.
    """
    left = written(edges.select("src", "dst").distinct(), "depth")
    open_ = written(left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct(), "depth")
    level, found = 0, None
    while True:
        now = written(open_.join(left.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(level).alias("depth")), "depth")
        found = now if found is None else found.union(now)
        if now.isEmpty():
            return found
        left = written(left.join(now.select(F.col("node").alias("src")), "src", "left_anti"), "depth")
        open_, level = written(open_.join(now, "node", "left_anti"), "depth"), level + 1


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node, other, side (out or in)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("side"))
    return out.union(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("side")))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node, kind): nodes left after peeling those without predecessors and those without successors, and self-loops.

    Each round of peeling is written, so that the plan does not grow.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit("loop").alias("kind")).distinct()
    left = written(edges.where("src <> dst").select("src", "dst").distinct(), "peel")
    n, before = left.count(), -1
    while n != before:
        inner = left.select(F.col("dst").alias("src")).intersect(left.select("src"))
        left = written(left.join(inner, "src", "left_semi").join(inner.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "peel")
        n, before = left.count(), n
    return left.select(F.col("src").alias("node"), F.lit("cycle").alias("kind")).distinct().union(loops)
