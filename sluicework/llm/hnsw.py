"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by hash, so equal vectors meet; a shard indexes each once, with the least
ids that it stands for. Vectors are inserted in batches: each is led down from the level above, looks for neighbours
among those inserted before with a beam, takes a diverse choice of them, and is entered with these in turn. A shard's
vectors are numbered so that every level is a prefix of the one below; so a level is nothing but one flat array of
neighbours. Each shard's index is loaded once for a stream of blocks of queries, and the shards' results are merged.
The graph is walked in single precision; what it finds is scored on the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.session import small_batches, written

SHARD = 1 << 15
BLOCK = 512
#: Blocks of queries that one load of a shard's index answers.
STREAM = 64
DEGREE = 24
CANDIDATES = 96
BEAM = 224
WIDE = 4
NEAREST = 20


def _lifted(x: np.ndarray) -> np.ndarray:
    """Single precision, scaled, with one more component that makes all lengths equal, so that nearness in the graph follows the inner product."""
    x = x / np.abs(x).max()
    square = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)


def _diverse(x: np.ndarray, own: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to DEGREE of each one's candidates (numbers, -1 for none) and their similarities: first those not nearer to one already taken, then the nearest of the others."""
    sims = np.einsum("nkd,nd->nk", x[np.maximum(near, 0)], x[own])
    sims[near < 0] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    picked = x[np.maximum(near, 0)]
    among = picked @ picked.transpose(0, 2, 1)
    keep, closest = np.zeros(near.shape, bool), np.full(near.shape, -np.inf, np.float32)
    for j in range(near.shape[1]):
        take = (near[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (keep.sum(axis=1) < DEGREE)
        keep[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, among[:, j, :]), closest)
    order = np.argsort(np.where(keep, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :DEGREE]
    return np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """Best-first search of one level from entry points (-1 for none), for all queries in step; numbers found, best first, -1 where there are fewer."""
    n, rows = len(near), np.arange(len(q))[:, None]
    beam = min(beam, n)
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    ids, scores, done = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)
    new = entry
    while True:
        new = np.sort(np.where(new < 0, n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        fresh = ~seen[rows, new]
        seen[rows, new] = True
        s = np.full(new.shape, -np.inf, np.float32)
        at, col = np.nonzero(fresh)
        s[at, col] = np.einsum("ij,ij->i", x[new[at, col]], q[at])
        ids, scores = np.concatenate([ids, np.where(fresh, new, -1)], axis=1), np.concatenate([scores, s], axis=1)
        done = np.concatenate([done, ~fresh], axis=1)
        best = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
        ids, scores, done = ids[rows, best], scores[rows, best], done[rows, best]
        wide = min(WIDE, beam)
        take = np.argpartition(np.where(done, np.inf, -scores), wide - 1, axis=1)[:, :wide]
        open_ = ~done[rows, take]
        if not open_.any():
            break
        done[rows, take] = True
        new = np.where(open_[:, :, None], near[np.maximum(ids[rows, take], 0)], -1).reshape(len(q), -1)
    return ids[rows, np.argsort(-scores, axis=1, kind="stable")]


def _entered(near: np.ndarray, back: np.ndarray, new: np.ndarray, to: np.ndarray, sims: np.ndarray) -> None:
    """Enters new vectors with their neighbours, which keep the nearest DEGREE that point to them."""
    at, col = np.nonzero(to >= 0)
    target = to[at, col]
    each = np.unique(target)
    a = np.concatenate([np.repeat(each, DEGREE), target])
    b = np.concatenate([near[each, DEGREE:].ravel(), new[at]])
    s = np.concatenate([back[each].ravel(), sims[at, col]])
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    fits = rank < DEGREE
    near[a[fits], DEGREE + rank[fits]], back[a[fits], rank[fits]] = b[fits], s[fits]


def build(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels): the order in which the vectors are numbered, and neighbours by number of each level, the ground level first."""
    order = np.random.default_rng(20).permutation(len(x))
    x = _lifted(x[order])
    sizes = [len(x)]
    while sizes[-1] > 2 * DEGREE:
        sizes.append(sizes[-1] // DEGREE)
    levels: list[np.ndarray] = []
    for n in reversed(sizes):  # from the top; the level above is complete
        near, back, done = np.full((n, 2 * DEGREE), -1, np.int32), np.full((n, DEGREE), -np.inf, np.float32), 0
        while done < n:
            new = np.arange(done, min(n, done + min(max(done, 2 * DEGREE), BLOCK)), dtype=np.int32)
            sims = x[new] @ x[new].T
            np.fill_diagonal(sims, -np.inf)
            c = min(CANDIDATES, len(new) - 1)
            found = [new[np.argpartition(-sims, c - 1, axis=1)[:, :c]]] if c > 0 else []
            if done:
                entry = descend(x, levels, x[new], 8)
                entry = np.concatenate([np.where(entry < done, entry, -1), np.zeros((len(new), 1), np.int32)], axis=1)
                found.append(_beam(x, near[:done], x[new], entry, CANDIDATES))
            if found:
                near[new, :DEGREE], sims = _padded(*_diverse(x, new, np.concatenate(found, axis=1)))
                _entered(near, back, new, near[new, :DEGREE], sims)
            done += len(new)
        levels.append(near)
    return order, levels[::-1]


def _padded(near: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    more = ((0, 0), (0, DEGREE - near.shape[1]))
    return np.pad(near, more, constant_values=-1), np.pad(sims, more, constant_values=-np.inf)


def descend(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, beam: int) -> np.ndarray:
    """Entry points for each query: the best found on the last of the levels (the top level first)."""
    n = min(len(levels[0]), 2 * DEGREE) if levels else 1
    entry = np.broadcast_to(np.arange(n, dtype=np.int32), (len(q), n))
    for near in levels:
        entry = _beam(x, near, q, entry, beam)
    return entry


def search(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Up to ``beam`` near vectors' numbers for each query (-1 where there are fewer); x and q in single precision."""
    return _beam(x, levels[0], q, descend(x, levels[:0:-1], q, 16), beam)


# ---- shards and blocks ---------------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).reshape(-1, dim)


def _grouped(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each different vector, its least ``most`` ids joined to one array, number of these)."""
    key = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()  # one zero, without a sign
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    of, ids = of[order], ids[order]
    keep = np.concatenate(([True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])))
    of, ids = of[keep], ids[keep]
    fits = np.arange(len(of)) - np.searchsorted(of, of) < most
    return one, ids[fits], np.bincount(of[fits], minlength=len(one))


def _fewer(most: int):
    """A function for mapInArrow: of (dim, shard, id, vector) the least ``most`` ids of equal vectors, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                ids = np.asarray(batch.column(2))[own]
                one, kept, n = _grouped(_matrix(batch.column(3).take(pa.array(own)), dim), ids, most)
                row = own[np.repeat(one, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(kept), batch.column(3).take(pa.array(row))], batch.schema.names)

    return run


INDEX = "dim int, shard int, vectors binary, ids binary, sizes binary, edges binary, levels binary"


def _index(most: int):
    """A function for applyInArrow: one shard's rows (dim, shard, id, vector) to one row of flat arrays."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table["vector"], table["dim"][0].as_py())
        one, ids, n = _grouped(x, np.asarray(table["id"]), most)
        x, stops = x[one], np.cumsum(n)
        order, levels = build(x.astype(np.float64))
        ids = np.concatenate([ids[stops[k] - n[k] : stops[k]] for k in order.tolist()])
        flat = x[order], ids.astype(np.int64), n[order].astype(np.int32), np.concatenate(levels), np.array(list(map(len, levels)), np.int32)
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1]} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(["vectors", "ids", "sizes", "edges", "levels"], flat, strict=True)})

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (dim, query_id, vector) to blocks of them, of one dim each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(dim: int, at: int) -> pa.RecordBatch:
        ids, x = (np.concatenate(c) for c in zip(*held[dim], strict=True))
        held[dim] = [(ids[at:], x[at:])]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[:at].tobytes()]), pa.array([x[:at].tobytes()])], ["dim", "ids", "queries"])

    for batch in batches:
        dims = np.asarray(batch.column(0))
        for dim in np.unique(dims).tolist():
            own = pa.array(np.flatnonzero(dims == dim))
            held.setdefault(dim, []).append((np.asarray(batch.column(1).take(own)), _matrix(batch.column(2).take(own), dim)))
            while (n := sum(len(i) for i, _ in held[dim])) >= BLOCK:
                yield out(dim, BLOCK)
    for dim in list(held):
        if n := sum(len(i) for i, _ in held[dim]):
            yield out(dim, n)


def _search(k: int, beam: int, kind: str):
    """A function for mapInArrow: rows sorted by shard, each shard's index before its blocks of queries; the k best of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                if r["vectors"] is not None:
                    exact = np.frombuffer(r["vectors"], kind).reshape(-1, r["dim"])
                    scale = np.abs(exact).max().astype(np.float64)
                    x = (exact / scale).astype(np.float32)
                    cuts = np.cumsum(np.frombuffer(r["levels"], np.int32))[:-1]
                    levels = np.split(np.frombuffer(r["edges"], np.int32).reshape(-1, 2 * DEGREE), cuts)
                    ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32)
                    starts = np.cumsum(sizes) - sizes
                    continue
                own, q = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["queries"], kind).reshape(-1, r["dim"])
                one, whose = np.unique(q + 0.0, axis=0, return_inverse=True)
                near = search(x, levels, (one / np.abs(one).max(axis=1, keepdims=True)).astype(np.float32), beam)
                at, col = np.nonzero(near >= 0)
                hit = near[at, col]
                score = np.einsum("ij,ij->i", one[at].astype(np.float64), exact[hit].astype(np.float64))
                order = np.lexsort((ids[starts[hit]], -score, at))  # enough vectors for k ids that aren't the query's own
                rank = np.arange(len(order)) - np.searchsorted(at[order], at[order])
                order = order[rank <= k]
                at, hit, score = at[order], hit[order], score[order]
                each = sizes[hit]
                offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                at, vec, score = np.repeat(at, each), ids[np.repeat(starts[hit], each) + offset], np.repeat(score, each)
                order = np.lexsort((vec, -score, at))
                at, vec, score = at[order], vec[order], score[order]
                low, high = np.searchsorted(at, whose.ravel()), np.searchsorted(at, whose.ravel(), "right")
                n = high - low
                pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                query = np.repeat(np.arange(len(own)), n)
                other = vec[pick] != own[query]
                pick, query = pick[other], query[other]
                fits = np.arange(len(query)) - np.searchsorted(query, query) < k
                pick, query = pick[fits], query[fits]
                yield pa.RecordBatch.from_arrays([pa.array(r["block"] * BLOCK + query), pa.array(own[query]), pa.array(vec[pick]), pa.array(score[pick])], ["uid", "query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where ``is_query`` (a condition on id) holds.

    A row is never its own answer; ties go to the smaller id; with fewer candidates all that are reached are
    returned. Rows whose id or vector is null, or whose vector is zero or empty or holds a null or non-finite
    component, take no part. Only vectors of the query's own length are candidates. Rows repeated with one id and one
    vector count as one, as query and as candidate; of equal vectors the k + 1 least ids are kept, which is all that an
    answer can hold. An id with several vectors is a query and a candidate with each, but never its own answer. An empty
    table gives an empty result. Other columns are ignored. Components of any numeric type are compared in double
    precision.
    """
    small_batches(df.sparkSession)
    single = df.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType.elementType.typeName() == "float"
    v = F.col(f"`{vector_col}`").cast("array<float>" if single else "array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector")).where(good & F.col("id").isNotNull())
    shards = max(1, math.ceil(rows.count() / shard))
    dealt = rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64(F.transform("vector", lambda c: c + F.lit(0.0))), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    index = written(dealt.mapInArrow(_fewer(k + 1), dealt.schema).groupBy("dim", "shard").applyInArrow(_index(k + 1), INDEX), "hnsw-index")
    asked = rows.where(is_query(F.col("id"))).distinct().select(F.size("vector").alias("dim"), F.col("id").alias("query_id"), "vector")
    blocks = written(asked.mapInArrow(_blocks, "dim int, ids binary, queries binary").withColumn("block", F.monotonically_increasing_id()), "hnsw-queries")
    parts = max(1, math.ceil(blocks.count() / STREAM))
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    none = {c: F.lit(None).cast("binary").alias(c) for c in ("vectors", "ids", "sizes", "edges", "levels")}
    loads = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("block", F.lit(-1).cast("long")).withColumn("query_ids", none["ids"]).withColumn("queries", none["ids"])
    given = blocks.select("dim", all_shards.alias("shard"), *none.values(), part.alias("part"), "block", F.col("ids").alias("query_ids"), "queries")
    given = given.join(index.select("dim", "shard"), ["dim", "shard"], "left_semi").select(loads.columns)
    met = loads.unionByName(given).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "block")
    found = met.mapInArrow(_search(k, beam, "<f4" if single else "<f8"), "uid long, query_id long, vec_id long, score double")
    best = W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "hnsw-found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
