"""Exact threshold joins of vectors with a pivot index, and groups of near copies with their evidence.

Angles between vectors obey the triangle inequality. Some vectors are pivots; every vector belongs to the cell of the nearest
and lies in a ring around it. Vectors of a cell are packed to blocks in order of their angle, each with the range of its
angles to every pivot. Cells are put in groups of about equal size, of which there is a fixed number, so a block is sent at most that
often and what is sent grows with the number of vectors. A block goes only to groups with a cell whose ring it can reach within the
threshold's angle, and there it is multiplied only with blocks whose ranges come near its own for every pivot. What is passed over can hold no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.operators.components import Forest, connected_components
from sluicework.session import if_few, small_batches, written

#: Vectors of a block, blocks of a group at least, vectors for each pivot, and the most pivots.
BLOCK, TOGETHER, SPREAD, MOST = 512, 1, 1024, 1024
#: Groups of blocks, and vectors of a group from which there are more groups.
GROUPS, HELD = 48, 1 << 18
#: Parts by which the vectors of one cell are dealt before they are packed.
SALTS = 8
#: Allowance for rounding, as an angle.
SLACK = 1e-6


def unit(vector: Column) -> Column:
    """The vector in double precision, of length 1; null where it is null, empty or zero or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0)
    return F.when(good, F.transform(v, lambda x: x / norm))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


BLOCKS = "cell int, n int, ids binary, x binary, rest binary, low binary, high binary, nearest double, farthest double"


def _assigned(pivots: np.ndarray):
    """A function for mapInArrow: (id, x, rest) to (cell, angle, id, x, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column(1)), pivots)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), *batch.columns], ["cell", "angle", "id", "x", "rest"])

    return run


def _packed(pivots: np.ndarray):
    """A function for mapInArrow: rows in order of cell to blocks of one cell each."""

    def block(cell: int, ids: np.ndarray, both: np.ndarray) -> dict:
        x, rest = both[:, : pivots.shape[1]], both[:, pivots.shape[1] :]
        angles = _angles(x, pivots)
        low, high = angles.min(axis=0), angles.max(axis=0)
        return {"cell": cell, "n": len(ids), "ids": ids.tobytes(), "x": x.tobytes(), "rest": rest.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "nearest": low[cell], "farthest": high[cell]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("cell", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "x", "rest", "low", "high")], ("nearest", pa.float64()), ("farthest", pa.float64())])
        now, ids, rows = -1, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, own = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            x = np.concatenate([_matrix(batch.column(3)), _matrix(batch.column(4))], axis=1)
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if cells[a] != now and ids:
                    yield pa.RecordBatch.from_pylist([block(now, np.concatenate(ids), np.concatenate(rows))], schema=kinds)
                    ids, rows = [], []
                now = int(cells[a])
                ids.append(own[a:b])
                rows.append(x[a:b])
                if sum(map(len, ids)) >= BLOCK:
                    i, r = np.concatenate(ids), np.concatenate(rows)
                    whole = len(i) // BLOCK * BLOCK
                    for k in range(0, whole, BLOCK):
                        yield pa.RecordBatch.from_pylist([block(now, i[k : k + BLOCK], r[k : k + BLOCK])], schema=kinds)
                    ids, rows = ([i[whole:]], [r[whole:]]) if whole < len(i) else ([], [])
        if ids:
            yield pa.RecordBatch.from_pylist([block(now, np.concatenate(ids), np.concatenate(rows))], schema=kinds)

    return run


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, added in order: the same number for a pair wherever it is computed."""
    return (x * y).cumsum(axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _multiplied(angle: float, threshold: float, dims: list[int], before: int, links: bool):
    """A function for mapInArrow: blocks by group, those at home first; pairs above the threshold with their scores, and (a null) how many pairs of blocks met and were multiplied.

    ``dims`` are the lengths of x and of the vectors in rest (NaN where masked), whose first ``before`` routes find their pairs themselves, so these are
    left out here. With ``links`` only pairs that join what was apart and each vector's best of each score are given.
    """
    names = ["a", "b", *[f"s{k}" for k in range(len(dims))], "met", "multiplied"]
    ends = np.cumsum([0, *dims])

    def near(p: dict, q: dict) -> bool:
        return bool((p["low"] <= q["high"] + angle).all() and (q["low"] <= p["high"] + angle).all())

    def rows(a: np.ndarray, b: np.ndarray, scores: list[np.ndarray]) -> pa.RecordBatch:
        shown = [pa.array(s, mask=np.isnan(s)) for s in scores]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *shown, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names)

    def pairs(h: dict, own: dict, forest: Forest, best: list[np.ndarray]) -> tuple:
        i, j = np.nonzero(h["x"][:, : dims[0]] @ own["x"][:, : dims[0]].T > threshold - 1e-9)
        a, b = h["ids"][i], own["ids"][j]
        keep = a < b if h is own else a != b
        i, j = i[keep], j[keep]
        x, y = h["x"][i], own["x"][j]
        scores = [_dot(x[:, p:q], y[:, p:q]) for p, q in zip(ends[:-1], ends[1:], strict=True)]
        good = scores[0] > threshold
        if links:
            scores = [s[good] for s in scores]
            i, j = i[good], j[good]
            kept = [forest.joining(h["at"] + i, own["at"] + j)]
            for s, top in zip(scores, best, strict=True):
                more = np.flatnonzero(np.nan_to_num(s, nan=-np.inf) > top[h["at"] + i])
                more = more[np.lexsort((-s[more], i[more]))]
                more = more[np.unique(i[more], return_index=True)[1]]
                top[h["at"] + i[more]] = s[more]
                kept.append(more)
            places = np.unique(np.concatenate(kept))
        else:
            for s in scores[1 : 1 + before]:
                good &= ~(s > threshold)
            places = np.flatnonzero(good)
        return h["ids"][i[places]], own["ids"][j[places]], [s[places] for s in scores]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, at, met, done, forest, best = [], None, 0, 0, Forest(), []
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"], np.float64).reshape(r["n"], -1)
                own = {"ids": np.frombuffer(r["ids"], np.int64), "x": np.concatenate([x, np.frombuffer(r["rest"], np.float64).reshape(r["n"], -1)], axis=1), "low": np.frombuffer(r["low"]), "high": np.frombuffer(r["high"])}
                if r["to"] != at:
                    home, at, forest, best = [], r["to"], Forest(), [np.zeros(0) for _ in dims]
                if links:
                    own["at"] = forest.grown(r["n"])
                if r["home"]:
                    home.append(own)
                    best = [np.concatenate([top, np.full(r["n"], -np.inf)]) for top in best] if links else best
                for h in home:
                    met += 1
                    if not near(h, own):
                        continue
                    done += 1
                    a, b, scores = pairs(h, own, forest, best)
                    if len(a):
                        yield rows(a, b, scores)
        nothing = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64()) for _ in dims]]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([met]), pa.array([done])], names)

    return run


def threshold_join(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((a, b, score), a < b, of vectors (id, vector) whose cosine is above a threshold; one row: blocks, met, multiplied).

    Exact. ``met`` counts pairs of blocks that were sent to one group, ``multiplied`` those that could hold a pair, of
    blocks * (blocks + 1) / 2. Vectors that unit() makes null and null ids take no part, nor do vectors of another length than
    the first pivot's; ids should be unique (of a repeated id with one vector no pair is made). An empty table gives none.
    Work is bounded by all pairs of blocks and falls as cells come apart, at high thresholds on vectors that lie in clusters.
    """
    if not -1.0 <= threshold <= 1.0:
        raise ValueError("a threshold is a cosine, from -1 to 1")
    small_batches(vectors.sparkSession)
    rows = written(vectors.select(F.col("id").cast("long").alias("id"), unit(F.col("vector")).alias("v0")).where("id is not null"), "pivot-rows")
    found, stats = _joined(rows, threshold, [_pivots(rows, "v0")])
    return found.select("a", "b", F.col("s0").alias("score")).distinct(), stats


def _pivots(rows: DataFrame, column: str) -> np.ndarray:
    """Some of a column's vectors, all of one length: at most MOST come to the driver, and go from there to all tasks."""
    known = rows.where(F.col(column).isNotNull())
    first = known.orderBy(F.xxhash64(column), "id").limit(max(1, min(MOST, known.count() // SPREAD))).select(column).collect()
    dim = len(first[0][0]) if first else 1
    return np.array([r[0] for r in first if len(r[0]) == dim], np.float64).reshape(-1, dim)


def _joined(rows: DataFrame, threshold: float, pivots: list[np.ndarray], route: int = 0, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """((a, b, a score s0, s1, ... of each route), stats) of written rows (id, unit vectors v0, v1, ...): pairs above the threshold on one route and, unless ``links``, not on an earlier one."""
    order = [route, *[k for k in range(len(pivots)) if k != route]]
    dims = [pivots[k].shape[1] for k in order]
    pivots = pivots[route]
    of = lambda k, n: F.when(F.size(f"v{k}") == n, F.col(f"v{k}"))
    masked = [F.coalesce(of(k, n), F.array_repeat(F.lit(float("nan")), n)) for k, n in zip(order[1:], dims[1:], strict=True)]
    rest = F.concat(*masked) if masked else F.array().cast("array<double>")
    rows = rows.select("id", of(route, dims[0]).alias("x"), rest.alias("rest")).where("x is not null")
    assigned = rows.mapInArrow(_assigned(pivots), "cell int, angle double, id long, x array<double>, rest array<double>")
    by = ["cell", "salt", "angle"]
    laid = assigned.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).repartition("cell", "salt").sortWithinPartitions(*by).drop("salt")
    blocks = written(laid.mapInArrow(_packed(pivots), BLOCKS).withColumn("at", F.monotonically_increasing_id()), "pivot-blocks")
    rings = blocks.groupBy("cell").agg(F.min("nearest").alias("lo"), F.max("farthest").alias("hi"), F.count("*").alias("n"), F.sum("n").alias("rows")).collect()  # a row a pivot
    lo, hi, many = (np.full(len(pivots), v) for v in (np.inf, -np.inf, 0))
    for r in rings:
        lo[r["cell"]], hi[r["cell"]], many[r["cell"]] = r["lo"], r["hi"], r["n"]
    groups = max(GROUPS, math.ceil(sum(r["rows"] for r in rings) / HELD))
    share = max(TOGETHER, math.ceil(many.sum() / groups))
    parts = np.maximum(1, np.ceil(many / share).astype(int))
    # Cells, or parts of large ones, fill one group after another.
    group_of, members, filled = {}, [[]], 0
    for c in range(len(many)):
        for p in range(parts[c]):
            if filled >= share:
                members.append([])
                filled = 0
            group_of[c, p] = len(members) - 1
            members[-1].append(c)
            filled += many[c] / parts[c]
    angle = math.acos(threshold) + SLACK

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, home, row = [], [], []
            for k, r in enumerate(batch.select(["cell", "low", "high", "at"]).to_pylist()):
                low, high, c = np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["cell"]
                reach = (low <= hi + angle) & (lo <= high + angle) & (low - high[c] <= 2 * angle) & (many > 0)
                g = group_of[c, r["at"] % parts[c]]
                # Of two groups one sends to the other, by turns.
                others = [h for h in range(len(members)) if h != g and (h > g) ^ ((h + g) % 2 == 1) and reach[members[h]].any()]
                to += [g, *others]
                home += [True, *[False] * len(others)]
                row += [k] * (1 + len(others))
                if len(row) >= 64 or k == batch.num_rows - 1:
                    own = batch.select(["n", "ids", "x", "rest", "low", "high"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(home), *own.columns], ["to", "home", *own.schema.names])
                    to, home, row = [], [], []

    dealt = blocks.mapInArrow(sent, "to int, home boolean, n int, ids binary, x binary, rest binary, low binary, high binary")
    dealt = dealt.repartition(4 * len(members), "to").sortWithinPartitions("to", F.desc("home"))
    scores = ", ".join(f"s{k} double" for k in range(len(order)))
    work = _multiplied(angle, threshold, dims, route, links)
    found = written(dealt.mapInArrow(work, f"a long, b long, {scores}, met long, multiplied long"), "pivot-pairs")
    stats = found.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("multiplied"), F.lit(0)).alias("multiplied")).select(F.lit(sum(r["n"] for r in rings)).cast("long").alias("blocks"), "met", "multiplied")
    return found.where("a is not null").select("a", "b", *[F.col(f"s{order.index(k)}").alias(f"s{k}") for k in range(len(order))]), stats


def route_pairs(vectors: DataFrame, threshold: float, routes: dict[str, str], links: bool = False) -> DataFrame:
    """a, b and each route's cosine, a < b: pairs above the threshold on any route; with ``links`` only enough of them that their closure and each closure's best scores are the same.

    ``vectors`` is (id, a vector for each route), ids unique; ``routes`` names the score of each vector column. A null vector is masked: its
    route neither finds nor scores the row's pairs, so the score is null; so is one of another length than its route's first pivot. A pair is given by the first route that finds it, with all its
    scores, for blocks carry the vectors of all routes: pairs are never joined to vectors again. Links are at most a few for each vector and group.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    small_batches(vectors.sparkSession)
    rows = written(vectors.select(F.col("id").cast("long").alias("id"), *[unit(F.col(c)).alias(f"v{k}") for k, c in enumerate(routes)]).where("id is not null"), "pivot-rows")
    pivots = [_pivots(rows, f"v{k}") for k in range(len(routes))]
    found = None
    for k in range(len(routes)):
        own = _joined(rows, threshold, pivots, k, links)[0]
        found = own if found is None else found.union(own)
    return found.select("a", "b", *[F.col(f"s{k}").alias(name) for k, name in enumerate(routes.values())])


def coverage(ids: DataFrame, vectors: DataFrame, routes: list[str]) -> DataFrame:
    """One row: rows of an index, of these how many have a vector at all and on each route, ids on one side only, percent covered."""
    index = ids.select("id").distinct()
    own = vectors.select("id", *[unit(F.col(c)).isNotNull().alias(c) for c in routes]).groupBy("id").agg(*[F.max(c).alias(c) for c in routes]).withColumn("stored", F.lit(True))
    met = index.withColumn("indexed", F.lit(True)).join(own, "id", "full")
    both = F.col("indexed").isNotNull() & F.col("stored").isNotNull()
    counts = met.agg(
        F.count("indexed").alias("indexed"), F.count_if(both).alias("covered"), *[F.count_if(both & F.col(c)).alias(f"with_{c}") for c in routes],
        F.count_if(F.col("indexed").isNotNull() & F.col("stored").isNull()).alias("without_vector"), F.count_if(F.col("indexed").isNull()).alias("not_indexed"),
    )
    return counts.withColumn("percent", F.round(F.when(F.col("indexed") > 0, F.col("covered") * 100.0 / F.col("indexed")), 1))


def evidence_groups(pairs: DataFrame, scores: list[str], meta: DataFrame, formula_limit: int = 100) -> DataFrame:
    """group_id, canonical, member, size, the largest of each score, score_formula, shared, same_topic: a row for each member.

    Groups are what accepted ``pairs`` (a, b and ``scores``, null where a route is masked) connect; canonical is the smallest id.
    ``meta`` is (id, topics, formulas); an id without a row there, or with null lists, has none. ``shared`` counts topics that
    all members have, ``same_topic`` says whether there are any. ``score_formula`` is the largest share of the lesser's formulas
    that two members have in common: 0 where none has, null in groups of over ``formula_limit`` members, whose pairs are not
    compared. All of it is summed over members and edges where they are, so no row holds a group. No pairs, no groups.
    """
    if formula_limit < 2:
        raise ValueError("formula_limit must be at least 2")
    nodes = written(connected_components(pairs, "a", "b"), "evidence-nodes")
    edges = pairs.join(if_few(nodes.select(F.col("node").alias("a"), "component")), "a")
    best = edges.groupBy("component").agg(*[F.max(s).alias(s) for s in scores])
    sizes = nodes.groupBy("component").agg(F.count("*").alias("size"))
    own = nodes.join(meta.select(F.col("id").alias("node"), "topics", "formulas"), "node", "left")
    topics = own.select("component", "node", F.explode(F.array_distinct("topics")).alias("topic")).groupBy("component", "topic").agg(F.count_distinct("node").alias("have"))
    shared = topics.join(sizes, "component").where("have = size").groupBy("component").agg(F.count("*").alias("shared"))
    small = sizes.where(F.col("size") <= formula_limit)
    have = own.select("component", "node", F.array_distinct("formulas").alias("f")).where(F.size("f") > 0).join(small.select("component"), "component", "left_semi")
    share = F.size(F.array_intersect("f", "g")) / F.least(F.size("f"), F.size("g")).cast("double")
    formula = have.join(have.select("component", F.col("node").alias("other"), F.col("f").alias("g")), "component").where("node < other").groupBy("component").agg(F.max(share).alias("score_formula"))
    groups = written(sizes.join(best, "component").join(shared, "component", "left").join(formula, "component", "left"), "evidence-groups")
    numbered = _numbered(groups).withColumn("score_formula", F.when(F.col("size") <= formula_limit, F.coalesce("score_formula", F.lit(0.0)))).withColumn("shared", F.coalesce("shared", F.lit(0)))
    columns = ["group_id", "component", "size", *scores, "score_formula", "shared"]
    met = nodes.join(if_few(written(numbered.select(*columns), "evidence-groups")), "component")
    return met.select("group_id", F.col("component").alias("canonical"), F.col("node").alias("member"), "size", *[F.round(s, 4).alias(s) for s in [*scores, "score_formula"]], "shared", (F.col("shared") > 0).alias("same_topic"))


def _numbered(groups: DataFrame) -> DataFrame:
    from sluicework.operators.similarity import numbered  # similarity joins by this module

    return numbered(groups, ["component"], "_n").withColumn("group_id", F.format_string("DG-%05d", "_n"))
