"""Embedding whitening by TSQR.

Vectors are rounded to whole numbers, so their sums are exact. Every task centres its part of the distinct vectors by these
sums and keeps nothing but the R factor of a QR decomposition; R factors are stacked and decomposed again, ``FAN`` at a time,
until one is left, whose singular values and right vectors are those of the whole centred matrix. The covariance matrix is
never formed, which would square its condition number. All that is sent are R factors, dim x dim numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm.batches import handing_back
from sluicework.session import small_batches, written

STEP = 256.0
COMPONENTS = 4
#: R factors that one task stacks, and rows that are decomposed together.
FAN, ROWS = 16, 4096


def _by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of whole numbers) of the vectors of each length."""
    sizes = np.diff(np.asarray(x.offsets))
    for dim in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == dim)
        yield dim, own, np.asarray(x.take(pa.array(own)).flatten()).reshape(-1, dim)


SUMS = "dim int, place int, n long, high long, low long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's vectors by component, in two parts of 32 bits that can't overflow."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, own, x in _by_length(batch.column(0)):
            part = np.stack([np.full(dim, len(own)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            held[dim] = held[dim] + part if dim in held else part
    for dim, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), *map(pa.array, part)], ["dim", "place", "n", "high", "low"])


@dataclass
class Centre:
    """Number of distinct vectors and their sums, as Python's whole numbers."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        floors = [s // self.n for s in self.sums]
        self.small = all(abs(s) < 1 << 62 for s in floors)
        self.floor = np.array(floors, np.int64 if self.small else object)
        self.rest = np.array([(s - f * self.n) / self.n for s, f in zip(self.sums, floors, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part of the difference is exact, then one rounding."""
        if self.small and len(x) and -(1 << 61) < x.min() and x.max() < 1 << 61:
            return (x - self.floor).astype(np.float64) - self.rest
        return np.array([[int(v) - int(f) for v, f in zip(row, self.floor, strict=True)] for row in x.tolist()], object).reshape(x.shape).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over components of (n x - S)^2, exactly, from three products of whole numbers."""
        most = max(int(x.max()), -int(x.min())) if x.size else 0
        squares = sum(s * s for s in self.sums)
        if most < 1 << 24 and x.shape[1] < 1 << 7 and all(abs(s) < 1 << 62 for s in self.sums):
            s = np.array(self.sums, np.int64)
            a, high, low = (x * x).sum(axis=1), x @ (s >> 32), x @ (s & 0xFFFFFFFF)
            return [self.n * self.n * p - 2 * self.n * ((h << 32) + q) + squares for p, h, q in zip(a.tolist(), high.tolist(), low.tolist(), strict=True)]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


FACTORS = "dim int, part long, r binary"


def _factor(centres: dict[int, Centre]):
    """A function for mapInArrow: distinct vectors to one R factor of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for dim, _, x in _by_length(batch.column(0)):
                for a in range(0, len(x), max(ROWS, 2 * dim)):
                    rows = centres[dim].centred(x[a : a + max(ROWS, 2 * dim)])
                    held[dim] = np.linalg.qr(np.concatenate([held[dim], rows]) if dim in held else rows, mode="r")
        for dim, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part]), pa.array([r.astype("<f8").tobytes()])], ["dim", "part", "r"])

    return run


def _stack(table: pa.Table) -> pa.Table:
    """One R factor of several, in order of their parts."""
    table = table.sort_by("part")
    dim = table["dim"][0].as_py()
    r = np.linalg.qr(np.concatenate([np.frombuffer(b.as_py(), "<f8").reshape(-1, dim) for b in table["r"]]), mode="r")
    return pa.table({"dim": table["dim"][:1], "part": pa.array([table["part"][0].as_py() // FAN]), "r": pa.array([r.astype("<f8").tobytes()])})


@dataclass
class Whitener:
    """Centre, components (columns, at most k), singular values of these, the sum of all squares."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; not a number where vectors don't differ along it."""
        deviation = np.sqrt(self.values**2 / self.centre.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(deviation > 0, self.centre.centred(x) @ self.vectors / deviation, np.nan)


def _whitener(centre: Centre, r: np.ndarray, k: int) -> Whitener:
    _, s, vt = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(len(vt) - len(s))])
    s[s <= s.max(initial=0) * max(centre.n, len(vt)) * np.finfo(float).eps] = 0
    v = vt[:k].T
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return Whitener(centre, v, s[:k], float((s**2).sum()))


def fit(x: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, dict[int, Whitener]]:
    """(the distinct vectors, written; a whitener for each length) of the column ``x`` of whole numbers."""
    each = written(x.select("x").distinct(), "whitening-fit")
    sums = each.mapInArrow(handing_back(_sums), SUMS).groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for row in sums.collect():  # a row for each component
        found.setdefault(row["dim"], {})[row["place"]] = row["n"], (int(row["high"]) << 32) + int(row["low"])
    centres = {dim: Centre(own[0][0], [own[j][1] for j in range(dim)]) for dim, own in found.items()}
    factors = written(each.mapInArrow(handing_back(_factor(centres)), FACTORS), "whitening-r")
    while (factors.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        factors = written(factors.groupBy("dim", F.floor(F.col("part") / FAN).alias("to")).applyInArrow(_stack, FACTORS), "whitening-r")
    return each, {r["dim"]: _whitener(centres[r["dim"]], np.frombuffer(r["r"], "<f8").reshape(-1, r["dim"]), k) for r in factors.collect()}


def _columns(by: dict[int, Whitener], k: int):
    """A function for mapInArrow: distinct vectors to their length and whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _by_length(batch.column(0)):
                w = by[dim].whitened(x)
                w = np.concatenate([w, np.full((len(w), k - w.shape[1]), np.nan)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), dim), pa.int32()), *[pa.array(w[:, j], from_pandas=True) for j in range(k)]], ["dim", *[f"w{j}" for j in range(k)]])

    return run


def identity_error(each: DataFrame, by: dict[int, Whitener], k: int) -> dict[int, float | None]:
    """For each length the largest entry of the whitened distinct vectors' covariance minus the identity, over components along which they differ."""
    columns = each.mapInArrow(handing_back(_columns(by, k)), "dim int, " + ", ".join(f"w{j} double" for j in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = columns.groupBy("dim").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for row in found:
        off = [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None]
        out[row["dim"]] = max(off, default=None)
    return out


def whitened(df: DataFrame, k: int = COMPONENTS, step: float = STEP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component up to ``k``.

    Vectors that are null or empty or hold null or non-finite entries are left out. Each entry, times ``step``, is rounded down to
    a long (values beyond a long become its ends). Everything is fitted to the distinct vectors of one length, and vectors
    of another length are fitted for themselves. Components have the sign that makes their largest entry positive. Where
    vectors don't differ along a component (as with a single vector) whitened is null and explained 0 or, without any
    difference, null. ``deviation`` is exact; it is null where it takes more than 38 digits. Repeated rows and null ids keep their rows. An
    empty table gives an empty result. Other columns are ignored.
    """
    small_batches(df.sparkSession)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * step)).alias("x"))
    each, by = fit(rows, k)
    errors = identity_error(each, by, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _by_length(batch.column(1)):
                m = by[dim]
                w, exact = m.whitened(x), m.centre.deviations(x)
                own_k, digits = w.shape[1], 10**38
                text = pa.array([str(d) if d < digits else None for d in exact]).take(pa.array(np.repeat(np.arange(len(x)), own_k)))
                share = np.tile(m.values**2 / m.trace if m.trace else np.full(own_k, np.nan), len(x))
                n = len(x) * own_k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(own, own_k))), pa.array(np.tile(np.arange(1, own_k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, m.centre.n)),
                    text, pa.array(w.ravel(), from_pandas=True), pa.array(share, from_pandas=True), pa.array([errors.get(dim)] * n, pa.float64()),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(handing_back(run), "id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the first four whitened components of every embedding."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
