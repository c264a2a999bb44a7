"""Document fingerprints by Order MinHash.

A text's k-mers (8 bytes of UTF-8) are numbered by occurrence. Each of ``FUNCTIONS`` hash functions selects the
``LENGTH`` numbered k-mers with the least hashes; these are put back into text order and their tuple is hashed to
one entry of the signature. Entries agree when the same k-mers are selected in the same order, so the share that
agrees falls with edit distance, also when an edit only moves text.

The query compares each document with the next by id. One range sort puts most documents beside their next; of
each partition only the first and the last document meet others, in a second small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicework.session import small_batches, written

K = 8
FUNCTIONS = 32
LENGTH = 2
CHUNK = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(8)
_FACTORS = (_RNG.integers(0, 1 << 32, FUNCTIONS, np.uint32) | np.uint32(1))[:, None]
_FLIPS = _RNG.integers(0, 1 << 32, FUNCTIONS, np.uint32)[:, None]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def signature(text: bytes) -> np.ndarray:
    """The uint32 signature. A text shorter than a k-mer is one k-mer, padded and marked with its length."""
    if len(text) < K:
        kmers = np.frombuffer(text.ljust(K, b"\0"), "<u8") ^ np.uint64(len(text) + 1 << 59)
    else:
        kmers = np.ndarray((len(text) - K + 1,), "<u8", text, strides=(1,)).copy()
    order = np.argsort(kmers, kind="stable")
    run = kmers[order]
    index = np.arange(len(run))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], run[1:] != run[:-1])), index, 0))
    occurrence = np.empty(len(run), np.uint64)
    occurrence[order] = index - first
    hashes = (_mixed(kmers + occurrence * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(FUNCTIONS)
    best_at, best = np.empty((FUNCTIONS, 0), np.int64), np.empty((FUNCTIONS, 0), np.uint64)
    for k in range(0, len(hashes), CHUNK):
        own = (hashes[None, k : k + CHUNK] ^ _FLIPS) * _FACTORS
        for _ in range(min(LENGTH, own.shape[1])):
            at = own.argmin(axis=1)
            best_at = np.concatenate([best_at, at[:, None] + k], axis=1)
            best = np.concatenate([best, own[rows, at].astype(np.uint64)[:, None]], axis=1)
            own[rows, at] = np.uint32(0xFFFFFFFF)
        if best.shape[1] > LENGTH:
            pick = np.argsort(best, axis=1, kind="stable")[:, :LENGTH]
            best_at, best = np.take_along_axis(best_at, pick, 1), np.take_along_axis(best, pick, 1)
    chosen = kmers[np.sort(best_at, axis=1)]
    out = np.full(FUNCTIONS, chosen.shape[1], np.uint64) + rows.astype(np.uint64)
    for j in range(chosen.shape[1]):
        out = _mixed(out * np.uint64(0xFF51AFD7ED558CCD) + chosen[:, j])
    return (out >> np.uint64(32)).astype(np.uint32)


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter, rounded down, replaced by as many first characters of the following text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


NAMES = ["kind", "part", "doc_id", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _compared(doc_id: int | None, text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> tuple:
    other = _bytes(edited(text, following))
    mark = signature(other)
    return 0, 0, doc_id, None, len(text), hashlib.sha256(other).hexdigest(), _hex(sig), _hex(mark), likeness(sig, mark), likeness(sig, next_sig)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents: a row for each but the last (kind 0), then the first (1) and the last (2) with their texts."""
    part = TaskContext.get().partitionId()
    last, rows = None, []
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            i, t = i.as_py(), t.as_py() or ""
            sig = signature(_bytes(t))
            if last is None:
                yield _batch([(1, part, i, t, *[None] * 6)])
            else:
                rows.append(_compared(*last, t, sig))
            last = i, t, sig
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)
    if last is not None:
        yield _batch([(2, part, last[0], last[1], *[None] * 6)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_compared(i, t, signature(_bytes(t)), f, signature(_bytes(f))) for i, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield _batch(rows)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Rows are in the order of their ids (null first; rows of one id by their text's hash, so repeated rows stay and
    follow each other); the last is followed by the first, a single row by itself. A null text is an empty one. Very
    long texts are read whole. An empty table gives an empty result. Other columns are ignored. Two empty texts are
    alike (1). An id, or a row, that many rows repeat is dealt to several tasks.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    small_batches(df.sparkSession)
    order = ["doc_id", F.xxhash64("text"), "text", "tie"]
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("doc_id", order[1], "tie").sortWithinPartitions(*order).drop("tie")
    along = written(laid.mapInArrow(_along, KINDS), "order-minhash")
    # One row a partition from here on.
    ends = along.where("kind > 0").select("kind", "part", "doc_id", "text")
    parts = ends.where("kind = 1").select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("following"))
    firsts = ends.where("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    met = ends.where("kind = 2").join(parts, "part").join(firsts, "following").select("doc_id", "text", "next_text")
    return along.where("kind = 0").unionByName(met.mapInArrow(_ends, KINDS)).select(*NAMES[2:3], *NAMES[4:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprints of every document and of its edited text."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
