"""Tables of numbered snapshots that stand against other writers.

A commit is one small file, named by its number, that is put where no file of that name is: of two writers that want the same
number one succeeds, and the other looks at what has changed and tries the next. Data is written before its commit and
never after it, so readers see whole snapshots, and a job that dies leaves only files that no commit names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "turn long, place string, digest string, txn string"


class Conflict(Exception):
    """Another writer has committed since the snapshot that a write was made for."""


def digest(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order."""
    h = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(h)).first()
    return f"{n}:{total}:{rows.schema.simpleString()}"


def _put(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Puts a small file if there is none of that name, whole or not at all; whether it did.

    On a local or mounted file system by a hard link; elsewhere by a rename that does not overwrite, which HDFS does in one
    step. A store without such a rename needs its own conditional put here.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{folder}/{name}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        to = where.toUri().getPath()
        os.makedirs(os.path.dirname(to), exist_ok=True)
        own = f"{os.path.dirname(to)}/_{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, to)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    own = hadoop.Path(f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.exists(where):
            return False
        return bool(fs.rename(own, where))
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(own, False)


def log(spark: SparkSession, path: str) -> DataFrame | None:
    """The commits of a table (turn, place, digest, txn); None before the first."""
    try:
        return spark.read.schema(ENTRY).json(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last(spark: SparkSession, path: str, turn: int | None = None):
    """The latest commit, or that of a number; None if there is none."""
    found = log(spark, path)
    if found is None:
        return None
    return (found if turn is None else found.where(F.col("turn") == turn)).orderBy(F.desc("turn")).first()


def current(spark: SparkSession, path: str, turn: int | None = None) -> DataFrame | None:
    """The latest snapshot, or that of a number; None if there is none."""
    row = last(spark, path, turn)
    return spark.read.parquet(row["place"]) if row else None


def _done(spark: SparkSession, path: str, txn: str | None) -> bool:
    found = log(spark, path) if txn else None
    return found is not None and not found.where(F.col("txn") == txn).isEmpty()


def _commit(spark: SparkSession, path: str, turn: int, place: str, mark: str, txn: str | None) -> bool:
    return _put(spark, f"{path}/published", f"{turn:020d}.json", json.dumps({"turn": turn, "place": place, "digest": mark, "txn": txn}))


def publish(rows: DataFrame, path: str, partial: bool = False, base: int | None = None) -> bool:
    """Commits rows as the next snapshot; False, and nothing is written, if they are those of the latest.

    With ``base``, the number of the snapshot that the rows were made for (0: none yet), a later commit of another writer is a
    Conflict; without it writers land one after the other and the last counts. Partial results, of a limited run, are refused.
    """
    if partial:
        raise ValueError("a limited run's rows are not the whole table")
    spark, mark, place = rows.sparkSession, digest(rows), None
    while True:
        before = last(spark, path)
        turn = before["turn"] if before else 0
        if base is not None and turn != base:
            raise Conflict(f"snapshot {turn} of {path} came after {base}")
        if before and before["digest"] == mark:
            return False
        if place is None:
            place = f"{path}/version-{uuid.uuid4().hex}"
            rows.write.parquet(place)
        if _commit(spark, path, turn + 1, place, mark, None):
            return True


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 10, txn: str | None = None) -> int | None:
    """Commits what ``change`` makes of the latest snapshot and tells its number; where another writer was first, it is made anew of that one's.

    So no writer's change is lost. A change that raises commits nothing. With ``txn``, a name that is committed with
    the snapshot, a change that was committed before is not made again (None). After ``tries`` it is a Conflict.
    """
    for _ in range(tries):
        if _done(spark, path, txn):
            return None
        before = last(spark, path)
        made = change(spark.read.parquet(before["place"]) if before else None)
        place = f"{path}/version-{uuid.uuid4().hex}"
        made.write.parquet(place)
        turn = (before["turn"] if before else 0) + 1
        if _commit(spark, path, turn, place, digest(spark.read.parquet(place)), txn):
            return turn
    raise Conflict(f"{path} was changed by others {tries} times")


def upserted(now: DataFrame | None, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A table in which rows, by the largest ``order`` of each key, replace or follow those of the same key and no larger order."""
    both = rows if now is None else now.unionByName(rows)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*").select(*both.columns)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: str, name: str):
    """A writer of a stream's rows into a table of snapshots, batch by batch; start() it with a checkpoint.

    A batch is committed under the stream's name and the batch's number, so one that is run again after a failure changes nothing.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            update(rows.sparkSession, path, lambda now: upserted(now, rows, keys, order), txn=f"{name}:{batch}")
        finally:
            rows.unpersist()

    return stream.writeStream.queryName(name).outputMode("update").foreachBatch(write)


class Rejected(Exception):
    """A batch of records with errors, none of which was applied; ``errors`` has them."""

    def __init__(self, errors: DataFrame) -> None:
        super().__init__("records have errors")
        self.errors = errors


def apply_all(spark: SparkSession, path: str, records: DataFrame, check: Callable[[DataFrame, DataFrame], DataFrame], change: Callable[[DataFrame, DataFrame], DataFrame]) -> int | None:
    """Commits ``change(state, records)`` if ``check(records, state)`` gives no row with an error, else Rejected, and nothing is written.

    Both see one snapshot; where another writer was first, records are checked again against what that one made.
    """

    def apply(state: DataFrame | None) -> DataFrame:
        if state is None:
            raise ValueError(f"{path} has no snapshot to apply records to")
        errors = check(records, state).where("error is not null")
        if not errors.isEmpty():
            raise Rejected(errors)
        return change(state, records)

    return update(spark, path, apply)
