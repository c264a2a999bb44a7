"""Places and tables that jobs share, read from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast.
FEW = 1 << 20
#: Bytes of an Arrow batch that goes to Python and rows that a Parquet reader decodes together, where the session doesn't say.
BATCH, DECODED = 4 << 20, 512
#: Bytes of a row group of a table that is written, which a task holds until it is full.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset and the session's master is this one machine, as
    in tests, a temporary folder is made and set for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sluicework-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read again.

    This cuts the lineage so that a lost executor costs no more than rereading a file.
    """
    path = f"{shared_dir(df.sparkSession)}/sluicework/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what this session's readers and Arrow batches hold of rows at once, unless the session has bounds of its own.

    Spark bounds an Arrow batch by 10,000 rows and 64 MB, and a reader's by 4,096 rows: where rows are texts, that is hundreds of
    MB for a worker and its JVM.
    """
    has = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH), ("spark.sql.parquet.columnarReaderBatchSize", DECODED)):
        if key not in has:
            spark.conf.set(key, str(value))


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it has at most ``most`` of them; otherwise as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
