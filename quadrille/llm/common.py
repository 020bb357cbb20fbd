"""Shared helpers: input tables, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only if its written row count times this many bytes stays below.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where none is set (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    given = spark.sparkContext.getCheckpointDir()
    if given is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="spark-quadrille-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage, survives lost executors, and gives the optimiser true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 1_000


def lean_batches(spark: SparkSession) -> None:
    """Texts are a few kilobytes each, and a batch is held several times (in the JVM, on its way and in
    Python): the session's batches are made smaller where they are larger than BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def numbered(df: DataFrame) -> DataFrame:
    """(row, doc): every row of df, written once, under a number of its own that later steps join on.

    Null and repeated ids stay apart this way, and no column of df can clash with another.
    """
    return materialize(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")), "rows")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, with a broadcast hint if it is below the limit; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))


def held_out(doc_id: Column) -> Column:
    """Rows on which nothing is learnt: crc32 of the id's text is a multiple of five."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
