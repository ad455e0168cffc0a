"""What the training-data operators share: inputs, lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six characters that count as white space in the line and word rules.
SPACES = " \t\n\x0b\x0c\r"
#: A broadcast is used only for a side measured to be below this many bytes.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors and the driver see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: for wide rows, which a checkpoint would not compress."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, actions send Python batches of at most so many rows: batches of long texts then take megabytes of an
    executor's memory, not hundreds. The session's setting comes back at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions of frames made within it delete their shuffle files when they end; else these stay until the driver
    happens to collect its garbage. A frame to be returned is made outside, as one that runs twice would shuffle
    twice. The session's setting comes back at the end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Deletes the files of a written() table. All that was made of it must be written or checkpointed itself."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """df as Parquet in the shared folder, bucketed by a column: what groups by it later needs no shuffle.
    Its entry in the catalogue goes at once, the files stay with the other written tables."""
    spark, name = df.sparkSession, f"t_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", shared_folder(spark)).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return out


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, of about row_bytes a row, may be broadcast. df should be cheap to count."""
    return df.limit(limit // row_bytes + 1).count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if it was measured to be small; else Spark picks a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes) else df
