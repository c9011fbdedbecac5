"""Small shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task works on at a time where rows carry whole texts.
TEXT_ROWS = 512


def short_text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """For jobs, not operators: lower the session's Arrow batches to ``rows`` (never raises them).

    Operators work on pieces of a batch either way; short batches also keep the batch itself small,
    which is else bounded by spark.sql.execution.arrow.maxBytesPerBatch only (64 MB if not set).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a single-machine session gets a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    use_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shared_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written once as Parquet to the shared folder and read again; deleted at the end of the block."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(folder)
        yield spark.read.parquet(folder)
    finally:
        delete_folder(spark, folder)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Small sides are broadcast up to this many bytes.
BROADCAST_BYTES = 64_000_000


def measured(side: DataFrame, bytes_per_row: Column | int = 32) -> DataFrame:
    """A small side of a join: measured first, and broadcast if it fits BROADCAST_BYTES.

    Beyond that the join shuffles both sides; the result is the same.
    """
    side = cut_lineage(side)
    size = side.agg(F.sum(bytes_per_row if isinstance(bytes_per_row, Column) else F.lit(bytes_per_row))).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


#: Keys with more than 1/HOT_KEYS of all rows, and with more than HOT_LEAST, are hot: fewer than HOT_KEYS.
HOT_KEYS, HOT_LEAST = 1 << 16, 1_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``counted``: one row a key, whose column ``n`` says how many ``rows`` it meets.

    Hot keys are few by their definition, so they are broadcast and their rows stay where they are;
    all others meet in a shuffled join, in which no key has many rows. ``total`` is the number of rows.
    """
    bound = max(HOT_LEAST, total // HOT_KEYS)
    hot, cold = F.broadcast(counted.where(F.col("n") > bound).drop("n")), counted.where(F.col("n") <= bound).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
