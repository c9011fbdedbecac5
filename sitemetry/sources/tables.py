"""Typed tables in, idempotent results out."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versioned

BUCKETS = versioned.BUCKETS
#: Small sides of joins are broadcast up to this many bytes.
BROADCAST_BYTES = 64_000_000


def read_table(spark: SparkSession, path: str, schema: str | None = None, crawls: list[str] | None = None) -> DataFrame:
    """A Parquet table with an explicit schema, or the newest version of a table that ``replace_results`` keeps.

    With ``crawls`` only those are read; of a table with versions only their buckets.
    """
    wanted = None if crawls is None else spark.createDataFrame([(c,) for c in crawls], "crawl_run_id string")
    if versioned.is_versioned(spark, path):
        size = versioned.current(spark, path).buckets
        df = versioned.read_version(spark, path, None if wanted is None else [r[0] for r in wanted.select(versioned.bucket_of(["crawl_run_id"], size)).distinct().collect()])
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df if crawls is None else df.where(F.col("crawl_run_id").isin(crawls))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a temporary one on a single machine only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Rows that several branches of a plan read, computed once and kept where lost executors don't take them along."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def measured(side: DataFrame, bytes_per_row: Column | int = 32) -> DataFrame:
    """A small side of a join, computed once and measured: broadcast if it fits BROADCAST_BYTES, else joined by a shuffle."""
    side = cut_lineage(side)
    size = side.agg(F.sum(bytes_per_row if isinstance(bytes_per_row, Column) else F.lit(bytes_per_row))).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def replace_results(results: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the rows of every crawl in ``results``; other crawls stay, and a rerun changes nothing.

    Crawls are dealt into buckets; only touched ones are rewritten, and readers (``read_table``) see
    all of the new rows at once or none (see ``versioned``).
    """
    new = cut_lineage(results)
    same = measured(new.select("crawl_run_id").distinct(), F.length("crawl_run_id") + 16)
    versioned.replace_rows(new, path, "crawl_run_id", same, buckets)


def kept_result(df: DataFrame, folder: str) -> DataFrame:
    """``df``, computed now, whose sources in ``folder`` are then deleted."""
    df = cut_lineage(df)
    versioned.delete(df.sparkSession, folder)
    return df
