"""The same transforms on streams. Single-end trimming is stateless, so a stream's results are the batch's; options
that depend on the data are resolved on a static prefix first (operators.detect.resolve)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, stats
from ..operators.trim import trim_single
from ..options import TrimConfig

READS = "rec_idx long, id string, seq string, qual string"


def read_stream(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """Reads from files as they arrive in a folder."""
    return spark.readStream.schema(READS).format(kind).load(folder)


def trim_stream(reads: DataFrame, c: TrimConfig) -> DataFrame:
    """Trimmed reads with their verdict; works alike on batches and streams."""
    return filters.judge(trim_single(reads, c), c)


def stats_stream(trimmed: DataFrame, c: TrimConfig) -> DataFrame:
    """Running counters, for output mode complete or update."""
    return stats.single_stats(trimmed, c)


def pair_stream(r1: DataFrame, r2: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Inner join of two streams (rec_idx, ts, id, seq, qual) by position, with state bounded by a watermark on ts."""
    side = lambda df, n: df.withWatermark("ts", delay).select(F.col("rec_idx").alias(f"k{n}"), F.col("ts").alias(f"ts{n}"), F.struct("id", "seq", "qual").alias(f"r{n}"))
    near = f"k1 = k2 AND ts2 BETWEEN ts1 - INTERVAL {delay} AND ts1 + INTERVAL {delay}"
    return side(r1, 1).join(side(r2, 2), F.expr(near)).select(F.col("k1").alias("rec_idx"), "r1", "r2")


def write_stream(trimmed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch of reads that pass to `write`; the checkpoint makes a restart go on where it stopped."""
    passed = trimmed.filter(F.col("verdict") == filters.PASS).select("rec_idx", "r.*")
    return passed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
