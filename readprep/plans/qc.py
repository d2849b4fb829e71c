"""Generic quality control of reads as DataFrames: no particular tool's format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_position(reads: DataFrame, offset: int = 33) -> DataFrame:
    """(position from 1, reads, quality_sum, n_a, n_c, n_g, n_t, n_n), combined before the shuffle."""
    p = reads.filter(F.length("seq") > 0).select(F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("position"), "seq", "qual")
    base = F.substring("seq", F.col("position"), F.lit(1))
    score = F.ascii(F.substring(F.col("qual"), F.col("position"), F.lit(1))) - offset
    return p.groupBy("position").agg(F.count(F.lit(1)).alias("reads"), F.sum(score).cast("long").alias("quality_sum"), *[F.count(F.when(base == b, 1)).alias(f"n_{b.lower()}") for b in "ACGTN"])


def lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("reads"))


def gc_content(reads: DataFrame) -> DataFrame:
    """(percent, reads) by whole percent of G and C."""
    gc = F.length("seq") - F.length(F.translate("seq", "GCgc", ""))
    return reads.filter(F.length("seq") > 0).groupBy(F.round(gc * 100 / F.length("seq")).cast("int").alias("percent")).agg(F.count(F.lit(1)).alias("reads"))


def duplication(reads: DataFrame) -> DataFrame:
    """(copies, sequences): how many sequences occur how often."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("sequences"))
