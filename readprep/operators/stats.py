"""Run statistics: counters by side, pair counters, adapter histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import TrimConfig
from . import filters as V

COUNTERS = [
    "total_reads", "reads_with_adapter", "bp_processed", "quality_bp", "bp_after_trim", "bp_written", "too_short", "too_long", "too_many_n",
    "reads_written", "discarded_untrimmed", "rrbs_3prime", "rrbs_5prime", "rrbs_r2_clipped", "poly_a_reads", "poly_a_bp", "poly_g_reads", "poly_g_bp",
]
PAIR_COUNTERS = ["pairs_analyzed", "pairs_removed", "pairs_removed_n", "pairs_removed_too_long", "r1_unpaired", "r2_unpaired", "passthrough_kept", "passthrough_dropped", "passthrough_checked"]


def had_adapter(t: Column) -> Column:
    return F.size(t["matches"]) > 0


def _sum(x: Column, name: str) -> Column:
    return F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long").alias(name)


def _count(cond: Column, name: str) -> Column:
    return F.count(F.when(cond, 1)).alias(name)


def counters(t: Column, in_len: Column, out_len: Column, verdict: Column, c: TrimConfig, side: int = 1, single: bool = True) -> list[Column]:
    """The aggregates of one side, over trimmed rows. Filter counters of pairs lie with the pair, not with its sides."""
    written = verdict == V.PASS
    own = lambda v: (verdict == v) if single else F.lit(False)
    return [
        F.count(F.lit(1)).alias("total_reads"),
        _count(had_adapter(t), "reads_with_adapter"),
        _sum(in_len, "bp_processed"),
        _sum(t["quality_bp"], "quality_bp"),
        _sum(t["after_adapter"], "bp_after_trim"),
        _sum(F.when(written, out_len).otherwise(0), "bp_written"),
        _count(own(V.SHORT), "too_short"),
        _count(own(V.LONG), "too_long"),
        _count(own(V.MANY_N), "too_many_n"),
        _count(written, "reads_written"),
        _count(verdict == V.UNTRIMMED, "discarded_untrimmed"),
        _count(t["rrbs3"], "rrbs_3prime"),
        _count(t["rrbs5"], "rrbs_5prime"),
        _count(F.lit(c.rrbs and side == 2) & (t["clip5"] > 0), "rrbs_r2_clipped"),
        _count(t["poly_a_bp"] > 0, "poly_a_reads"),
        _sum(t["poly_a_bp"], "poly_a_bp"),
        _count(t["poly_g_bp"] > 0, "poly_g_reads"),
        _sum(t["poly_g_bp"], "poly_g_bp"),
    ]


def single_stats(trimmed: DataFrame, c: TrimConfig) -> DataFrame:
    """One row of COUNTERS over trimmed reads with a verdict column."""
    return trimmed.agg(*counters(F.col("t"), F.col("in_len"), F.col("t.stop") - F.col("t.start"), F.col("verdict"), c))


def side_stats(pairs: DataFrame, c: TrimConfig, side: int) -> DataFrame:
    return pairs.agg(*counters(F.col(f"t{side}"), F.col(f"in{side}"), F.col(f"t{side}.stop") - F.col(f"t{side}.start"), F.col("v.verdict"), c, side, False))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """One row of PAIR_COUNTERS over pairs with v: (verdict, r1_ok, r2_ok). Pairs dropped as untrimmed count as
    removed, for no reason of their own."""
    v = F.col("v.verdict")
    checked = F.lit("pt" in pairs.columns)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs_analyzed"),
        _count(v != V.PASS, "pairs_removed"),
        _count(v == V.MANY_N, "pairs_removed_n"),
        _count(v == V.LONG, "pairs_removed_too_long"),
        _count(F.col("v.r1_ok"), "r1_unpaired"),
        _count(F.col("v.r2_ok"), "r2_unpaired"),
        _count(checked & (v == V.PASS), "passthrough_kept"),
        _count(checked & (v != V.PASS), "passthrough_dropped"),
        _count(checked, "passthrough_checked"),
    )


def length_histogram(trimmed: DataFrame, t: str = "t") -> DataFrame:
    """(adapter_idx, length, count): bases removed a round, by adapter."""
    m = trimmed.select(F.explode(F.col(f"{t}.matches")).alias("m"))
    return m.groupBy(F.col("m.adapter_idx").alias("adapter_idx"), F.col("m.removed").alias("length")).agg(F.count(F.lit(1)).alias("count"))


def expected(histogram: DataFrame, total_reads: Column, rate: float) -> DataFrame:
    """Adds expect = total / 4^length and max_err = floor(length * rate)."""
    return histogram.withColumns({"expect": total_reads / F.pow(F.lit(4.0), F.col("length")), "max_err": F.floor(F.col("length") * rate).cast("int")})
