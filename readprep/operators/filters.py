"""Verdicts on reads and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import n_count
from ..options import TrimConfig

PASS, SHORT, LONG, MANY_N, UNTRIMMED = "pass", "too_short", "too_long", "too_many_n", "untrimmed"


def too_many_n(seq: Column, max_n: float | None) -> Column:
    """From 1 on a count (whole part), below a share of the bases; an empty read has too many if there is a limit."""
    if max_n is None:
        return F.lit(False)
    n = n_count(seq)
    over = n > int(max_n) if max_n >= 1 else n / F.greatest(F.length(seq), F.lit(1)) > max_n
    return F.when(F.length(seq) == 0, True).otherwise(over)


def single_verdict(seq: Column, had_adapter: Column, c: TrimConfig, size: Column | None = None) -> Column:
    """untrimmed, too_many_n, too_short, too_long or pass, in this order. `size`: the length of seq where it is known."""
    size = F.length(seq) if size is None else size
    out = F.when(F.lit(c.discard_untrimmed) & ~had_adapter, UNTRIMMED)
    out = out.when(too_many_n(seq, c.max_n), MANY_N).when(size < c.length_cutoff, SHORT)
    if c.max_length is not None:
        out = out.when(size > c.max_length, LONG)
    return out.otherwise(PASS)


def pair_verdict(seq1: Column, seq2: Column, had1: Column, had2: Column, c: TrimConfig, size1: Column | None = None, size2: Column | None = None) -> Column:
    """Struct (verdict, r1_ok, r2_ok): each mate of a pair with a short mate may be rescued on its own length."""
    n1, n2 = (F.length(q) if n is None else n for q, n in ((seq1, size1), (seq2, size2)))
    out = F.when(F.lit(c.discard_untrimmed) & ~had1 & ~had2, UNTRIMMED)
    out = out.when(too_many_n(seq1, c.max_n) | too_many_n(seq2, c.max_n), MANY_N).when(F.least(n1, n2) < c.length_cutoff, SHORT)
    if c.max_length is not None:
        out = out.when(F.greatest(n1, n2) > c.max_length, LONG)
    verdict = out.otherwise(PASS)
    ok = lambda size, n: (verdict == SHORT) & F.lit(c.retain_unpaired) & (size >= n)
    return F.struct(verdict.alias("verdict"), ok(n1, c.length_1).alias("r1_ok"), ok(n2, c.length_2).alias("r2_ok"))


def judge(trimmed: DataFrame, c: TrimConfig) -> DataFrame:
    """Trimmed reads with their verdict; bases are looked at only where there is a limit of Ns."""
    t = F.col("t")
    return trimmed.withColumn("verdict", single_verdict(F.col("r.seq"), F.size(t["matches"]) > 0, c, t["stop"] - t["start"]))


def judge_pairs(trimmed: DataFrame, c: TrimConfig) -> DataFrame:
    """Trimmed pairs with v: verdict, r1_ok, r2_ok."""
    had, size = zip(*[(F.size(f"t{n}.matches") > 0, F.col(f"t{n}.stop") - F.col(f"t{n}.start")) for n in (1, 2)], strict=True)
    return trimmed.withColumn("v", pair_verdict(F.col("r1.seq"), F.col("r2.seq"), *had, c, *size))
