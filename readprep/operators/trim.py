"""The fused per-read trim: one Arrow kernel that returns positions, and the columns cut by them in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..options import TrimConfig
from ..schema import MATCH, TRIM


def trim_udf(c: TrimConfig, side: int = 1) -> Callable[..., Column]:
    """(seq, qual) -> TRIM struct of positions and counters."""

    @F.arrow_udf(TRIM)
    def trim(seq: pa.Array, qual: pa.Array) -> pa.Array:
        s, n = kernels.matrix(seq)
        q, nq = kernels.matrix(qual)
        if not np.array_equal(n, nq):
            raise ValueError("a read's bases and qualities differ in length")
        out = kernels.trim(s, q, n, c, side)
        kinds = {"matches": None, "rrbs3": pa.bool_(), "rrbs5": pa.bool_()}
        cols = [v if k == "matches" else pa.array(v).cast(kinds.get(k, pa.int32())) for k, v in out.items()]
        return pa.StructArray.from_arrays(cols, list(out))

    return trim


def match_udf(adapter: str, rate: float, min_overlap: int) -> Callable[..., Column]:
    """seq -> MATCH struct; null where the adapter isn't found."""

    @F.arrow_udf(MATCH)
    def match(seq: pa.Array) -> pa.Array:
        out = kernels.align(*kernels.matrix(seq), adapter, rate, min_overlap)
        cols = [pa.array(out[:, k], pa.int32()) for k in range(4)]
        return pa.StructArray.from_arrays(cols, ["read_start", "read_end", "overlap", "errors"], mask=pa.array(out[:, 0] < 0))

    return match


def length_udf(kernel: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """Wrap a kernel of (seq matrix, qual matrix, lengths) -> int as (seq, qual) -> int column."""

    @F.arrow_udf("int")
    def run(seq: pa.Array, qual: pa.Array) -> pa.Array:
        s, n = kernels.matrix(seq)
        return pa.array(kernel(s, kernels.matrix(qual)[0], n)).cast(pa.int32())

    return run


def quality_keep(seq: Column, qual: Column, cutoff: int, offset: int = 33, two_colour: bool = False) -> Column:
    return length_udf(lambda s, q, n: kernels.quality_keep(q, n, cutoff, offset, s if two_colour else None))(seq, qual)


def homopolymer(seq: Column, base: str, head: bool = False) -> Column:
    return length_udf(lambda s, q, n: kernels.homopolymer(s, n, base, head))(seq, seq)


def minimizer(seq: Column) -> Column:
    @F.arrow_udf("long")
    def run(s: pa.Array) -> pa.Array:
        return pa.array(kernels.minimizer(*kernels.matrix(s)))

    return run(seq)


def _renamed(read_id: Column, t: Column, seq: Column, other: tuple[Column, Column] | None = None) -> Column:
    """Behind the id, the clipped bases of the read."""
    five = F.when(t["clip5"] > 0, F.concat(F.lit(":clip5:"), F.substring(seq, t["start"] - t["clip5"] + 1, t["clip5"]))).otherwise("")
    three = F.when(t["clip3"] > 0, F.concat(F.lit(":clip3:"), F.substring(seq, t["stop"] + 1, t["clip3"]))).otherwise("")
    from ..functions.exprs import append_to_id

    return append_to_id(read_id, F.concat(five, three))


def trim_read(read: Column, t: Column, c: TrimConfig) -> Column:
    """The struct (id, seq, qual) cut as the TRIM struct says."""
    cut = lambda x: F.substring(x, t["start"] + 1, t["stop"] - t["start"])
    clips = any((c.clip_r1, c.clip_r2, c.three_prime_clip_r1, c.three_prime_clip_r2))
    read_id = _renamed(read["id"], t, read["seq"]) if c.rename and clips else read["id"]
    return F.struct(read_id.alias("id"), cut(read["seq"]).alias("seq"), cut(read["qual"]).alias("qual"))


def once(df: DataFrame, **udfs: Column) -> DataFrame:
    """Add columns that predicates on them don't compute anew: a generator stands between, which only predicates on
    other columns pass on their way to the scan."""
    for name, c in udfs.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def trim_single(reads: DataFrame, c: TrimConfig) -> DataFrame:
    """reads (.., id, seq, qual) with r: the trimmed read, t: what was done, in_len: bases before."""
    out = once(reads, t=trim_udf(c)(F.col("seq"), F.col("qual"))).withColumn("in_len", F.length("seq"))
    return out.withColumn("r", trim_read(F.struct("id", "seq", "qual"), F.col("t"), c))


def trim_pairs(pairs: DataFrame, c: TrimConfig) -> DataFrame:
    """pairs (.., r1, r2[, pt]) with both mates trimmed; t1, t2: what was done, in1, in2: bases before."""
    both = F.struct(trim_udf(c, 1)(F.col("r1.seq"), F.col("r1.qual")).alias("t1"), trim_udf(c, 2)(F.col("r2.seq"), F.col("r2.qual")).alias("t2"))
    out = once(pairs, t=both).withColumns({"t1": F.col("t.t1"), "t2": F.col("t.t2")}).drop("t")
    out = out.withColumn("in1", F.length("r1.seq")).withColumn("in2", F.length("r2.seq"))
    return out.withColumn("r1", trim_read(F.col("r1"), F.col("t1"), c)).withColumn("r2", trim_read(F.col("r2"), F.col("t2"), c))
