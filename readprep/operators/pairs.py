"""Reads into pairs and triples: by position, by interleaving, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import id_prefix

SLACK = 1024
BLOCK = 1 << 16


class PairingError(ValueError):
    """Files that don't fit together; the message says where."""


def _side(reads: DataFrame, name: str, key: str) -> DataFrame:
    return reads.select(F.col(key).alias("rec_idx"), F.struct("id", "seq", "qual").alias(name))


def zip_pairs(r1: DataFrame, r2: DataFrame, pt: DataFrame | None = None, key: str = "rec_idx") -> DataFrame:
    """(rec_idx, r1, r2[, pt], fault): full outer by position. fault names the side that ran short, or an id that
    differs from read 1's (with a third stream only; a missing mate outranks it); null where all is well."""
    out = _side(r1, "r1", key).join(_side(r2, "r2", key), "rec_idx", "full_outer")
    if pt is not None:
        out = out.join(_side(pt, "pt", key), "rec_idx", "full_outer")
    fault = F.when(F.col("r1").isNull() & F.col("r2").isNull(), "passthrough is longer than the pairs")
    fault = fault.when(F.col("r1").isNull(), "read 1 is shorter than read 2").when(F.col("r2").isNull(), "read 2 is shorter than read 1")
    if pt is not None:
        same = (id_prefix(F.col("r1.id")) == id_prefix(F.col("r2.id"))) & (id_prefix(F.col("r1.id")) == id_prefix(F.col("pt.id")))
        fault = fault.when(F.col("pt").isNull(), "passthrough is shorter than the pairs").when(~same, "ids differ")
    return out.withColumn("fault", fault.otherwise(F.lit(None).cast("string")))


def faults(zipped: DataFrame) -> DataFrame:
    """One row: pairs, faulty ones, and the first fault's record (from 1 on) and kind."""
    bad = F.col("fault").isNotNull()
    first = F.min(F.when(bad, F.struct((F.col("rec_idx") + 1).alias("record"), F.col("fault"))))
    out = zipped.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(bad, 1)).alias("faulty"), first.alias("first"))
    return out.select("pairs", "faulty", F.col("first.record").alias("first_record"), F.col("first.fault").alias("first_fault"))


def strict(zipped: DataFrame) -> DataFrame:
    """The pairs, or PairingError with the first fault. One small aggregate runs at once."""
    x = faults(zipped).first()
    if x["faulty"]:
        raise PairingError(f"{x['first_fault']} at record {x['first_record']}")
    return zipped.drop("fault")


def interleaved(reads: DataFrame, slack: int = SLACK) -> DataFrame:
    """Pairs from one stream (rec_idx, side 1 or 2, id, seq, qual): the k-th read 1 with the k-th read 2.

    (rec_idx: k, r1, r2, fault): orphans and more than `slack` waiting mates are faults."""
    block = F.floor(F.col("rec_idx") / BLOCK).cast("long")
    rows = reads.withColumn("block", block)
    sums = rows.groupBy("block").agg(*[F.count(F.when(F.col("side") == n, 1)).alias(f"n{n}") for n in (1, 2)])
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK records
    sums = sums.select("block", *[F.coalesce(F.sum(f"n{n}").over(before), F.lit(0)).alias(f"p{n}") for n in (1, 2)])
    by = Window.partitionBy("block").orderBy("rec_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "block").withColumns({f"c{n}": F.col(f"p{n}") + F.count(F.when(F.col("side") == n, 1)).over(by) for n in (1, 2)})
    rows = rows.withColumn("k", F.when(F.col("side") == 1, F.col("c1")).otherwise(F.col("c2")) - 1).withColumn("waiting", F.abs(F.col("c1") - F.col("c2")))
    side = lambda n: rows.filter(F.col("side") == n).select(F.col("k").cast("long").alias("rec_idx"), F.struct("id", "seq", "qual").alias(f"r{n}"), F.col("waiting").alias(f"w{n}"))
    out = side(1).join(side(2), "rec_idx", "full_outer")
    fault = F.when(F.col("r1").isNull(), "read 2 without read 1").when(F.col("r2").isNull(), "read 1 without read 2")
    fault = fault.when(F.greatest("w1", "w2") > slack, "too many waiting mates").otherwise(F.lit(None).cast("string"))
    return out.withColumn("fault", fault).drop("w1", "w2")


def kept_passthrough(pt: DataFrame, pairs: DataFrame) -> DataFrame:
    """The third stream's records whose pair stays."""
    return pt.join(pairs.select("rec_idx"), "rec_idx", "left_semi")


def removed_pairs(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    return pairs.join(kept.select("rec_idx"), "rec_idx", "left_anti")
