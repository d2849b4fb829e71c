"""Run-and-exit modes: hard trims, UMI transfer, demultiplexing, and ordering by minimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .trim import minimizer

NO_CODE = "NoCode"


def hardtrim5(reads: DataFrame, keep: int, rename: bool = False) -> DataFrame:
    """The first `keep` bases; with rename, the removed 3' part behind the id, labelled clip5."""
    gone = F.substring("seq", F.lit(keep + 1), F.length("seq"))
    new = E.append_to_id(F.col("id"), F.concat(F.lit(":clip5:"), gone)) if rename else F.col("id")
    read_id = F.when(F.length("seq") > keep, new).otherwise(F.col("id"))
    return reads.withColumns({"id": read_id, "seq": E.truncate(F.col("seq"), keep), "qual": E.truncate(F.col("qual"), keep)})


def hardtrim3(reads: DataFrame, keep: int, rename: bool = False) -> DataFrame:
    """The last `keep` bases; with rename, the removed 5' part behind the id, labelled clip3."""
    gone = F.substring(F.col("seq"), F.lit(1), F.length("seq") - keep)
    new = E.append_to_id(F.col("id"), F.concat(F.lit(":clip3:"), gone)) if rename else F.col("id")
    read_id = F.when(F.length("seq") > keep, new).otherwise(F.col("id"))
    return reads.withColumns({"id": read_id, "seq": E.keep_last(F.col("seq"), keep), "qual": E.keep_last(F.col("qual"), keep)})


def _from(read: str, first: int, read_id: Column) -> Column:
    cut = lambda c: F.substring(F.col(f"{read}.{c}"), F.lit(first), F.length(f"{read}.{c}")).alias(c)
    return F.struct(read_id.alias("id"), cut("seq"), cut("qual"))


def clock_umi(pairs: DataFrame) -> DataFrame:
    """8 bases of UMI and 4 fixed ones of both mates go behind both ids; R1 starts at its 13th, R2 at its 15th base.

    Adds with_fixed: both fixed parts are CAGT. Reads under 13 and 15 bases raise."""
    part = lambda r, a, n: F.substring(F.col(f"{r}.seq"), a, n)
    suffix = F.concat(F.lit(":R1:"), part("r1", 1, 8), F.lit(":R2:"), part("r2", 1, 8), F.lit(":F1:"), part("r1", 9, 4), F.lit(":F2:"), part("r2", 9, 4))
    short = (F.length("r1.seq") < 13) | (F.length("r2.seq") < 15)
    suffix = F.when(short, F.raise_error(F.concat(F.lit("too short for the UMI: "), F.col("r1.id")))).otherwise(suffix)
    fixed = (part("r1", 9, 4) == "CAGT") & (part("r2", 9, 4) == "CAGT")
    new = {"with_fixed": fixed, "r1": _from("r1", 13, E.append_to_id(F.col("r1.id"), suffix)), "r2": _from("r2", 15, E.append_to_id(F.col("r2.id"), suffix))}
    return pairs.withColumns(new)


def clock_summary(umi: DataFrame) -> DataFrame:
    out = umi.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("with_fixed"), 1)).alias("with_fixed"), F.count(F.when(~F.col("with_fixed"), 1)).alias("without_fixed"))
    return out.withColumn("percent_with", E.percentage(F.col("with_fixed"), F.col("pairs")))


def implicon_umi(pairs: DataFrame, n: int = 8) -> DataFrame:
    """The first n bases of R2 go behind both ids and off R2; R1 keeps its bases. A shorter R2 raises."""
    umi = F.concat(F.lit(":"), F.substring("r2.seq", 1, n))
    umi = F.when(F.length("r2.seq") < n, F.raise_error(F.concat(F.lit("too short for the UMI: "), F.col("r2.id")))).otherwise(umi)
    return pairs.withColumns({"r1": _from("r1", 1, E.append_to_id(F.col("r1.id"), umi)), "r2": _from("r2", n + 1, E.append_to_id(F.col("r2.id"), umi))})


def demultiplex(reads: DataFrame, sheet: DataFrame) -> DataFrame:
    """Adds barcode and sample: the last bases name the sample and are cut off; spaces in ids become underscores.

    A read shorter than the barcode is all barcode and becomes empty. `sheet` (sample, barcode) is checked to hold
    distinct barcodes of one length; it is broadcast as the lookup it is, one row a sample."""
    check = sheet.agg(F.count(F.lit(1)), F.countDistinct("barcode"), F.min(F.length("barcode")), F.max(F.length("barcode"))).first()
    if not check[0] or check[0] != check[1] or check[2] != check[3]:
        raise ValueError("a sample sheet needs distinct barcodes of one length")
    n = check[2]
    rest = F.greatest(F.length("seq") - n, F.lit(0))
    cut = lambda c: F.substring(F.col(c), F.lit(1), rest)
    code = F.substring(F.col("seq"), rest + 1, F.lit(n))
    out = reads.withColumn("barcode", code)
    out = out.withColumns({"id": F.concat(F.translate("id", " ", "_"), F.lit("_BC:"), F.col("barcode")), "seq": cut("seq"), "qual": cut("qual")})
    known = sheet.select("barcode", "sample")
    small = check[0] <= 100_000
    return out.join(F.broadcast(known) if small else known, "barcode", "left").withColumn("sample", F.coalesce("sample", F.lit(NO_CODE)))


def demux_summary(assigned: DataFrame, sheet: DataFrame) -> DataFrame:
    """(sample, barcode, reads) for every sample of the sheet and NoCode, most reads first."""
    counts = assigned.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))
    all_ = sheet.select("sample", "barcode").unionByName(sheet.sparkSession.createDataFrame([(NO_CODE, None)], "sample string, barcode string"))
    return all_.join(counts, "sample", "left").select("sample", "barcode", F.coalesce("reads", F.lit(0)).cast("long").alias("reads")).orderBy(F.desc("reads"), "barcode")


def clump(reads: DataFrame, n_bins: int, key: str = "seq") -> DataFrame:
    """Reads dealt to bins by the hash of their minimizer and sorted within each; adds minimizer and bin.

    For pairs, give the read-1 column as `key`: both mates follow it. Sorting is by minimizer, bases, qualities, id."""
    prefix = key.rpartition(".")[0]
    col = lambda c: F.col(f"{prefix}.{c}" if prefix else c)
    out = reads.withColumn("minimizer", minimizer(col("seq")))
    out = out.withColumn("bin", E.fnv_bin(F.col("minimizer"), n_bins).cast("int"))
    return out.repartition(n_bins, "bin").sortWithinPartitions("bin", "minimizer", col("seq"), col("qual"), col("id"), "rec_idx")
