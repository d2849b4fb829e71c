"""What a run finds out from the data before it is planned: the adapter and poly-G tails. One small aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import trailing_poly_g
from ..options import PRESETS, PROBED, SCAN_CAP, Adapters, Options, TrimConfig

SUPPRESSED_NAME = "none (input is trimmed already)"


@dataclass(frozen=True)
class Detection:
    adapters: Adapters
    adapters_r2: Adapters
    counts: dict[str, int]
    reads_scanned: int
    poly_g: int
    suppressed: bool
    message: str


def probe(reads: DataFrame, cap: int = SCAN_CAP) -> DataFrame:
    """One row: reads_scanned, a count of reads that hold each probed adapter, poly_g.

    The read that reaches the cap is counted and not looked at. rec_idx numbers reads from 0."""
    seen = F.col("rec_idx") < cap - 1
    found = [F.count(F.when(seen & F.contains("seq", F.lit(PRESETS[p][1])), 1)).alias(p) for p in PROBED]
    scan = reads.select("rec_idx", "seq").filter(F.col("rec_idx") < cap)
    return scan.agg(F.count(F.lit(1)).alias("reads_scanned"), *found, F.count(F.when(seen & trailing_poly_g(F.col("seq")), 1)).alias("poly_g"))


def poly_g_scan(reads: DataFrame, cap: int = SCAN_CAP) -> DataFrame:
    """The scan for poly-G alone; the last read counts here."""
    scan = reads.select("rec_idx", "seq").filter(F.col("rec_idx") < cap)
    return scan.agg(F.count(F.lit(1)).alias("reads_scanned"), F.count(F.when(trailing_poly_g(F.col("seq")), 1)).alias("poly_g"))


def ranking(probed: DataFrame) -> DataFrame:
    """(adapter, hits, place) of the probed adapters: most hits first, ties in probing order."""
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(PRESETS[p][0]).alias("adapter"), F.col(p).alias("hits")) for i, p in enumerate(PROBED)])
    order = F.array_sort(names, lambda a, b: F.when(a["hits"] != b["hits"], F.when(a["hits"] > b["hits"], -1).otherwise(1)).otherwise(a["i"] - b["i"]))
    out = probed.select(F.posexplode(order).alias("place", "x"))
    return out.select("x.adapter", "x.hits", (F.col("place") + 1).cast("int").alias("place"))


def wants_poly_g(count: int, scanned: int) -> bool:
    return count > max(scanned // 10_000, 10)


def detect(reads: DataFrame, consider_already_trimmed: int | None = None, cap: int = SCAN_CAP) -> Detection:
    x = probe(reads, cap).first()
    order = sorted(PROBED, key=lambda p: -x[p])
    best, second = order[0], order[1]
    counts, scanned = {PRESETS[p][0]: x[p] for p in PROBED}, x["reads_scanned"]
    if consider_already_trimmed is not None and x[best] <= consider_already_trimmed:
        return Detection(((SUPPRESSED_NAME, ""),), (), counts, scanned, x["poly_g"], True, f"Every probed adapter was seen at most {consider_already_trimmed} times, so the input counts as trimmed: adapters are left alone, low quality ends go.")
    name, seq, other = PRESETS[best]
    text = f"{name} occurs in {x[best]} of {scanned} reads looked at, {PRESETS[second][0]}, the next, in {x[second]}: trimming {name}."
    if not x[best]:
        text = f"None of the probed adapters occurs in the {scanned} reads looked at: trimming {name}."
    return Detection(((name, seq),), (((f"{name}_r2", other),) if other else ()), counts, scanned, x["poly_g"], False, text)


def resolve(options: Options, reads: DataFrame, cap: int = SCAN_CAP) -> tuple[TrimConfig, str]:
    """The configuration for one file or pair, given its (first) reads, and a note on how it came about.

    This is the only eager step of a run; everything after it is one lazy plan."""
    given = options.user_adapters()
    if given is None:
        d = detect(reads, options.consider_already_trimmed, cap)
        first, second, note, g, n = d.adapters, d.adapters_r2, d.message, d.poly_g, d.reads_scanned
    else:
        (first, second), note, g, n = given, "Adapters as given.", 0, 0
        if not (options.poly_g or options.no_poly_g):
            x = poly_g_scan(reads, cap).first()
            g, n = x["poly_g"], x["reads_scanned"]
    if options.adapter2 and not options.adapter:
        note += " A read 2 adapter is ignored without one for read 1."
    poly_g = options.poly_g or (not options.no_poly_g and wants_poly_g(g, n))
    return options.config(first, second, poly_g), note
