"""Small text inputs: sample sheets and adapter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..options import parse_fasta
from .fastq import FormatError


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(sample, barcode) of a tab-separated sheet: CRLF and blank lines are fine; barcodes are of one length, of
    A, C, G, T and N, and distinct."""
    with open(path, newline="") as f:
        rows = [x.rstrip("\r\n").split("\t") for x in f if x.strip()]
    if not rows:
        raise FormatError(f"{path} holds no sample")
    out = []
    for r in rows:
        if len(r) < 2 or not r[0].strip() or not r[1].strip() or set(r[1].strip().upper()) - set("ACGTN"):
            raise FormatError(f"{path}: not a sample and a barcode: {r}")
        out.append((r[0].strip(), r[1].strip().upper()))
    codes = [b for _, b in out]
    if len({len(b) for b in codes}) > 1 or len(set(codes)) < len(codes):
        raise FormatError(f"{path}: barcodes differ in length or repeat")
    return spark.createDataFrame(out, "sample string, barcode string")


def read_adapters(spark: SparkSession, path: str) -> DataFrame:
    with open(path) as f:
        rows = [(i, n, s) for i, (n, s) in enumerate(parse_fasta(f.read()))]
    return spark.createDataFrame(rows, "idx int, name string, seq string")
