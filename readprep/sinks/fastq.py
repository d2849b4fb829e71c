"""FASTQ sink: ordered parts written by Spark, each gzip part a member of its own, so that parts joined are a file.

Paths that name their store become folders of parts; local paths become single files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .naming import make_folders

LEVELS = dict(enumerate(["BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION"], 1))


def fastq_text(read: Column | str) -> Column:
    c = (lambda x: F.col(x)) if read == "" else (lambda x: F.col(f"{read}.{x}"))
    return F.concat_ws("\n", c("id"), c("seq"), F.lit("+"), c("qual")).alias("value")


def _write(rows: DataFrame, folder: str, gzip: bool, level: int) -> None:
    """The level is an option of this write alone."""
    rows.write.mode("overwrite").option("compression", "gzip" if gzip else "none").option("zlib.compress.level", LEVELS[level]).text(folder)


def write_parts(df: DataFrame, folder: str, read: str = "", order: str = "rec_idx", gzip: bool = True, level: int = 1) -> None:
    """A folder of FASTQ parts whose names follow `order`."""
    _write(df.select(F.col(order).alias("_order"), fastq_text(read)).orderBy("_order").select("value"), folder, gzip, level)


def write_fastq(df: DataFrame, path: str, read: str = "", order: str = "rec_idx", gzip: bool = True, level: int = 1) -> str:
    """The reads (id, seq, qual) of column `read` ('' for top level), in order."""
    if store.is_uri(path):
        write_parts(df, path, read, order, gzip, level)
        return path
    make_folders([path])
    folder = store.parts_of(path)
    write_parts(df, folder, read, order, gzip, level)
    return store.join_parts(df.sparkSession, folder, path)


def write_clumped(df: DataFrame, path: str, read: str = "", level: int = 1) -> str:
    """Reads as they lie, always gzip: each bin of operators.modes.clump is a member."""
    rows = df.select(fastq_text(read))
    if store.is_uri(path):
        _write(rows, path, True, level)
        return path
    make_folders([path])
    folder = store.parts_of(path)
    _write(rows, folder, True, level)
    return store.join_parts(df.sparkSession, folder, path)
