"""Files in whatever store Spark reaches: text, parts joined into one file, rows of bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def is_uri(path: str) -> bool:
    """A path that names its store. Outputs there are folders of parts; local ones are single files."""
    return "://" in path


def uri(path: str) -> str:
    return path if is_uri(path) else f"file://{os.path.abspath(path)}"


@contextmanager
def _stored(spark: SparkSession, path: str) -> Iterator[tuple]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    yield jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{uri(base or tempfile.mkdtemp(prefix='readprep-')).rstrip('/')}/readprep/{name}-{uuid.uuid4().hex}"


def head(spark: SparkSession, path: str, n: int = 1 << 16) -> bytes:
    """The first bytes of a stored file, or of the first part of a folder."""
    with _stored(spark, path) as (_, p, fs):
        if fs.getFileStatus(p).isDirectory():
            parts = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
            if not parts:
                return b""
            p = parts[0].getPath()
        stream = fs.open(p)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    with _stored(spark, uri(path)) as (_, p, fs):
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def write_bytes(df: DataFrame, folder: str, end: bytes) -> None:
    """Write the rows of a binary column as parts, by Spark's own writer: `end`, which must mean nothing, follows each row."""
    rows = df.select(df[0].cast("string").alias("value")).write.mode("overwrite")
    rows.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(folder)


def join_parts(spark: SparkSession, folder: str, path: str, first: bytes = b"") -> str:
    """Put a folder's parts together, in the order of their names, as one file, without their bytes reaching Python."""
    with _stored(spark, folder) as (jvm, source, fs), _stored(spark, uri(path)) as (_, target, to):
        out = to.create(target, True)
        try:
            if first:
                out.write(bytearray(first))
            for name in sorted(s.getPath().getName() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
        fs.delete(source, True)
        checksum = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.crc")
        to.delete(checksum, False)
    return path


def parts_of(path: str) -> str:
    return f"{uri(path)}.parts-{uuid.uuid4().hex}"
