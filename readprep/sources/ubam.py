"""Unaligned BAM as a Spark data source: spark.read.format("ubam").load(path)."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fastq import BATCH, FormatError

BASES = "=ACMGRSVTWYHKDBN"
_TO_N = str.maketrans("RYMKSWBDHV", "N" * 10)
_TWO = [a + b for a in BASES for b in BASES]
_SHOWN = bytes(min(i, 93) + 33 for i in range(256))
_INT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def read_header(f) -> tuple[str, int]:
    """The SAM header text and the number of reference sequences, which are skipped."""
    if f.read(4) != b"BAM\x01":
        raise FormatError("not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode()
    (n,) = struct.unpack("<i", f.read(4))
    for _ in range(n):
        f.read(struct.unpack("<i", f.read(4))[0] + 4)
    return text, n


def peek_header(path: str) -> str:
    with gzip.open(path) as f:
        return read_header(f)[0]


def parse_tags(data: bytes) -> dict[str, tuple[str, str]]:
    """Tag -> (type, value); integers of any width are i. Arrays and hex strings raise when asked for."""
    out, at = {}, 0
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[tag], at = ("A", chr(data[at])), at + 1
        elif kind in _INT:
            n = struct.calcsize(_INT[kind])
            out[tag], at = ("i", str(struct.unpack(_INT[kind], data[at : at + n])[0])), at + n
        elif kind == "f":
            out[tag], at = ("f", f"{struct.unpack('<f', data[at : at + 4])[0]:g}"), at + 4
        elif kind in "ZH":
            end = data.index(0, at)
            out[tag], at = (kind, data[at:end].decode()), end + 1
        elif kind == "B":
            n = struct.calcsize(_INT.get(chr(data[at]), "<f")) * struct.unpack("<i", data[at + 1 : at + 5])[0]
            out[tag], at = ("B", ""), at + 5 + n
        else:
            raise FormatError(f"tag {tag} has the unknown type {kind}")
    return out


def records(path: str, keep: tuple[str, ...] = (), content: bytes | None = None) -> Iterator[tuple[int, str, str, str]]:
    """(flag, id, seq, qual) of each record of a file, or of its content, checked to be an unaligned primary read."""
    with gzip.open(path if content is None else io.BytesIO(content)) as f:
        read_header(f)
        n = 0
        while head := f.read(4):
            if len(head) < 4:
                raise FormatError(f"{path}: record {n + 1} is truncated")
            (size,) = struct.unpack("<i", head)
            body = f.read(size)
            if len(body) < size:
                raise FormatError(f"{path}: record {n + 1} is truncated")
            n += 1
            where = f"{path}: record {n}"
            l_name, n_cigar, flag, l_seq = struct.unpack("<B", body[8:9])[0], *struct.unpack("<HHi", body[12:20])
            if not flag & 0x4:
                raise FormatError(f"{where} is aligned")
            if flag & (0x10 | 0x100 | 0x800):
                raise FormatError(f"{where} is a reverse, secondary or supplementary record")
            at = 32 + l_name
            name = body[32 : at - 1].decode()
            at += 4 * n_cigar
            packed = body[at : at + (l_seq + 1) // 2]
            at += (l_seq + 1) // 2
            if not name or name == "*" or not l_seq:
                raise FormatError(f"{where} has no name or no bases")
            seq = "".join(map(_TWO.__getitem__, packed))[:l_seq]
            if "=" in seq:
                raise FormatError(f"{where} has '=' for a base")
            raw = body[at : at + l_seq]
            qual = "!" * l_seq if raw == b"\xff" * l_seq else raw.translate(_SHOWN).decode("ascii")
            tail = ""
            if keep:
                tags = parse_tags(body[at + l_seq :])
                for tag in keep:
                    if tag in tags:
                        if tags[tag][0] in "BH":
                            raise FormatError(f"{where}: tag {tag} of type {tags[tag][0]} can't be kept")
                        tail += f"\t{tag}:{tags[tag][0]}:{tags[tag][1]}"
            yield flag, f"@{name}{tail}", seq.translate(_TO_N), qual


@dataclass
class Part(InputPartition):
    path: str
    file_id: int


class UbamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.keep = tuple(t for t in options.get("tags", "").split(",") if t)

    def partitions(self) -> list[Part]:
        return [Part(p, i) for i, p in enumerate(self.paths)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rec in records(part.path, self.keep):
            held.append(rec)
            if len(held) == BATCH:
                yield self._batch(held, part, n)
                n, held = n + len(held), []
        if held:
            yield self._batch(held, part, n)

    @staticmethod
    def _batch(held: list, part: Part, first: int) -> pa.RecordBatch:
        n = len(held)
        flag, *text = zip(*held, strict=True)
        cols = [pa.array([part.file_id] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(flag, pa.int32()), *map(pa.array, text)]
        return pa.RecordBatch.from_arrays(cols, names=["file_id", "rec_idx", "flag", "id", "seq", "qual"])


class UbamSource(DataSource):
    """Options: path, tags (comma-separated tags to keep behind the id, in this order)."""

    @classmethod
    def name(cls) -> str:
        return "ubam"

    def schema(self) -> str:
        return "file_id int, rec_idx long, flag int, id string, seq string, qual string"

    def reader(self, schema) -> UbamReader:
        return UbamReader(dict(self.options))


def read_ubam(spark: SparkSession, *paths: str, tags: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(UbamSource)
    return spark.read.format("ubam").option("tags", ",".join(tags)).load(",".join(paths))


def read_ubam_store(spark: SparkSession, path: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """(rec_idx, flag, id, seq, qual) of a BAM file, or of a folder of parts, in any store that Spark reads; a task reads a
    part. rec_idx goes on from part to part, in the order of their names; the counts are a row for each part."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held = []
                for k, rec in enumerate(records(name, tags, content.as_py())):
                    held.append((name, k, *rec))
                    if len(held) == BATCH:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["file", "place", "flag", "id", "seq", "qual"])

    rows = files.mapInArrow(run, "file string, place long, flag int, id string, seq string, qual string")
    base, bases = 0, []
    for name, n in sorted((r[0], r[1]) for r in rows.groupBy("file").agg(F.count(F.lit(1))).collect()):
        bases.append((name, base))
        base += n
    shared = spark.createDataFrame(bases, "file string, base long")
    return rows.join(F.broadcast(shared), "file").select((F.col("base") + F.col("place")).alias("rec_idx"), "flag", "id", "seq", "qual")


def read_ubam_sides(spark: SparkSession, path: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """Adds side (1 or 2) by flags 0x40 and 0x80, of which exactly one must be set."""
    bits = F.col("flag").bitwiseAND(0xC0)
    side = F.when(bits == 0x40, 1).when(bits == 0x80, 2).otherwise(F.raise_error(F.concat(F.lit("neither or both mates: "), F.col("id"))))
    reads = read_ubam_store(spark, path, tags) if "://" in path else read_ubam(spark, path, tags=tags)
    return reads.withColumn("side", side)
