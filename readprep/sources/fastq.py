"""FASTQ as a Spark data source: spark.read.format("fastq").load(paths).

Plain files are split at record boundaries, so a large one is read by many tasks; compressed ones are one partition
each (gzip can't be split), several members included. Content, not the name, says whether a file is compressed.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


SPLIT = 64 << 20
BATCH = 8192
_LINES = ("id", "sequence", "separator", "quality")


class FormatError(ValueError):
    """A file that isn't what it is read as; the message names the file and the place."""


def open_any(path: str) -> io.BufferedIOBase:
    f = open(path, "rb")
    if f.peek(2)[:2] == b"\x1f\x8b":
        return gzip.open(f)
    return f


def detect_format(path: str) -> str:
    """fastq, fastq.gz or bam by content; anything else and an empty file raise."""
    with open(path, "rb") as f:
        return format_of(path, f.read(1 << 16))


def format_of(path: str, data: bytes) -> str:
    """As detect_format, from the first bytes of a file."""
    if not data:
        raise FormatError(f"{path} is empty")
    if data[:1] == b"@":
        return "fastq"
    if data[:3] == b"\x1f\x8b\x08":
        return "bam" if zlib.decompressobj(31).decompress(data, 4) == b"BAM\x01" else "fastq.gz"
    raise FormatError(f"{path} is neither FASTQ nor BAM")


def parse(lines: Iterator[bytes], name: str = "input", first: int = 0) -> Iterator[tuple[str, str, str]]:
    """(id, seq, qual) of each record; an end within a record, or lengths that differ, raise FormatError."""
    n = first
    for line in lines:
        rec = [line]
        for _ in range(3):
            rec.append(next(lines, None))
        if None in rec:
            missing = _LINES[rec.index(None)]
            raise FormatError(f"{name}: record {n + 1} is truncated, its {missing} line is missing")
        a, s, _, q = (x.rstrip(b"\r\n").decode("ascii") for x in rec)
        if len(s) != len(q):
            raise FormatError(f"{name}: record {n + 1} has {len(s)} bases and {len(q)} qualities")
        yield a, s, q
        n += 1


def sanity_check(path: str) -> None:
    """The first record: there is one, its id starts with @, its bases hold no digit (colour space)."""
    with open_any(path) as f:
        check_first(path, f)


def check_first(path: str, lines: Iterable[bytes]) -> None:
    """As sanity_check, from the first lines of a file."""
    first = next(parse(iter(lines), path), None)
    if first is None:
        raise FormatError(f"{path} is empty")
    if not first[0].startswith("@"):
        raise FormatError(f"{path}: the first record doesn't start with '@'")
    if any(c.isdigit() for c in first[1]):
        raise FormatError(f"{path} looks like colour space data, which can't be processed")


@dataclass
class Part(InputPartition):
    path: str
    file_id: int
    start: int
    stop: int  # -1: the whole file


def _is_start(lines: list[bytes], k: int) -> bool:
    return lines[k][:1] == b"@" and lines[k + 2][:1] == b"+" and len(lines[k + 1].rstrip(b"\r\n")) == len(lines[k + 3].rstrip(b"\r\n"))


def record_start(f: io.BufferedIOBase, at: int) -> int:
    """The first record that starts at or after byte `at`: @ may be a quality, so three records in a row must fit."""
    if at == 0:
        return 0
    f.seek(at - 1)
    f.readline()  # to the next line
    base = f.tell()
    lines, places, here = [], [], base
    for _ in range(16):
        line = f.readline()
        if not line:
            break
        lines.append(line)
        places.append(here)
        here += len(line)
    for k in range(min(4, len(lines))):
        group = range(k, len(lines) - 3, 4)
        if len(group) and all(_is_start(lines, g) for g in group):
            return places[k]
    return here if len(lines) < 16 else base


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options.get("path", "")
        self.paths = sorted(p for part in path.split(",") if part for p in (glob.glob(part) or [part]))
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def partitions(self) -> list[Part]:
        out = []
        for i, p in enumerate(self.paths):
            size = os.path.getsize(p)
            with open(p, "rb") as f:
                if f.read(2) == b"\x1f\x8b" or size <= self.split:
                    out.append(Part(p, i, 0, -1))
                    continue
                cuts = sorted({record_start(f, at) for at in range(0, size, self.split)} | {size})
            out += [Part(p, i, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with open_any(part.path) as f:
            lines = iter(f)
            if part.stop >= 0:
                f.seek(part.start)
                lines = self._until(f, part.stop)
            held: list[tuple[str, str, str]] = []
            n = 0
            for rec in parse(lines, part.path):
                held.append(rec)
                if len(held) == BATCH:
                    yield self._batch(held, part, n)
                    n, held = n + len(held), []
            if held:
                yield self._batch(held, part, n)

    @staticmethod
    def _until(f: io.BufferedIOBase, stop: int) -> Iterator[bytes]:
        while f.tell() < stop:
            yield f.readline()

    @staticmethod
    def _batch(held: list[tuple[str, str, str]], part: Part, first: int) -> pa.RecordBatch:
        n = len(held)
        cols = [pa.array([part.file_id] * n, pa.int32()), pa.array([(part.start << 0)] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())]
        cols += [pa.array(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["file_id", "part_start", "rec_in_part", "id", "seq", "qual"])


class FastqSource(DataSource):
    """Options: path (comma-separated, globs allowed), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file_id int, part_start long, rec_in_part long, id string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """(file_id, rec_idx, id, seq, qual): rec_idx numbers the records of a file from 0, whatever the splits.

    A file of one split needs no further pass; else the records of each split are counted first."""
    spark.dataSource.register(FastqSource)
    reader = FastqReader({"path": ",".join(paths), "splitBytes": str(split)})
    raw = spark.read.format("fastq").option("splitBytes", split).load(",".join(paths))
    parts = reader.partitions()
    if len(parts) == len({p.file_id for p in parts}):
        return raw.select("file_id", F.col("rec_in_part").alias("rec_idx"), "id", "seq", "qual")
    counts = sorted((r["file_id"], r["part_start"], r["n"]) for r in raw.groupBy("file_id", "part_start").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each split
    base, rows, last = 0, [], None
    for f, start, n in counts:
        base = base if f == last else 0
        rows.append((f, start, base))
        base, last = base + n, f
    bases = spark.createDataFrame(rows, "file_id int, part_start long, base long")
    out = raw.join(F.broadcast(bases), ["file_id", "part_start"])  # a row for each split of SPLIT bytes
    return out.select("file_id", (F.col("base") + F.col("rec_in_part")).alias("rec_idx"), "id", "seq", "qual")


def read_fastq_store(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, rec_idx, id, seq, qual) of FASTQ files in any store that Spark can read, large ones by many tasks.

    Spark's text source splits files at lines, not at records. Lines of each split are counted first, which numbers
    them all; records that lie in one split are put together there, and only the few that two splits share are
    shuffled. The counts are a row for each split."""
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], int] = {}
        for batch in it:
            t = pa.Table.from_batches([batch]).group_by(["file", "block"]).aggregate([([], "count_all")])
            for f, b, n in zip(*[t.column(c).to_pylist() for c in ("file", "block", "count_all")], strict=True):
                found[f, b] = found.get((f, b), 0) + n
        cols = list(zip(*[(f, b, n) for (f, b), n in found.items()], strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "block", "n"])

    counts = raw.select("file", "block").mapInArrow(count, "file string, block long, n long").groupBy("file", "block").agg(F.sum("n").alias("n")).collect()
    first: dict[tuple[str, int], int] = {}
    total: dict[str, int] = {}
    for f, b, n in sorted(map(tuple, counts)):
        first[f, b] = total.get(f, 0)
        total[f] = total.get(f, 0) + n
    for f, n in total.items():
        if n % 4:
            raise FormatError(f"{f}: record {n // 4 + 1} is truncated, its {_LINES[n % 4]} line is missing")
    shared = spark.sparkContext.broadcast(first)

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records (part 0: id, sequence, quality joined by line feeds), and single lines of the others."""
        at: dict[tuple[str, int], int] = {}
        held: list[tuple[str, int, int, str]] = []

        def out(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "record", "part", "text"])

        for batch in it:
            rows: list[tuple[str, int, int, str]] = []
            for f, b, text in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "text")], strict=True):
                line = at.setdefault((f, b), shared.value[f, b])
                at[f, b] = line + 1
                if held and (held[0][0], held[0][1]) != (f, line // 4):
                    rows, held = rows + held, []
                held.append((f, line // 4, line % 4 + 1, text.rstrip("\r")))
                if len(held) == 4:
                    rows.append((f, line // 4, 0, "\n".join((held[0][3], held[1][3], held[3][3]))))
                    held = []
            yield out(rows)
        if held:
            yield out(held)

    made = raw.mapInArrow(join, "file string, record long, part int, text string")
    whole = made.filter("part = 0").select("file", "record", "text")
    lines = made.filter("part > 0").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    split = lines.select("file", "record", F.concat_ws("\n", F.col("x.text")[0], F.col("x.text")[1], F.col("x.text")[3]).alias("text"))
    x = F.split("text", "\n")
    out = whole.unionByName(split).select("file", F.col("record").alias("rec_idx"), x[0].alias("id"), x[1].alias("seq"), x[2].alias("qual"))
    fits = F.length("seq") == F.length("qual")
    return out.withColumn("qual", F.when(fits, F.col("qual")).otherwise(F.raise_error(F.concat(F.lit("bases and qualities differ in length: "), F.col("id")))))
