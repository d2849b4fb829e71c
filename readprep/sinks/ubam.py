"""Unaligned BAM sink."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fastq import FormatError
from ..sources.ubam import BASES, _TO_N
from . import store
from .naming import make_folders

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SINGLE, FIRST, SECOND = 0x4, 0x4D, 0x8D
_HEX = str.maketrans({b: f"{i:x}" for i, b in enumerate(BASES)})
_QUALITY = bytes(max(i - 33, 0) for i in range(256))
ROW = 1 << 20


def bgzf(data: bytes, level: int = 1) -> bytes:
    """One BGZF block of at most 64 KiB of data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def header(source: str | None, program: str, version: str, command: str) -> str:
    """The source's header, or a minimal one, with a program line that follows the chain of the others."""
    text = source if source and source.strip() else "@HD\tVN:1.6\tSO:unsorted\n"
    text = text if text.endswith("\n") else text + "\n"
    ids = re.findall(r"^@PG\t(?:.*\t)?ID:([^\t\n]+)", text, re.M)
    used = set(re.findall(r"^@PG\t(?:.*\t)?PP:([^\t\n]+)", text, re.M))
    own, k = program, 1
    while own in ids:
        own, k = f"{program}.{k}", k + 1
    last = [i for i in ids if i not in used][-1:]
    return text + "\t".join(["@PG", f"ID:{own}", f"PN:{program}", f"VN:{version}", *[f"PP:{x}" for x in last], f"CL:{command}"]) + "\n"


def encode_tag(entry: str) -> bytes:
    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9]):([AZif]):(.*)", entry, re.S)
    if not m:
        raise FormatError(f"not a tag that can be written: {entry}")
    tag, kind, value = m[1].encode(), m[2], m[3]
    if kind == "A":
        if len(value) != 1:
            raise FormatError(f"not one character: {entry}")
        return tag + b"A" + value.encode()
    if kind == "i":
        n = int(value)
        return tag + (b"i" + struct.pack("<i", n) if -(1 << 31) <= n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return tag + b"f" + struct.pack("<f", float(value))
    return tag + b"Z" + value.encode() + b"\0"


def encode(read_id: str, seq: str, qual: str, flag: int) -> bytes:
    """One BAM record of an unaligned read; tags are taken back from the id's tail."""
    head, *tail = read_id.removeprefix("@").split("\t")
    name = head.split()[0].encode() if head.split() else b"*"
    if len(name) > 254:
        raise FormatError(f"the name is too long: {head}")
    bases = seq.upper().translate(_TO_N)
    if set(bases) - set("ACGTN"):
        raise FormatError(f"not a BAM sequence: {seq}")
    packed = bytes.fromhex(bases.translate(_HEX) + "0" * (len(bases) % 2))
    raw = qual.encode("ascii").translate(_QUALITY)
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 4680, 0, flag, len(seq), -1, -1, 0)
    body += name + b"\0" + packed + raw + b"".join(map(encode_tag, tail))
    return struct.pack("<i", len(body)) + body


def header_block(head: str, level: int = 1) -> bytes:
    text = head.encode()
    return bgzf_all(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0), level)


def bgzf_all(data: bytes, level: int = 1) -> bytes:
    return b"".join(bgzf(data[at : at + 0xFF00], level) for at in range(0, len(data), 0xFF00))


def file_bytes(head: str, rows: Iterable[tuple[str, str, str, int]], level: int = 1) -> Iterator[bytes]:
    """A whole file: the header, blocks of records, the end mark."""
    yield header_block(head, level)
    yield bgzf_all(b"".join(encode(*r) for r in rows), level)
    yield EOF


def write_ubam(df: DataFrame, path: str, head: str, level: int = 1) -> str:
    """Reads (rec_idx, id, seq, qual) as BAM, in order."""
    return _write(df.select("rec_idx", "id", "seq", "qual", F.lit(SINGLE).alias("flag")).orderBy("rec_idx"), path, head, level)


def write_ubam_pairs(df: DataFrame, path: str, head: str, level: int = 1) -> str:
    """Pairs (rec_idx, r1, r2) as interleaved BAM: read 1, read 2, read 1, ..."""
    side = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(r).alias("r")) for r, f in (("r1", FIRST), ("r2", SECOND))])).alias("s")
    rows = df.select("rec_idx", side).select("rec_idx", "s.r.id", "s.r.seq", "s.r.qual", "s.flag")
    return _write(rows.orderBy("rec_idx", "flag"), path, head, level)


def _write(rows: DataFrame, path: str, head: str, level: int) -> str:
    """Tasks encode and compress. A path that names its store becomes a folder of parts, each a BAM file; a local one a file."""
    own = store.is_uri(path)
    block = header_block(head, level)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = bytearray(), block if own else b""
        for batch in it:
            for r in zip(*[batch.column(c).to_pylist() for c in ("id", "seq", "qual", "flag")], strict=True):
                held += encode(*r)
                if len(held) >= ROW:
                    yield row(first + bgzf_all(bytes(held), level))
                    held, first = bytearray(), b""
        if held or first:
            yield row(first + bgzf_all(bytes(held), level))

    def row(data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    made = rows.select("id", "seq", "qual", "flag").mapInArrow(blocks, "data binary")
    if own:
        store.write_bytes(made, path, EOF)  # an empty block follows each row, at the end as the format wants it
        return path
    make_folders([path])
    folder = store.parts_of(path)
    store.write_bytes(made, folder, EOF)
    empty = made.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").isEmpty()
    return store.join_parts(made.sparkSession, folder, path, block + EOF * empty)
