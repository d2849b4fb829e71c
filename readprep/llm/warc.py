"""WARC archives: writing with revisits, reading back, and an external merge of capture indexes.

Archives are WARC files of one gzip member a record in the shared folder. Reading yields one locally sorted run of
captures for each archive, with the offset and size of each record; the runs are merged k ways by (URL key, timestamp)
with a loser tree in every range of keys, which gives globally ordered capture histories.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, new_path, shuffle_parts, spread_join, table

LEAST_PAYLOAD = 100
FILE_BYTES = 32 << 20
FEED = 4096
RANGE = 100_000  # captures
EPOCH = 1_577_836_800  # 2020-01-01: pages carry no time, so capture k is dated k seconds later
CRLF = "\r\n"


def records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, html, payload_digest, record_type, refers_to); of equal payloads the smallest page_id is response.

    Short payloads need no join; a payload of very many pages is dealt out in chunks."""
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    body = body.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    long_, short = body.filter(F.col("payload_bytes") >= least), body.filter(F.col("payload_bytes") < least)
    first = long_.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = materialize(first, "warc-first")
    rows = spread_join(long_, first.drop("_n"), "payload_digest", first.select("payload_digest", "_n"))
    rows = rows.unionByName(short.withColumn("_first", F.lit(None).cast("long")))
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("page_id"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(rows: DataFrame, path: str, most: int = FILE_BYTES) -> None:
    """Write records as WARC/1.1 files of little more than `most` bytes, a gzip member for each record, so that a record can
    be read from its offset alone. A revisit holds no payload but its digest and the page that it refers to.

    Spark's own writer makes the files, so they may lie in any store that it reaches: a row is a file, and what ends a
    line of text is an empty gzip member.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
    ]
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("html"))

    def files(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for head, block in zip(batch.column("head"), batch.column("body"), strict=True):
                block = block.as_buffer().to_pybytes()
                held.append(member(f"{head.as_py()}{CRLF}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + b"\r\n\r\n"))
                size += len(held[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    packed = rows.select(F.concat_ws(CRLF, *lines).alias("head"), body.alias("body")).mapInArrow(files, "value binary")
    text = packed.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    text.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


def members(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(content, offset, size) of each gzip member that isn't empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts, upto = zlib.decompressobj(31), [], at
        while not z.eof:  # bit by bit, as what lies beyond the member's end is copied
            if upto >= len(view):
                raise ValueError(f"the gzip member at byte {at} has no end")
            parts.append(z.decompress(view[upto : upto + FEED]))
            upto = min(upto + FEED, len(view))
        size = upto - at - len(z.unused_data)
        if content := b"".join(parts):
            yield content, at, size
        at += size


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of each record of an uncompressed archive; a break in it raises ValueError."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split(CRLF) if head >= 0 else []
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = head + 4, int(h["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end after {n} bytes")
        yield h, data[start : start + n], at
        at = start + n + 4


def url_key(url: str) -> str:
    """Host labels from the last on, then path and query: a key that sorts a site's pages together."""
    try:
        p = urlsplit(url)
        host = (p.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    tail = (p.path or "/") + ("?" + p.query if p.query else "")
    return ",".join(reversed(host.split("."))) + ")" + tail.lower() if host else url.lower()


INDEX = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long, size long, run_place long"
_NUMBERS = {"page_id", "payload_bytes", "refers_to", "position", "size", "run_place"}
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(tail) if tail.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path: one locally sorted run for each archive. Payloads of responses are
    hashed again and held against their headers; a difference raises ValueError."""

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for data, at, size in members(content.as_buffer()):
                    for h, block, _ in parse(data):
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if h["warc-type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(h["x-payload-length"])):
                            raise ValueError(f"{name}, byte {at}: the payload isn't what its digest says")
                        rows.append((url_key(h["warc-target-uri"]), h["warc-date"], _page(h["warc-record-id"]), int(h["x-payload-length"]), digest, h["warc-type"], _page(h.get("warc-refers-to")), name, at, size))
                rows.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -(1 << 63), r[8]))
                rows = [(*r, k) for k, r in enumerate(rows)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in _NUMBERS else pa.string()) for n, c in zip(_NAMES, cols, strict=True)], names=_NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(runs, INDEX)


class LoserTree:
    """k-way merge: inner nodes hold the loser of the match below them, so each output costs log2(k) comparisons."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        self.heads = [r[0] if len(r) else None for r in runs] + [None] * (self.k - len(runs))
        self.tree = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            yield head
            r = self.winner
            self.at[r] += 1
            self.heads[r] = self.runs[r][self.at[r]] if self.at[r] < len(self.runs[r]) else None
            node = (r + self.k) >> 1
            while node:
                if self._beats(self.tree[node], r):
                    self.tree[node], r = r, self.tree[node]
                node >>= 1
            self.winner = r


RUN = ["url_key", "timestamp", "_page", "archive", "position"]


class Run:
    """A sorted run of captures: keys are read from its columns one by one, as the merge asks for them."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        self.columns, self.rows = [table.column(c) for c in RUN], rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple:
        return (*(c[int(self.rows[i])].as_py() for c in self.columns), int(self.rows[i]))


def merge(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """Globally ordered capture histories: index_position numbers the captures from 0 by (url_key, timestamp, page_id,
    archive, position), in which null page_ids come first.

    `captures` holds sorted runs, one per archive. They are cut at common bounds into ranges of about RANGE captures, and
    each task merges the runs' shares of a range by a loser tree: a range, not the index, is what a task holds. As the
    bounds are places in the whole order, captures of one URL, or without page_id, are split between ranges.
    """
    captures = materialize(captures, "warc-runs")
    dealt = captures.withColumn("_page", F.coalesce("page_id", F.lit(-(1 << 63))))
    n = ranges or max(shuffle_parts(captures), -(-captures.count() // RANGE))
    dealt = dealt.repartitionByRange(n, *RUN).withColumn("range_id", F.spark_partition_id())

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        name = np.asarray(t.column("archive").combine_chunks().dictionary_encode().indices)
        by = np.argsort(name, kind="stable")
        runs = []
        for rows in np.split(by, np.flatnonzero(np.diff(name[by])) + 1):
            # a shuffle brings an archive's rows in pieces, each in order: a piece is a run
            place = np.asarray(t.column("run_place"))[rows]
            runs += [Run(t, x) for x in np.split(rows, np.flatnonzero(np.diff(place) <= 0) + 1)]
        out = np.fromiter((x[-1] for x in LoserTree(runs)), np.int64, t.num_rows)
        t = t.take(pa.array(out)).drop_columns(["_page"]).append_column("ordinal", pa.array(np.arange(len(out))))
        yield from t.to_batches(max_chunksize=10_000)

    ordered = materialize(dealt.mapInArrow(merged, f"{INDEX}, range_id int, ordinal long"), "warc-index")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # a row is a range
    base = ordered.groupBy("range_id").agg(F.count(F.lit(1)).alias("_n")).select("range_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ordered.join(base, "range_id").withColumn("index_position", F.col("_base") + F.col("ordinal")).drop("range_id", "ordinal", "_base", "run_place")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives below path, read them back and merge their captures.

    Null html is an empty payload; payloads under 100 bytes are never revisits. Null page_ids stay null and are
    response; repeated rows of a page_id with equal payloads are all response. An empty table gives no rows.
    """
    write(records(pages), path)
    return merge(read(pages.sparkSession, path))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "index_position")
