"""Helpers shared by the corpus operators: shared-folder tables, bounded ranking, hashing of words, connected components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
PARTS = 1024  # salted parts of a key whose rows are numbered; fixed, so that numbers don't depend on the session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only a local master may leave it unset; then one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="readprep-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage is cut and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: dict[str, list[str]] = {}
_owner: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which `clear` of the present owner deletes."""
    path = f"{shared_dir(spark)}/readprep/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(_owner.get(), []).append(path)
    return path


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Whatever is written in this block belongs to `owner`."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def clear(spark: SparkSession, owner: str = "") -> None:
    """Delete what was written for `owner` (default: outside any `owned` block); only where no result that reads it is still needed."""
    for path in _made.pop(owner, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shuffle_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def part_of(salt: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int")


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], out: str, parts: DataFrame) -> DataFrame:
    """Number the rows of each key from 0 without gathering a key in one task.

    `df` has a column _part that deals a key's rows to salted parts; `parts` has (*keys, _part, _n, ...): the rows of
    each. Rows are numbered within their part by `order` and shifted by the rows of the key's earlier parts. Further
    columns of `parts` are joined to the rows. Keys must not be null. One shuffle of `df`; `parts` grows with it and is
    never broadcast, however well its file compresses.
    """
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    return local.join(base.hint("merge"), [*keys, "_part"]).withColumn(out, (F.col("_base") + F.col("_local")).cast("long")).drop("_part", "_base", "_local")


HOT_ROWS = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "left") -> DataFrame:
    """`left` (read from files) joined by `key` to `right`, which has one row a key, without gathering a key's rows.

    `counts` has (key, _n), the rows of left by key, as a written table. A key with more than HOT_ROWS rows and more than a
    thousandth of all (so at most a thousand keys, which are broadcast) is dealt out in chunks, and its right row with it.
    """
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(HOT_ROWS, -(-total // 1000))
    hot = F.broadcast(counts.filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).alias("_chunks")))
    chunks = F.coalesce("_chunks", F.lit(1))
    numbered = left.withColumn("_place", F.monotonically_increasing_id())
    salted = numbered.join(hot, key, "left").withColumn("_salt", F.pmod("_place", chunks)).drop("_place", "_chunks")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).drop("_chunks")
    return salted.join(copied.hint("merge"), [key, "_salt"], how).drop("_salt")


# ------------------------------------------------------------------ words of an Arrow column of texts

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], "<i8", n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
POWERS = 4 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; up to POWERS of them are kept for the next batch."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        out = np.ones(max(n, min(2 * n, POWERS)), np.uint64)
        out[1:] = base
        kept = np.multiply.accumulate(out)
        if len(kept) <= POWERS:
            _POWERS[int(base)] = kept
    return kept[:n]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash64) of every word of every row; a word is a run of other than 0x20 and 0x09-0x0D."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = solid[cut]
    start = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_B, n), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_B_INV, n)[start]
    return start, end, row, mix64(h ^ (end - start).astype(np.uint64) * _M3)


def batches_of(it, most_bytes: int = 2 << 20, column: str = "text"):
    """Arrow batches, cut further so that one holds little more than `most_bytes` of the text column or one row."""
    for batch in it:
        n, size = batch.num_rows, batch.column(column).nbytes
        step = max(1, n * most_bytes // max(size, 1))
        for at in range(0, n, step):
            yield batch.slice(at, step)


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give the memory that this process holds but doesn't use back to the system: cached powers, Arrow's pool, free pages of the heap."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def released(kernel: Kernel) -> Kernel:
    """An Arrow kernel after whose task the worker is as small as before it. Workers are kept for later tasks, and for a
    minute when idle; else each holds on to what its largest task took, beside the heap of the executor."""

    @functools.wraps(kernel)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(it)
        finally:
            release()

    return run


# ------------------------------------------------------------------ connected components


def fingerprint(rows: DataFrame, *columns: str) -> tuple:
    """Count and 128 bits that tell sets of distinct rows apart; exclusive ors don't overflow, whatever the number of rows."""
    return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*columns)), F.bit_xor(F.xxhash64(F.lit(1), *columns))).first())


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) of every vertex of `edges` (a, b long, not null): component is its smallest reachable id.

    Labels start at the smallest neighbour and are joined to the graph of (vertex, label) again and again: large-star
    and small-star in turn, until no edge changes. Every round is written to the shared folder. A hub's edges are
    aggregated on the map side, and no neighbour list is ever gathered. Empty edges give an empty table.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), tag)
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v"), F.col("m"))
        e1 = large.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = e1.groupBy("b").agg(F.min("a").alias("m"))
        small = e1.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("s")).select("s.a", "s.b")
        e = materialize(small.filter("a <> b").distinct(), tag)
        now = fingerprint(e, "a", "b")
        if now == seen:
            break
        seen = now
    star = e.groupBy("b").agg(F.min("a").alias("component"))
    return materialize(star.select(F.col("b").alias("id"), "component").unionByName(star.select(F.col("component").alias("id"), "component").distinct()), tag)

