"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(slot | class, context) * P(token | class, slot). The class of a token is a
hash of its last two bytes. In a class, the most frequent tokens have slots of their own, all others share a few by hash.
Classes are log-linear in hashed features of the context: the word before, the two words before as one, and the word two
before (a skip); slots in the word before together with the class. Only tokens that share a slot are told apart by
smoothed counts, whatever the context.

Training takes two distributed rounds over all training texts. The first counts features with classes and slots, which
starts the weights. The second sums the expectations under these weights, and with them the gradient, and takes one step
scaled by its curvature. A slot's distribution depends on its feature row and class alone, so the first round counts these
pairs and the slots' expectations follow from their counts, a distribution a pair in place of one a token. All that
tasks add up are integers, so scores don't depend on splits, order or reruns.

Feature rows grow with the vocabulary, from 2^14 to MAX_ROWS, which bounds what is broadcast. Counts of words are exact.
Words of at least 1 in FREQUENT training tokens are at most FREQUENT many and are broadcast with their counts; the
others meet theirs in a join by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, materialize, mix64, shuffle_parts, table, text_bytes, words_of
from .quality import remainder

CLASSES = 32
SLOTS = 32
OWN = 24  # slots of a class that hold one token each
MAX_ROWS = 1 << 17
TEXT = 256 << 10  # bytes of text at once: what follows from them stays in the caches
BATCH = 8192
START = 0.5  # share of the counts' log odds in the first weights: features overlap
PRIOR = 30.0
STEP = 0.5
LIMIT = 10.0  # of a weight, so that exponentials of sums of three stay finite
FREQUENT = 1 << 21
SCALE = float(1 << 12)
MOST = (1 << 31) // int(SCALE) - 1  # tokens
BLOCK_ROWS = 1024
FAN = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.uint64(CLASSES - 1)
END = np.uint64(0x5851F42D4C957F2D) & ~_MASK  # the end token: class 0
_START = np.uint64(0x14057B7EF767814F)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of every token, the end of each text included; the low bits of an id are its class."""
    raw, offsets = text_bytes(texts)
    raw = _LOWER[raw]
    n = len(offsets) - 1
    start, end, row, h = words_of(raw, offsets)
    if len(start):
        tail = raw[end - 1].astype(np.uint64) * np.uint64(256) + raw[np.maximum(end - 2, start)]
        h = (h & ~_MASK) | (mix64(tail + np.uint64(1)) & _MASK)
    at = np.cumsum(np.bincount(row, minlength=n)) if n else np.zeros(0, np.int64)
    return np.insert(row, at, np.arange(n)), np.insert(h, at, np.full(n, END))


def contexts(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The context of each token: the word before, the two before as one, the word two before."""
    n, back = len(ids), []
    for k in (1, 2):
        p = np.full(n, _START)
        p[k:] = np.where(row[k:] == row[:-k], ids[:-k], _START) if n > k else p[k:]
        back.append(p)
    return np.stack([back[0], mix64(back[0] * np.uint64(3) + np.uint64(1)) ^ back[1], back[1]])


def class_rows(ctx: np.ndarray, rows: int) -> list[np.ndarray]:
    """The feature rows of each token's class."""
    return [(mix64(x * np.uint64(2 * k + 3) + np.uint64(k)) & np.uint64(rows - 1)).astype(np.int64) for k, x in enumerate(ctx)]


def slot_rows(ctx: np.ndarray, cls: np.ndarray, rows: int) -> list[np.ndarray]:
    """The feature rows of each token's slot, given its class."""
    with_class = mix64(cls.astype(np.uint64) + np.uint64(9))
    return [(mix64((ctx[0] ^ with_class) * np.uint64(5)) & np.uint64(rows - 1)).astype(np.int64)]


class Heads:
    """The tokens with slots of their own: by class, the most frequent (ties to smaller ids) of the given ones."""

    def __init__(self, ids: np.ndarray, c: np.ndarray):
        cls = (ids & _MASK).astype(np.int64)
        order = np.lexsort((ids, -c, cls))
        rank = np.arange(len(order)) - np.searchsorted(cls[order], cls[order])
        top, slot = order[rank < OWN], rank[rank < OWN]
        by = np.argsort(ids[top])
        self.ids, self.slot = ids[top][by], slot[by]

    def slots(self, ids: np.ndarray) -> np.ndarray:
        shared = OWN + (mix64(ids ^ np.uint64(77)) % np.uint64(SLOTS - OWN)).astype(np.int64)
        if not len(self.ids):
            return shared
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.slot[at], shared)


def exponentials(weights: np.ndarray, bias: np.ndarray, f: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits, a row for each token, and their sums."""
    z = weights.take(f[0], 0)
    for x in f[1:]:
        z += weights.take(x, 0)
    z += bias
    np.exp(z, z)
    return z, z.sum(1)


class Sums:
    """A table of integers: 32 bits wide while they can't overflow, which halves what is read and written at random."""

    def __init__(self, rows: int, width: int):
        self.small, self.whole, self.room = np.zeros((rows, width), np.int32), None, MOST

    def reserve(self, tokens: int) -> np.ndarray:
        """The table to add at most SCALE a token to."""
        if tokens > self.room:
            self.total()
        self.room -= tokens
        return self.small

    def total(self) -> np.ndarray:
        self.whole = self.small.astype(np.int64) if self.whole is None else self.whole + self.small
        self.small[:], self.room = 0, MOST
        return self.whole


def expect(out: np.ndarray, weights: np.ndarray, bias: np.ndarray, f: list[np.ndarray]) -> None:
    """Add each token's distribution, in units of 1 / SCALE, to its feature rows."""
    z, total = exponentials(weights, bias, f)
    z *= (np.float32(SCALE) / total)[:, None]
    z += np.float32(0.5)
    # two sums of 32 bits at a time: all are positive and stay under 2^31, so none is carried into the next
    q, lane = z.astype(np.int32).view(np.int64).reshape(-1), np.arange(z.shape[1] // 2)
    for own in f:
        np.add.at(out.view(np.int64).reshape(-1), ((own * len(lane))[:, None] + lane).reshape(-1), q)


def first_weights(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """From counts n of a feature row with each outcome, and the outcomes' shares p."""
    n = n.astype(np.float32)
    w = np.log((n + PRIOR * p) / (n.sum(1, keepdims=True) + PRIOR)) - np.log(p)
    return np.clip(START * w, -LIMIT, LIMIT).astype(np.float32)


def step(weights: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The weights after a step along the gradient n - m / SCALE, scaled by the curvature of the expectations m."""
    m = m.astype(np.float64) / SCALE
    total = np.maximum(n.sum(1, keepdims=True), 1)
    by = np.clip(STEP * (n - m) / (np.maximum(m * (1 - m / total), 0) + PRIOR), -1.5, 1.5)
    return np.clip(weights + by, -LIMIT, LIMIT).astype(np.float32)


@dataclass
class Model:
    heads: Heads
    rows: int
    class_bias: np.ndarray
    slot_bias: np.ndarray  # a row for each class
    class_weights: np.ndarray | None = None
    slot_weights: np.ndarray | None = None

    def places(self, row: np.ndarray, ids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """(which tokens, class, slot, class rows, slot rows), BATCH tokens at a time."""
        ctx, cls, slot = contexts(row, ids), (ids & _MASK).astype(np.int64), self.heads.slots(ids)
        for at in range(0, len(ids), BATCH):
            p = slice(at, at + BATCH)
            yield p, cls[p], slot[p], class_rows(ctx[:, p], self.rows), slot_rows(ctx[:, p], cls[p], self.rows)

    def log_probabilities(self, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(class, slot | context) of each token, and the number of its class and slot."""
        out, leaf = np.empty(len(ids)), np.empty(len(ids), np.int64)
        for p, cls, slot, f, g in self.places(row, ids):
            for first, (w, bias, x, y) in enumerate(((self.class_weights, self.class_bias, f, cls), (self.slot_weights, self.slot_bias[cls], g, slot))):
                z, total = exponentials(w, bias, x)
                value = np.log10(z[np.arange(len(y)), y].astype(np.float64) / total)
                out[p] = value if not first else out[p] + value
            leaf[p] = cls * SLOTS + slot
        return out, leaf


def _count(docs: DataFrame, tag: str) -> DataFrame:
    """(id, c): how often each token occurs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, inv = np.unique(ids, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(np.bincount(inv, c).astype(np.int64))], names=["id", "c"])

        for batch in batches_of(it, TEXT):
            held.append(np.unique(tokens(batch.column("text"))[1], return_counts=True))
            if sum(len(x[0]) for x in held) > 4_000_000:
                yield out()
                held = []
        if held:
            yield out()

    return materialize(docs.select("text").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")), tag)


def _summed(docs: DataFrame, model: Model, widths: tuple[int, ...], add: Callable[[Model, np.ndarray, np.ndarray, list[Sums]], None]) -> list[np.ndarray]:
    """What `add` adds up over all texts, in tables of model.rows rows of integers, as wide as given."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value, [Sums(shared.value.rows, w) for w in widths]
        for batch in batches_of(it, TEXT):
            add(model, *tokens(batch.column("text")), tables)
        z = zstandard.ZstdCompressor(level=1)
        for k, t in enumerate(x.total() for x in tables):
            blocks = [(k, b, t[b : b + BLOCK_ROWS]) for b in range(0, len(t), BLOCK_ROWS)]
            yield packed([(k, b, z.compress(x.tobytes())) for k, b, x in blocks if x.any()])

    def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "block", "sums"])

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        unpack, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in it:
            for kind, block, x in zip(*[batch.column(c).to_pylist() for c in ("kind", "block", "sums")], strict=True):
                new = np.frombuffer(unpack.decompress(x), np.int64)
                if (kind, block) in sums:
                    sums[kind, block] += new
                else:
                    sums[kind, block] = new.copy()
        yield packed([(*key, z.compress(x.tobytes())) for key, x in sums.items()])

    kind = "kind int, block int, sums binary"
    left, blocks = docs.rdd.getNumPartitions(), len(widths) * (model.rows // BLOCK_ROWS)
    summed = docs.select("text").mapInArrow(own, kind)
    while left > 1:  # a tree: a task adds about FAN blocks of a place, however many tasks made some
        left = -(-left // FAN)
        salted = summed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(left)))
        summed = salted.repartition(min(blocks * left, max(blocks, shuffle_parts(docs))), "kind", "block", "salt").drop("salt").mapInArrow(join, kind)
    out, unpack = [np.zeros((model.rows, w), np.int64) for w in widths], zstandard.ZstdDecompressor()
    for r in summed.collect():  # the tables' size in all, whatever the corpus
        x = np.frombuffer(unpack.decompress(r["sums"]), np.int64).reshape(-1, widths[r["kind"]])
        out[r["kind"]][r["block"] : r["block"] + len(x)] += x
    shared.unpersist()
    return out


def count_features(model: Model, row: np.ndarray, ids: np.ndarray, tables: list[Sums]) -> None:
    """How often each class feature row occurs with each class, and each slot feature row with each slot and each class."""
    for _, cls, slot, f, g in model.places(row, ids):
        first, second, third = (t.reserve(len(cls)).reshape(-1) for t in tables)
        one = np.ones(len(cls), np.int32)  # of the tables' own type, or each sum is converted
        for x in f:
            np.add.at(first, x * CLASSES + cls, one)
        for x in g:
            np.add.at(second, x * SLOTS + slot, one)
            np.add.at(third, x * CLASSES + cls, one)


def expect_features(model: Model, row: np.ndarray, ids: np.ndarray, tables: list[Sums]) -> None:
    """How often the model expects each class feature row with each class, in units of 1 / SCALE."""
    ctx = contexts(row, ids)
    for at in range(0, len(ids), BATCH):
        f = class_rows(ctx[:, at : at + BATCH], model.rows)
        met = sum(int(np.count_nonzero(x == y)) for k, x in enumerate(f) for y in f[:k])  # these add to one row more than once
        expect(tables[0].reserve(len(f[0]) + met), model.class_weights, model.class_bias, f)


def expected_slots(weights: np.ndarray, bias: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often the model expects each slot feature row with each slot, in units of 1 / SCALE, by the counts n of its
    tokens of each class."""
    out = np.zeros(weights.shape)
    for at in range(0, len(n), BLOCK_ROWS):
        r, k = np.nonzero(n[at : at + BLOCK_ROWS])
        if len(r):
            z, total = exponentials(weights, bias[k], [r + at])
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[r[first] + at] = np.add.reduceat(z * (SCALE * n[r + at, k] / total)[:, None], first, 0)
    return out


def rows_for(distinct: int) -> int:
    """Feature rows by the number of distinct training tokens: a quarter of it, from 2^14 to MAX_ROWS, a power of two."""
    return max(1 << 14, min(MAX_ROWS, 1 << max(0, distinct // 4).bit_length()))


def train(docs: DataFrame, heads: Heads, leaves: np.ndarray, rows: int) -> Model:
    """The model after both rounds over the texts of docs; leaves: training tokens by (class, slot)."""
    by_class = leaves.sum(1)
    class_bias = np.log((by_class + 1) / (by_class.sum() + CLASSES)).astype(np.float32)
    slot_bias = np.log((leaves + 0.5) / (by_class[:, None] + 0.5 * SLOTS)).astype(np.float32)
    model = Model(heads, rows, class_bias, slot_bias)
    counts = _summed(docs, model, (CLASSES, SLOTS, CLASSES), count_features)
    slots = (leaves.sum(0) + 1) / (leaves.sum() + SLOTS)
    model.class_weights, model.slot_weights = first_weights(counts[0], np.exp(class_bias)), first_weights(counts[1], slots.astype(np.float32))
    (expected,) = _summed(docs, model, (CLASSES,), expect_features)
    slots = expected_slots(model.slot_weights, slot_bias, counts[2])
    model.class_weights, model.slot_weights = step(model.class_weights, counts[0], expected), step(model.slot_weights, counts[1], slots)
    return model


def _leaves(counts: DataFrame, heads: Heads) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens, and distinct ones, by (class, slot)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = np.zeros(CLASSES * SLOTS, np.int64), np.zeros(CLASSES * SLOTS, np.int64)
        for batch in it:
            ids = np.asarray(batch.column("id"), np.int64).view(np.uint64)
            leaf = (ids & _MASK).astype(np.int64) * SLOTS + heads.slots(ids)
            np.add.at(n, leaf, np.asarray(batch.column("c")))
            size += np.bincount(leaf, minlength=len(size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(size)], names=["leaf", "n", "size"])

    out = np.zeros((2, CLASSES * SLOTS), np.int64)
    for r in counts.mapInArrow(run, "leaf long, n long, size long").groupBy("leaf").agg(F.sum("n"), F.sum("size")).collect():  # CLASSES * SLOTS rows
        out[:, r[0]] = r[1], r[2]
    return out[0].reshape(CLASSES, SLOTS), out[1].reshape(CLASSES, SLOTS)


def score(docs: DataFrame, folds: int = 5, out_fold: int = 1, rows: int | None = None, tag: str = "lm") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Learns from the rows whose crc32 of doc_id as text, modulo `folds`, isn't `out_fold`. `rows`: of the feature tables, a
    power of two from BLOCK_ROWS on (default by the vocabulary). Null and empty texts are an end alone. Null doc_ids
    count as empty text for the fold; rows that repeat a doc_id are texts of their own. Without training texts every
    count is 0, and classes and slots are equally likely. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), folds) == out_fold)
    learn = docs.filter(~F.col("held_out"))
    counts = _count(learn, f"{tag}-counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    frequent = F.col("c") >= max(1, -(-total // FREQUENT))  # at most FREQUENT rows
    often = counts.filter(frequent).toArrow()
    ids, c = np.asarray(often.column("id").combine_chunks(), np.int64).view(np.uint64), np.asarray(often.column("c"), np.int64)
    heads, order = Heads(ids, c), np.argsort(ids)
    leaves, sizes = _leaves(counts, heads)
    inside = np.log10(leaves + 0.5 * (sizes + 1)).ravel()
    outside = float(np.log10(total + 0.5 * (distinct + 1)))
    shared = spark.sparkContext.broadcast((train(learn, heads, leaves, rows or rows_for(distinct)), ids[order], c[order]))

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, known, c = shared.value
        known_value = np.log10(c + 0.5)
        for batch in batches_of(it, TEXT):
            row, ids = tokens(batch.column("text"))
            n, (value, leaf) = batch.num_rows, lm.log_probabilities(row, ids)
            model = np.bincount(row, value - inside[leaf], n)
            if len(known):
                own, back = np.unique(ids, return_inverse=True)  # in order, which finds them in a large table faster
                where = np.minimum(np.searchsorted(known, own), len(known) - 1)
                where, hit = where[back], (known[where] == own)[back]
            else:
                where, hit = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            words = np.bincount(row[hit], known_value[where[hit]], n) if len(known) else np.zeros(n)
            r, w = row[~hit], ids[~hit]
            o = np.lexsort((w, r))
            r, w = r[o], w[o]
            cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])]) if len(r) else np.zeros(0, int)
            times = np.diff(np.r_[cut, len(r)])
            at = pa.array(np.searchsorted(r[cut], np.arange(n + 1)), pa.int32())
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[hit], minlength=n)), pa.array(words), pa.array(model), pa.ListArray.from_arrays(at, pa.array(w[cut].astype(np.int64))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_often", "often", "model", "ids", "times"])

    kind = docs.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_often", "long").add("often", "double").add("model", "double").add("ids", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.IntegerType()))
    rows = materialize(docs.mapInArrow(local, kind).withColumn("_row", F.monotonically_increasing_id()), f"{tag}-rows")
    rare = rows.select("_row", F.explode(F.arrays_zip("ids", "times")).alias("x")).select("_row", F.col("x.ids").alias("id"), F.col("x.times").alias("k"))
    found = rare.join(counts.filter(~frequent), "id").groupBy("_row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("_v"), F.sum(F.col("k").cast("long")).alias("_n"))
    own = rows.select("_row", "doc_id", "held_out", "n_tokens", "n_often", "often", "model")
    out = own.join(found, "_row", "left")
    n_known = F.col("n_often") + F.coalesce("_n", F.lit(0))
    value = F.col("often") + F.coalesce("_v", F.lit(0.0)) + (F.col("n_tokens") - n_known) * float(np.log10(0.5))
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (value - F.col("n_tokens") * outside).alias("base_score"), (value + F.col("model")).alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
