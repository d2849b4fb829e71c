"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length (norm) and cut into blocks, blocks into buckets. A query's k-th best score against the
longest block is a lower bound, so in a bucket whose longest vector has norm l only cosines of at least
bound / (|q| * l) matter: above 1 the bucket and all shorter ones go; at high local thresholds candidates must lie in
the feasible range of the query's largest coordinates; else those long enough are kept. What is left is verified by
exact integer products. Bounds rise as blocks are seen.

The query set meets all rows cell by cell: some blocks of queries, held by a task, and a run of candidate blocks that it
reads one after the other. Which cells can matter is told from norms and bounds alone, before any vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_parts, table

K = 20
BLOCK = 2048
BUCKET = 256
FULL = 8  # blocks that a task fills before there are more tasks: cells of few blocks would be shipped more often
SEEDED = 64  # dimensions that start from a bound; the others find theirs on the way
HELD = 2048  # dimensions by query blocks that a task holds: 32 MiB of vectors
MET = 256  # candidate blocks, at most, that a task then reads one by one
STEEP = 0.7  # local cosine threshold from which coordinates prune
FOCUS = 4


def valid(vector: Column) -> Column:
    """Neither null nor empty, no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _blocks(rows: DataFrame, tag: str) -> DataFrame:
    """(dim, block, n, norm, ids, data): rows (id, v array<double>) of one dimension, longest first, BLOCK at a time."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    order = rows.withColumn("norm", norm).withColumn("dim", F.size("v"))
    parts = max(1, min(shuffle_parts(rows), -(-rows.count() // (BLOCK * FULL))))
    order = order.repartitionByRange(parts, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = t.column("v").combine_chunks()
            dim = t.column("dim")[0].as_py()
            data = np.asarray(v.values if isinstance(v, pa.ListArray) else pa.concat_arrays(v.chunks).values, np.float64)
            cols = [[dim], [t.num_rows], [t.column("norm")[0].as_py()], [np.asarray(t.column("id"), "<i8").tobytes()], [data.astype("<f8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "n", "norm", "ids", "data"])

        for batch in it:
            at = 0
            while at < batch.num_rows:
                dims = np.asarray(batch.column("dim"))[at:]
                same = len(dims) if (dims == dims[0]).all() else int(np.argmax(dims != dims[0]))
                if held and held[0].column("dim")[0].as_py() != dims[0]:
                    yield out()
                    held = []
                take = min(same, BLOCK - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
                if sum(b.num_rows for b in held) == BLOCK:
                    yield out()
                    held = []
        if held:
            yield out()

    packed = order.select("id", "v", "norm", "dim").mapInArrow(cut, "dim int, n int, norm double, ids binary, data binary")
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), tag)


MOST = (1 << 63) - 1


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of float64 arrays that hold integers: exact, those past 64 bits held at -MOST or MOST."""
    d = max(q.shape[1], 1)
    a, b = np.abs(q).max(1, initial=0), np.abs(c).max(1, initial=0)
    top = float(a.max(initial=0)) * float(b.max(initial=0)) * d
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    if top < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    # only pairs of large vectors need integers of any size
    out = np.zeros((len(q), len(c)), np.int64)
    for i in range(len(q)):
        reach = a[i] * b * d
        fits = reach < 2**53
        out[i, fits] = (c[fits] @ q[i]).astype(np.int64)
        own = [int(x) for x in q[i]]
        for j in np.flatnonzero(~fits):
            s = sum(x * int(y) for x, y in zip(own, c[j], strict=True))
            out[i, j] = max(-MOST, min(MOST, s))
    return out


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their row, ties to smaller ids."""
    order = np.lexsort((ids, -score, row))
    r = row[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[rank < k]


def search_block(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(query row, candidate id, score) of at most k per query with scores of at least `bound` (raised in place)."""
    qn, cn = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    q_unit, c_unit = q / np.maximum(qn, 1e-300)[:, None], c / np.maximum(cn, 1e-300)[:, None]
    focus = np.argsort(-np.abs(q_unit), 1)[:, :FOCUS]
    seen = {"pairs": 0, "verified": 0}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(c), BUCKET):
        part = slice(at, at + BUCKET)
        longest = cn[part].max(initial=0)
        seen["pairs"] += len(q) * len(c[part])
        # without a bound (-inf), or with a bound <= 0, nothing can be pruned
        local = np.where(bound > 0, bound * (1 - 1e-12) / np.maximum(qn * longest, 1e-300), -1.0)
        live = np.flatnonzero(~(local > 1))
        if not len(live):
            continue
        steep = live[local[live] >= STEEP]
        for i in steep:  # coordinate pruning
            t, ok = local[i], np.ones(len(c[part]), bool)
            for f in focus[i]:
                x = q_unit[i, f]
                away = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - x * x))
                y = c_unit[part, f]
                # a cone of cosine t around the query reaches the axis itself where |x| > t
                if -x <= t:
                    ok &= y >= t * x - away - 1e-9
                if x <= t:
                    ok &= y <= t * x + away + 1e-9
            if ok.any():
                at_c = np.flatnonzero(ok) + at
                s = _scores(q[i : i + 1], c[at_c])[0]
                seen["verified"] += len(s)
                keep = (s >= bound[i]) & (c_ids[at_c] != q_ids[i])
                found.append((np.full(keep.sum(), i), at_c[keep], s[keep]))
        flat = live[~(local[live] >= STEEP)]
        if len(flat):  # length pruning: those too short for every query of the block go
            least = np.where(bound[flat] > 0, bound[flat] * (1 - 1e-12) / np.maximum(qn[flat], 1e-300), 0).min()
            at_c = np.flatnonzero(cn[part] >= least) + at
            s = _scores(q[flat], c[at_c])
            seen["verified"] += s.size
            i, j = np.nonzero((s >= bound[flat, None]) & (c_ids[at_c][None, :] != q_ids[flat, None]))
            found.append((flat[i], at_c[j], s[i, j]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, seen
    row, at_c, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _best(row, c_ids[at_c], score, k)
    row, ids, score = row[keep], c_ids[at_c[keep]], score[keep]
    n = np.bincount(row, minlength=len(q))
    full = np.flatnonzero(n >= k)
    low = np.full(len(q), np.iinfo(np.int64).max)
    np.minimum.at(low, row, score)
    bound[full] = np.maximum(bound[full], low[full])
    return row, ids, score, seen


def _array(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all candidates, ties to
    the smaller vec_id, without candidates of the query's own id.

    Both have (id long, v array<double>) with integer values. A product past 64 bits counts as 2^63 - 1, or its negative,
    and ties with others such. Rows with a null id, or a vector that is null, empty or
    holds null or non-finite components, take no part. Vectors of another dimension than the query's aren't scored.
    Repeated candidates all count; repeated queries give repeated answers. Empty tables give no rows.
    """
    spark = candidates.sparkSession
    clean = lambda df: df.filter(F.col("id").isNotNull() & valid(F.col("v"))).select("id", "v")
    cands, asks = _blocks(clean(candidates), "topk-candidates"), _blocks(clean(queries), "topk-queries")
    seeds: dict[int, tuple[bytes, bytes]] = {}  # the longest block of each dimension, BLOCK rows at most
    longest = cands.groupBy("dim").agg(F.max_by(F.struct("ids", "data"), "norm").alias("x"), F.sum("n").alias("rows"))
    for r in longest.orderBy(F.desc("rows"), "dim").limit(SEEDED).collect():  # bounds of further dimensions rise without a seed
        seeds[r["dim"]] = (r["x"]["ids"], r["x"]["data"])
    seed = spark.sparkContext.broadcast(seeds)

    def bounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for r in batch.to_pylist():
                bound = np.full(r["n"], -MOST)
                if r["dim"] in seed.value:
                    ids, data = seed.value[r["dim"]]
                    search_block(_array(r["data"], r["dim"]), np.frombuffer(r["ids"], "<i8"), bound, _array(data, r["dim"]), np.frombuffer(ids, "<i8"), k)
                out.append(bound)
            cols = [pa.array([b.tobytes() for b in out], pa.binary()), pa.array([float(b.min()) for b in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("dim", "norm", "ids", "data", "block")], *cols], names=["dim", "norm", "ids", "data", "block", "bounds", "low"])

    asks = materialize(asks.mapInArrow(bounds, "dim int, norm double, ids binary, data binary, block long, bounds binary, low double"), "topk-bounds")
    # a block's id holds its task and its place there; blocks are in order of dimension and norm
    place = F.col("block").bitwiseAND((1 << 33) - 1)
    met = max(1, min(MET, -(-cands.count() // shuffle_parts(candidates))))
    task = F.shiftright("block", 33) * (1 << 33)
    asks = asks.withColumn("h", task + F.floor(place * F.col("dim") / HELD))
    cands = cands.withColumn("g", task + F.floor(place / met))
    reach = F.when(F.col("low") > 0, F.try_divide(F.col("low"), F.col("norm"))).otherwise(0.0)
    cells = asks.groupBy("dim", "h").agg(F.min(reach).alias("reach")).join(cands.groupBy("dim", "g").agg(F.max("norm").alias("most")), "dim")
    cells = materialize(cells.filter(F.col("most") * (1 + 1e-9) >= F.col("reach")).select("dim", "h", "g"), "topk-cells")
    own = ["dim", "h", "g", "kind", "block", "norm", "ids", "data", "bounds"]
    left = asks.hint("merge").join(cells, ["dim", "h"]).withColumn("kind", F.lit(0)).select(*own)
    right = cands.hint("merge").join(cells, ["dim", "g"]).withColumn("kind", F.lit(1)).withColumn("bounds", F.lit(None).cast("binary")).select(*own)
    cell = ["dim", "h", "g"]
    met_by = left.unionByName(right).repartition(shuffle_parts(candidates), *cell).sortWithinPartitions(*cell, "kind", F.desc("norm"))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Asked] = []
        last = None
        for batch in it:
            for r in batch.to_pylist():
                if (key := (r["dim"], r["h"], r["g"])) != last:
                    yield from (a.found(k) for a in held)
                    held, last = [], key
                v, ids = _array(r["data"], r["dim"]), np.frombuffer(r["ids"], "<i8")
                if r["kind"] == 0:
                    held.append(Asked(r["block"], r["norm"], v, ids, np.frombuffer(r["bounds"], "<i8").copy()))
                else:
                    for a in held:
                        a.meet(v, ids, r["norm"], k)
        yield from (a.found(k) for a in held)

    found = met_by.mapInArrow(search, "q_block long, q_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Asked:
    """A block of queries and the best candidates met so far."""

    def __init__(self, block: int, norm: float, q: np.ndarray, ids: np.ndarray, bound: np.ndarray):
        self.block, self.norm, self.q, self.ids, self.bound = block, norm, q, ids, bound
        self.best = [tuple(np.zeros(0, np.int64) for _ in range(3))]

    def meet(self, c: np.ndarray, ids: np.ndarray, norm: float, k: int) -> None:
        low = self.bound.min()
        if low > 0 and self.norm * norm * (1 + 1e-9) < low:
            return
        self.best.append(search_block(self.q, self.ids, self.bound, c, ids, k)[:3])
        if sum(len(x[0]) for x in self.best) > 4 * k * len(self.q):
            row, _, score = self._cut(k)
            n = np.bincount(row, minlength=len(self.q))
            least = np.full(len(self.q), MOST)
            np.minimum.at(least, row, score)
            self.bound[n >= k] = np.maximum(self.bound, least)[n >= k]

    def _cut(self, k: int) -> tuple[np.ndarray, ...]:
        row, ids, score = (np.concatenate(x) for x in zip(*self.best, strict=True))
        keep = _best(row, ids, score, k)
        self.best = [(row[keep], ids[keep], score[keep])]
        return self.best[0]

    def found(self, k: int) -> pa.RecordBatch:
        row, ids, score = self._cut(k)
        cols = [pa.array(x, pa.int64()) for x in (np.full(len(row), self.block), row, self.ids[row], ids, score)]
        return pa.RecordBatch.from_arrays(cols, names=["q_block", "q_row", "query_id", "vec_id", "score"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null or with null or non-finite components take no part, nor do those where 64 * x isn't finite any more."""
    # a double from 2^53 on is an integer already, and floor() gives a long, which ends at 2^63
    def grain(x: Column) -> Column:
        y = x.cast("double") * 64
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    v = F.transform("embedding", grain)
    e = table(spark, sf_dir, "embeddings").filter(valid(F.col("embedding"))).select(F.col("vec_id").alias("id"), v.alias("v"))
    return top_k(e, e.filter(F.pmod("id", F.lit(20)) == 0))


ORACLE = """
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
