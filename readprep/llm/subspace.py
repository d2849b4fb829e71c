"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length 1 and rotated; the rotated space is split into blocks of BLOCK_DIM dimensions. Two vectors
of cosine c lie at squared distance 2 - 2c, so in at least one block their squared distance is at most its share of
2 - 2 * threshold, in proportion to its dimensions. Each block is range-joined on its own: cells as wide as the block's
radius along one axis, neighbouring cells, then block distances. Candidates are verified by exact cosines in the same
task, and a pair counts only in the first block that finds it, so the union holds every pair once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, table
from .topk import valid

THRESHOLD = 0.93
BLOCK_DIM = 8
CHUNK = 2048
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, width: int = BLOCK_DIM) -> list[tuple[int, int]]:
    return [(a, min(a + width, dim)) for a in range(0, dim, width)]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so squares neither vanish nor overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def links_in(v: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of at least `threshold` that `block` is the first to find; visitors don't meet."""
    u = unit(v)
    r, edges, budget = u @ rotation(v.shape[1]), block_edges(v.shape[1]), 2 - 2 * threshold + SLACK
    share = [budget * (b - a) / v.shape[1] for a, b in edges]
    a, b = edges[block]
    x, y = r[left, a:b], r[right, a:b]
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero((d <= share[block] + 1e-7) & (home[left][:, None] | home[right][None, :]))
    i, j = left[i], right[j]
    if np.array_equal(left, right):
        i, j = i[(ok := i < j)], j[ok]
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d2 = (r[p] - r[q]) ** 2
        near = [d2[:, s:e].sum(1) <= share[n] for n, (s, e) in enumerate(edges[: block + 1])]
        ok = near[block]
        for earlier in near[:block]:
            ok &= ~earlier
        p, q = p[ok], q[ok]
        ok = (u[p] * u[q]).sum(1) >= threshold
        out_i.append(p[ok])
        out_j.append(q[ok])
    z = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (z, z)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component under edges (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tag: str = "subspace") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Only rows of one label are compared. A vector that is null, empty, zero or holds null or non-finite components, or
    whose label is null, links with nothing. Equal vectors of a label are joined as one class with a count, and links
    to a class count its members, so copies are never expanded into pairs. Vectors of different dimension don't link.
    Repeated vec_ids are vectors of their own; a null vec_id counts as a link and is kept only where its component has
    no other id. Empty tables give no rows.
    """
    e = F.col("embedding")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # shuffled as it comes
    whole = valid(e) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    key = F.when(whole, F.xxhash64(F.lit("class"), "label", e))
    rows = vectors.select("vec_id", key.alias("class"), F.when(whole, F.xxhash64(e, "label")).alias("class2"), e.cast(kind).alias("v"), "label")
    cls = rows.filter(F.col("class").isNotNull()).groupBy("class", "class2").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count(F.lit(1)).alias("size"))
    cls = materialize(cls, f"{tag}-classes")

    def cells(it):
        for batch in it:
            v = batch.column("v")
            n = np.diff(np.asarray(v.offsets))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                r = unit(np.asarray(v.take(pa.array(at)).flatten(), np.float64).reshape(-1, dim)) @ rotation(int(dim))
                for k, (a, b) in enumerate(block_edges(int(dim))):
                    cell = np.floor(r[:, a] / np.sqrt((2 - 2 * threshold + SLACK) * (b - a) / dim)).astype(np.int64)
                    for step in (0, 1):  # visitors go to the cell below
                        for o, x in zip(out, (at, np.full(len(at), dim), np.full(len(at), k), cell - step, np.full(len(at), step == 0)), strict=True):
                            o.append(x)
            at, *rest = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            cols = [batch.column(c).take(pa.array(at)) for c in ("class", "size", "label", "v")]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x).cast(k) for x, k in zip(rest, kinds, strict=True)]], names=["class", "size", "label", "v", "dim", "block", "cell", "home"])

    label_type = dict(vectors.dtypes)["label"]
    slim = cls.select("class", "size", "label", F.col("v"))
    dealt = slim.mapInArrow(cells, f"class long, size long, label {label_type}, v {kind}, dim int, block int, cell long, home boolean")
    where = ["label", "dim", "block", "cell"]
    # a cell of many rows is dealt out in chunks, every two chunks meet in a task of their own
    many = dealt.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"), F.max("home").alias("_any"))
    dealt = dealt.join(many.filter("_any").drop("_any"), where)
    mine = F.pmod(F.xxhash64("class", "cell"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("chunks", "other", "cell_rows")

    def join(t: pa.Table) -> pa.Table:
        ids, size, home, mine = (np.asarray(t.column(c)) for c in ("class", "size", "home", "mine"))
        lo, hi, block, dim = (t.column(c)[0].as_py() for c in ("lo", "hi", "block", "dim"))
        v = np.asarray(pa.concat_arrays(t.column("v").chunks).flatten(), np.float64).reshape(-1, dim)
        i, j = links_in(v, home.astype(bool), np.flatnonzero(mine == lo), np.flatnonzero(mine == hi), block, threshold)
        links = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
        at = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[at]), "links": pa.array(links[at].astype(np.int64)), "root": pa.array(ids[forest(len(ids), i, j)[at]])})

    found = materialize(dealt.groupBy(*where, "lo", "hi").applyInArrow(join, "id long, links long, root long"), f"{tag}-links")
    parts = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), tag)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    info = cls.select("class", "size").join(links.withColumnRenamed("id", "class"), "class", "left").join(parts.withColumnRenamed("id", "class"), "class", "left")
    info = materialize(info.select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class").alias("part")), f"{tag}-info")
    members = materialize(rows.select("vec_id", "class").join(info, "class", "left"), f"{tag}-members")
    low = members.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min("vec_id").alias("low"))
    out = members.join(low, "part", "left")
    component = F.when(F.col("part").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
