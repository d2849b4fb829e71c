"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted over one feature at a time, in turn; the trees of a feature add up to a lookup table over its
bins, those of a pair of features to a two-dimensional table. A text's score is the logistic sum of its bins' entries.
Features come from the whole text alone. The fit uses at most FIT_ROWS labelled rows, chosen by a hash of doc_id;
features, bins and scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, materialize, released, table, text_bytes, words_of

FIT_ROWS = 60_000
BINS = 48
ROUNDS = 150
PAIRS = 6
PAIR_BINS = 12
PAIR_ROUNDS = 60
RATE = 0.1
L2 = 2.0

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop_mark", "exclaim", "symbol", "high_byte", "space",
    "line_words", "distinct", "top_word", "longest", "capital_words", "marked_words", "repeat_lines", "bracket", "at_slash",
]

_CLASS = np.zeros((256, 9), np.float64)
for _k, _set in enumerate([range(65, 91), range(48, 58), b".,;:", b"!?", b"#$%&*+=~^_|<>\\`", range(128, 256), b" \t", b"()[]{}\"'", b"@/"]):
    _CLASS[list(_set), _k] = 1
_KIND = np.where(_CLASS.any(1), _CLASS.argmax(1), 9).astype(np.uint8)


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kind = _KIND[raw]
    count = [_share(kind == k, offsets) for k in range(9)]
    start, end, row, h = words_of(raw, offsets)
    words = np.bincount(row, minlength=n).astype(np.float64)
    length = np.bincount(row, end - start, n)
    longest = np.zeros(n)
    np.maximum.at(longest, row, end - start)
    order = np.lexsort((h, row))
    r, s = row[order], h[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])] if len(r) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(r)])
    distinct = np.bincount(r[first], minlength=n).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, r[first], runs)
    head, tail = (raw[start], raw[end - 1]) if len(start) else (np.zeros(0, np.uint8),) * 2
    body = raw[np.minimum(start + 1, end - 1)] if len(start) else head
    capital = np.bincount(row, (_KIND[head] == 0) & (_KIND[body] == 0) & (end - start > 1), n)
    marked = np.bincount(row, (_KIND[tail] == 4) | (_KIND[tail] == 3), n)
    newline = raw == 10
    lines = _share(newline, offsets) + 1
    # equal lines of a text: sums of their words' hashes
    line = np.cumsum(newline) if len(raw) else np.zeros(0, np.int64)
    at = line[start] + row if len(start) else line
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    key = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(cut, np.diff(np.r_[cut, len(h)])).astype(np.uint64) + np.uint64(3)), cut) if len(cut) else h
    lrow = row[cut]
    o = np.lexsort((key, lrow))
    again = np.r_[False, (lrow[o][1:] == lrow[o][:-1]) & (key[o][1:] == key[o][:-1])] if len(o) else np.zeros(0, bool)
    repeats = np.bincount(lrow[o], again, n)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    cols = [np.log1p(size), np.log1p(words), length / w, *[c / b for c in (count[0], count[1], count[2], count[3], count[4], count[5], count[6])], words / lines, distinct / w, top / w, np.log1p(longest), capital / w, marked / w, repeats / lines, count[7] / b, count[8] / b]
    return np.stack(cols, 1) * (size > 0)[:, None]


@dataclass
class Model:
    """Lookup tables: edges and table by feature, and (i, j, coarse edges of i and j, table) by pair."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, k], "right")]
        for i, j, a, b, t in self.pairs:
            z += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(x) else np.zeros(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + L2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The values by bin of a tree over ordered bins: the best split again and again, up to `leaves` leaves."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + L2)
    while len(parts) < leaves:
        best, where = 1e-9, None
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                up = gain(a, m) + gain(m, b) - gain(a, b)
                if up.max() > best:
                    best, where = up.max(), (k, int(m[up.argmax()]))
        if where is None:
            break
        a, b = parts[where[0]]
        parts[where[0] : where[0] + 1] = [(a, where[1]), (where[1], b)]
    for a, b in parts:
        out[a:b] = _leaf(G[b] - G[a], H[b] - H[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut in each of two features over a table of sums; its values and gain."""
    G, H = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return np.zeros_like(g), 0.0
    n, m = g.shape

    def part(A: np.ndarray) -> list[np.ndarray]:
        a = A[i, j]
        return [a, A[i, m] - a, A[n, j] - a, A[n, m] - A[i, m] - A[n, j] + a]

    gain = sum(x * x / (y + L2) for x, y in zip(part(G), part(H), strict=True))
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    vals = [_leaf(float(x[a, b]), float(y[a, b])) for x, y in zip(part(G), part(H), strict=True)]
    out = np.empty_like(g)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = vals
    return out, float(gain.max() - G[n, m] ** 2 / (H[n, m] + L2))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost over the features in turn, then over the pairs that explain most of what is left. No rows: score 0.5."""
    d = x.shape[1]
    p0 = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(p0 / (1 - p0)))
    edges = [_edges(x[:, k], BINS) for k in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return Model(bias, edges, tables, [])
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    z = np.full(len(y), bias)
    sig = lambda: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for _ in range(ROUNDS):
        for k in range(d):
            if len(tables[k]) > 1:
                p = sig()
                step = RATE * _tree(np.bincount(at[k], y - p, len(tables[k])), np.bincount(at[k], p * (1 - p), len(tables[k])))
                tables[k] += step
                z += step[at[k]]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(d)]
    cat = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(coarse[i]) + 1, len(coarse[j]) + 1
        c = cat[i] * m + cat[j]
        return np.bincount(c, y - p, n * m).reshape(n, m), np.bincount(c, p * (1 - p), n * m).reshape(n, m)

    p = sig()
    gains = sorted(((_quadrants(*sums(i, j, p))[1], i, j) for i in range(d) for j in range(i)), reverse=True)[:PAIRS]
    pairs = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for g, i, j in gains if g > 0}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in pairs.items():
            step = RATE * _quadrants(*sums(i, j, sig()))[0]
            t += step
            z += step[cat[i], cat[j]]
    return Model(bias, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in pairs.items()])


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit labels.quality (0 or 1; others and nulls are ignored) of the documents whose remainder modulo 3 isn't 1.

    Every distinct (doc_id, text, label) counts once. Of more than `rows` about `rows` are taken, by hash, so what is
    broadcast, and then collected, is bounded: their ids and their features.
    """
    own = labels.filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1)).select(F.col("doc_id").alias("_id"), F.col("quality").alias("y")).distinct()
    texts = docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_t"))
    marked = materialize(texts.select("_id", "_t").join(own, "_id").distinct(), "quality-labelled")
    n = marked.count()
    if n > rows:
        marked = marked.filter(F.pmod(F.xxhash64("_id", "_t", "y"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))

    @released
    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it):
            x = features(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_t"), batch.column("y"), _arrays(x)], names=["_id", "_t", "y", "x"])

    chosen = texts.join(F.broadcast(marked), ["_id", "_t"]).select("_id", "_t", "y", "text")
    found = chosen.mapInArrow(measure, chosen.drop("text").schema.add("x", T.ArrayType(T.DoubleType())))
    train = found.dropDuplicates(["_id", "_t", "y"]).select("x", "y").toArrow()
    x = np.asarray(train.column("x").combine_chunks().flatten(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, np.asarray(train.column("y"))))  # rows arrive in any order; sums shall not depend on it
    return fit(x[order], np.asarray(train.column("y"), np.float64)[order])


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Learns by doc_id; a doc_id that has several labels or texts counts each. At most about `rows` labelled texts, by
    hash, enter the fit; every text is scored, in one pass. Null and empty texts are scored from features of zero.
    Repeated rows get equal scores. Without labels every score is 0.5. A null doc_id counts as empty text for the
    fold. Empty tables give no rows.
    """
    model = learn(docs, labels, rows)

    @released
    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it):
            s = model.score(features(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return out.mapInArrow(score, out.drop("text").schema.add("score", "double").add("predicted", "integer"))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose predicted quality is 1, with all their columns; texts are scored in one pass, none is shuffled.

    Null and empty texts are scored as such, repeated rows go or stay together, an empty table gives no rows.
    """
    model = learn(docs, labels, rows)

    @released
    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it):
            yield batch.filter(pa.array(model.score(features(*text_bytes(batch.column("text")))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
