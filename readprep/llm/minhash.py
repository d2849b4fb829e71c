"""MinHash near-duplicates with ProbMinHash signatures.

Every distinct shingle of a text is an element that sends points of a Poisson process of rate 1, however often it
occurs; each point falls on a random register, and a register keeps the element of its earliest point. An element
stops as soon as its next point is later than every register's (early termination). Two texts agree on a register with
their probability Jaccard similarity, which at equal weights is the Jaccard similarity of their shingle sets, by which
links are decided. Registers are banded; texts that share a band are verified by that similarity, exactly.

Equal texts, told by their SHA-256, are one class from the start. Within a band's group the members are first held
against the group's smallest; only in groups that this leaves in several components are the other pairs looked at, and of
these only those between components. Before texts are compared, signatures are: registers are independent, so the chances
below are binomial. No group is gathered or paired out whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, components, materialize, mix64, released, shuffle_parts, spread_join, table, text_bytes, words_of

WORDS = 5
THRESHOLD = 0.8
REGISTERS = 63
BAND = 3  # registers a band: at similarity 0.8 a pair misses all 21 bands with probability 3e-7
LEAST_AGREE = 32  # at similarity 0.8 a pair agrees in fewer of 63 registers with probability 5e-8
CHUNK = 1024


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash64) of every shingle occurrence; a text of 1 to words - 1 words is one shingle, without words none."""
    _, _, row, h = words_of(raw, offsets)
    n = len(h)
    if not n:
        return row, h
    acc = mix64(h + np.uint64(words))
    for k in range(1, words):
        nxt = np.zeros(n, np.uint64)
        same = np.zeros(n, bool)
        nxt[:-k], same[:-k] = h[k:], row[k:] == row[:-k]
        acc = np.where(same, mix64(acc ^ (nxt + np.uint64(k))), acc)
        full = same  # of the last step: all words of the shingle lie in the row
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.r_[True, row[1:] != row[:-1]]
    keep = (full if words > 1 else np.ones(n, bool)) | (first & (count[row] < words))
    return row[keep], acc[keep]


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, element) in order; elements are 40-bit hashes."""
    key = (row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return (key[first] >> np.uint64(40)).astype(np.int64), key[first] & np.uint64((1 << 40) - 1)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The n x m elements of the registers; rows without elements stay all ones."""
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    if not len(row):
        return out.reshape(n, m)
    at, live = np.full(n * m, np.inf), np.arange(len(row))
    time, step = np.zeros(len(row)), 0
    while len(live):
        step += 1
        u = mix64(element[live] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        time[live] += -np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)) / weight[live]
        register = row[live] * m + (mix64(u ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        t = time[live]
        better = t < at[register]
        r, t, e = register[better], t[better], element[live][better]
        np.minimum.at(at, r, t)
        won = at[r] == t
        out[r[won]] = e[won]
        latest = at.reshape(n, m).max(1)
        live = live[time[live] < latest[row[live]]]
    return out.reshape(n, m)


def sign(texts: pa.Array, m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and whether a text has any word."""
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    row, element = distinct(*shingles(raw, offsets))
    has = np.zeros(n, bool)
    has[row] = True
    return signatures(row, element, np.ones(len(row)), n, m), has


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def text_key(text: Column | str) -> Column:
    """Tells texts apart: equal for equal texts only."""
    return F.unhex(F.sha2(text, 256))


def _sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """(id, x): the sorted shingle hashes of the text of each class in `ids`."""
    want = ids.join(classes.select("id", "rep", "_key"), "id")
    texts = docs.join(want, [docs["_doc"].eqNullSafe(F.col("rep")), docs["_key"] == want["_key"]]).select("id", "_text")

    @released
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, column="_text"):
            raw, offsets = text_bytes(batch.column("_text"))
            row, h = shingles(raw, offsets)
            o = np.lexsort((h, row))
            row, h = row[o], h[o]
            keep = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
            row, h = row[keep], h[keep]
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["id", "x"])

    found = texts.mapInArrow(sets, "id long, x binary")
    return materialize(found.groupBy("id").agg(F.first("x").alias("x")), f"{tag}-sets")


def _held(edges: DataFrame, data: DataFrame, alike: Callable[[bytes, bytes], bool], tag: str) -> DataFrame:
    """The edges (a, b) whose ends' data (id, x binary) are alike. A hub a is met by its neighbours in chunks, each chunk
    with one copy of the hub's data; a neighbour's data are sent once for each of its hubs."""
    hubs = materialize(edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), f"{tag}-hubs")
    salt = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("salt")
    ends = edges.join(hubs, "a").select("a", salt, "b")
    one = hubs.join(data.withColumnRenamed("id", "a").hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "x")
    many = ends.join(data.withColumnRenamed("id", "b").hint("merge"), "b").select("a", "salt", "b", "x")
    dealt = one.unionByName(many).repartition(shuffle_parts(edges), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    @released
    def hold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, b""
        for batch in it:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x")), strict=True)):
                if b is None:
                    hub, own = a, x
                else:
                    assert a == hub
                    keep[i] = alike(own, x)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return materialize(dealt.select("a", "b", "x").mapInArrow(hold, "a long, b long"), tag)


def links_between(ids: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: int, threshold: float) -> list[tuple[int, int]]:
    """Links between members of `left` and `right` that join different components: enough of them to join every two
    components that any link joins, at most one for each join. Pairs within a component aren't looked at."""
    size = np.array([len(x) for x in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    here = np.zeros(int(dense.max(initial=-1)) + 1, bool)
    _, comp = np.unique(comp, return_inverse=True)
    out = []
    for i in left:
        j = right[comp[right] != comp[i]]
        j = j[(sig[j] == sig[i]).sum(1) >= least]
        if not len(j):
            continue
        own = dense[start[i] : start[i + 1]]
        here[own] = True
        at = np.repeat(start[j] - np.r_[0, np.cumsum(size[j])[:-1]], size[j]) + np.arange(int(size[j].sum()))
        common = np.add.reduceat(here[dense[at]].astype(np.int64), np.r_[0, np.cumsum(size[j])[:-1]])
        here[own] = False
        for x in j[common / (size[i] + size[j] - common) >= threshold]:
            if comp[x] != comp[i]:
                out.append((int(min(ids[i], ids[x])), int(max(ids[i], ids[x]))))
                comp[comp == comp[x]] = comp[i]
    return out


def _cross(members: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, least: int, threshold: float, tag: str) -> DataFrame:
    """Verified links between different components whose texts share a band and agree in at least `least` registers.

    Bands whose groups have the same members are looked at once. Pairs are verified where they are found, so a task
    emits fewer links than it has members."""
    named = members.join(parts.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("m2"))
    mixed = mixed.filter("x <> y and n > 2").groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("g"))
    rows = named.join(mixed.select("g.band", "g.key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), ["band", "key"])
    rows = materialize(rows.select("band", "key", "id", "component", "chunks"), f"{tag}-mixed")
    if rows.isEmpty():
        return rows.select(F.col("id").alias("a"), F.col("component").alias("b"))
    sets = _sets(rows.select("id").distinct(), docs, classes, f"{tag}-mixed").withColumnRenamed("x", "s")
    rows = rows.join(classes.select("id", "sig").join(sets, "id"), "id")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    # groups share tasks: one sort, then group by group as a stream
    keys = ["band", "key", "lo", "hi"]
    dealt = rows.select(*keys, "mine", "id", "component", "sig", "s").repartition(*keys).sortWithinPartitions(*keys)

    @released
    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(group)
            ids, comp, mine = (np.asarray(t.column(c)) for c in ("id", "component", "mine"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()]
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            found = links_between(ids, comp, sig, sets, np.flatnonzero(mine == lo), np.flatnonzero(mine == hi), least, threshold)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            key = np.stack([np.asarray(batch.column(c), np.int64) for c in keys], 1)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else []
            for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
                if held and (key[a] != last).any():
                    yield of(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
        if held:
            yield of(held)

    return materialize(dealt.mapInArrow(links, "a long, b long").distinct(), f"{tag}-cross")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tag: str = "minhash") -> DataFrame:
    """(doc_id, class_id, kept, text_key) for every row of docs (doc_id, text): class_id is the smallest doc_id of its group.

    Groups are the components of links between texts whose sets of five-word shingles have a Jaccard similarity of at
    least `threshold`; equal texts with words are linked. A text of one to four words is one shingle. Texts without
    words, null texts among them, link with nothing. kept: the row's doc_id is its class_id. Null doc_ids take the
    group's smallest other id (null, and kept, if there is none); rows that repeat a doc_id are kept together. An empty
    table gives no rows.
    """
    base = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    base = base.withColumn("_key", text_key("_text"))

    @released
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, column="_text"):
            sig, has = sign(batch.column("_text"))
            band = mix64(np.cumsum(mix64(sig.reshape(len(sig), -1, BAND) + np.arange(BAND, dtype=np.uint64)), 2, dtype=np.uint64)[:, :, -1]).astype(np.int64)
            small = mix64(sig).astype(np.uint32)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * band.shape[1], pa.int32()), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_key"), pa.array(has), bands, pa.array([s.tobytes() for s in small], pa.binary())], names=["_doc", "_key", "has", "bands", "sig"])

    signed = materialize(base.select("_doc", "_text", "_key").mapInArrow(run, "_doc long, _key binary, has boolean, bands array<long>, sig binary"), f"{tag}-signed")
    classes = signed.filter("has").groupBy("_key").agg(F.min("_doc").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("_n"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), f"{tag}-classes")
    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("_top")).filter("hub <> _top").drop("_top")
    members = materialize(banded.join(hubs, ["band", "key"]), f"{tag}-members")
    star = materialize(members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), f"{tag}-star")
    agree = lambda x, y: int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) >= LEAST_AGREE
    near = _held(star, classes.select("id", F.col("sig").alias("x")), agree, f"{tag}-near")
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    alike = lambda x, y: jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold
    links = _held(near, _sets(ids, base, classes, tag), alike, f"{tag}-links")
    parts = components(links, tag)
    more = _cross(members, parts, classes, base, LEAST_AGREE, threshold, tag)
    if not more.isEmpty():
        parts = components(links.unionByName(more), tag)
    named = classes.select("id", "_key", "rep").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = named.groupBy("component").agg(F.min("rep").alias("low"))
    named = materialize(named.join(low, "component").select("_key", "low"), f"{tag}-named")
    out = spread_join(signed.select("_doc", "_key", "has"), named, "_key", classes.select("_key", "_n"))
    cls = F.when(F.col("has"), F.col("low")).otherwise(F.col("_doc"))
    return out.select(F.col("_doc").alias("doc_id"), cls.alias("class_id"), F.col("_doc").eqNullSafe(cls).alias("kept"), F.col("_key").alias("text_key"))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group of near-duplicates: the rows of docs with the group's smallest doc_id, all columns.

    Rows that repeat both doc_id and text stay once; rows of one kept doc_id with other texts all stay. Texts without
    words, null ones too, are near nothing and stay; an empty table gives no rows.
    """
    kept = near_duplicates(docs, threshold).filter("kept").select(F.struct("doc_id", "text_key").alias("_key")).distinct()
    kept = materialize(kept, "minhash-kept")
    key = F.struct("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key.alias("_key"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


ORACLE = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                 WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
    h AS (SELECT DISTINCT doc_id, hash(s) AS s FROM s),
    n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE p.c * 1.0 / (x.n + y.n - p.c) >= 0.8),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
    SELECT doc_id, class_id, doc_id = class_id AS kept FROM c"""
