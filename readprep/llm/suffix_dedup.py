"""Suffix-array dedup: removes the bytes of 100-byte strings that start earlier in the corpus.

A string's shard is its minimizer, the smallest hash among its grams of GRAM bytes, so all occurrences of a string meet
in one shard wherever they stand. Consecutive strings of one minimizer make a segment of text. Minimizers that occur
once in the corpus hold no repeats and stay where they are; the segments of the others are dealt out by minimizer.
There a suffix array of the segments is built by induced sorting: the suffixes at LMS places are sorted first, by
names of their LMS substrings, all others are induced bucket by bucket through queues. Neighbouring suffixes are
compared to a common prefix of LENGTH bytes; of each group of equal strings all but the first are repeats.

The order of a shard's suffixes, which holds the queues, is a file in the task's temporary folder where it takes more
than MEMORY bytes; the other arrays are in memory. A minimizer with more than HOT segments, or more than HOT_BYTES in
them, isn't gathered: its strings are counted one by one, by hash, with the first place of each. Equal
texts are one document first: every copy but the first is removed whole, or kept if it has under LENGTH bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialize, mix64, released, shuffle_parts, spread_join, table, text_bytes

LENGTH = 100
GRAM = 24
SHARD = 3 << 20
MEMORY = 96 << 20
HOT = 20_000
HOT_BYTES = 4 << 20  # only periodic segments are longer than 2 * LENGTH - GRAM bytes, so others reach HOT first
PIECE = 4096  # strings of a long segment that are looked at at once
_NONE = np.uint64(np.iinfo(np.uint64).max)
LAST = (1 << 63) - 1
KEY = ["ord", "h", "g"]  # of a text: doc_id, and 128 bits of hashes that tell texts of one id, and equal texts, apart
KEYS = ", ".join(f"{c} long" for c in KEY)


# ------------------------------------------------------------------ minimizers


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of the gram at each byte; no gram crosses the end of its text."""
    n = len(raw)
    out = np.full(n, _NONE, np.uint64)
    if n >= GRAM:
        words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(raw).data, 0, (1,))
        acc = words[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, GRAM, 8):
            acc = (acc ^ (acc >> np.uint64(29))) + words[k : n - GRAM + 1 + k] * np.uint64(0xC2B2AE3D27D4EB4F)
        out[: n - GRAM + 1] = mix64(acc) >> np.uint64(1)
    for k in range(1, GRAM):  # the last grams of a text
        at = offsets[1:] - k
        out[at[(at >= 0) & (at >= offsets[:-1])]] = _NONE
    return out


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, most: int = 8 << 20) -> tuple[np.ndarray, ...]:
    """As _segments, for `most` bytes at a time: a long text is cut where a string starts, and its pieces overlap."""
    if len(raw) <= most:
        return _segments(raw, offsets, length)
    out = []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, b - length + 1, most):
            piece = raw[at : min(at + most + length - 1, b)]
            _, start, end, m, multi = _segments(piece, np.array([0, len(piece)]), length)
            out.append((np.full(len(start), row), start + at, end + at, m, multi))
    if not out:
        return _segments(raw[:0], np.zeros(1, np.int64), length)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, minimizer, multi): strings that start in [start, end) share a minimizer; starts are places in
    `raw`. multi: the minimizer's gram occurs more than once in the segment, so it may hold repeats of its own."""
    w, g = length - GRAM + 1, grams(raw, offsets)
    n = len(g) - w + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    low, span = g, 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    low = low[:n].copy()
    # strings that would cross the end of their text
    size = np.diff(offsets)
    stop = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    valid = np.zeros(len(raw) + 1, np.int32)
    np.add.at(valid, offsets[:-1][size > 0], 1)
    np.add.at(valid, stop[size > 0], -1)
    valid = np.cumsum(valid[:n]) > 0
    new = np.r_[True, low[1:] != low[:-1]]
    new[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(new & valid)
    over = np.flatnonzero(new | ~valid)
    nxt = np.searchsorted(over, start, "right")
    end = np.where(nxt < len(over), np.r_[over, n][np.minimum(nxt, len(over))], n)
    m = low[start]
    multi = np.zeros(len(start), bool)
    for at in range(0, len(start), 1 << 16):
        s, e, v = (x[at : at + (1 << 16)] for x in (start, end, m))
        a, b = ((g[p[:, None] + np.arange(w)[None, :]] == v[:, None]) for p in (s, e - 1))
        multi[at : at + (1 << 16)] = (e - s > w) | (a.sum(1) > 1) | (b.sum(1) > 1) | (a.argmax(1) + s != b.argmax(1) + e - 1)
    return np.searchsorted(offsets, start, "right") - 1, start, end, m, multi


# ------------------------------------------------------------------ induced sorting


class Space:
    """Arrays in memory, or in files of a temporary folder when together they would take more than `memory` bytes."""

    def __init__(self, memory: int):
        self.left, self.folder, self.files = memory, None, 0

    def new(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not size:
            self.left -= size
            return np.empty(n, kind)
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        self.files += 1
        return np.memmap(f"{self.folder.name}/{self.files}", kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


class Induction:
    """Induced sorting of a text of characters 0..sigma-1 by bucket queues.

    A queue holds the suffixes of one first character in sorted order. Taking a queue's entries in order and appending
    to the queue of its character each predecessor of the right type keeps all queues sorted. Work goes a batch of a
    queue at a time; a batch that appends to its own queue is followed by one of what it appended.
    """

    STEP = 1 << 20

    def __init__(self, text: np.ndarray, sigma: int, space: Space):
        self.text, self.sigma, self.space = text, sigma, space
        n = len(text)
        up = np.r_[text[:-1] < text[1:], True]
        change = np.r_[text[:-1] != text[1:], True]
        at = np.where(change, np.arange(n), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        self.small = up[nearest]  # S-type: smaller than the suffix after it
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.counts = np.bincount(text, minlength=sigma)
        self.larges = np.bincount(text[~self.small], minlength=sigma)
        self.begin = np.r_[0, np.cumsum(self.counts)][:-1]
        self.order = space.new(n, np.int32)

    def _append(self, sources: np.ndarray, small: bool, fill: np.ndarray, step: int) -> None:
        before = sources[sources > 0] - 1
        before = before[self.small[before] == small]
        chars = self.text[before]
        by = np.argsort(chars, kind="stable")
        n = np.bincount(chars, minlength=self.sigma)
        first = np.r_[0, np.cumsum(n)][:-1]
        self.order[np.repeat(fill - step * first, n) + step * np.arange(len(before))] = before[by]
        fill += step * n

    def run(self, sorted_lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, given those at LMS places in order (by bucket at least)."""
        chars = self.text[sorted_lms]
        by = np.argsort(chars, kind="stable")
        parts = np.split(sorted_lms[by], np.cumsum(np.bincount(chars, minlength=self.sigma))[:-1])
        fill = self.begin.copy()
        last = len(self.text) - 1
        if not self.small[last]:
            raise ValueError("the text doesn't end in its smallest character")
        for c in range(self.sigma):
            done = self.begin[c]
            while done < fill[c]:
                upto = min(fill[c], done + self.STEP)
                self._append(np.array(self.order[done:upto]), False, fill, 1)
                done = upto
            if len(parts[c]):
                self._append(parts[c], False, fill, 1)
        fill = self.begin + self.counts - 1
        self.order[fill[self.text[last]]] = last
        fill[self.text[last]] -= 1
        for c in range(self.sigma - 1, -1, -1):
            done, low = self.begin[c] + self.counts[c] - 1, self.begin[c] + self.larges[c]
            while done > fill[c]:
                upto = max(fill[c], done - self.STEP)
                self._append(np.array(self.order[upto + 1 : done + 1])[::-1], True, fill, -1)
                done = upto
            for at in range(low, self.begin[c], -self.STEP):
                self._append(np.array(self.order[max(self.begin[c], at - self.STEP) : at])[::-1], True, fill, -1)
        return self.order


def _names(text: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order, equal for equal substrings and in the substrings' order."""
    n = len(text)
    size = np.diff(np.r_[lms, n - 1]) + 1
    where = np.zeros(n, np.int64)
    where[lms] = np.arange(len(lms))
    a, b = ordered[:-1], ordered[1:]
    sa, sb = size[where[a]], size[where[b]]
    same = sa == sb
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        ok = text[a[open_] + k] == text[b[open_] + k]
        same[open_[~ok]] = False
        k += 1
        open_ = open_[ok]
        open_ = open_[sa[open_] > k]
    names = np.cumsum(np.r_[0, ~same])
    out = np.zeros(len(lms), np.int64)
    out[where[ordered]] = names
    return out


def suffix_array(text: np.ndarray, sigma: int, depth: int, space: Space | None = None) -> np.ndarray:
    """The suffixes of `text` (its last character is 0) in order of their first `depth` characters at least."""
    space = space or Space(1 << 62)
    work = Induction(text, sigma, space)
    lms = work.lms
    if len(lms) > 1:
        first = work.run(lms)
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        names = _names(text, np.concatenate([x[is_lms[x]] for x in (np.array(first[i : i + Induction.STEP]) for i in range(0, len(first), Induction.STEP))]), lms)
        # the recursion: suffixes of the string of names; a name stands for two characters or more, and ranks of 2k
        # names follow from those of k
        k, rank = 1, names
        while rank.max() + 1 < len(rank) and k * 2 < depth + 2:
            ahead = np.r_[rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)][: len(rank)]
            key = rank * (len(rank) + 2) + ahead
            by = np.argsort(key)
            s = key[by]
            rank = np.empty_like(rank)
            rank[by] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
            k *= 2
        lms = lms[np.argsort(rank, kind="stable")]
    return work.run(lms)


def repeats(text: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, space: Space | None = None) -> np.ndarray:
    """Places in `text` of strings of `length` bytes that start at an earlier place as well.

    Segment k holds the strings that start in [starts[k], ends[k]); segments stand apart in text, in order."""
    raw = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    sizes = ends - starts + length - 1
    out_at = np.cumsum(np.r_[0, sizes + 1])
    n = int(out_at[-1])
    sigma = 2 + int(raw.max(initial=0))  # UTF-8 has no byte 255, so characters of 8 bits do, which sort in one pass
    own = np.zeros(n + 1, np.uint8 if sigma <= 256 else np.int16)
    shift = np.repeat(starts - out_at[:-1], sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    own[at] = raw[at + shift].astype(own.dtype) + 1
    flag = np.zeros(n + 1, bool)
    np.add.at(edge := np.zeros(n + 2, np.int32), out_at[:-1], 1)
    np.add.at(edge, out_at[:-1] + (ends - starts), -1)
    flag[:] = np.cumsum(edge[: n + 1]) > 0
    order = suffix_array(own, sigma, length, space)
    order = np.concatenate([x[flag[x]] for x in (np.array(order[i : i + (1 << 20)]) for i in range(0, len(order), 1 << 20))])
    if len(order) < 2:
        return np.zeros(0, np.int64)
    data = (own[:-1] - 1).astype(np.uint8)
    data = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    open_ = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:  # the common prefix of neighbours, 8 bytes at a time
        open_ = open_[words[order[open_] + k] == words[order[open_ + 1] + k]]
    equal = np.zeros(len(order), bool)
    equal[open_ + 1] = True
    first = np.flatnonzero(~equal)
    lowest = np.repeat(np.minimum.reduceat(order, first), np.diff(np.r_[first, len(order)]))
    found = np.sort(order[order != lowest])
    k = np.searchsorted(out_at, found, "right") - 1
    return found - out_at[k] + starts[k]


def runs(places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs [start, end) of bytes that strings at these sorted places cover."""
    if not len(places):
        return places, places
    first = np.flatnonzero(np.r_[True, np.diff(places) > length])
    return places[first], places[np.r_[first[1:], len(places)] - 1] + length


# ------------------------------------------------------------------ the corpus


def _deal(texts: DataFrame, length: int) -> DataFrame:
    """Segments whose minimizer is in `wanted`: (kind 0, minimizer, KEY, start, bytes), the first in its task of
    equal ones; or (kind 1, KEY, start, stop): bytes of a segment that an earlier one in the task equals."""

    @released
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        known: dict[bytes, tuple[int, int, int, int]] = {}
        salt = lambda row: mix64(row.astype(np.uint64) + np.uint64(1))
        for batch in batches_of(it, 1 << 20, "z"):
            out: list[tuple] = []
            of_text = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            texts = [unpack.decompress(z) for z in batch.column("z").to_pylist()]
            data, offsets = b"".join(texts), np.cumsum(np.r_[0, [len(x) for x in texts]])
            row, start, end, m, _ = segments(np.frombuffer(data, np.uint8), offsets, length)
            wanted = batch.column("wanted")
            of = np.repeat(np.arange(len(of_text)), np.diff(np.asarray(wanted.offsets)))
            # a chance hit deals out a segment in vain, no more
            want = np.isin(m ^ salt(row), np.asarray(wanted.flatten()).view(np.uint64) ^ salt(of))
            row, start, end, m = row[want], start[want], end[want] + length - 1, m[want].astype(np.int64)
            place = start - offsets[row]
            for r, s, e, v, at in zip(row.tolist(), start.tolist(), end.tolist(), m.tolist(), place.tolist(), strict=True):
                piece = data[s:e]
                mark = hashlib.blake2b(piece, digest_size=16).digest()
                here = (*of_text[r], at)
                if (seen := known.get(mark)) is not None and seen < here:
                    out.append((1, None, *here, at + e - s, None))
                else:  # an earlier one: what was sent before it is found to repeat it in the shard
                    if len(known) < 400_000 or seen is not None:
                        known[mark] = here
                    out.append((0, v, *here, at + e - s, piece))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int8(), *[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "minimizer", *KEY, "start", "stop", "bytes"])

    return texts.mapInArrow(run, f"kind byte, minimizer long, {KEYS}, start long, stop long, bytes binary")


def _shards(dealt: DataFrame, length: int, memory: int) -> DataFrame:
    """(KEY, start, stop) of repeats among the segments; a task builds suffix arrays of whole minimizers in turn."""

    @released
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            places = [np.asarray(t.column(c)) for c in (*KEY, "start", "stop")]
            by = np.lexsort(places[3::-1])
            places = [x[by] for x in places]
            joined = t.column("bytes").combine_chunks().take(pa.array(by))
            code = np.asarray(joined.dictionary_encode().indices)
            first = np.diff(np.maximum.accumulate(code), prepend=-1) > 0  # codes are numbered as they come
            again = ~first  # equal to an earlier segment as a whole
            whole = [x[again] for x in places]
            *text, start, stop = (x[first] for x in places)
            raw, offsets = text_bytes(joined.filter(pa.array(first)))
            space = Space(memory)
            found = repeats(raw, offsets[:-1], offsets[:-1] + (stop - start) - length + 1, length, space)
            space.close()
            k = np.searchsorted(offsets, found, "right") - 1
            # runs within a segment
            new = np.flatnonzero(np.r_[True, (np.diff(found) > length) | (np.diff(k) > 0)]) if len(found) else np.zeros(0, int)
            last = np.r_[new[1:], len(found)] - 1 if len(found) else new
            seg, a, b = k[new], found[new], found[last] + length
            shift = start[seg] - offsets[seg]
            cols = [np.concatenate(x) for x in zip(whole, (*(x[seg] for x in text), a + shift, b + shift), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[*KEY, "start", "stop"])

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in it:
            m = np.asarray(batch.column("minimizer"))
            width = np.asarray(batch.column("stop")) - np.asarray(batch.column("start"))
            cut = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else []
            for a, b in zip(cut, [*cut[1:], len(m)], strict=True):
                if size > SHARD and m[a] != last:
                    yield of(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(width[a:b].sum())
                last = m[a]
        if held:
            yield of(held)

    by = dealt.repartition(shuffle_parts(dealt), "minimizer").sortWithinPartitions("minimizer")
    return by.select("minimizer", *KEY, "start", "stop", "bytes").mapInArrow(run, f"{KEYS}, start long, stop long")


def _hot(dealt: DataFrame, length: int) -> DataFrame:
    """(KEY, start, stop) of repeats among segments of very frequent minimizers: every string by its hash, its first
    place by an aggregate that is combined before the shuffle; all other places are repeats."""

    @released
    def strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches_of(it, 256 << 10, "bytes"):
            for batch in cut(whole):
                yield each_of(batch)

    def cut(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        held, size = [], 0
        for *text, start, p in zip(*(batch.column(c).to_pylist() for c in (*KEY, "start", "bytes")), strict=True):
            for at in range(0, len(p) - length + 1, PIECE):
                held.append((*text, start + at, p[at : at + PIECE + length - 1]))
                size += len(held[-1][-1])
                if size > 256 << 10:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def each_of(batch: list[tuple]) -> pa.RecordBatch:
        *places, pieces = zip(*batch, strict=True)
        n = np.array([len(p) - length + 1 for p in pieces])
        marks = [hashlib.blake2b(p[i : i + length], digest_size=16).digest() for p in pieces for i in range(len(p) - length + 1)]
        *text, start = (np.repeat(np.array(x, np.int64), n) for x in places)
        at = start + np.arange(len(marks)) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays([*map(pa.array, text), pa.array(start), pa.array(at), pa.array(marks, pa.binary())], names=[*KEY, "segment", "at", "mark"])

    each = dealt.select(*KEY, "start", "bytes").mapInArrow(strings, f"{KEYS}, segment long, at long, mark binary")
    first = each.groupBy(F.hex("mark").alias("mark")).agg(F.min(F.struct(*KEY, "at", "segment")).alias("x")).select(*[f"x.{c}" for c in KEY], F.col("x.segment").alias("start"), F.col("x.at").alias("at"))
    kept = first.groupBy(*KEY, "start").agg(F.collect_list("at").alias("kept"))
    starts = F.sequence("start", F.col("stop") - length, F.lit(PIECE).cast("long"))
    all_ = dealt.select(*KEY, F.explode(starts).alias("start"), "stop").withColumn("stop", F.least("stop", F.col("start") + PIECE + length - 1))
    all_ = all_.join(kept, [*KEY, "start"], "left")
    places = F.array_except(F.sequence("start", F.col("stop") - length), F.coalesce("kept", F.array().cast("array<long>")))
    return all_.select(*KEY, F.explode(places).alias("start")).withColumn("stop", F.col("start") + length)


def dedup(docs: DataFrame, length: int = LENGTH, memory: int = MEMORY, hot: int = HOT, row: Column | None = None, with_text: bool = False, tag: str = "suffix") -> DataFrame:
    """(_row, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of docs (doc_id, text).

    Null text is empty. Earlier means a smaller doc_id (null: after all others). Rows that repeat both doc_id and text
    are one document and get the same result; rows that repeat a doc_id (null too) with another text are apart, in
    the order of their texts' hashes. Matches never cross documents, and strings are judged on the input. Empty tables give no rows. `row` is
    what to carry (default doc_id); `with_text` adds the bytes that remain.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), (F.col("doc_id") if row is None else row).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(1), "text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    @released
    def minimizers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it):
            row_, _, _, m, multi = segments(*text_bytes(batch.column("text")), length)
            by = np.lexsort((m, row_))
            row_, m, multi = row_[by], m[by], multi[by]
            first = np.flatnonzero(np.r_[True, (row_[1:] != row_[:-1]) | (m[1:] != m[:-1])]) if len(m) else np.zeros(0, int)
            many = np.add.reduceat(multi.astype(np.int64), first) + np.diff(np.r_[first, len(m)]) > 1 if len(m) else multi
            yield pa.RecordBatch.from_arrays([pa.array(m[first].astype(np.int64)), batch.column("h").take(pa.array(row_[first])), pa.array(many)], names=["minimizer", "h", "multi"])

    @released
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches_of(it):
            packed = [z.compress(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(packed, pa.binary())], names=[*KEY, "z"])

    long_ = base.filter(F.col("n_bytes") >= length)
    found = materialize(long_.select("text", "h").mapInArrow(minimizers, "minimizer long, h long, multi boolean"), f"{tag}-minimizers")
    several = found.groupBy("minimizer").agg(F.count(F.lit(1)).alias("_n"), F.min("h").alias("x"), F.max("h").alias("y"), F.max("multi").alias("z"))
    several = materialize(several.filter("x <> y or z").select("minimizer", "_n"), f"{tag}-shared")
    shared = spread_join(found.select("minimizer", "h"), several.select("minimizer"), "minimizer", several, "inner")
    wanted = materialize(shared.groupBy("h").agg(F.collect_set("minimizer").alias("wanted")), f"{tag}-wanted")  # as long as a text
    reps = materialize(base.groupBy("h", "g").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("_n")), f"{tag}-first")
    packed = long_.select(*KEY, "text").mapInArrow(pack, f"{KEYS}, z binary")
    want = wanted.join(reps, "h").select("h", "g", F.col("first").alias("ord"), "wanted")
    once = packed.join(want, KEY).dropDuplicates(KEY)  # else a repeated row would repeat itself
    dealt = materialize(_deal(once.select(*KEY, "z", "wanted"), length), f"{tag}-dealt")
    sent = dealt.filter("kind = 0")
    common = materialize(sent.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("size")).filter((F.col("n") > hot) | (F.col("size") > HOT_BYTES)).select("minimizer"), f"{tag}-hot")
    few = common.isEmpty()
    spans = _shards(sent if few else sent.join(common, "minimizer", "left_anti"), length, memory)
    if not few:
        spans = spans.unionByName(_hot(sent.join(common, "minimizer", "left_semi"), length))
    spans = spans.unionByName(dealt.filter("kind = 1").select(*KEY, "start", "stop"))
    spans = materialize(spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), f"{tag}-spans")  # as long as a text

    @released
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in it:
            rows = []
            for *text, z, own in zip(*(batch.column(c).to_pylist() for c in (*KEY, "z")), batch.column("spans"), strict=True):
                data = unpack.decompress(z)
                a = np.stack([np.asarray(own.values.field(k)) for k in ("start", "stop")])
                a = a[:, np.argsort(a[0], kind="stable")]
                reach = np.maximum.accumulate(a[1])
                new = np.flatnonzero(np.r_[True, a[0][1:] > reach[:-1]])
                s, e = a[0][new], reach[np.r_[new[1:], a.shape[1]] - 1]
                kept, at = [], 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                rows.append((*text, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (*[pa.int64()] * 5, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*KEY, "_removed", "_spans", "_sha", "_kept"])

    again = packed.join(spans, KEY).select(*KEY, "z", "spans")
    cuts = materialize(again.dropDuplicates(KEY).mapInArrow(cut, f"{KEYS}, _removed long, _spans long, _sha string, _kept binary"), f"{tag}-cuts")
    info = reps.join(cuts.withColumnRenamed("ord", "first"), ["h", "g", "first"], "left")
    text_key, whole = F.struct("h", "g").alias("_text"), F.sha2("text", 256).alias("_whole")
    own = base.select("ord", text_key, "_row", "n_bytes", *["text"] * with_text, whole)
    rows = spread_join(own, info.select(text_key, "first", "_removed", "_spans", "_sha", "_kept"), "_text", reps.select(text_key, "_n"), "inner")
    copy = (F.col("ord") != F.col("first")) & (F.col("n_bytes") >= length)
    pick = lambda a, b, c: F.when(copy, a).when(F.col("_removed").isNotNull(), b).otherwise(c)
    cols = [
        pick(F.col("n_bytes"), F.col("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("_sha"), F.col("_whole")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(pick(F.lit(b""), F.col("_kept"), F.col("text").cast("binary")).alias("kept"))
    return rows.select("_row", "n_bytes", *cols)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, each text without its repeated bytes; a character cut in two goes as a whole, and
    n_chars, where there is one, follows. Texts that are untouched stay as they are, null ones too."""
    cols = docs.columns
    out = dedup(docs, row=F.struct(*[F.col(c) for c in cols]), with_text=True)

    @released
    def text(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kept = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("n_removed"), pa.array(kept, pa.string())], names=["_row", "n_removed", "kept"])

    out = out.select("_row", "n_removed", "kept")
    out = out.mapInArrow(text, out.drop("kept").schema.add("kept", "string"))
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row.text"))
    own = {"text": new} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("_row.n_chars")).cast("long")} if "n_chars" in cols else {})
    return out.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in cols])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).withColumnRenamed("_row", "doc_id")


ORACLE = """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
    p AS (SELECT doc_id, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100),
    s AS (SELECT p.doc_id, p.i, array_slice(d.b, p.i, p.i + 99) AS s FROM p JOIN d USING (doc_id)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
    g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
    h AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
    c AS (SELECT doc_id, k, min(i) AS a, max(i) + 99 AS z FROM h GROUP BY doc_id, k),
    e AS (SELECT doc_id, 0 AS k, 0 AS a, 0 AS z FROM d UNION ALL SELECT doc_id, k, a, z FROM c),
    f AS (SELECT doc_id, z + 1 AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS upto, a, z FROM e),
    t AS (SELECT f.doc_id, string_agg(hex(array_slice(d.b, f.from_, coalesce(f.upto, d.n))), '' ORDER BY f.from_) AS kept,
                 sum(CASE WHEN f.z > 0 THEN f.z - f.a + 1 ELSE 0 END) AS removed, count(*) - 1 AS spans
          FROM f JOIN d ON d.doc_id = f.doc_id GROUP BY f.doc_id)
    SELECT d.doc_id, d.n AS n_bytes, CAST(t.removed AS BIGINT) AS n_removed, CAST(t.spans AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256
    FROM d JOIN t ON t.doc_id = d.doc_id"""
