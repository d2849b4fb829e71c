"""Packing documents into sequences of a fixed number of tokens: best-fit decreasing.

Overlong documents are first cut into full windows; every remainder is placed whole. Pieces of one length are
interchangeable, so best-fit decreasing runs over the counts of pieces by length (at most WINDOW numbers, whatever the
corpus) with a segment tree over remaining capacities that finds the tightest open window. Its plan says which ranks
of each length go to which windows; pieces are then numbered within their length and look their place up.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PARTS, batches_of, materialize, part_of, ranked, released, table

WINDOW = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, for a lower-case BPE vocabulary with word ends.

    Texts of Latin letters take a fast way: split by the vocabulary's own pattern, each pre-token closed by a byte of
    its own that plays the word-end mark, and merged in the order of the vocabulary's merges. All others, and texts
    that hold that byte or a special token, are encoded by the tokenizers library itself; the ids are the same.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        model, split = spec["model"], next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the pattern's classes, spelt out over the letters of the fast way; upper case is gone by then
        own = [chr(i) for i in range(0x180)]
        of = lambda kind: "".join(c for c in own if unicodedata.category(c)[0] == kind)
        self.split = re.compile(split.replace("\\p{L}", of("L")).replace("\\p{N}", of("N")).replace("\\s", "\t-\r \x85\xa0"))
        self.other = re.compile("[\x01\u0130\u0180-\U0010ffff]")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        end = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            closed = token.endswith(end)
            return bytes(back[c] for c in token.removesuffix(end)) + self.MARK.encode() * closed

        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + self.MARK.encode() for b in range(256) if b != 1]
        order += [raw(a) + raw(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.ids = np.array([ids[t] for t in order], "<u4")
        self.bpe = tiktoken.Encoding("word-ends", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if (not text.isascii() or self.MARK in text) and self.other.search(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.split.findall(text.lower())
        return self.ids[self.bpe.encode_ordinary(self.MARK.join(words) + self.MARK)].tobytes() if words else b""


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's ids with `end` after them, cut into full windows and a remainder of 1 to window - 1 ids."""

    @released
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches_of(it):
            rows, own = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), n))
                    own.append(piece)
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            names = PIECES.names
            if with_ids:
                cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


class Capacities:
    """Open windows by remaining capacity; a segment tree over 0..window counts them and finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[list[int]]] = {}

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.ranges.setdefault(capacity, []).append([first, count])
            self._count(capacity, count)

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least `need` that a window has; 0 if none."""
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return 0

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to `most` windows of this capacity: (first, count) of neighbours."""
        own = self.ranges[capacity]
        first, count = own[-1]
        got = min(most, count)
        if got == count:
            own.pop()
        else:
            own[-1] = [first + got, count - got]
        self._count(capacity, -got)
        return first, got


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, window_from, per_window, offset): pieces of that length with ranks in
    [rank_from, rank_to) fill windows from window_from on, per_window in each, from offset on."""
    open_, made, plan = Capacities(window), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = open_.tightest(length)
            if capacity:
                per = min(capacity // length, left)
                first, k = open_.take(capacity, left // per)
            else:
                capacity, per = window, min(window // length, left)
                k = left // per
                first, made = made, made + k
            plan.append((length, rank, rank + k * per, first, per, window - capacity))
            open_.add(capacity - per * length, first, k)
            rank, left = rank + k * per, left - k * per
    return plan


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Sequences of at most `window` ids: a row for each piece, with its sequence_id and offset there.

    Null and empty texts are a single `end`. Null doc_ids are kept, repeated rows are documents of their own, an empty
    table gives no rows. Every id of every text lies in exactly one piece; the pieces of a sequence leave no gap.
    `with_ids` adds each piece's ids as little-endian unsigned 32-bit numbers.
    """
    cut = materialize(pieces(docs, vocabulary, window, end, with_ids).withColumn("_part", part_of(F.coalesce("doc_id", F.lit(-1)), PARTS)), "pack-pieces")
    parts = materialize(cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "pack-lengths")
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `window` rows
    plan = sorted(best_fit_decreasing(counts, window), key=lambda x: (x[0], x[1]))
    keys = np.array([x[0] for x in plan], np.int64), np.array([x[1] for x in plan], np.int64)
    far = int(keys[1].max(initial=0)) + 1 + max(counts.values(), default=0)
    flat = np.array(plan, np.int64).reshape(-1, 6)
    if float(window) * far < 2**62:
        code = keys[0] * far + keys[1]
    else:
        raise ValueError("more pieces than ranks can number")
    shared = docs.sparkSession.sparkContext.broadcast((code, flat))  # its size depends on the window only

    @released
    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, flat = shared.value
        for batch in it:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "_rank"))
            row = flat[np.searchsorted(code, length * far + rank, "right") - 1] if len(length) else flat[:0]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // np.maximum(row[:, 4], 1), row[:, 5] + k % np.maximum(row[:, 4], 1) * length
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", parts)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "_rank"]
    return out.select(*cols).mapInArrow(place, schema + ", sequence_id long, offset long")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
