"""Edit-aware token counts: a segment tree of pre-token counts for each document.

Leaves hold the characters and tokens of a pre-token, inner nodes their sums, the root the document's count. An edit
re-encodes the leaves it touches and as many before and after as the vocabulary's splitting pattern can look at, until
a boundary of the old text is met again; only the sums above those leaves change. A document's edits are applied in one
pass. Leaves can be kept as a table, so a later edit encodes nothing else anew.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches_of, table

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 200_000
DENSE = 48  # characters that the context of an edit may take: with more edits than that, a text is split as a whole
MAIL = re.compile(r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
DIGITS = re.compile(r"[0-9](?:[0-9 ().-]{4,30})[0-9]")

Edit = tuple[int, int, str]


def mask_personal_data(text: str) -> list[Edit]:
    """The production edits: mail addresses and long digit strings give way to tags; (start, end, replacement), in order."""
    found = [(*m.span(), "<mail>") for m in MAIL.finditer(text)] if "@" in text else []
    found += [(*m.span(), "<number>") for m in DIGITS.finditer(text)]
    out: list[Edit] = []
    for e in sorted(found):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each; the counts of frequent ones are kept."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > CACHE:
                self.known.clear()
            n = len(self.bpe.encode_ordinary(piece))
            if len(piece) < 64:
                self.known[piece] = n
        return n

    def whole(self, text: str) -> int:
        return len(self.bpe.encode_ordinary(text))


class TokenTree:
    """The token count of one document under edits.

    Leaves may be given as they were kept (characters and tokens of each); then nothing is encoded until an edit asks.
    """

    def __init__(self, text: str, counter: Counter, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.counter, self.reencoded = text, counter, 0
        if leaves is None:
            pieces = counter.pattern.findall(text)
            leaves = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(counter.count, pieces), np.int64, len(pieces))
        self.n_pieces = int((leaves[0] > 0).sum())
        self.leaves = 1 << max(0, len(leaves[0]) - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.leaves, np.int64) for _ in range(2))
        self.chars[self.leaves : self.leaves + len(leaves[0])] = leaves[0]
        self.tokens[self.leaves : self.leaves + len(leaves[0])] = leaves[1]
        self._sum(None)

    def _sum(self, touched: np.ndarray | None) -> None:
        """Subtree sums above these leaves, or all of them."""
        level = self.leaves
        nodes = None if touched is None else np.unique(touched + level)
        while level > 1:
            half = level >> 1
            at = np.arange(half, level) if nodes is None else np.unique(nodes >> 1)
            for a in (self.chars, self.tokens):
                a[at] = a[2 * at] + a[2 * at + 1]
            level, nodes = half, None if nodes is None else at

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that hold characters: what a table keeps of the tree."""
        chars, tokens = self.chars[self.leaves :], self.tokens[self.leaves :]
        return chars[chars > 0], tokens[chars > 0]

    def find(self, positions: np.ndarray) -> np.ndarray:
        """Where the leaves that hold these characters start: all descend from the root together."""
        node, start = np.ones(len(positions), np.int64), np.zeros(len(positions), np.int64)
        while len(node) and node[0] < self.leaves:
            left = self.chars[2 * node]
            right = positions >= start + left
            start += np.where(right, left, 0)
            node = 2 * node + right
        return start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) of the text."""
        self.apply([(start, end, new)])

    def apply(self, edits: list[Edit]) -> None:
        """Replace parts of the text: edits are in order, apart, and at places of the text as it is.

        The new text is put together once. Around each edit, pre-tokens are split anew from a safe place before it until
        one ends at a boundary that the old text had; their counts take the leaves' places, and the sums above change.
        """
        if not edits:
            return
        old, parts, at = self.text, [], 0
        for s, e, new in edits:
            parts += (old[at:s], new)
            at = e
        text = "".join([*parts, old[at:]])
        if not old or len(edits) * DENSE > len(old):  # hardly a leaf would stay
            self.__init__(text, self.counter)
            self.reencoded = self.n_pieces
            return
        begin, end, size = (np.fromiter(x, np.int64, len(edits)) for x in ((e[0] for e in edits), (e[1] for e in edits), (len(e[2]) for e in edits)))
        shift = np.cumsum(size - (end - begin))
        # a match before this leaf ends at least two characters before the edit: the pattern can't have seen the edit
        safe = self.find(np.clip(np.minimum(begin, len(old)) - 2, 0, None)).tolist()
        starts = np.cumsum(self.chars[self.leaves :]) - self.chars[self.leaves :]
        boundary = np.zeros(len(old) + 1, np.uint8)
        boundary[starts] = boundary[-1] = 1
        boundary, back = boundary.tobytes(), [0, *shift.tolist()]
        starts_new, end = (begin + np.r_[0, shift[:-1]]).tolist(), end.tolist()
        starts_new.append(len(text) + 1)
        find, count = self.counter.pattern.finditer, self.counter.count
        k, done, regions = 0, 0, []
        while k < len(edits):
            at = safe[k]
            while at > done and old[at - 1].isspace():
                at = int(self.find(np.array([at - 1]))[0])
            at = max(at, done)
            chars, tokens, stop, last = [], [], len(old), at + back[k]
            for m in find(text, last):
                e = m.end()
                chars.append(e - last)
                tokens.append(count(m.group()))
                last = e
                while starts_new[k + 1] <= e:  # the next edit lies in what was split
                    k += 1
                o = e - back[k + 1]
                if o >= end[k] and o > at and boundary[o]:
                    stop = o
                    break
            else:
                k = len(edits)
            regions.append((at, stop, chars, tokens))
            done, k = stop, k + 1
        # the leaves that start in a region give way; the last of them takes up what its pre-tokens exceed their number
        lo, hi = (np.searchsorted(starts, [r[i] for r in regions], "left") for i in (0, 1))
        hi[np.array([r[1] for r in regions]) == len(old)] = self.leaves
        touched = []
        for (_, _, chars, tokens), a, b in zip(regions, lo.tolist(), hi.tolist(), strict=True):
            self.reencoded += len(chars)
            for tree, own in ((self.chars, chars), (self.tokens, tokens)):
                if len(own) > b - a:
                    own = [*own[: b - a - 1], sum(own[b - a - 1 :])]
                tree[self.leaves + a : self.leaves + a + len(own)] = own
                tree[self.leaves + a + len(own) : self.leaves + b] = 0
            touched.append(np.arange(a, b))
        self._sum(np.concatenate(touched))
        self.text = text


KEPT = "chars binary, tokens binary"


def _counted(docs: DataFrame, vocabulary: str, pattern: str, edits: Callable[[str], list[Edit]], kept: bool) -> DataFrame:
    names = ["doc_id", "n_tokens", "n_edits", "edited_tokens", "n_pieces", "reencoded"]
    given = "chars" in docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, pattern)
        for batch in batches_of(it):
            rows, trees = [], []
            own = [batch.column(c).to_pylist() for c in ("chars", "tokens")] if given else [[None] * batch.num_rows] * 2
            for text, *leaves in zip(batch.column("text").to_pylist(), *own, strict=True):
                tree = TokenTree(text or "", counter, tuple(np.frombuffer(x, "<i4") for x in leaves) if given else None)
                before, n, found = tree.total, tree.n_pieces, edits(text or "")
                tree.apply(found)
                rows.append((before, len(found), tree.total, n, tree.reencoded))
                if kept:
                    trees.append((None if text is None else tree.text, *(x.astype("<i4").tobytes() for x in tree.kept())))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            cols = [batch.column("doc_id").cast(pa.int64()), *cols]
            if kept:
                more = list(zip(*trees, strict=True)) if trees else [[]] * 3
                cols += [pa.array(c, t) for c, t in zip(more, (pa.string(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *["text", "chars", "tokens"] * kept])

    read = docs.select("doc_id", "text", *["chars", "tokens"] * given)
    return read.mapInArrow(run, ", ".join(f"{c} long" for c in names) + f", text string, {KEPT}" * kept)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, edits: Callable[[str], list[Edit]] = mask_personal_data) -> DataFrame:
    """(doc_id, n_tokens, n_edits, edited_tokens, n_pieces, reencoded) for every row of docs (doc_id, text).

    n_tokens counts the text as it is, edited_tokens after the edits; reencoded is how many pre-tokens the edits had
    encoded anew. Null and empty texts have no tokens; doc_ids may be null or repeat; an empty table gives no rows.
    """
    return _counted(docs.select("doc_id", "text"), vocabulary, pattern, edits, False)


def token_trees(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text, chars, tokens, n_tokens) for every row of docs (doc_id, text): the leaves of each document's tree,
    characters and tokens of its pre-tokens as little-endian 32-bit integers, to be written as a table."""
    out = _counted(docs.select("doc_id", "text"), vocabulary, pattern, lambda text: [], True)
    return out.select("doc_id", "text", "chars", "tokens", "n_tokens")


def edited_trees(trees: DataFrame, vocabulary: str, pattern: str, edits: Callable[[str], list[Edit]] = mask_personal_data) -> DataFrame:
    """token_trees' columns after the edits, with token_counts' ones. Only what the edits touch is encoded."""
    return _counted(trees, vocabulary, pattern, edits, True).select("doc_id", "text", "chars", "tokens", "n_tokens", "n_edits", "edited_tokens", "n_pieces", "reencoded")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
