"""Vectorised read kernels over Arrow string arrays; all results are positions, so no string crosses back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 8192


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ASCII strings as a zero-padded matrix (reads x longest), and their lengths; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], "<i8", n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    lens = np.diff(offsets)
    if column.null_count:
        lens = np.where(np.asarray(column.is_valid()), lens, 0)
    wide = int(lens.max(initial=0))
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    at = np.arange(wide)[None, :]
    out = raw[np.minimum(offsets[:-1, None] + at, len(raw) - 1)]
    out[at >= lens[:, None]] = 0
    return out, lens.astype(np.int64)


def window(m: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The matrix of the pieces [start, stop) of each row."""
    size = stop - start
    at = np.arange(int(size.max(initial=0)), dtype=np.int32)[None, :]
    if not m.shape[1]:
        return np.zeros((len(m), at.shape[1]), np.uint8)
    if not start.any():
        return np.where(at < size[:, None], m[:, : at.shape[1]], np.uint8(0))
    out = np.take_along_axis(m, np.minimum(start[:, None] + at, m.shape[1] - 1), 1)
    out[at >= size[:, None]] = 0
    return out


def flipped(m: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each row's bytes from its end to its start."""
    if not m.shape[1]:
        return m
    out = np.ascontiguousarray(m[:, ::-1])
    rows = np.flatnonzero(lens != m.shape[1])
    if len(rows):
        at = lens[rows, None] - 1 - np.arange(m.shape[1])[None, :]
        part = np.take_along_axis(m[rows], np.maximum(at, 0), 1)
        part[at < 0] = 0
        out[rows] = part
    return out


def _sums(wide: int) -> type:
    """Small integers for running sums over reads of this length."""
    return np.int16 if wide < 120 else np.int32


def quality_keep(qual: np.ndarray, lens: np.ndarray, cutoff: int, offset: int = 33, seq: np.ndarray | None = None) -> np.ndarray:
    """How many bases the 3' quality trim keeps; with `seq`, a G counts +1 whatever its quality (two-colour chemistry).

    Sums cutoff - quality from the 3' end until the sum is negative; cuts where it first is largest, if positive."""
    if not qual.shape[1]:
        return lens.copy()
    add = cutoff - np.maximum(flipped(qual, lens).astype(_sums(qual.shape[1])) - offset, 0)
    if seq is not None:
        add = np.where(flipped(seq, lens) == ord("G"), 1, add)
    run = np.cumsum(add, 1, dtype=add.dtype)
    over = np.logical_or.accumulate(run < 0, 1) | (np.arange(run.shape[1])[None, :] >= lens[:, None])
    run[over] = 0
    at = run.argmax(1)
    best = run[np.arange(len(run)), at]
    return np.where(best > 0, lens - 1 - at, lens)


def homopolymer(seq: np.ndarray, lens: np.ndarray, base: str, head: bool = False) -> np.ndarray:
    """Length of the homopolymer at the 3' end (or, `head`, at the 5' end): 0 if under 3.

    +1 for a match, -2 otherwise; the first best score counts among places with at most a fifth of mismatches."""
    if seq.shape[1] < 3:
        return np.zeros(len(seq), np.int64)
    m = seq if head else flipped(seq, lens)
    hit = m == ord(base)
    inside = np.arange(m.shape[1])[None, :] < lens[:, None]
    kind = _sums(m.shape[1])
    score = np.cumsum(np.where(hit, kind(1), kind(-2)), 1, dtype=kind)
    ok = inside & (np.cumsum(~hit, 1, dtype=kind) * kind(5) <= np.arange(1, m.shape[1] + 1, dtype=kind)[None, :])
    score = np.where(ok, score, 0)
    at = score.argmax(1)
    n = np.where(score[np.arange(len(score)), at] > 0, at + 1, 0)
    return np.where((n >= 3) & (lens >= 3), n, 0)


def error_budget(length: int, rate: float) -> int:
    return length * round(rate * 1_000_000) // 1_000_000


def align(seq: np.ndarray, lens: np.ndarray, adapter: str, rate: float, min_overlap: int) -> np.ndarray:
    """Semi-global matches of a 3' adapter: rows (read_start, read_end, overlap, errors), -1 where there is none.

    One column of unit-cost distances and of the start places they lead back to, for BLOCK reads at a time. Start
    places move along diagonal, then deletion, then insertion, which is what a backtrace of that preference finds.
    """
    out = np.full((len(seq), 4), -1, np.int32)
    if not adapter or min_overlap < 1 or not seq.shape[1]:
        return out
    pieces = _pieces(adapter, rate)
    for at in range(0, len(seq), BLOCK):
        m, n, own = seq[at : at + BLOCK], lens[at : at + BLOCK], out[at : at + BLOCK]
        if pieces is None:
            own[:] = _align(m, n, adapter, rate, min_overlap)
            continue
        near = np.zeros(len(m), bool)
        for p in pieces:
            near |= _holds(m, p)
        rest = np.flatnonzero(~near)
        own[rest] = _exact_end(m[rest], n[rest], adapter, min_overlap)
        near = np.flatnonzero(near)
        own[near] = _align(m[near], n[near], adapter, rate, min_overlap)
    return out


def _pieces(adapter: str, rate: float) -> list[bytes] | None:
    """Pieces of the adapter of which every match but an exact one at the read's end holds one unchanged.

    A match with k errors covers at least the shortest prefix that allows k; cut into k + 1 pieces, that prefix keeps one of
    them. None if pieces would be too short to tell anything."""
    out = {adapter.encode()}  # an exact full match
    for k in range(1, error_budget(len(adapter), rate) + 1):
        n = next(i for i in range(1, len(adapter) + 1) if error_budget(i, rate) >= k)
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        out |= {adapter[a:b].encode() for a, b in zip(cuts, cuts[1:], strict=False)}
    least = min(map(len, out))
    return None if least < 4 else [p for p in out if not any(q != p and q in p for q in out)]


def _holds(m: np.ndarray, piece: bytes) -> np.ndarray:
    """Which rows hold these bytes; padding is no base, so a hit lies within the read."""
    n = m.shape[1] - len(piece) + 1
    if n <= 0:
        return np.zeros(len(m), bool)
    hit = m[:, :n] == piece[0]
    for i, b in enumerate(piece[1:], 1):
        hit &= m[:, i : i + n] == b
    return hit.any(1)


def _exact_end(m: np.ndarray, lens: np.ndarray, adapter: str, min_overlap: int) -> np.ndarray:
    """Matches without errors of a prefix of the adapter with the end of the read, the longest first."""
    k = len(adapter)
    tail = flipped(m, lens)[:, : min(k, m.shape[1])]
    out = np.full((len(m), 4), -1, np.int32)
    open_ = np.ones(len(m), bool)
    for i in range(min(k, m.shape[1]), min_overlap - 1, -1):
        hit = open_ & (lens >= i)
        for j in range(i):
            hit &= tail[:, j] == ord(adapter[i - 1 - j])
        out[hit] = np.stack((lens - i, lens, np.full(len(m), i), np.zeros(len(m))), 1)[hit]
        open_ &= ~hit
    return out


def _align(seq: np.ndarray, lens: np.ndarray, adapter: str, rate: float, min_overlap: int) -> np.ndarray:
    rows, wide, m = len(seq), int(lens.max(initial=0)), len(adapter)
    out = np.full((rows, 4), -1, np.int32)
    if not wide:
        return out
    cols = np.ascontiguousarray(seq[:, :wide].T)
    code = np.frombuffer(adapter.encode(), np.uint8)
    dp = np.repeat(np.arange(m + 1, dtype=np.int16)[:, None], rows, 1)
    st = np.zeros((m + 1, rows), np.int16)
    end_dp, end_st = np.repeat(np.arange(m + 1, dtype=np.int16)[:, None], rows, 1), np.zeros((m + 1, rows), np.int16)
    last = np.full((wide + 1, rows), m, np.int16)  # the last row of distances
    full_j, full_s = np.full(rows, -1, np.int32), np.zeros(rows, np.int32)
    budget = error_budget(m, rate)
    ends = np.argsort(lens, kind="stable")
    stops = np.searchsorted(lens[ends], np.arange(wide + 2))
    for j in range(1, wide + 1):
        up_dp, up_st = np.zeros(rows, np.int16), np.full(rows, j, np.int16)
        diag_dp, diag_st = dp[0].copy(), st[0].copy()
        dp[0], st[0] = up_dp, up_st
        miss = cols[j - 1][None, :] != code[:, None]
        for i in range(1, m + 1):
            left_dp, left_st = dp[i].copy(), st[i].copy()
            d, u, le = diag_dp + miss[i - 1], up_dp + 1, left_dp + 1
            best = np.minimum(np.minimum(d, u), le)
            where = np.where(best == d, diag_st, np.where(best == u, up_st, left_st))
            dp[i], st[i] = best, where
            diag_dp, diag_st, up_dp, up_st = left_dp, left_st, best, where
        last[j] = dp[m]
        hit = (dp[m] <= budget) & (full_j < 0) & (lens >= j)
        full_j[hit], full_s[hit] = j, st[m][hit]
        done = ends[stops[j] : stops[j + 1]]  # reads that end here
        end_dp[:, done], end_st[:, done] = dp[:, done], st[:, done]
    full = full_j >= 0
    natural = full_s + m
    r = np.arange(rows)
    at_j, at_n = last[np.maximum(full_j, 0), r], last[np.minimum(natural, wide), r]
    fits = natural <= lens
    full_err = np.where(fits & (at_n <= budget), np.minimum(at_n, at_j), at_j)
    full_end = np.where(fits & (at_n <= at_j), natural, full_j)
    part_o, part_s, part_e = np.full(rows, -1, np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    for i in range(m, min_overlap - 1, -1):
        hit = (part_o < 0) & (lens >= i) & (end_dp[i] <= error_budget(i, rate))
        part_o[hit], part_s[hit], part_e[hit] = i, end_st[i][hit], end_dp[i][hit]
    part = part_o >= 0
    use_full = full & (~part | (full_s <= part_s))
    out[use_full] = np.stack((full_s, full_end, np.full(rows, m), full_err), 1)[use_full]
    use = part & ~use_full
    out[use] = np.stack((part_s, lens, part_o, part_e), 1)[use]
    return out


def minimizer(seq: np.ndarray, lens: np.ndarray, k: int = 16) -> np.ndarray:
    """The smallest canonical 2-bit 16-mer of each read; short reads are padded with A, other letters count as A."""
    wide = max(seq.shape[1], k)
    two = np.zeros(256, np.uint32)
    for i, b in enumerate("ACGT"):
        two[ord(b)] = two[ord(b.lower())] = i
    code = np.zeros((len(seq), wide), np.uint32)
    code[:, : seq.shape[1]] = two[seq]
    fwd, rc, span = code, np.uint32(3) - code, 1
    while span < k:
        shift = np.uint32(2 * span)
        fwd, rc = (fwd[:, :-span] << shift) | fwd[:, span:], rc[:, :-span] | (rc[:, span:] << shift)
        span *= 2
    both = np.minimum(fwd, rc).astype(np.int64)
    both[np.arange(both.shape[1])[None, :] > np.maximum(lens - k, 0)[:, None]] = 1 << 40
    return both.min(1) if len(both) else np.zeros(0, np.int64)


def trim_ns(seq: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece without Ns at either end; of Ns alone nothing is left."""
    m, size = window(seq, start, stop), stop - start
    at = np.arange(m.shape[1])[None, :]
    solid = (m != ord("N")) & (m != ord("n")) & (at < size[:, None])
    if not m.shape[1]:
        return start, stop
    any_ = solid.any(1)
    first, last = solid.argmax(1), m.shape[1] - solid[:, ::-1].argmax(1)
    return np.where(any_, start + first, start), np.where(any_, start + last, start)


def trim(seq: np.ndarray, qual: np.ndarray, lens: np.ndarray, c, side: int) -> dict[str, np.ndarray | list]:
    """All steps of the per-read pipeline, in their fixed order, as pieces [start, stop) of the original read."""
    n = len(seq)
    start, stop = np.zeros(n, np.int64), lens.copy()
    if c.quality_cutoff > 0:
        stop = quality_keep(qual, lens, c.quality_cutoff, c.phred, seq if c.two_colour else None)
    quality_bp = lens - stop
    adapters = c.adapters_r2 if side == 2 and c.adapters_r2 else c.adapters
    events: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(stop > 0)
    for _ in range(c.times):
        if not len(live):
            break
        best = np.full(len(live), np.iinfo(np.int32).max)
        which = np.full(len(live), -1)
        piece = window(seq[live], start[live], stop[live])
        for k, (_, s) in enumerate(adapters):
            hit = align(piece, stop[live], s, c.error_rate, c.stringency)[:, 0] if s else np.full(len(live), -1)
            better = (hit >= 0) & (hit < best)
            best[better], which[better] = hit[better], k
        found = which >= 0
        live, best, which = live[found], best[found].astype(np.int64), which[found]
        events.append((live, which, stop[live] - best))
        stop[live] = best
        live = live[best > 0]
    had = np.zeros(n, bool)
    for rows, _, _ in events:
        had[rows] = True
    after_adapter = stop - start
    size = stop - start
    rrbs3, rrbs5 = np.zeros(n, bool), np.zeros(n, bool)
    if c.rrbs and c.non_directional:
        head = window(seq, start, np.minimum(stop, start + 3))
        if head.shape[1] == 3:
            rrbs5 = (size > 2) & (head[:, 0] == ord("C")) & ((head[:, 1] == ord("A")) | (head[:, 1] == ord("G"))) & (head[:, 2] == ord("A"))
        rrbs3 = (size > 2) & ~rrbs5 & had
    elif c.rrbs:
        rrbs3 = (size >= 2) & had & (not (c.paired and side == 2))
    start, stop = start + 2 * rrbs5, stop - 2 * rrbs3
    poly_a = np.zeros(n, np.int64)
    if c.poly_a:
        piece = window(seq, start, stop)
        poly_a = homopolymer(piece, stop - start, "T" if side == 2 else "A", head=side == 2)
        start, stop = (start + poly_a, stop) if side == 2 else (start, stop - poly_a)
    poly_g = np.zeros(n, np.int64)
    if c.poly_g:
        poly_g = homopolymer(window(seq, start, stop), stop - start, "G")
        stop = stop - poly_g
    if c.trim_n and not c.rrbs:
        start, stop = trim_ns(seq, start, stop)
    five, three = (c.clip_r2, c.three_prime_clip_r2) if side == 2 else (c.clip_r1, c.three_prime_clip_r1)
    clip5 = np.where(stop - start > five, five, 0) if five else np.zeros(n, np.int64)
    start = start + clip5
    clip3 = np.where(stop - start > three, three, 0) if three else np.zeros(n, np.int64)
    stop = stop - clip3
    rows = np.concatenate([e[0] for e in events]) if events else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    cut = np.searchsorted(rows[order], np.arange(n + 1))
    idx = np.concatenate([e[1] for e in events])[order] if events else rows
    removed = np.concatenate([e[2] for e in events])[order] if events else rows
    matches = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(removed, pa.int32())], ["adapter_idx", "removed"]))
    return {
        "start": start, "stop": stop, "quality_bp": quality_bp, "after_adapter": after_adapter, "matches": matches, "rrbs3": rrbs3, "rrbs5": rrbs5,
        "poly_a_bp": poly_a, "poly_g_bp": poly_g, "clip5": clip5, "clip3": clip3,
    }
