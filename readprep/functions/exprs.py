"""Catalyst-only column expressions of the read operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit, when = F.lit, F.when


def phred(qual: Column, pos: Column, offset: int) -> Column:
    return F.greatest(F.ascii(F.substring(qual, pos, lit(1))) - offset, lit(0))


def quality_keep(seq: Column, qual: Column, cutoff: int, offset: int = 33, two_colour: bool = False) -> Column:
    """Bases kept by the 3' quality trim: a fold over positions from the 3' end that stops adding once below zero."""
    n = F.length(qual)

    def step(a: Column, k: Column) -> Column:
        pos = n - k + 1
        add = lit(cutoff) - phred(qual, pos, offset)
        if two_colour:
            add = when(F.substring(seq, pos, lit(1)) == "G", 1).otherwise(add)
        run = a["run"] + add
        dead = a["dead"] | (run < 0)
        better = ~dead & (run > a["best"])
        return F.struct(run.alias("run"), dead.alias("dead"), when(better, run).otherwise(a["best"]).alias("best"), when(better, k).otherwise(a["cut"]).alias("cut"))

    zero = F.struct(lit(0).alias("run"), lit(False).alias("dead"), lit(0).alias("best"), lit(0).alias("cut"))
    folded = F.aggregate(F.sequence(lit(1), F.greatest(n, lit(1))), zero, step, lambda a: a["cut"])
    return when(n == 0, 0).otherwise(n - folded)


def homopolymer(seq: Column, base: str, head: bool = False) -> Column:
    """Length of the homopolymer tail (or head) that is trimmed; 0 if under 3."""
    n = F.length(seq)

    def step(a: Column, k: Column) -> Column:
        hit = F.substring(seq, k if head else n - k + 1, lit(1)) == base
        score = a["score"] + when(hit, 1).otherwise(-2)
        errors = a["errors"] + when(hit, 0).otherwise(1)
        better = (score > a["best"]) & (errors * 5 <= k)
        return F.struct(score.alias("score"), errors.alias("errors"), when(better, score).otherwise(a["best"]).alias("best"), when(better, k).otherwise(a["at"]).alias("at"))

    zero = F.struct(lit(0).alias("score"), lit(0).alias("errors"), lit(0).alias("best"), lit(0).alias("at"))
    at = F.aggregate(F.sequence(lit(1), F.greatest(n, lit(1))), zero, step, lambda a: a["at"])
    return when((n >= 3) & (at >= 3), at).otherwise(0)


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def ns_start(seq: Column) -> Column:
    """Ns at the 5' end (0-based start of what stays)."""
    return F.length(seq) - F.length(F.ltrim(F.translate(seq, "Nn", "  ")))


def ns_stop(seq: Column) -> Column:
    """End of what stays without Ns at the 3' end; of Ns alone the start."""
    return F.greatest(F.length(F.rtrim(F.translate(seq, "Nn", "  "))), ns_start(seq) * 0)


def id_prefix(read_id: Column) -> Column:
    """The mate key: no leading @, up to the first white space, without /1, /2 or /3 at its end."""
    first = F.regexp_extract(F.regexp_replace(read_id, r"\A@", ""), r"\A\s*(\S*)", 1)
    return F.regexp_replace(first, r"/[123]\z", "")


def append_to_id(read_id: Column, suffix: Column) -> Column:
    """Put a suffix behind the id, before a tail of tags that starts with the first tab."""
    head, tail = F.substring_index(read_id, "\t", 1), F.substring(read_id, F.instr(read_id, "\t"), F.length(read_id))
    return F.concat(F.rtrim(head), suffix, when(F.instr(read_id, "\t") > 0, tail).otherwise(""))


def clip5(text: Column, n: int, seq: Column) -> Column:
    """Without its first n letters, where the read is longer than n."""
    return when(F.length(seq) > n, F.substring(text, lit(n + 1), F.length(text))).otherwise(text)


def clip3(text: Column, n: int, seq: Column) -> Column:
    return when(F.length(seq) > n, F.substring(text, lit(1), F.length(text) - n)).otherwise(text)


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def keep_last(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - n, lit(0)) + 1, F.length(text))


def rrbs(seq: Column, had_adapter: Column, non_directional: bool, second: bool = False) -> tuple[Column, Column]:
    """(bases to cut at the 5' end, bases to cut at the 3' end)."""
    n = F.length(seq)
    if non_directional:
        five = (n > 2) & F.substring(seq, 1, 3).isin("CAA", "CGA")
        return when(five, 2).otherwise(0), when(~five & (n > 2) & had_adapter, 2).otherwise(0)
    return lit(0), (lit(0) if second else when(had_adapter & (n >= 2), 2).otherwise(0))


def record_bytes(read_id: Column, seq: Column, qual: Column) -> Column:
    return F.length(read_id) + F.length(seq) + F.length(qual) + 5


def trailing_poly_g(seq: Column) -> Column:
    return F.endswith(seq, lit("G" * 10))


def colorspace(seq: Column) -> Column:
    return seq.rlike("[0-9]")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def bam_sequence(seq: Column) -> Column:
    """Upper case, ambiguity codes to N; anything else but A, C, G, T and N raises."""
    out = F.translate(F.upper(seq), "RYMKSWBDHV", "N" * 10)
    return when(out.rlike(r"\A[ACGTN]*\z"), out).otherwise(F.raise_error(F.concat(lit("not a BAM sequence: "), seq)))


def unmapped_only(flag: Column) -> Column:
    """BAM flags that a read source accepts: unmapped, neither reverse, secondary nor supplementary."""
    return (flag.bitwiseAND(0x4) != 0) & (flag.bitwiseAND(0x10 | 0x100 | 0x800) == 0)


def minimizer(seq: Column, k: int = 16) -> Column:
    """The smallest canonical 2-bit k-mer as a number; short reads are padded with A, other letters count as A."""
    plain = F.regexp_replace(F.upper(seq), "[^ACGT]", "A")
    s = F.rpad(plain, F.greatest(F.length(plain), lit(k)), "A")
    code = lambda x, to: F.conv(F.translate(x, "ACGT", to), 4, 10).cast("long")

    def at(p: Column) -> Column:
        w = F.substring(s, p, lit(k))
        return F.least(code(w, "0123"), code(F.reverse(w), "3210"))

    return F.array_min(F.transform(F.sequence(lit(1), F.length(s) - (k - 1)), at))


def fnv_bin(key: Column, bins: int) -> Column:
    """32-bit FNV-1a of the key's four bytes, largest first, modulo bins; in 64-bit arithmetic with masks."""
    h = lit(0x811C9DC5).cast("long")
    for shift in (24, 16, 8, 0):
        h = (h.bitwiseXOR(F.shiftright(key, shift).bitwiseAND(0xFF)) * lit(0x01000193)).bitwiseAND(lit(0xFFFFFFFF))
    return F.pmod(h, lit(bins))


def percentage(part: Column, total: Column) -> Column:
    return when(total == 0, 0.0).otherwise(part / total * 100)


def tags(read_id: Column) -> Column:
    """The TAG:TYPE:VALUE tail of an id as a map of tag to (type, value)."""
    tail = F.slice(F.split(read_id, "\t"), 2, 1 << 20)
    entry = lambda t: F.struct(F.substring(t, 1, 2), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, lit(6), F.length(t)).alias("value")))
    return F.map_from_entries(F.transform(tail, entry))
