import random

import numpy as np
import pyarrow as pa
import pytest

import models
from readprep.functions import kernels as K

I13 = "AGATCGGAAGAGC"


def mat(*texts):
    return K.matrix(pa.array(list(texts), pa.string()))


def test_matrix_takes_slices_nulls_and_empties():
    m, n = K.matrix(pa.array(["AC", None, "", "ACGT"], pa.string()).slice(1))
    assert n.tolist() == [0, 0, 4] and bytes(m[2]) == b"ACGT" and not m[0].any()
    assert K.matrix(pa.array([], pa.string()))[0].shape == (0, 0)


@pytest.mark.parametrize(("read", "adapter", "overlap", "want"), [
    ("ACGTACGTAAGAGATCGGAAGAGC", I13, 1, (11, 24, 13, 0)),
    ("ACGTACGTACGTAGATC", I13, 1, (12, 17, 5, 0)),
    ("ACGTACGTACGT", "T" * 12, 5, None),
    ("ACGTACGTAGATCGGAAGAGX", I13, 1, (8, 21, 13, 1)),
    ("ACGTACGTAG", I13, 5, None),
    ("CTGTGCCTCTTCCGATTCAGATCGGAAGAGAGTAGAAGCTACACG", I13, 1, (18, 31, 13, 1)),
    (I13, I13, 1, (0, 13, 13, 0)), ("A", I13, 1, (0, 1, 1, 0)),
    ("XXXXX" + I13 + "XXXXXAGA", I13, 1, (5, 18, 13, 0)), ("X" * 13 + "AGA", I13, 1, (13, 16, 3, 0)),
])
def test_alignment_cases(read, adapter, overlap, want):
    out = K.align(*mat(read), adapter, 0.1, overlap)[0].tolist()
    assert (None if out[0] < 0 else tuple(out)) == want == models.align(read, adapter, 0.1, overlap)


def test_alignment_equals_the_full_matrix():
    rng = random.Random(5)
    for adapter in (I13, "CTGTCTCTTATA", "ACG", "AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA"):
        reads = []
        for _ in range(400):
            r = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 50)))
            if rng.random() < 0.7:
                a = list(adapter)
                for _ in range(rng.randint(0, 3)):
                    k = rng.randrange(len(a))
                    a[k : k + rng.randint(0, 1)] = rng.choice(["", "A", "G"])
                r = r + "".join(a) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 8)))
            reads.append(r[: rng.randint(1, 70)])
        for rate in (0.0, 0.1, 0.2, 0.3, 1.0):
            for overlap in (1, 5):
                got = K.align(*mat(*reads), adapter, rate, overlap)
                for r, g in zip(reads, got.tolist(), strict=True):
                    assert (None if g[0] < 0 else tuple(g)) == models.align(r, adapter, rate, overlap), (r, adapter, rate, overlap)


def test_quality_cases():
    keep = lambda q, **k: K.quality_keep(*mat(q), 20, **k)[0]
    assert [keep(q) for q in ("IIIII#####", "IIII#IIII", "#####", "", "".join(chr(33 + x) for x in (30, 25, 20, 15, 10, 5)))] == [5, 9, 0, 0, 3]
    assert keep("hhhhhhBBBB", offset=64) == 6
    two = lambda s: K.quality_keep(*mat("I" * len(s)), 20, seq=mat(s)[0])[0]
    assert [two(s) for s in ("ACGTGGGG", "ACGTACGG", "AGGAGG", "G" * 8)] == [4, 6, 4, 0]


def test_tails_cases():
    tail = lambda s, b, head=False: K.homopolymer(*mat(s), b, head)[0]
    assert [len(s) - tail(s, "A") for s in ("ACGTACGTAAA", "ACGTACGTAA", "ACGTAAAAAGAAAAA", "A" * 10)] == [8, 10, 4, 0]
    assert [tail(s, "T", True) for s in ("TTTTTCTTTTTACGT", "TTACGTACGT")] == [11, 0]
    assert [len(s) - tail(s, "G") for s in ("ACGTACGTGGG", "ACGTGGGGGAGGGGG")] == [8, 4]


def test_scans_equal_the_models():
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACGTN", [3, 2, 4, 3, 1], k=rng.randint(0, 40))) for _ in range(600)]
    seqs = [s + rng.choice("AGT") * rng.randint(0, 9) for s in seqs]
    quals = ["".join(chr(33 + rng.choice([2, 10, 19, 20, 21, 30, 40])) for _ in s) for s in seqs]
    (m, n), (q, _) = mat(*seqs), mat(*quals)
    assert K.quality_keep(q, n, 20).tolist() == [models.quality_keep(x, 20) for x in quals]
    assert K.quality_keep(q, n, 20, seq=m).tolist() == [models.quality_keep(x, 20, seq=s) for x, s in zip(quals, seqs, strict=True)]
    for b in "ACGT":
        for head in (False, True):
            assert K.homopolymer(m, n, b, head).tolist() == [models.homopolymer(s, b, head) for s in seqs]
    assert K.minimizer(m, n).tolist() == [models.minimizer(s) for s in seqs]


def test_minimizer_is_the_same_for_both_strands():
    s = "ACGTTGCAAGGCTATTCCGATTACA"
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b, c = (K.minimizer(*mat(x))[0] for x in (s, rc, s.lower()))
    assert a == b == c
    assert K.minimizer(*mat("", "NNNN")).tolist() == [0, 0]


def test_no_reads():
    from readprep.options import TrimConfig

    m, n = mat()
    out = K.trim(m, m, n, TrimConfig(adapters=(("a", I13),), poly_a=True, poly_g=True, trim_n=True), 1)
    assert len(out["start"]) == 0 and np.asarray(out["matches"]).size == 0
