from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import models
from readprep.functions import exprs as E
from readprep.operators import detect, filters, modes, pairs, stats, trim
from readprep.options import Options, TrimConfig
from readprep.synth import reads

I13 = "AGATCGGAAGAGC"
SCHEMA = "rec_idx long, id string, seq string, qual string"


def frame(spark, *seqs, quals=None):
    return spark.createDataFrame([(i, f"@r{i}", s, (quals or {}).get(i, "I" * len(s))) for i, s in enumerate(seqs)], SCHEMA)


def config(**k):
    return TrimConfig(**({"adapters": (("Illumina", I13),)} | k))


def trimmed(spark, c, *seqs, side=1):
    df = frame(spark, *seqs).withColumn("t", trim.trim_udf(c, side)(F.col("seq"), F.col("qual")))
    return [r["seq"] for r in df.select("rec_idx", trim.trim_read(F.struct("id", "seq", "qual"), F.col("t"), c).alias("r")).orderBy("rec_idx").select("r.seq").collect()]


def test_expressions_equal_the_kernels(spark, small):
    r = reads(spark, small)
    same = r.select(
        *[(E.quality_keep(F.col("seq"), F.col("qual"), 20, two_colour=t) == trim.quality_keep(F.col("seq"), F.col("qual"), 20, two_colour=t)).alias(f"q{t}") for t in (False, True)],
        *[(E.homopolymer(F.col("seq"), b, h) == trim.homopolymer(F.col("seq"), b, h)).alias(f"h{b}{h}") for b, h in (("A", False), ("T", True), ("G", False))],
        (E.minimizer(F.col("seq")) == trim.minimizer(F.col("seq"))).alias("m"),
    )
    assert same.agg(*[F.min(c).alias(c) for c in same.columns]).first().asDict() == dict.fromkeys(same.columns, True)


def test_bins(spark):
    keys = [0, 1, 255, 256, 123456789, 2**32 - 1]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", E.fnv_bin(F.col("k"), 37).alias("b")).collect()
    assert {r["k"]: r["b"] for r in got} == {k: models.fnv_bin(k, 37) for k in keys}


def test_two_adapters_and_rounds(spark):
    both = config(quality_cutoff=0, adapters=(("a", I13), ("b", "CTGTCTCTTATA")))
    assert trimmed(spark, both, "ACGT" * 5 + "CTGTCTCTTATA" + "G" * 8 + I13) == ["ACGT" * 5]
    for times in (1, 2):
        assert trimmed(spark, config(quality_cutoff=0, times=times), "ACGT" * 4 + I13 + I13) == ["ACGT" * 4]


def test_rrbs(spark):
    c = config(quality_cutoff=0, rrbs=True)
    read = "ACGTTGCATT" * 3 + I13
    assert [len(x) for x in trimmed(spark, c, read)] == [28]
    assert [len(x) for x in trimmed(spark, replace(c, paired=True), read, side=2)] == [30]
    nd = replace(c, non_directional=True)
    assert trimmed(spark, nd, "CAATTGCATTTT", "CGATTGCATTTT", "CC", read[:30] + I13) == ["ATTGCATTTT", "ATTGCATTTT", "CC", read[:28]]


def test_n_trim_is_off_under_rrbs(spark):
    assert trimmed(spark, config(trim_n=True), "ACGTACGTACGTNNNN", "NNNN", "NNACNGTNN") == ["ACGTACGTACGT", "", "ACNGT"]
    assert trimmed(spark, config(trim_n=True, rrbs=True), "ACGTACGTACGTNNNN") == ["ACGTACGTACGTNNNN"]


def test_tails_by_side(spark):
    c = config(quality_cutoff=0, adapters=(), poly_a=True, poly_g=True)
    assert trimmed(spark, c, "ACGTCCGTAAAAAA", "ACGTCCGTGGGG") == ["ACGTCCGT", "ACGTCCGT"]
    assert trimmed(spark, c, "TTTTTTACGTCC", "CCCCCACGTAGGGG", side=2) == ["ACGTCC", "CCCCCACGTA"]


def test_clips_only_longer_reads_and_rename(spark):
    c = config(quality_cutoff=0, adapters=(), clip_r1=4, three_prime_clip_r1=2, rename=True)
    out = trim.trim_single(frame(spark, "ACGTTGCA", "ACGT", "AC"), c).orderBy("rec_idx").select("r.id", "r.seq").collect()
    assert [tuple(r) for r in out] == [("@r0:clip5:ACGT:clip3:CA", "TG"), ("@r1:clip3:GT", "AC"), ("@r2", "AC")]


def test_append_goes_before_tags(spark):
    df = spark.createDataFrame([("@r x \tCB:Z:AA\tNM:i:1",), ("@r",)], "id string")
    assert [r[0] for r in df.select(E.append_to_id(F.col("id"), F.lit(":U"))).collect()] == ["@r x:U\tCB:Z:AA\tNM:i:1", "@r:U"]


def test_id_prefix(spark):
    df = spark.createDataFrame([("@read1/1 1:N:0:X",), ("@read1/4",), ("read2/3",), ("@a/1/2",)], "id string")
    assert [r[0] for r in df.select(E.id_prefix(F.col("id"))).collect()] == ["read1", "read1/4", "read2", "a/1"]


@pytest.mark.parametrize(("max_n", "seq", "want"), [(2, "ANNNC", True), (2, "ANNC", False), (1.9, "ANNC", True), (0.5, "NNNAA", True), (0.5, "NNAA", False), (0, "ACGN", True), (0, "ACGT", False), (3, "", True), (None, "", False)])
def test_too_many_n(spark, max_n, seq, want):
    assert frame(spark, seq).select(filters.too_many_n(F.col("seq"), max_n)).first()[0] is want


def test_single_verdicts_in_order(spark):
    c = config(max_n=1, max_length=30)
    got = frame(spark, "NN", "A" * 5, "A" * 31, "A" * 25).select("rec_idx", filters.single_verdict(F.col("seq"), F.lit(False), c)).orderBy("rec_idx").collect()
    assert [r[1] for r in got] == ["too_many_n", "too_short", "too_long", "pass"]
    first = frame(spark, "NN").select(filters.single_verdict(F.col("seq"), F.lit(False), replace(c, discard_untrimmed=True))).first()[0]
    assert first == "untrimmed"


def test_pair_verdict_rescues_each_mate(spark):
    c = config(length_cutoff=80, retain_unpaired=True)
    df = spark.createDataFrame([("A" * 50, "C" * 50), ("A" * 90, "C" * 10), ("A" * 90, "N" * 90)], "a string, b string")
    f = lambda x: df.select(filters.pair_verdict(F.col("a"), F.col("b"), F.lit(True), F.lit(False), x).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in f(replace(c, max_n=3))] == [("too_short", True, True), ("too_short", True, False), ("too_many_n", False, False)]
    assert [tuple(r) for r in f(replace(c, retain_unpaired=False))][0] == ("too_short", False, False)


def test_zip_reports_the_first_fault(spark):
    a, b = frame(spark, "A", "C", "G"), frame(spark, "A", "C")
    x = pairs.faults(pairs.zip_pairs(a, b)).first()
    assert tuple(x) == (3, 1, 3, "read 2 is shorter than read 1")
    with pytest.raises(pairs.PairingError, match="read 1 is shorter than read 2 at record 3"):
        pairs.strict(pairs.zip_pairs(b, a))
    odd = a.withColumn("id", F.when(F.col("rec_idx") == 1, "@other").otherwise(F.col("id")))
    with pytest.raises(pairs.PairingError, match="ids differ at record 2"):
        pairs.strict(pairs.zip_pairs(a, a, odd))
    with pytest.raises(pairs.PairingError, match="ids differ at record 2"):  # the first record counts
        pairs.strict(pairs.zip_pairs(a, b, odd))
    with pytest.raises(pairs.PairingError, match="read 2 is shorter than read 1 at record 3"):  # outranks the ids there
        pairs.strict(pairs.zip_pairs(a, b, a.withColumn("id", F.when(F.col("rec_idx") == 2, "@other").otherwise(F.col("id")))))
    assert pairs.strict(pairs.zip_pairs(a, a, a)).count() == 3


def test_interleaved(spark):
    rows = [(0, 1, "a1"), (1, 1, "b1"), (2, 2, "a2"), (3, 2, "b2"), (4, 1, "c1")]
    df = spark.createDataFrame([(i, s, f"@{x}", x, "II") for i, s, x in rows], "rec_idx long, side int, id string, seq string, qual string")
    got = pairs.interleaved(df).orderBy("rec_idx").select("r1.seq", F.col("r2.seq").alias("s2"), "fault").collect()
    assert [tuple(r) for r in got] == [("a1", "a2", None), ("b1", "b2", None), ("c1", None, "read 1 without read 2")]
    assert pairs.interleaved(df, slack=1).filter("fault = 'too many waiting mates'").count() == 1


def test_umi_modes(spark):
    df = spark.createDataFrame([(0, ("@r", "AAAAAAAACAGTNCCCCCCC", "I" * 20), ("@r", "TTTTTTTTCAGTNNNGGGGG", "I" * 20))], "rec_idx long, r1 struct<id:string,seq:string,qual:string>, r2 struct<id:string,seq:string,qual:string>")
    r = modes.clock_umi(df).first()
    tail = ":R1:AAAAAAAA:R2:TTTTTTTT:F1:CAGT:F2:CAGT"
    assert (r["r1"]["id"], r["r2"]["id"], r["r1"]["seq"], r["r2"]["seq"], r["with_fixed"]) == ("@r" + tail, "@r" + tail, "NCCCCCCC", "NGGGGG"[-6:], True)
    u = modes.implicon_umi(df, 6).first()
    assert (u["r1"]["id"], u["r1"]["seq"], u["r2"]["seq"]) == ("@r:TTTTTT", "AAAAAAAACAGTNCCCCCCC", "TTCAGTNNNGGGGG")
    with pytest.raises(Exception, match="too short"):
        modes.implicon_umi(df, 30).collect()


def test_demultiplex(spark):
    sheet = spark.createDataFrame([("sample1", "ACGTACGT")], "sample string, barcode string")
    got = modes.demultiplex(frame(spark, "ACGTA", "NNNNNNNNGGGGTTTT", "NNNNNNNNACGTACGT"), sheet).orderBy("rec_idx").collect()
    assert [(r["sample"], r["seq"], r["barcode"]) for r in got] == [("NoCode", "", "ACGTA"), ("NoCode", "N" * 8, "GGGGTTTT"), ("sample1", "N" * 8, "ACGTACGT")]
    assert got[2]["id"] == "@r2_BC:ACGTACGT"
    with pytest.raises(ValueError, match="distinct"):
        modes.demultiplex(frame(spark, "A"), sheet.union(sheet))


def test_hardtrim_names_what_it_removes(spark):
    df = frame(spark, "ACGTTGCA", "AC")
    assert [tuple(r)[1:3] for r in modes.hardtrim5(df, 3, True).orderBy("rec_idx").collect()] == [("@r0:clip5:TTGCA", "ACG"), ("@r1", "AC")]
    assert [tuple(r)[1:3] for r in modes.hardtrim3(df, 3, True).orderBy("rec_idx").collect()] == [("@r0:clip3:ACGTT", "GCA"), ("@r1", "AC")]


def test_probe_counts_the_capping_read_unseen(spark):
    df = frame(spark, *["ACGT" + I13 + "G" * 10] * 100)
    d = detect.detect(df, cap=7)
    assert (d.reads_scanned, d.counts["Illumina"], d.poly_g) == (7, 6, 6)
    assert detect.poly_g_scan(df, 7).first()["poly_g"] == 7


def test_detection(spark):
    none = detect.detect(frame(spark, "ACGT", "GGGG"))
    assert none.adapters == (("Illumina", I13),) and "None of the probed" in none.message
    nextera = frame(spark, "ACCTGTCTCTTATA", "CTGTCTCTTATA", I13)
    assert detect.detect(nextera).adapters[0][0] == "Nextera"
    off = detect.detect(nextera, consider_already_trimmed=2)
    assert off.suppressed and off.adapters[0][1] == ""
    assert trimmed(spark, config(quality_cutoff=0, adapters=off.adapters), "ACGT" + I13) == ["ACGT" + I13]


def test_resolve(spark):
    small_rna = frame(spark, "ACGTTGGAATTCTCGG")
    c, _ = detect.resolve(Options(paired=True, inputs=("a", "b")), small_rna)
    assert (c.length_cutoff, c.adapters_r2) == (18, (("smallRNA_r2", "GATCGTCGGACT"),))
    c, _ = detect.resolve(Options(adapter=("A{10}", "CCC"), rrbs=True, paired=True, inputs=("a", "b")), small_rna)
    assert c.adapters == (("adapter_1", "A" * 10), ("adapter_2", "CCC")) and c.clip_r2 == 2
    _, note = detect.resolve(Options(adapter2=("CCC",)), small_rna)
    assert "ignored" in note
    assert not detect.wants_poly_g(10, 50) and detect.wants_poly_g(11, 50) and not detect.wants_poly_g(30, 300_000)


def test_results_do_not_depend_on_partitions(spark, small):
    r = reads(spark, small)
    c = config(times=2, poly_g=True, trim_n=True)
    runs = []
    for n in (1, 5, 16):
        t = trim.trim_single(r.repartition(n), c)
        t = t.withColumn("verdict", filters.single_verdict(F.col("r.seq"), stats.had_adapter(F.col("t")), c))
        runs.append((stats.single_stats(t, c).first(), t.agg(F.sum(F.xxhash64("rec_idx", "r").cast("decimal(38,0)"))).first()[0]))
    assert runs[0] == runs[1] == runs[2]


def test_clump_keeps_mates_together(spark, small):
    p = pairs.zip_pairs(reads(spark, small), reads(spark, small, "r2")).drop("fault")
    c = modes.clump(p, 8, "r1.seq")
    assert c.join(p.select("rec_idx", F.col("r2").alias("mate")), "rec_idx").filter("r2.seq <> mate.seq").isEmpty() and c.count() == p.count()
    assert c.select("bin").distinct().count() <= 8
