"""One query for each operator, over the whole tables, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..operators import detect, filters, modes, pairs, stats, trim
from ..options import PRESETS, TrimConfig
from ..sinks import store
from ..sinks.fastq import write_fastq
from ..sinks.ubam import header, write_ubam, write_ubam_pairs
from ..sources.ubam import read_ubam_sides
from ..synth import reads
from . import qc
from .oracles import Sql, big, n_count
from .run import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ILLUMINA, NEXTERA, BGI = PRESETS["illumina"][1], PRESETS["nextera"][1], PRESETS["bgiseq"][1]
CONFIG = TrimConfig(adapters=(("Illumina", ILLUMINA),))
BOTH = replace(CONFIG, adapters=(("adapter_1", ILLUMINA), ("adapter_2", NEXTERA)))
SAMPLES = [(f"sample{i}", b) for i, b in enumerate(["AAA", "ACG", "AGT", "CAT", "CCC", "GAC", "GGA", "TAG", "TCA", "TTT"], 1)]
SHEET = "(VALUES " + ", ".join(f"('{s}', '{b}')" for s, b in SAMPLES) + ") sheet(sample, barcode)"


def query(oracle: Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle()
        return f

    return put


def _long(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


def seq() -> Column:
    return F.col("seq")


def qual() -> Column:
    return F.col("qual")


def read_id() -> Column:
    return F.col("id")


# ------------------------------------------------------------------ quality and tails


def _oracle_quality(two: bool = False) -> str:
    s = Sql()
    q = s.quality(s.reads(), 20, two)
    return s.select(f"SELECT rec_idx, {big('keep', 'keep')}, substr(seq, 1, keep) AS seq, substr(qual, 1, keep) AS qual FROM {q}")


def _quality(spark: SparkSession, sf: str, two: bool = False) -> DataFrame:
    r = reads(spark, sf).withColumn("keep", trim.quality_keep(seq(), qual(), 20, two_colour=two))
    return r.select("rec_idx", _long("keep", "keep"), F.substring(seq(), F.lit(1), F.col("keep")).alias("seq"), F.substring(qual(), F.lit(1), F.col("keep")).alias("qual"))


@query(_oracle_quality)
def quality_trim_bwa(spark, sf):
    return _quality(spark, sf)


@query(lambda: _oracle_quality(True))
def quality_trim_2colour(spark, sf):
    return _quality(spark, sf, True)


def _oracle_tail(base: str, head: bool) -> str:
    s = Sql()
    h = s.homopolymer(s.reads(), base, head)
    cut = "substr(seq, hlen + 1)" if head else "substr(seq, 1, length(seq) - hlen)"
    return s.select(f"SELECT rec_idx, {big('hlen', 'removed')}, {cut} AS seq FROM {h}")


def _tail(spark: SparkSession, sf: str, base: str, head: bool = False) -> DataFrame:
    r = reads(spark, sf).withColumn("n", trim.homopolymer(seq(), base, head))
    cut = F.substring(seq(), F.col("n") + 1, F.length("seq")) if head else F.substring(seq(), F.lit(1), F.length("seq") - F.col("n"))
    return r.select("rec_idx", _long("n", "removed"), cut.alias("seq"))


@query(lambda: _oracle_tail("A", False))
def poly_a_tail(spark, sf):
    return _tail(spark, sf, "A")


@query(lambda: _oracle_tail("T", True))
def poly_t_head(spark, sf):
    return _tail(spark, sf, "T", True)


@query(lambda: _oracle_tail("G", False))
def poly_g_tail(spark, sf):
    return _tail(spark, sf, "G")


# ------------------------------------------------------------------ plain projections


def _plain(select: str, where: str = "") -> Callable[[], str]:
    def sql() -> str:
        s = Sql()
        return s.select(f"SELECT {select} FROM {s.reads()} {where}")

    return sql


@query(_plain("rec_idx, regexp_replace(regexp_replace(seq, '^[Nn]+', ''), '[Nn]+$', '') AS seq"))
def trim_ns(spark, sf):
    start, stop = E.ns_start(seq()), E.ns_stop(seq())
    return reads(spark, sf).select("rec_idx", F.substring(seq(), start + 1, F.greatest(stop - start, F.lit(0))).alias("seq"))


@query(_plain("rec_idx, CASE WHEN length(seq) > 10 THEN substr(seq, 11) ELSE seq END AS seq, CASE WHEN length(seq) > 10 THEN substr(qual, 11) ELSE qual END AS qual"))
def clip_5p(spark, sf):
    return reads(spark, sf).select("rec_idx", E.clip5(seq(), 10, seq()).alias("seq"), E.clip5(qual(), 10, seq()).alias("qual"))


@query(_plain("rec_idx, CASE WHEN length(seq) > 5 THEN substr(seq, 1, length(seq) - 5) ELSE seq END AS seq, CASE WHEN length(seq) > 5 THEN substr(qual, 1, length(qual) - 5) ELSE qual END AS qual"))
def clip_3p(spark, sf):
    return reads(spark, sf).select("rec_idx", E.clip3(seq(), 5, seq()).alias("seq"), E.clip3(qual(), 5, seq()).alias("qual"))


@query(_plain("rec_idx, id || CASE WHEN length(seq) > 4 THEN ':clip5:' || substr(seq, 1, 4) ELSE '' END || CASE WHEN length(seq) > 7 OR length(seq) = 4 THEN ':clip3:' || right(seq, 3) ELSE '' END AS id, CASE WHEN length(seq) > 7 THEN substr(seq, 5, length(seq) - 7) WHEN length(seq) > 4 THEN substr(seq, 5) WHEN length(seq) = 4 THEN substr(seq, 1, 1) ELSE seq END AS seq"))
def rename_suffix(spark, sf):
    c = TrimConfig(quality_cutoff=0, clip_r1=4, three_prime_clip_r1=3, rename=True)
    return trim.trim_single(reads(spark, sf), c).select("rec_idx", "r.id", "r.seq")


@query(_plain("rec_idx, substr(seq, 1, 20) AS seq, substr(qual, 1, 20) AS qual"))
def hardtrim5(spark, sf):
    return modes.hardtrim5(reads(spark, sf), 20).select("rec_idx", "seq", "qual")


@query(_plain("rec_idx, id || CASE WHEN length(seq) > 20 THEN ':clip3:' || substr(seq, 1, length(seq) - 20) ELSE '' END AS id, right(seq, 20) AS seq, right(qual, 20) AS qual"))
def hardtrim3(spark, sf):
    return modes.hardtrim3(reads(spark, sf), 20, rename=True).select("rec_idx", "id", "seq", "qual")


@query(_plain("rec_idx, regexp_replace(split_part(ltrim(id, '@'), ' ', 1), '/[123]$', '') AS mate_key"))
def id_prefix(spark, sf):
    return reads(spark, sf).select("rec_idx", E.id_prefix(read_id()).alias("mate_key"))


@query(_plain(f"rec_idx, {big('length(id) + length(seq) + length(qual) + 5', 'n_bytes')}"))
def record_size(spark, sf):
    return reads(spark, sf).select("rec_idx", _long(E.record_bytes(read_id(), seq(), qual()), "n_bytes"))


@query(_plain("rec_idx, regexp_replace(upper(seq), '[RYMKSWBDHV]', 'N', 'g') AS bam_seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS reverse_complement"))
def bam_sequence(spark, sf):
    return reads(spark, sf).select("rec_idx", E.bam_sequence(seq()).alias("bam_seq"), F.reverse(E.complement(seq())).alias("reverse_complement"))


@query(_plain("rec_idx, id || '	CB:Z:' || substr(seq, 1, 4) || '	NM:i:' || CAST(rec_idx % 7 AS STRING) AS tagged, substr(seq, 1, 4) AS cb, CAST(rec_idx % 7 AS BIGINT) AS nm, id || ':X' || '	CB:Z:' || substr(seq, 1, 4) || '	NM:i:' || CAST(rec_idx % 7 AS STRING) AS renamed"))
def aux_tags(spark, sf):
    tagged = F.concat(read_id(), F.lit("\tCB:Z:"), F.substring(seq(), 1, 4), F.lit("\tNM:i:"), (F.col("rec_idx") % 7).cast("string"))
    r = reads(spark, sf).withColumn("tagged", tagged).withColumn("tags", E.tags(F.col("tagged")))
    return r.select("rec_idx", "tagged", F.col("tags")["CB"]["value"].alias("cb"), F.col("tags")["NM"]["value"].cast("long").alias("nm"), E.append_to_id(F.col("tagged"), F.lit(":X")).alias("renamed"))


# ------------------------------------------------------------------ RRBS


def _oracle_rrbs(non_directional: bool) -> str:
    s = Sql()
    c = s.cut(s.reads(), [ILLUMINA])
    if non_directional:
        five = "length(seq) > 2 AND substr(seq, 1, 3) IN ('CAA', 'CGA')"
        out = f"CASE WHEN {five} THEN substr(seq, 3) WHEN length(seq) > 2 AND adapter_idx IS NOT NULL THEN substr(seq, 1, length(seq) - 2) ELSE seq END"
    else:
        out = "CASE WHEN length(seq) >= 2 AND adapter_idx IS NOT NULL THEN substr(seq, 1, length(seq) - 2) ELSE seq END"
    return s.select(f"SELECT rec_idx, {out} AS seq FROM {c}")


def _rrbs(spark: SparkSession, sf: str, non_directional: bool) -> DataFrame:
    c = replace(CONFIG, quality_cutoff=0, rrbs=True, non_directional=non_directional)
    return trim.trim_single(reads(spark, sf), c).select("rec_idx", "r.seq")


@query(lambda: _oracle_rrbs(False))
def rrbs_directional(spark, sf):
    return _rrbs(spark, sf, False)


@query(lambda: _oracle_rrbs(True))
def rrbs_non_directional(spark, sf):
    return _rrbs(spark, sf, True)


# ------------------------------------------------------------------ filters


@query(_plain(f"rec_idx, {big(n_count(), 'n_count')}", f"WHERE length(seq) > 0 AND {n_count()} <= 2"))
def max_n_count(spark, sf):
    return reads(spark, sf).filter(~filters.too_many_n(seq(), 2)).select("rec_idx", _long(E.n_count(seq()), "n_count"))


@query(_plain(f"rec_idx, {big(n_count(), 'n_count')}", f"WHERE length(seq) > 0 AND {n_count()} <= 0.05 * length(seq)"))
def max_n_fraction(spark, sf):
    return reads(spark, sf).filter(~filters.too_many_n(seq(), 0.05)).select("rec_idx", _long(E.n_count(seq()), "n_count"))


@query(_plain("rec_idx, CASE WHEN length(seq) = 0 OR " + n_count() + " > 3 THEN 'too_many_n' WHEN length(seq) < 20 THEN 'too_short' WHEN length(seq) > 60 THEN 'too_long' ELSE 'pass' END AS verdict"))
def max_length(spark, sf):
    c = replace(CONFIG, max_n=3, max_length=60)
    return reads(spark, sf).select("rec_idx", filters.single_verdict(seq(), F.lit(True), c).alias("verdict"))


@query(_plain("rec_idx, regexp_matches(seq, 'G{10}$') AS poly_g, contains(seq, 'AGATCGGAAGAGC') AS illumina, regexp_matches(seq, '[0-9]') AS colorspace, starts_with(seq, 'CAA') OR starts_with(seq, 'CGA') AS msp1"))
def predicates(spark, sf):
    msp1 = F.startswith(seq(), F.lit("CAA")) | F.startswith(seq(), F.lit("CGA"))
    return reads(spark, sf).select("rec_idx", E.trailing_poly_g(seq()).alias("poly_g"), F.contains(seq(), F.lit(ILLUMINA)).alias("illumina"), E.colorspace(seq()).alias("colorspace"), msp1.alias("msp1"))


# ------------------------------------------------------------------ adapters


def _oracle_match() -> str:
    s = Sql()
    m = s.match(s.reads(), ILLUMINA)
    return s.select(f"SELECT rec_idx, {', '.join(big(c, c) for c in ('read_start', 'read_end', 'overlap', 'errors'))} FROM {m}")


@query(_oracle_match)
def adapter_match(spark, sf):
    r = trim.once(reads(spark, sf), m=trim.match_udf(ILLUMINA, 0.1, 1)(seq())).filter("m IS NOT NULL")
    return r.select("rec_idx", *[_long(f"m.{c}", c) for c in ("read_start", "read_end", "overlap", "errors")])


def _oracle_cut(adapters: list[str], select: str) -> Callable[[], str]:
    def sql() -> str:
        s = Sql()
        return s.select(f"SELECT {select} FROM {s.trimmed(s.reads(), adapters)}")

    return sql


@query(_oracle_cut([ILLUMINA], "rec_idx, seq, qual, adapter_idx IS NOT NULL AS had_adapter"))
def adapter_trim_se(spark, sf):
    return trim.trim_single(reads(spark, sf), CONFIG).select("rec_idx", "r.seq", "r.qual", stats.had_adapter(F.col("t")).alias("had_adapter"))


@query(_oracle_cut([ILLUMINA, NEXTERA], f"rec_idx, seq, {big('adapter_idx', 'adapter_idx')}, {big('removed', 'removed')}"))
def adapter_multi(spark, sf):
    r = trim.trim_single(reads(spark, sf), BOTH)
    first = F.get(F.col("t.matches"), 0)
    return r.select("rec_idx", "r.seq", _long(first["adapter_idx"], "adapter_idx"), _long(first["removed"], "removed"))


def _oracle_rounds() -> str:
    s = Sql()
    first = s.trimmed(s.reads(), [ILLUMINA, NEXTERA])
    again = s.add(f"SELECT rec_idx, id, seq, qual FROM {first} WHERE adapter_idx IS NOT NULL")
    second = s.cut(again, [ILLUMINA, NEXTERA])
    return s.select(f"SELECT f.rec_idx, coalesce(x.seq, f.seq) AS seq, CAST((f.adapter_idx IS NOT NULL)::INT + (x.adapter_idx IS NOT NULL)::INT AS BIGINT) AS rounds FROM {first} f LEFT JOIN {second} x ON x.rec_idx = f.rec_idx")


@query(_oracle_rounds)
def adapter_rounds(spark, sf):
    return trim.trim_single(reads(spark, sf), replace(BOTH, times=2)).select("rec_idx", "r.seq", _long(F.size("t.matches"), "rounds"))


_HIST = f"{big('adapter_idx', 'adapter_idx')}, {big('removed', 'length')}, {big('count(*)', 'count')}"


def _oracle_histogram(expect: bool) -> str:
    s = Sql()
    t = s.trimmed(s.reads(), [ILLUMINA, NEXTERA])
    h = s.add(f"SELECT {_HIST} FROM {t} WHERE adapter_idx IS NOT NULL GROUP BY adapter_idx, removed")
    if not expect:
        return s.select(f"SELECT * FROM {h}")
    return s.select(f"SELECT *, round((SELECT count(*) FROM orders) / pow(4.0, length), 6) AS expect, {big('floor(length * 0.1)', 'max_err')} FROM {h}")


@query(lambda: _oracle_histogram(False))
def adapter_len_hist(spark, sf):
    h = stats.length_histogram(trim.trim_single(reads(spark, sf), BOTH))
    return h.select(_long("adapter_idx", "adapter_idx"), _long("length", "length"), "count")


@query(lambda: _oracle_histogram(True))
def report_histogram_expect(spark, sf):
    h = stats.length_histogram(trim.trim_single(reads(spark, sf), BOTH))
    total = spark.read.parquet(f"{sf}/orders.parquet").count()
    x = stats.expected(h, F.lit(total), 0.1)
    return x.select(_long("adapter_idx", "adapter_idx"), _long("length", "length"), "count", F.round("expect", 6).alias("expect"), _long("max_err", "max_err"))


@query(_oracle_cut([ILLUMINA], "rec_idx, CASE WHEN adapter_idx IS NULL THEN 'untrimmed' WHEN length(seq) < 20 THEN 'too_short' ELSE 'pass' END AS verdict"))
def discard_untrimmed(spark, sf):
    c = replace(CONFIG, discard_untrimmed=True)
    return filters.judge(trim.trim_single(reads(spark, sf), c), c).select("rec_idx", "verdict")


# ------------------------------------------------------------------ detection: rec_idx numbers the scan, as in a file


def _oracle_detect() -> str:
    s = Sql()
    r = s.reads()
    hits = lambda a: f"(SELECT count(*) FROM {r} WHERE rec_idx < 999999 AND contains(seq, '{a}'))"
    p = s.add(" UNION ALL ".join(f"SELECT {i} AS i, '{PRESETS[k][0]}' AS adapter, {hits(PRESETS[k][1])} AS hits" for i, k in enumerate(detect.PROBED)))
    return s.select(f"SELECT adapter, {big('hits', 'hits')}, CAST(row_number() OVER (ORDER BY hits DESC, i) AS INTEGER) AS place FROM {p}")


@query(_oracle_detect)
def adapter_autodetect(spark, sf):
    return detect.ranking(detect.probe(reads(spark, sf)))


_POLY_G = "regexp_matches(seq, 'G{10}$')"


@query(_plain(f"{big('count(*)', 'reads_scanned')}, {big(f'count(*) FILTER ({_POLY_G})', 'poly_g')}, count(*) FILTER ({_POLY_G}) > greatest(count(*) // 10000, 10) AS wanted", "WHERE rec_idx < 1000000"))
def polyg_detect(spark, sf):
    x = detect.poly_g_scan(reads(spark, sf))
    return x.withColumn("wanted", F.col("poly_g") > F.greatest(F.floor(F.col("reads_scanned") / 10_000), F.lit(10)))


def _oracle_suppress() -> str:
    s = Sql()
    r = s.reads()
    best = "greatest(" + ", ".join(f"(SELECT count(*) FROM {r} WHERE rec_idx < 999999 AND contains(seq, '{PRESETS[k][1]}'))" for k in detect.PROBED) + ")"
    return s.select(f"SELECT {big(best, 'hits')}, {best} <= 100 AS suppressed_at_100, {best} <= 10000 AS suppressed_at_10000")


@query(_oracle_suppress)
def already_trimmed_suppress(spark, sf):
    top = detect.ranking(detect.probe(reads(spark, sf))).filter("place = 1")
    return top.select("hits", (F.col("hits") <= 100).alias("suppressed_at_100"), (F.col("hits") <= 10_000).alias("suppressed_at_10000"))


# ------------------------------------------------------------------ pairs


def _pairs(spark: SparkSession, sf: str, pt: bool = False) -> DataFrame:
    """The streams by position; r2 and the third by their own salts."""
    return pairs.zip_pairs(reads(spark, sf, "r1"), reads(spark, sf, "r2"), reads(spark, sf, "r3") if pt else None)


@query(lambda: (s := Sql()).select(f"SELECT a.rec_idx, a.seq AS seq1, b.seq AS seq2, CAST(NULL AS STRING) AS fault FROM {s.reads('r1')} a JOIN {s.reads('r2')} b USING (rec_idx)"))
def pair_zip(spark, sf):
    return _pairs(spark, sf).select("rec_idx", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"), "fault")


PAIRED = replace(CONFIG, paired=True, max_n=4, max_length=62, retain_unpaired=True)


def _judged(spark: SparkSession, sf: str, c: TrimConfig = PAIRED, pt: bool = False) -> DataFrame:
    t = trim.trim_pairs(_pairs(spark, sf, pt).drop("fault"), c)
    return filters.judge_pairs(t, c)


def _sql_judged(s: Sql) -> str:
    a, b = s.trimmed(s.reads("r1"), [ILLUMINA]), s.trimmed(s.reads("r2"), [ILLUMINA])
    many = lambda x: f"(length({x}.seq) = 0 OR {n_count(f'{x}.seq')} > 4)"
    v = f"CASE WHEN {many('a')} OR {many('b')} THEN 'too_many_n' WHEN least(length(a.seq), length(b.seq)) < 20 THEN 'too_short' WHEN greatest(length(a.seq), length(b.seq)) > 62 THEN 'too_long' ELSE 'pass' END"
    j = s.add(f"SELECT a.rec_idx, a.id AS id1, b.id AS id2, a.seq AS seq1, b.seq AS seq2, a.qual AS qual1, b.qual AS qual2, a.n0 AS in1, b.n0 AS in2, a.quality_bp AS q1, b.quality_bp AS q2, a.adapter_idx AS x1, b.adapter_idx AS x2, {v} AS verdict FROM {a} a JOIN {b} b ON a.rec_idx = b.rec_idx")
    return s.add(f"SELECT *, verdict = 'too_short' AND length(seq1) >= 35 AS r1_ok, verdict = 'too_short' AND length(seq2) >= 35 AS r2_ok FROM {j}")


def _oracle_pairs(select: str, tail: str = "") -> Callable[[], str]:
    def sql() -> str:
        s = Sql()
        return s.select(f"SELECT {select} FROM {_sql_judged(s)} {tail}")

    return sql


@query(_oracle_pairs("rec_idx, verdict, r1_ok, r2_ok"))
def pair_verdict(spark, sf):
    return _judged(spark, sf).select("rec_idx", "v.verdict", "v.r1_ok", "v.r2_ok")


def _oracle_unpaired() -> str:
    s = Sql()
    j = _sql_judged(s)
    return s.select(f"SELECT rec_idx, 1 AS side, id1 AS id, seq1 AS seq FROM {j} WHERE r1_ok UNION ALL SELECT rec_idx, 2, id2, seq2 FROM {j} WHERE r2_ok")


@query(_oracle_unpaired)
def retain_unpaired(spark, sf):
    j = _judged(spark, sf)
    side = lambda n: j.filter(f"v.r{n}_ok").select("rec_idx", F.lit(n).alias("side"), f"r{n}.id", f"r{n}.seq")
    return side(1).unionByName(side(2))


def counted(name: str, where: str | None = None) -> str:
    return big("count(*)" + (f" FILTER ({where})" if where else ""), name)


_PAIR_COUNTS = [
    counted("pairs_analyzed"), counted("pairs_removed", "verdict <> 'pass'"), counted("pairs_removed_n", "verdict = 'too_many_n'"),
    counted("pairs_removed_too_long", "verdict = 'too_long'"), counted("r1_unpaired", "r1_ok"), counted("r2_unpaired", "r2_ok"),
]


@query(_oracle_pairs(", ".join(_PAIR_COUNTS)))
def pair_stats(spark, sf):
    return stats.pair_stats(_judged(spark, sf)).select(*stats.PAIR_COUNTERS[:6])


@query(_oracle_pairs("rec_idx, id1, seq1, qual1, id2, seq2, qual2", "WHERE verdict = 'pass'"))
def pe_full(spark, sf):
    j = _judged(spark, sf).filter("v.verdict = 'pass'")
    return j.select("rec_idx", *[F.col(f"r{n}.{c}").alias(f"{c}{n}") for n in (1, 2) for c in ("id", "seq", "qual")])


def _oracle_passthrough() -> str:
    s = Sql()
    return s.select(f"SELECT p.rec_idx, p.id, p.seq, p.qual FROM {s.reads('r3')} p JOIN {_sql_judged(s)} j ON j.rec_idx = p.rec_idx WHERE j.verdict = 'pass'")


@query(_oracle_passthrough)
def passthrough_lockstep(spark, sf):
    j = _judged(spark, sf, replace(PAIRED, retain_unpaired=False), pt=True).filter("v.verdict = 'pass'")
    return j.select("rec_idx", "pt.id", "pt.seq", "pt.qual")


@query(_oracle_passthrough)
def passthrough_semi_join(spark, sf):
    kept = _judged(spark, sf, replace(PAIRED, retain_unpaired=False)).filter("v.verdict = 'pass'")
    return pairs.kept_passthrough(reads(spark, sf, "r3"), kept).select("rec_idx", "id", "seq", "qual")


@query(lambda: (s := Sql()).select(f"SELECT p.rec_idx, p.id FROM {s.reads('r3')} p WHERE p.rec_idx IN (SELECT rec_idx FROM {_sql_judged(s)} WHERE verdict <> 'pass')"))
def pairs_removed(spark, sf):
    j = _judged(spark, sf)
    return pairs.removed_pairs(reads(spark, sf, "r3"), j.filter("v.verdict = 'pass'")).select("rec_idx", "id")


_DROP = "seq NOT LIKE 'CAG%'"  # mates that a sequencer lost


def _oracle_faults() -> str:
    s = Sql()
    a, b = s.reads("r1"), s.reads("r2", _DROP)
    j = s.add(f"SELECT coalesce(a.rec_idx, b.rec_idx) + 1 AS record, CASE WHEN b.rec_idx IS NULL THEN 'read 2 is shorter than read 1' END AS fault FROM {a} a FULL JOIN {b} b ON a.rec_idx = b.rec_idx")
    return s.select(f"SELECT {big('count(*)', 'pairs')}, {big('count(fault)', 'faulty')}, {big('min(record) FILTER (fault IS NOT NULL)', 'first_record')}, arg_min(fault, record) FILTER (fault IS NOT NULL) AS first_fault FROM {j}")


@query(_oracle_faults)
def orphan_check(spark, sf):
    return pairs.faults(pairs.zip_pairs(reads(spark, sf, "r1"), reads(spark, sf, "r2").filter(_DROP)))


def _interleaved(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda n, df: df.select((F.col("rec_idx") * 2 + n - 1).alias("rec_idx"), F.lit(n).alias("side"), "id", "seq", "qual")
    return side(1, reads(spark, sf, "r1")).unionByName(side(2, reads(spark, sf, "r2").filter(_DROP)))


def _oracle_interleaved() -> str:
    s = Sql()
    a, b = s.reads("r1"), s.reads("r2", _DROP)
    k = lambda t: f"(SELECT row_number() OVER (ORDER BY rec_idx) - 1 AS k, seq FROM {t})"
    return s.select(f"SELECT coalesce(x.k, y.k) AS rec_idx, x.seq AS seq1, y.seq AS seq2, CASE WHEN y.k IS NULL THEN 'read 1 without read 2' END AS fault FROM {k(a)} x FULL JOIN {k(b)} y ON x.k = y.k")


@query(_oracle_interleaved)
def interleave_pairing(spark, sf):
    out = pairs.interleaved(_interleaved(spark, sf), slack=1 << 40)
    return out.select("rec_idx", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"), "fault")


# ------------------------------------------------------------------ run statistics


_STATS = [
    counted("total_reads"), counted("reads_with_adapter", "adapter_idx IS NOT NULL"), big("sum(n0)", "bp_processed"), big("sum(quality_bp)", "quality_bp"),
    big("sum(length(seq))", "bp_after_trim"), big("sum(length(seq)) FILTER (length(seq) >= 20)", "bp_written"), counted("too_short", "length(seq) < 20"),
    counted("reads_written", "length(seq) >= 20"),
]


@query(_oracle_cut([ILLUMINA], ", ".join(_STATS)))
def se_run_stats(spark, sf):
    t = filters.judge(trim.trim_single(reads(spark, sf), CONFIG), CONFIG)
    return stats.single_stats(t, CONFIG).select("total_reads", "reads_with_adapter", "bp_processed", "quality_bp", "bp_after_trim", "bp_written", "too_short", "reads_written")


_SIDE = [counted("total_reads"), counted("reads_with_adapter", "x2 IS NOT NULL"), big("sum(in2)", "bp_processed"), big("sum(q2)", "quality_bp"), counted("reads_written", "verdict = 'pass'"), big("sum(length(seq2)) FILTER (verdict = 'pass')", "bp_written")]


@query(_oracle_pairs(", ".join(_SIDE)))
def pe_run_stats(spark, sf):
    return stats.side_stats(_judged(spark, sf), PAIRED, 2).select("total_reads", "reads_with_adapter", "bp_processed", "quality_bp", "reads_written", "bp_written")


def _oracle_length() -> str:
    s = Sql()
    return s.select(f"SELECT rec_idx, {big('keep', 'length')} FROM {s.quality(s.reads())} WHERE keep >= 20")


@query(_oracle_length)
def se_length_filter(spark, sf):
    c = replace(CONFIG, adapters=())
    t = filters.judge(trim.trim_single(reads(spark, sf), c), c).filter(F.col("verdict") == filters.PASS)
    return t.select("rec_idx", _long(F.length("r.seq"), "length"))


FULL = replace(BOTH, times=1, poly_a=True, poly_g=True, trim_n=True, max_n=3, clip_r1=2, three_prime_clip_r1=1)


def _oracle_full() -> str:
    s = Sql()
    t = s.trimmed(s.reads(), [ILLUMINA, NEXTERA])
    a = s.homopolymer(t, "A")
    a = s.add(f"SELECT rec_idx, id, substr(seq, 1, length(seq) - hlen) AS seq, substr(qual, 1, length(seq) - hlen) AS qual FROM {a}")
    g = s.homopolymer(a, "G")
    g = s.add(f"SELECT rec_idx, id, substr(seq, 1, length(seq) - hlen) AS seq, substr(qual, 1, length(seq) - hlen) AS qual FROM {g}")
    n = s.add(f"SELECT rec_idx, id, regexp_replace(seq, '^[Nn]+', '') AS seq, substr(qual, length(seq) - length(regexp_replace(seq, '^[Nn]+', '')) + 1) AS qual FROM {g}")
    n = s.add(f"SELECT rec_idx, id, regexp_replace(seq, '[Nn]+$', '') AS seq, substr(qual, 1, length(regexp_replace(seq, '[Nn]+$', ''))) AS qual FROM {n}")
    c = s.add(f"SELECT rec_idx, id, CASE WHEN length(seq) > 2 THEN substr(seq, 3) ELSE seq END AS seq, CASE WHEN length(seq) > 2 THEN substr(qual, 3) ELSE qual END AS qual FROM {n}")
    c = s.add(f"SELECT rec_idx, id, CASE WHEN length(seq) > 1 THEN substr(seq, 1, length(seq) - 1) ELSE seq END AS seq, CASE WHEN length(seq) > 1 THEN substr(qual, 1, length(qual) - 1) ELSE qual END AS qual FROM {c}")
    return s.select(f"SELECT rec_idx, id, seq, qual FROM {c} WHERE length(seq) >= 20 AND {n_count()} <= 3")


@query(_oracle_full)
def se_full(spark, sf):
    t = filters.judge(trim.trim_single(reads(spark, sf), FULL), FULL)
    return t.filter(F.col("verdict") == filters.PASS).select("rec_idx", "r.id", "r.seq", "r.qual")


# ------------------------------------------------------------------ modes


def _long_pairs(spark: SparkSession, sf: str, n1: int, n2: int) -> DataFrame:
    """Without the pairs that a mode refuses, of which the tables hold some."""
    return _pairs(spark, sf).drop("fault").filter(f"length(r1.seq) >= {n1} AND length(r2.seq) >= {n2}")


def _oracle_clock() -> str:
    s = Sql()
    j = s.add(f"SELECT a.rec_idx, a.id AS id1, b.id AS id2, a.seq AS s1, b.seq AS s2 FROM {s.reads('r1')} a JOIN {s.reads('r2')} b USING (rec_idx) WHERE length(a.seq) >= 13 AND length(b.seq) >= 15")
    tail = "':R1:' || substr(s1, 1, 8) || ':R2:' || substr(s2, 1, 8) || ':F1:' || substr(s1, 9, 4) || ':F2:' || substr(s2, 9, 4)"
    return s.select(f"SELECT rec_idx, id1 || {tail} AS id1, substr(s1, 13) AS seq1, substr(s2, 15) AS seq2, substr(s1, 9, 4) = 'CAGT' AND substr(s2, 9, 4) = 'CAGT' AS with_fixed FROM {j}")


@query(_oracle_clock)
def clock_umi(spark, sf):
    return modes.clock_umi(_long_pairs(spark, sf, 13, 15)).select("rec_idx", F.col("r1.id").alias("id1"), F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"), "with_fixed")


def _oracle_clock_summary() -> str:
    s = Sql()
    j = s.add(f"SELECT substr(a.seq, 9, 4) = 'CAGT' AND substr(b.seq, 9, 4) = 'CAGT' AS f FROM {s.reads('r1')} a JOIN {s.reads('r2')} b USING (rec_idx) WHERE length(a.seq) >= 13 AND length(b.seq) >= 15")
    return s.select(f"SELECT {counted('pairs')}, {counted('with_fixed', 'f')}, {counted('without_fixed', 'NOT f')}, round(100.0 * count(*) FILTER (f) / greatest(count(*), 1), 6) AS percent_with FROM {j}")


@query(_oracle_clock_summary)
def clock_summary(spark, sf):
    out = modes.clock_summary(modes.clock_umi(_long_pairs(spark, sf, 13, 15)))
    return out.withColumn("percent_with", F.round("percent_with", 6))


def _oracle_implicon() -> str:
    s = Sql()
    j = s.add(f"SELECT a.rec_idx, a.id AS id1, b.id AS id2, a.seq AS s1, b.seq AS s2 FROM {s.reads('r1')} a JOIN {s.reads('r2')} b USING (rec_idx) WHERE length(b.seq) >= 8")
    return s.select(f"SELECT rec_idx, id1 || ':' || substr(s2, 1, 8) AS id1, id2 || ':' || substr(s2, 1, 8) AS id2, s1 AS seq1, substr(s2, 9) AS seq2 FROM {j}")


@query(_oracle_implicon)
def implicon_umi(spark, sf):
    u = modes.implicon_umi(_long_pairs(spark, sf, 0, 8))
    return u.select("rec_idx", F.col("r1.id").alias("id1"), F.col("r2.id").alias("id2"), F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


def _sheet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "sample string, barcode string")


_ASSIGNED = f"(SELECT rec_idx, replace(id, ' ', '_') || '_BC:' || right(seq, 3) AS id, substr(seq, 1, greatest(length(seq) - 3, 0)) AS seq, coalesce(sample, 'NoCode') AS sample FROM {{r}} LEFT JOIN {SHEET} ON barcode = right(seq, 3))"


@query(lambda: (s := Sql()).select(f"SELECT * FROM {_ASSIGNED.format(r=s.reads())} x"))
def demux_assign(spark, sf):
    return modes.demultiplex(reads(spark, sf), _sheet(spark)).select("rec_idx", "id", "seq", "sample")


@query(lambda: (s := Sql()).select(f"SELECT s.sample, s.barcode, {big('count(x.rec_idx)', 'reads')} FROM (SELECT * FROM {SHEET} UNION ALL SELECT 'NoCode', NULL) s LEFT JOIN {_ASSIGNED.format(r=s.reads())} x ON x.sample = s.sample GROUP BY s.sample, s.barcode"))
def demux_summary(spark, sf):
    return modes.demux_summary(modes.demultiplex(reads(spark, sf), _sheet(spark)), _sheet(spark))


# ------------------------------------------------------------------ minimizers


def _sql_minimizer(s: Sql) -> str:
    r = s.reads()
    p = s.add(f"SELECT rec_idx, id, seq, qual, rpad(regexp_replace(seq, '[^ACGT]', 'A', 'g'), CAST(greatest(length(seq), 16) AS INTEGER), 'A') AS s FROM {r}")
    w = s.add(f"SELECT rec_idx, substr(s, k, 16) AS w FROM (SELECT rec_idx, s, unnest(range(1, length(s) - 14)) AS k FROM {p})")
    code = lambda x, t: f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(translate({x}, 'ACGT', '{t}'), ''), lambda b: CAST(b AS BIGINT))), lambda a, b: a * 4 + b)"
    m = s.add(f"SELECT rec_idx, min(least({code('w', '0123')}, {code('reverse(w)', '3210')})) AS minimizer FROM {w} GROUP BY rec_idx")
    h = "2166136261"
    for shift in (24, 16, 8, 0):
        h = f"((xor(CAST({h} AS BIGINT), (minimizer >> {shift}) & 255) * 16777619) & 4294967295)"
    return s.add(f"SELECT r.*, m.minimizer, CAST({h} % 16 AS INTEGER) AS bin FROM {r} r JOIN {m} m ON m.rec_idx = r.rec_idx")


def _oracle_minimizer(select: str, tail: str = "") -> Callable[[], str]:
    def sql() -> str:
        s = Sql()
        return s.select(f"SELECT {select} FROM {_sql_minimizer(s)} {tail}")

    return sql


@query(_oracle_minimizer("rec_idx, minimizer"))
def minimizer_key(spark, sf):
    return reads(spark, sf).select("rec_idx", trim.minimizer(seq()).alias("minimizer"))


@query(_oracle_minimizer(f"bin, {big('count(*)', 'reads')}", "GROUP BY bin"))
def clump_bins(spark, sf):
    r = reads(spark, sf).select(E.fnv_bin(trim.minimizer(seq()), 16).cast("int").alias("bin"))
    return r.groupBy("bin").agg(F.count(F.lit(1)).alias("reads"))


@query(_oracle_minimizer("rec_idx, bin, CAST(row_number() OVER (PARTITION BY bin ORDER BY minimizer, seq, qual, id, rec_idx) AS INTEGER) AS place"))
def clump_order(spark, sf):
    c = modes.clump(reads(spark, sf), 16)
    w = Window.partitionBy("bin").orderBy("minimizer", "seq", "qual", "id", "rec_idx")
    return c.select("rec_idx", "bin", F.row_number().over(w).alias("place"))


# ------------------------------------------------------------------ QC


def _oracle_qc() -> str:
    s = Sql()
    p = s.add(f"SELECT unnest(range(1, length(seq) + 1)) AS position, seq, qual FROM {s.reads()}")
    b = lambda x: counted(f"n_{x.lower()}", f"substr(seq, position, 1) = '{x}'")
    return s.select(f"SELECT CAST(position AS INTEGER) AS position, {counted('reads')}, {big('sum(ascii(substr(qual, position, 1)) - 33)', 'quality_sum')}, {', '.join(map(b, 'ACGTN'))} FROM {p} GROUP BY position")


@query(_oracle_qc)
def qc_per_position(spark, sf):
    return qc.per_position(reads(spark, sf))


@query(_plain(f"CAST(length(seq) AS INTEGER) AS length, {counted('reads')}", "GROUP BY length(seq)"))
def qc_lengths(spark, sf):
    return qc.lengths(reads(spark, sf))


_GC = "CAST(round((length(seq) - length(translate(seq, 'GC', ''))) * 100.0 / length(seq)) AS INTEGER)"


@query(_plain(f"{_GC} AS percent, {counted('reads')}", f"WHERE length(seq) > 0 GROUP BY {_GC}"))
def qc_gc_content(spark, sf):
    return qc.gc_content(reads(spark, sf))


@query(lambda: (s := Sql()).select(f"SELECT copies, {counted('sequences')} FROM (SELECT count(*) AS copies FROM {s.reads()} GROUP BY seq) x GROUP BY copies"))
def qc_duplication(spark, sf):
    return qc.duplication(reads(spark, sf))


# ------------------------------------------------------------------ files


@query(lambda: (s := Sql()).select(f"SELECT row_number() OVER (ORDER BY rec_idx) - 1 AS rec_idx, id, seq, qual FROM {s.reads()}"))
def fastq_round_trip(spark, sf):
    """Written as gzip parts, in order, and read back, numbered anew."""
    folder = store.shared_folder(spark, "fastq")
    write_fastq(reads(spark, sf), folder, level=6)
    return load(spark, folder)


@query(lambda: (s := Sql()).select(f"SELECT row_number() OVER (ORDER BY rec_idx) - 1 AS rec_idx, split_part(id, ' ', 1) AS id, seq, qual FROM {s.reads()} WHERE length(seq) > 0"))
def ubam_round_trip(spark, sf):
    """As BAM parts, which hold no empty reads, and back; ids end at the first space."""
    folder = store.shared_folder(spark, "ubam")
    write_ubam(reads(spark, sf).filter("length(seq) > 0"), folder, header(None, "readprep", "1.0", "readprep"))
    return load(spark, folder)


@query(lambda: (s := Sql()).select(f"SELECT row_number() OVER (ORDER BY a.rec_idx) - 1 AS rec_idx, split_part(a.id, ' ', 1) AS id1, split_part(b.id, ' ', 1) AS id2, a.seq AS seq1, a.qual AS qual1, b.seq AS seq2, b.qual AS qual2 FROM {s.reads('r1')} a JOIN {s.reads('r2')} b USING (rec_idx) WHERE length(a.seq) > 0 AND length(b.seq) > 0"))
def ubam_pairs_round_trip(spark, sf):
    """Pairs as one interleaved BAM folder, and zipped again by flags."""
    folder = store.shared_folder(spark, "ubam")
    write_ubam_pairs(_long_pairs(spark, sf, 1, 1), folder, header(None, "readprep", "1.0", "readprep"))
    back = pairs.strict(pairs.interleaved(read_ubam_sides(spark, folder)))
    n = F.col("rec_idx").alias("rec_idx")
    return back.select(n, *[F.col(f"r{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in ("id", "seq", "qual")])
