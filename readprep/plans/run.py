"""Whole runs: files in, files and reports out. Each is one lazy plan after one small detection step."""

from __future__ import annotations

import gzip
import io
import json
import zlib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, filters, modes, pairs, stats
from ..operators.trim import trim_pairs, trim_single
from ..options import Options, OptionError, TrimConfig, clump_layout, parse_memory
from ..reports import Run, json_report, text_report
from ..sinks import naming, store
from ..sinks.fastq import write_clumped, write_fastq
from ..sinks.ubam import header, write_ubam, write_ubam_pairs
from ..sources.fastq import check_first, detect_format, format_of, read_fastq, read_fastq_store, sanity_check
from ..sources.sheets import read_sheet
from ..sources.ubam import peek_header, read_header, read_ubam, read_ubam_sides, read_ubam_store
from . import qc

TOOL, VERSION = "readprep", "1.0"


@dataclass
class Outcome:
    """What a run wrote and counted."""

    outputs: list[str] = field(default_factory=list)
    stats: list[dict] = field(default_factory=list)
    pair: dict | None = None
    note: str = ""


def kind_of(spark: SparkSession, path: str) -> str:
    """fastq, fastq.gz or bam, by content, wherever the file is."""
    return format_of(path, store.head(spark, path)) if store.is_uri(path) else detect_format(path)


def _header_of(spark: SparkSession, path: str) -> str | None:
    if kind_of(spark, path) != "bam":
        return None
    return read_header(gzip.open(io.BytesIO(store.head(spark, path, 1 << 22))))[0] if store.is_uri(path) else peek_header(path)


def load(spark: SparkSession, path: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """Reads (rec_idx, id, seq, qual) of a FASTQ or BAM file, whatever its name; of a path that names its store, also of a
    folder of parts, numbered from part to part."""
    own = ["rec_idx", "id", "seq", "qual"]
    if not store.is_uri(path):
        if detect_format(path) == "bam":
            return read_ubam(spark, path, tags=tags).select(*own)
        sanity_check(path)
        return read_fastq(spark, path).select(*own)
    kind = kind_of(spark, path)
    if kind == "bam":
        return read_ubam_store(spark, path, tags).select(*own)
    data = store.head(spark, path)
    data = zlib.decompressobj(31).decompress(data) if kind == "fastq.gz" else data
    check_first(path, [line + b"\n" for line in data.split(b"\n")[:4]])
    reads = read_fastq_store(spark, path)
    base, bases = 0, []
    for name, n in sorted((r[0], r[1]) for r in reads.groupBy("file").agg(F.count(F.lit(1))).collect()):  # a row for each part
        bases.append((name, base))
        base += n
    if len(bases) > 1:
        shared = spark.createDataFrame(bases, "file string, base long")
        reads = reads.join(F.broadcast(shared), "file").withColumn("rec_idx", F.col("rec_idx") + F.col("base"))
    return reads.select(*own)


def _zipped(o: Options, path: str) -> bool:
    """gzip output goes with gzip input, unless it is switched off."""
    return o.gzip and path.endswith(".gz")


def _histogram(trimmed: DataFrame, t: str) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for r in stats.length_histogram(trimmed, t).collect():  # adapters x lengths
        out.setdefault(r["adapter_idx"], {})[r["length"]] = r["count"]
    return out


def _report(spark: SparkSession, o: Options, run: Run, path: str, s: dict, side: int, pair: dict | None, mate: int | None = None, pt: tuple[str, str] | None = None) -> list[str]:
    if not o.report:
        return []
    out = []
    for as_json in (False, True):
        name = naming.report(path, o.output_dir, as_json, mate)
        naming.make_folders([name])
        store.write_text(spark, name, json_report(run, s, side, pair) if as_json else text_report(run, s, side, pair, pt))
        out.append(name)
    return out


def _qc(o: Options, reads: DataFrame, path: str) -> list[str]:
    """Per-position, length, GC and duplication counts of what was written, as JSON; a row for each position or length."""
    if not o.fastqc:
        return []
    name = naming.qc(path)
    parts = {"per_position": qc.per_position(reads), "lengths": qc.lengths(reads), "gc_content": qc.gc_content(reads), "duplication": qc.duplication(reads)}
    found = {k: sorted((r.asDict() for r in df.collect()), key=lambda r: next(iter(r.values()))) for k, df in parts.items()}
    store.write_text(reads.sparkSession, name, json.dumps(found, indent=1))
    return [name]


def _command(o: Options) -> str:
    return " ".join([TOOL, *o.inputs])


def single(spark: SparkSession, o: Options, path: str) -> Outcome:
    """One file: trim, filter, write, report; demultiplex the result if asked to."""
    reads = load(spark, path, o.preserve_tags)
    c, note = detect.resolve(o, reads)
    clumped = o.clumpify and clump_layout(parse_memory(o.memory), o.cores).fits
    source = modes.clump(reads, clump_layout(parse_memory(o.memory), o.cores).n_bins) if clumped else reads
    t = filters.judge(trim_single(source, c), c).persist()
    try:
        s = stats.single_stats(t, c).first().asDict()
        hist = _histogram(t, "t")
        kept = t.filter(F.col("verdict") == filters.PASS)
        gz = _zipped(o, path)
        if o.output_format == "ubam":
            out = naming.single_bam(path, o.output_dir, o.basename)
            write_ubam(kept.select("rec_idx", "r.*"), out, header(_header_of(spark, path), TOOL, VERSION, _command(o)), o.compression)
        else:
            out = naming.single(path, o.output_dir, o.basename, gz)
            if clumped:
                write_clumped(kept, out, "r", o.compression)
            else:
                write_fastq(kept, out, "r", gzip=gz, level=o.compression)
        outputs = [out, *_qc(o, kept.select("r.*"), out)]
        if o.demux:
            outputs += demux(spark, o, kept.select("rec_idx", "r.*"), out, gz)
    finally:
        t.unpersist()
    run = Run(c, Path(path).name, (Path(path).name,), _command(o), TOOL, VERSION, o.consider_already_trimmed, hist)
    return Outcome(outputs + _report(spark, o, run, path, s, 1, None), [s], None, note)


def demux(spark: SparkSession, o: Options, reads: DataFrame, path: str, gz: bool) -> list[str]:
    """A file for each sample of the sheet and one for the rest, and a summary."""
    sheet = read_sheet(spark, o.demux)
    assigned = modes.demultiplex(reads, sheet).persist()
    try:
        out = []
        for sample in [*[r["sample"] for r in sheet.collect()], modes.NO_CODE]:
            name = naming.demux(path, sample, o.output_dir, gz)
            out.append(write_fastq(assigned.filter(F.col("sample") == sample), name, gzip=gz, level=o.compression))
        summary = naming.demux_summary(path, o.output_dir)
        rows = modes.demux_summary(assigned, sheet).collect()
        store.write_text(spark, summary, "".join(f"{r['sample']}\t{r['barcode'] or ''}\t{r['reads']}\n" for r in rows))
    finally:
        assigned.unpersist()
    return [*out, summary]


def _pairs(spark: SparkSession, o: Options, r1: str, r2: str | None) -> DataFrame:
    if r2 is None:
        return pairs.strict(pairs.interleaved(read_ubam_sides(spark, r1, o.preserve_tags)))
    pt = load(spark, o.passthrough) if o.passthrough else None
    return pairs.strict(pairs.zip_pairs(load(spark, r1, o.preserve_tags), load(spark, r2, o.preserve_tags), pt))


def paired(spark: SparkSession, o: Options, r1: str, r2: str | None) -> Outcome:
    """A pair of files, or one interleaved BAM file."""
    joined = _pairs(spark, o, r1, r2)
    c, note = detect.resolve(o, joined.select("rec_idx", "r1.seq"))
    layout = clump_layout(parse_memory(o.memory), o.cores)
    clumped = o.clumpify and layout.fits
    t = trim_pairs(modes.clump(joined, layout.n_bins, "r1.seq") if clumped else joined, c)
    t = filters.judge_pairs(t, c).persist()
    try:
        sides = [stats.side_stats(t, c, n).first().asDict() for n in (1, 2)]
        p = stats.pair_stats(t).first().asDict()
        hists = [_histogram(t, f"t{n}") for n in (1, 2)]
        kept = t.filter(F.col("v.verdict") == filters.PASS)
        gz = _zipped(o, r1)
        outputs, pt = [], None
        if o.output_format == "ubam":
            out = naming.paired_bam(r1, o.output_dir, o.basename)
            outputs.append(write_ubam_pairs(kept, out, header(_header_of(spark, r1), TOOL, VERSION, _command(o)), o.compression))
        else:
            names = naming.interleaved(r1, o.output_dir, o.basename) if r2 is None else naming.paired(r1, r2, o.output_dir, o.basename, gz)
            for n, name in enumerate(names, 1):
                outputs.append(write_clumped(kept, name, f"r{n}", o.compression) if clumped else write_fastq(kept, name, f"r{n}", gzip=gz, level=o.compression))
            for n, name in enumerate(names, 1):
                outputs += _qc(o, kept.select(f"r{n}.*"), name)
            if o.retain_unpaired:
                for n, name in enumerate(naming.paired(r1, r2 or r1, o.output_dir, o.basename, gz, "unpaired"), 1):
                    outputs.append(write_fastq(t.filter(f"v.r{n}_ok"), name, f"r{n}", gzip=gz, level=o.compression))
            if o.passthrough:
                name = naming.passthrough(o.passthrough, o.output_dir, o.basename, gz)
                outputs.append(write_fastq(kept, name, "pt", gzip=gz, level=o.compression))
                pt = (o.passthrough, name)
    finally:
        t.unpersist()
    files = tuple(Path(x).name for x in ((r1, r2) if r2 else (r1,)))
    for n, s in enumerate(sides, 1):
        path = (r1 if n == 1 else r2) if r2 else r1
        run = Run(c, Path(path).name, files, _command(o), TOOL, VERSION, o.consider_already_trimmed, hists[n - 1])
        outputs += _report(spark, o, run, path, s, n, p, None if r2 else n, pt)
    return Outcome(outputs, sides, p, note)


def specialty(spark: SparkSession, o: Options) -> Outcome:
    """Hard trims, then clock, then UMI transfer: the first that is asked for runs alone."""
    out: list[str] = []
    if o.hardtrim5 or o.hardtrim3:
        n, end = (o.hardtrim5, "5prime") if o.hardtrim5 else (o.hardtrim3, "3prime")
        for path in o.inputs:
            reads = (modes.hardtrim5 if o.hardtrim5 else modes.hardtrim3)(load(spark, path, o.preserve_tags), n, o.rename)
            gz, bam = _zipped(o, path), o.output_format == "ubam"
            name = naming.hardtrim(path, n, end, o.output_dir, gz, bam)
            head = header(_header_of(spark, path), TOOL, VERSION, _command(o))
            out.append(write_ubam(reads, name, head, o.compression) if bam else write_fastq(reads, name, gzip=gz, level=o.compression))
        return Outcome(out)
    note = ""
    for r1, r2 in zip(o.inputs[::2], o.inputs[1::2], strict=True):
        joined, gz = _pairs(spark, o, r1, r2), _zipped(o, r1)
        if o.clock:
            done = modes.clock_umi(joined)
            s = modes.clock_summary(done).first()
            note += f"{r1}: {s['with_fixed']} of {s['pairs']} pairs hold both fixed sequences. "
            names = [naming.clock(r, n, o.output_dir, gz) for n, r in ((1, r1), (2, r2))]
        else:
            done = modes.implicon_umi(joined, o.implicon)
            names = [naming.implicon(r, o.implicon, n, o.output_dir, gz) for n, r in ((1, r1), (2, r2))]
        out += [write_fastq(done, name, f"r{n}", gzip=gz, level=o.compression) for n, name in enumerate(names, 1)]
    return Outcome(out, note=note)


def planned(o: Options, samples: tuple[str, ...] = ()) -> list[str]:
    """Every output of a run, for the check that none fall together. samples: of the barcode sheet."""
    out: list[str] = []
    if o.hardtrim5 or o.hardtrim3:
        n, end = (o.hardtrim5, "5prime") if o.hardtrim5 else (o.hardtrim3, "3prime")
        return [naming.hardtrim(p, n, end, o.output_dir, _zipped(o, p), o.output_format == "ubam") for p in o.inputs]
    if o.specialty:
        for a, b in zip(o.inputs[::2], o.inputs[1::2], strict=False):
            gz = _zipped(o, a)
            out += [naming.clock(r, n, o.output_dir, gz) if o.clock else naming.implicon(r, o.implicon, n, o.output_dir, gz) for n, r in ((1, a), (2, b))]
        return out
    units = [(p, None) for p in o.inputs]
    if o.paired and len(o.inputs) > 1:
        units = list(zip(o.inputs[::2], o.inputs[1::2], strict=True))
    for a, b in units:
        gz, main = _zipped(o, a), []
        if o.output_format == "ubam":
            main = [(naming.paired_bam if o.paired else naming.single_bam)(a, o.output_dir, o.basename)]
        elif b is not None:
            main = list(naming.paired(a, b, o.output_dir, o.basename, gz))
        elif o.paired:
            main = list(naming.interleaved(a, o.output_dir, o.basename))
        else:
            main = [naming.single(a, o.output_dir, o.basename, gz)]
        out += main
        if o.retain_unpaired and o.paired:
            out += naming.paired(a, b or a, o.output_dir, o.basename, gz, "unpaired")
        if o.passthrough:
            out.append(naming.passthrough(o.passthrough, o.output_dir, o.basename, gz))
        if o.demux and not o.paired:
            out += [naming.demux(main[0], s, o.output_dir, gz) for s in (*samples, modes.NO_CODE)] + [naming.demux_summary(main[0], o.output_dir)]
        if o.fastqc and o.output_format != "ubam":
            out += [naming.qc(x) for x in main]
        if o.report:
            sides = [(a, None), (b, None)] if b is not None else [(a, 1), (a, 2)] if o.paired else [(a, None)]
            out += [naming.report(p, o.output_dir, as_json, mate) for p, mate in sides for as_json in (False, True)]
    return out


def run(spark: SparkSession, o: Options) -> list[Outcome]:
    """Validate, check outputs, and run every file or pair."""
    if not o.inputs:
        raise OptionError("no input")
    kinds = [kind_of(spark, p) for p in o.inputs]
    o = Options(**(o.__dict__ | {"bam_inputs": "bam" in kinds})).validate()
    if o.passthrough and "bam" in kinds:
        raise OptionError("passthrough takes no BAM input")
    samples = tuple(r["sample"] for r in read_sheet(spark, o.demux).collect()) if o.demux else ()  # a sheet is small
    naming.make_folders(naming.preflight(planned(o, samples)))
    if o.specialty:
        return [specialty(spark, o)]
    if o.paired:
        if len(o.inputs) == 1:
            return [paired(spark, o, o.inputs[0], None)]
        return [paired(spark, o, a, b) for a, b in zip(o.inputs[::2], o.inputs[1::2], strict=True)]
    return [single(spark, o, p) for p in o.inputs]


def default_config(**own) -> TrimConfig:
    return TrimConfig(**own)
