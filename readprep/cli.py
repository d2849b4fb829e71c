"""Command line: python -m readprep.cli [options] FILE..."""

from __future__ import annotations

import argparse
import sys

from .options import Options

# Single-dash long forms that are still accepted, and options that no longer do anything.
LEGACY = {"-r1": "--length_1", "-r2": "--length_2", "-a2": "--adapter2"}
IGNORED = ["--gzip", "--suppress_warn", "--report", "--keep", "--hulu"]
IGNORED_WITH_VALUE = ["--path_to_cutadapt", "--cutadapt_args"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readprep", description="Trim and filter sequencing reads with Spark.")
    flag = lambda *n, **k: p.add_argument(*n, action="store_true", **k)
    num = lambda *n, **k: p.add_argument(*n, type=int, **k)
    p.add_argument("inputs", nargs="*")
    num("-q", "--quality", default=20)
    num("--nextseq", "--2colour", dest="nextseq")
    flag("--phred33"), flag("--phred64")
    p.add_argument("-a", "--adapter", action="append", default=[])
    p.add_argument("--adapter2", action="append", default=[])
    g = p.add_mutually_exclusive_group()
    for name in ("illumina", "nextera", "small_rna", "stranded_illumina", "bgiseq"):
        g.add_argument(f"--{name}", dest="preset", action="store_const", const=name)
    p.add_argument("-e", "--error_rate", type=float, default=0.1)
    num("--stringency", default=1), num("-n", "--times", default=1), num("--consider_already_trimmed")
    flag("--discard_untrimmed")
    num("--length"), num("--max_length")
    p.add_argument("--max_n", type=float)
    flag("--trim-n", dest="trim_n")
    num("--clip_R1", dest="clip_r1"), num("--clip_R2", dest="clip_r2")
    num("--three_prime_clip_R1", dest="three_prime_clip_r1"), num("--three_prime_clip_R2", dest="three_prime_clip_r2")
    flag("--rename"), flag("--paired"), flag("--retain_unpaired")
    num("--length_1", default=35), num("--length_2", default=35)
    p.add_argument("--passthrough")
    flag("--rrbs"), flag("--non_directional"), flag("--poly_a"), flag("--poly_g"), flag("--no_poly_g")
    num("--hardtrim5"), num("--hardtrim3")
    flag("--clock")
    num("--implicon", nargs="?", const=8)
    p.add_argument("--demux")
    p.add_argument("-o", "--output_dir")
    p.add_argument("--basename")
    p.add_argument("--dont_gzip", dest="gzip", action="store_false")
    num("--compression", default=1)
    flag("--clumpify")
    p.add_argument("--memory", default="1G")
    p.add_argument("--output-format", dest="output_format", default="fastq")
    p.add_argument("--preserve-tags", dest="preserve_tags", type=lambda s: tuple(s.split(",")), default=())
    p.add_argument("--no_report_file", dest="report", action="store_false")
    num("-j", "--cores", default=1)
    flag("--fastqc")
    p.add_argument("--fastqc_args", default="")
    return p


def options(argv: list[str]) -> Options:
    argv = [LEGACY.get(a, a) for a in argv]
    kept, skip = [], False
    for a in argv:
        if skip:
            skip = False
        elif a in IGNORED_WITH_VALUE:
            skip = True
        elif a not in IGNORED:
            kept.append(a)
    ns = vars(parser().parse_args(kept))
    ns.pop("phred33")
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in ns.items()})


def notes(argv: list[str], o: Options) -> list[str]:
    """What was given and does nothing here."""
    given = [a for a in argv if a in IGNORED or a in IGNORED_WITH_VALUE]
    out = [f"{a} has no effect any more and is ignored." for a in dict.fromkeys(given)]
    if o.cores > 1 and o.output_format == "ubam":
        out.append(f"The number of cores ({o.cores}) is ignored for BAM output: Spark's own tasks encode it.")
    if o.fastqc_args:
        out.append("Arguments for an external QC program are ignored: QC counts are made here.")
    if o.adapter2 and not o.paired:
        out.append("A read 2 adapter is ignored for single reads.")
    return out


def summary(x) -> list[str]:
    """The counts of a run, a line for each side, and for pairs."""
    out = [", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in s.items() if v) for s in x.stats]
    return out + ([", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in x.pair.items() if v)] if x.pair else [])


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.run import run

    argv = sys.argv[1:] if argv is None else argv
    o = options(argv)
    for note in notes(argv, o):
        print(f"Note: {note}", file=sys.stderr)
    spark = SparkSession.builder.appName("readprep").getOrCreate()
    for x in run(spark, o):
        print(x.note, *summary(x), *x.outputs, sep="\n  ", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
