"""Options of a run, their validation, and the resolved trim configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import groupby
from pathlib import Path

# Adapter presets (name, sequence, sequence for read 2), in probing order; the fourth is not probed.
PRESETS: dict[str, tuple[str, str, str | None]] = {
    "illumina": ("Illumina", "AGATCGGAAGAGC", None),
    "nextera": ("Nextera", "CTGTCTCTTATA", None),
    "small_rna": ("smallRNA", "TGGAATTCTCGG", "GATCGTCGGACT"),
    "stranded_illumina": ("Stranded Illumina", "ACTGTCTCTTATA", None),
    "bgiseq": ("BGI/DNBSEQ", "AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA", "AAGTCGGATCGTAGCCATGTCGTTCTGTGAGCCAAGGAGTTG"),
}
PROBED = ["illumina", "nextera", "small_rna", "bgiseq"]
SCAN_CAP = 1_000_000

Adapters = tuple[tuple[str, str], ...]


class OptionError(ValueError):
    """Options that contradict each other or lie out of range."""


@dataclass(frozen=True)
class TrimConfig:
    """Everything the per-read pipeline needs, resolved."""

    quality_cutoff: int = 20
    two_colour: bool = False
    phred: int = 33
    adapters: Adapters = ()
    adapters_r2: Adapters = ()
    error_rate: float = 0.1
    stringency: int = 1
    times: int = 1
    length_cutoff: int = 20
    max_length: int | None = None
    max_n: float | None = None
    trim_n: bool = False
    clip_r1: int | None = None
    clip_r2: int | None = None
    three_prime_clip_r1: int | None = None
    three_prime_clip_r2: int | None = None
    rename: bool = False
    paired: bool = False
    rrbs: bool = False
    non_directional: bool = False
    poly_a: bool = False
    poly_g: bool = False
    discard_untrimmed: bool = False
    retain_unpaired: bool = False
    length_1: int = 35
    length_2: int = 35
    gzip: bool = True


@dataclass(frozen=True)
class Options:
    """A user's options; None stands for not given."""

    inputs: tuple[str, ...] = ()
    quality: int = 20
    nextseq: int | None = None
    phred64: bool = False
    adapter: tuple[str, ...] = ()
    adapter2: tuple[str, ...] = ()
    preset: str | None = None
    error_rate: float = 0.1
    stringency: int = 1
    times: int = 1
    consider_already_trimmed: int | None = None
    discard_untrimmed: bool = False
    length: int | None = None
    max_length: int | None = None
    max_n: float | None = None
    trim_n: bool = False
    clip_r1: int | None = None
    clip_r2: int | None = None
    three_prime_clip_r1: int | None = None
    three_prime_clip_r2: int | None = None
    rename: bool = False
    paired: bool = False
    retain_unpaired: bool = False
    length_1: int = 35
    length_2: int = 35
    passthrough: str | None = None
    rrbs: bool = False
    non_directional: bool = False
    poly_a: bool = False
    poly_g: bool = False
    no_poly_g: bool = False
    hardtrim5: int | None = None
    hardtrim3: int | None = None
    clock: bool = False
    implicon: int | None = None
    demux: str | None = None
    output_dir: str | None = None
    basename: str | None = None
    gzip: bool = True
    compression: int = 1
    clumpify: bool = False
    memory: str = "1G"
    output_format: str = "fastq"
    preserve_tags: tuple[str, ...] = ()
    report: bool = True
    cores: int = 1
    fastqc: bool = False
    fastqc_args: str = ""
    bam_inputs: bool = False

    @property
    def specialty(self) -> bool:
        return bool(self.hardtrim5 or self.hardtrim3 or self.clock or self.implicon)

    def validate(self) -> Options:
        """Raise OptionError for the first rule that is broken."""
        def need(ok: object, what: str) -> None:
            if not ok:
                raise OptionError(what)

        need(0 <= self.error_rate <= 1, "error rate must lie between 0 and 1")
        need(self.stringency >= 1, "stringency must be at least 1")
        need(1 <= self.times <= 10, "rounds must lie between 1 and 10")
        need(self.cores >= 1, "at least one core is needed")
        need(1 <= self.compression <= 9, "compression must lie between 1 and 9")
        need(self.nextseq is None or 1 <= self.nextseq <= 199, "the two-colour cutoff must lie between 1 and 199")
        need(self.nextseq is None or self.quality == 20, "give a quality cutoff or a two-colour cutoff, not both")
        need(self.consider_already_trimmed is None or 0 <= self.consider_already_trimmed <= 10_000, "already-trimmed limit must be at most 10000")
        need(self.max_n is None or self.max_n >= 0, "the limit of Ns can't be negative")
        for n in (self.hardtrim5, self.hardtrim3):
            need(n is None or 1 <= n <= 999, "hard-trim length must lie between 1 and 999")
        need(self.implicon is None or self.implicon >= 1, "the UMI needs at least one base")
        need(self.preset is None or self.preset in PRESETS, f"unknown preset {self.preset}")
        need(not (self.poly_g and self.no_poly_g), "poly-G trimming can't be both on and off")
        need(self.rrbs or not self.non_directional, "non-directional needs RRBS")
        need(self.output_format in ("fastq", "ubam"), "output format is fastq or ubam")
        for tag in self.preserve_tags:
            need(re.fullmatch(r"[A-Za-z][A-Za-z0-9]", tag), f"{tag} is no tag name")
        need(not self.preserve_tags or self.bam_inputs, "tags can be preserved from BAM input only")
        if self.paired:
            n = len(self.inputs)
            need(n % 2 == 0 or (n == 1 and self.bam_inputs), "paired input needs an even number of files")
            pairs = list(zip(self.inputs[::2], self.inputs[1::2], strict=False))
            need(all(a != b for a, b in pairs), "read 1 and read 2 are the same file")
            need(len(set(pairs)) == len(pairs), "a pair of files is given twice")
        units = len(self.inputs) // 2 if self.paired and len(self.inputs) > 1 else len(self.inputs)
        need(self.basename is None or units <= 1, "a basename needs a single file or pair")
        if self.output_format == "ubam":
            bad = [self.clumpify, self.passthrough, self.clock, self.implicon, self.demux, self.retain_unpaired]
            need(not any(bad), "uBAM output excludes clumpify, passthrough, clock, implicon, demux and retain-unpaired")
        if self.clumpify:
            need(self.cores >= 2 and self.gzip, "clumpify needs two cores and gzip output")
            need(not self.specialty and not self.demux, "clumpify excludes specialty modes and demux")
        if self.passthrough is not None:
            need(self.paired and units == 1 and len(self.inputs) == 2, "passthrough needs exactly one pair")
            need(not (self.retain_unpaired or self.clumpify or self.specialty or self.demux), "passthrough excludes retain-unpaired, clumpify, specialty modes and demux")
            need(not self.bam_inputs, "passthrough takes no BAM input")
            need(Path(self.passthrough).exists(), "the passthrough file doesn't exist")
            need(Path(self.passthrough).resolve() not in {Path(x).resolve() for x in self.inputs}, "the passthrough file is one of the reads' files")
        if self.demux is not None:
            need(not self.paired, "demux takes single-end reads")
            need(Path(self.demux).exists(), "the sample sheet doesn't exist")
        return self

    def user_adapters(self) -> tuple[Adapters, Adapters] | None:
        """Adapters that the options fix; None if they are to be detected. Read 2 adapters count only beside -a."""
        if self.adapter:
            return numbered(self.adapter), numbered(self.adapter2)
        if self.preset:
            name, seq, second = PRESETS[self.preset]
            return ((name, seq),), (((f"{name}_r2", second),) if second else ())
        return None

    def config(self, adapters: Adapters, adapters_r2: Adapters, poly_g: bool) -> TrimConfig:
        """The resolved configuration for one file or pair."""
        small = bool(adapters) and adapters[0][1] == PRESETS["small_rna"][1]
        clip_r2 = 2 if self.rrbs and not self.non_directional and self.paired and self.clip_r2 is None else self.clip_r2
        shared = {k: getattr(self, k) for k in TrimConfig.__dataclass_fields__ if k in Options.__dataclass_fields__}
        own = TrimConfig(**(shared | {"clip_r2": clip_r2, "poly_g": poly_g}))
        return replace(
            own,
            quality_cutoff=self.nextseq or self.quality,
            two_colour=self.nextseq is not None,
            phred=64 if self.phred64 else 33,
            adapters=adapters,
            adapters_r2=adapters_r2 if self.paired else (),
            length_cutoff=self.length if self.length is not None else (18 if small else 20),
        )


def expand_braces(spec: str) -> str:
    """`A{10}` is ten As; a whole spec of one base only."""
    m = re.fullmatch(r"([ACGTN])\{(\d+)\}", spec.upper())
    if not m:
        return spec
    if int(m[2]) == 0:
        raise OptionError(f"{spec} stands for no base")
    return m[1] * int(m[2])


def checked(seq: str) -> str:
    seq = seq.strip().upper()
    if not seq or set(seq) - set("ACGTNX"):
        raise OptionError(f"'{seq}' isn't an adapter of A, C, G, T, N and X")
    return seq


def parse_fasta(text: str) -> list[tuple[str, str]]:
    """Entries of a FASTA text; sequences may run over lines. An empty entry or file is an error."""
    out: list[tuple[str, list[str]]] = []
    for line in map(str.strip, text.splitlines()):
        if line.startswith(">"):
            out.append((line[1:].strip(), []))
        elif line:
            if not out:
                raise OptionError("the file doesn't start with '>'")
            out[-1][1].append(line)
    if not out:
        raise OptionError("no adapter in the file")
    return [(name, checked("".join(parts))) for name, parts in out]


def parse_adapter(spec: str) -> list[str]:
    """The sequences of one option: file:PATH, several joined by ' -a ', or one, perhaps with braces."""
    if spec.startswith("file:"):
        return [s for _, s in parse_fasta(Path(spec[5:]).read_text())]
    if " -a " in f" {spec.strip()}":
        return [checked(s) for s in re.split(r"(?:^|\s)-a\s+", spec.strip()) if s.strip()]
    return [checked(expand_braces(spec.strip()))]


def numbered(specs: tuple[str, ...]) -> Adapters:
    seqs = [s for spec in specs for s in parse_adapter(spec)]
    return tuple((f"adapter_{i}", s) for i, s in enumerate(seqs, 1))


def parse_memory(text: str) -> int:
    """512M, 2G, 1024K or bytes; powers of 1024."""
    m = re.fullmatch(r"(\d+)\s*([KMG]?)B?", text.strip(), re.I)
    if not m or not 0 < (n := int(m[1]) * 1024 ** " KMG".index(m[2].upper() or " ")) < 1 << 63:
        raise OptionError(f"'{text}' isn't a size of memory")
    return n


@dataclass(frozen=True)
class ClumpLayout:
    """Bins and bytes a bin for sorting by minimizer within a memory size."""

    n_bins: int
    bin_bytes: int
    fits: bool = field(default=True)


def clump_layout(memory: int, cores: int) -> ClumpLayout:
    """4 * (memory - 512 MiB) over 5 bins and 7 cores each; below 1 MiB a bin the order isn't worth having."""
    n = max(16, 4 * cores)
    own = 4 * (memory - (512 << 20)) // (5 * n + 7 * cores)
    return ClumpLayout(n, max(own, 0), own >= 1 << 20)


def predicted_peak(layout: ClumpLayout, cores: int) -> int:
    return (512 << 20) + layout.bin_bytes * (5 * layout.n_bins + 7 * cores) // 4


def allowed_errors(length: int, rate: float) -> str:
    """`1-9 bp: 0; 10-13 bp: 1`: the ranges of lengths that allow the same number of errors."""
    steps = [(n, int(n * rate // 1)) for n in range(1, length + 1)]
    if not steps:
        return "1-0 bp: 0"
    spans = [(list(g), e) for e, g in groupby(steps, key=lambda x: x[1])]
    out = [f"{g[0][0]}-{g[-1][0]} bp: {e}" for g, e in spans]
    return "; ".join(out)
