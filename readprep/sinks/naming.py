"""Output names, and the check that no two outputs fall together."""

from __future__ import annotations

import re
from pathlib import Path

from ..options import OptionError


def stem(path: str) -> str:
    name = Path(path).name
    for ext in (".fastq.gz", ".fq.gz", ".fastq", ".fq"):
        if name.endswith(ext):
            return name.removesuffix(ext)
    return Path(name.removesuffix(".gz")).stem


def place(folder: str | None, name: str) -> str:
    """A name in a folder, which may name its store; without one, in the working folder."""
    return f"{folder.rstrip('/')}/{name}" if folder and "://" in folder else str(Path(folder or "") / name)


def _in(path: str, output_dir: str | None, name: str) -> str:
    return place(output_dir or (path.rpartition("/")[0] if "://" in path else str(Path(path).parent)), name)


def _gz(gzip: bool) -> str:
    return ".gz" if gzip else ""


def single(path: str, output_dir: str | None = None, basename: str | None = None, gzip: bool = True) -> str:
    return _in(path, output_dir, f"{basename or stem(path)}_trimmed.fq{_gz(gzip)}")


def single_bam(path: str, output_dir: str | None = None, basename: str | None = None) -> str:
    return _in(path, output_dir, f"{basename or stem(path)}_trimmed.bam")


def paired(r1: str, r2: str, output_dir: str | None = None, basename: str | None = None, gzip: bool = True, kind: str = "val") -> tuple[str, str]:
    """kind: val or unpaired."""
    return tuple(_in(r1, output_dir, f"{basename or stem(r)}_{kind}_{k}.fq{_gz(gzip)}") for k, r in ((1, r1), (2, r2)))


def interleaved(path: str, output_dir: str | None = None, basename: str | None = None, gzip: bool = False) -> tuple[str, str]:
    return tuple(_in(path, output_dir, f"{basename or stem(path)}_val_{k}.fq{_gz(gzip)}") for k in (1, 2))


def paired_bam(r1: str, output_dir: str | None = None, basename: str | None = None) -> str:
    return _in(r1, output_dir, f"{basename or stem(r1)}_val.bam")


def passthrough(path: str, output_dir: str | None = None, basename: str | None = None, gzip: bool = True) -> str:
    return _in(path, output_dir, f"{basename or stem(path)}_passthrough.fq{_gz(gzip)}")


def report(path: str, output_dir: str | None = None, json: bool = False, side: int | None = None) -> str:
    """Of a file; of one side of an interleaved file, with the stem in place of the name."""
    name = f"{stem(path)}_R{side}" if side else Path(path).name
    return _in(path, output_dir, f"{name}_trimming_report.{'json' if json else 'txt'}")


def hardtrim(path: str, keep: int, end: str, output_dir: str | None = None, gzip: bool = True, bam: bool = False) -> str:
    """In the output folder, or the working folder; end: 5prime or 3prime."""
    return place(output_dir, f"{stem(path)}.{keep}bp_{end}{'.bam' if bam else '.fq' + _gz(gzip)}")


def clock(path: str, side: int, output_dir: str | None = None, gzip: bool = True) -> str:
    return place(output_dir, f"{stem(path)}.clock_UMI.R{side}.fq{_gz(gzip)}")


def implicon(path: str, n: int, side: int, output_dir: str | None = None, gzip: bool = True) -> str:
    own = re.sub(r"_?R1$" if side == 1 else r"_?R[234]$", "", stem(path))
    return place(output_dir, f"{own}_{n}bp_UMI_R{side}.fastq{_gz(gzip)}")


def demux(path: str, sample: str, output_dir: str | None = None, gzip: bool = True) -> str:
    return _in(path, output_dir, f"{stem(path)}_{sample}.fq{_gz(gzip)}")


def demux_summary(path: str, output_dir: str | None = None) -> str:
    return _in(path, output_dir, f"{stem(path)}_demultiplexing_summary.txt")


def qc(path: str) -> str:
    """Beside the output that it counts."""
    return f"{path.removesuffix('.gz').rpartition('.')[0]}{'.fq' if path.endswith('.gz') else ''}_qc.json"


def preflight(outputs: list[str]) -> list[str]:
    """Raise OptionError if two outputs are the same file, also where case doesn't count."""
    seen: dict[str, str] = {}
    for o in outputs:
        key = (o if "://" in o else str(Path(o).absolute())).casefold()
        if key in seen:
            raise OptionError(f"{o} and {seen[key]} would be the same file")
        seen[key] = o
    return outputs


def make_folders(outputs: list[str]) -> None:
    for o in (o for o in outputs if "://" not in o):
        Path(o).parent.mkdir(parents=True, exist_ok=True)
