"""Text and JSON reports of a run, from collected counters. The tool's name on them is a parameter."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from math import floor

from .options import TrimConfig, allowed_errors

Row = dict[str, int]


@dataclass(frozen=True)
class Run:
    """What a report says about a run besides its counters."""

    config: TrimConfig
    input_filename: str
    input_filenames: tuple[str, ...] = ()
    command_line: str = ""
    tool: str = "readprep"
    version: str = "1.0"
    consider_already_trimmed: int | None = None
    histogram: dict[int, dict[int, int]] = field(default_factory=dict)  # adapter -> removed length -> count


# The lines of a report, which other tools parse. Braces take the run's own values.
HEADER = """\
SUMMARISING RUN PARAMETERS
=========================
Input filename: {file}
Trimming mode: {mode}
{tool} version: {version}"""
TWO_COLOUR = "2-colour high quality G-trimming enabled, with quality cutoff: --nextseq-trim={cutoff}"
QUALITY = "Quality Phred score cutoff: {cutoff}"
ENCODING = "Quality encoding type selected: ASCII+{phred}"
ONE_ADAPTER = "Adapter sequence: '{seq}' (user-specified or auto-detected)"
ADAPTERS = "Adapter sequence(s):{listed} (user-specified)"
ONE_ADAPTER_2 = "Optional adapter 2 sequence (Read 2): '{seq}'"
ADAPTERS_2 = "Adapter 2 sequence(s) (Read 2):{listed}"
ROUNDS = "Trimming rounds per read (-n): {times}"
ERROR_RATE = "Maximum trimming error rate: {rate}"
OVERLAP = "Minimum required adapter overlap (stringency): {overlap} bp"
LENGTH_SINGLE = "Minimum required sequence length single-end: {length} bp"
LENGTH_PAIRED = "Minimum required sequence length for both reads before a sequence pair gets removed: {length} bp"
TRIM_N = "Removing Ns from the end of reads"
RRBS = "File was specified to be an MspI-digested RRBS sample. Read 1 sequences with adapter contamination will be trimmed a further 2 bp from their 3' end, and Read 2 sequences will be trimmed by 2 bp from their 5' end to remove potential methylation-biased bases from the end-repair reaction"
NON_DIRECTIONAL = "File was specified to be a non-directional MspI-digested RRBS sample. Sequences starting with either 'CAA' or 'CGA' will have the first 2 bp trimmed off to remove potential methylation-biased bases from the end-repair reaction"
POLY_A = "Poly-A trimming enabled: removing poly-A tails from 3' end of R1/SE reads, and poly-T heads from 5' end of R2 reads"
POLY_G = "Poly-G trimming enabled: removing poly-G tails from 3' end of both R1 and R2 (2-colour sequencer artifact)"
GZIP = "Output file will be GZIP compressed"
SUMMARY_HEAD = """
{tool} {version} — adapter trimming built in
This is cutadapt 4.0 (compatible; for MultiQC backwards compatibility)
Command line parameters: -j 1 -e {rate} -q {cutoff} -O {overlap} -a {adapter} {file}
Processing reads on 1 core in single-end mode ...

=== Summary ===

Total reads processed:           {total:>10,}
Reads with adapters:             {hits:>10,} ({hits_share})"""
UNTRIMMED = "Reads discarded as untrimmed:    {n:>10,} ({share})"
SUMMARY_TAIL = """\
Reads written (passing filters): {written:>10,} ({written_share})

Total basepairs processed:   {bp:>12,} bp
Quality-trimmed:             {quality:>12,} bp ({quality_share})
Total written (filtered):    {after:>12,} bp ({after_share})
"""
ADAPTER_BLOCK = """\
=== Adapter {k} ===

Sequence: {seq}; Type: regular 3'; Length: {length}; Trimmed: {times} times.

No. of allowed errors:
{allowed}

Overview of removed sequences
length\tcount\texpect\tmax.err\terror counts"""
FOOTER = """\
RUN STATISTICS FOR INPUT FILE: {file}
=============================================
{total} sequences processed in total
Sequences removed because they became shorter than the length cutoff of {length} bp:\t{short}
Sequences removed because they were longer than the upper length cutoff:\t{long}
Sequences removed because of too many N bases:\t{many_n}"""
RRBS_3 = "RRBS reads trimmed by additional 2 bp when adapter contamination was detected:\t{share}"
RRBS_5 = "RRBS reads trimmed by 2 bp at the start when read started with CAA or CGA in total:\t{share}"
POLY_A_READS = "Reads with poly-A/T trimmed:\t{share}; {bp:,} bp removed"
POLY_G_READS = "Reads with poly-G/C trimmed:\t{share}; {bp:,} bp removed"
PAIRS = """\
=== Paired-end validation ===

Number of sequence pairs analysed:  {n:>10,}

Number of sequence pairs removed because at least one read was shorter than the length cutoff ({removed_share}):
                             {removed:>10,}
Number of pairs removed for N content ({many_n_share}):
                             {many_n:>10,}"""
UNPAIRED = """
Unpaired read 1 kept:        {one:>10,}
Unpaired read 2 kept:        {two:>10,}"""
PASSTHROUGH = """\
=== Passthrough file ===

Input:                          {source}
Output:                         {target}
Records carried through:        {kept:>10,} ({kept_share})
Records dropped (pair filtered):{dropped:>10,} ({dropped_share})
Sync checks performed:          {n:>10,} (all matched)"""
# End of the fixed values.


def percent(part: int, total: int, digits: int = 1) -> str:
    return f"{part / total * 100 if total else 0.0:.{digits}f}%"


def number(x: float) -> str:
    """As short as it reads back: 0.1, 1."""
    return f"{x:g}" if float(f"{x:g}") == x else repr(x)


def header(run: Run) -> str:
    c = run.config
    listed = lambda adapters: "".join(f" '{s}' [{n}]" for n, s in adapters)
    out = [HEADER.format(file=run.input_filename, mode="paired-end" if c.paired else "single-end", tool=run.tool, version=run.version)]
    out += [(TWO_COLOUR if c.two_colour else QUALITY).format(cutoff=c.quality_cutoff), ENCODING.format(phred=c.phred)]
    out.append(ONE_ADAPTER.format(seq=c.adapters[0][1]) if len(c.adapters) == 1 else ADAPTERS.format(listed=listed(c.adapters)))
    if c.adapters_r2:
        out.append(ONE_ADAPTER_2.format(seq=c.adapters_r2[0][1]) if len(c.adapters_r2) == 1 else ADAPTERS_2.format(listed=listed(c.adapters_r2)))
    if c.times > 1:
        out.append(ROUNDS.format(times=c.times))
    out += [ERROR_RATE.format(rate=number(c.error_rate)), OVERLAP.format(overlap=c.stringency), (LENGTH_PAIRED if c.paired else LENGTH_SINGLE).format(length=c.length_cutoff)]
    switches = [(c.trim_n, TRIM_N), (c.rrbs, RRBS), (c.non_directional, NON_DIRECTIONAL), (c.poly_a, POLY_A), (c.poly_g, POLY_G), (c.gzip, GZIP)]
    return "\n".join([*out, *[text for on, text in switches if on], "", ""])


def _adapters(run: Run, side: int):
    c = run.config
    return c.adapters_r2 if side == 2 and c.adapters_r2 else c.adapters


def compatible(run: Run, s: Row, side: int = 1) -> str:
    """The section that parsers of trimming reports know. Length filters don't count among its reads written."""
    c, adapters, total, bp = run.config, _adapters(run, side), s["total_reads"], s["bp_processed"]
    first = adapters[0][1] if adapters else ""
    hits, untrimmed, quality, after = (s[k] for k in ("reads_with_adapter", "discarded_untrimmed", "quality_bp", "bp_after_trim"))
    out = [SUMMARY_HEAD.format(tool=run.tool, version=run.version, rate=number(c.error_rate), cutoff=c.quality_cutoff, overlap=c.stringency, adapter=first, file=run.input_filename, total=total, hits=hits, hits_share=percent(hits, total))]
    if untrimmed:
        out.append(UNTRIMMED.format(n=untrimmed, share=percent(untrimmed, total)))
    written = total - untrimmed
    out.append(SUMMARY_TAIL.format(written=written, written_share=percent(written, total), bp=bp, quality=quality, quality_share=percent(quality, bp), after=after, after_share=percent(after, bp)))
    for k, (_, seq) in enumerate(adapters):
        counts = run.histogram.get(k, {})
        out.append(ADAPTER_BLOCK.format(k=k + 1, seq=seq, length=len(seq), times=sum(counts.values()), allowed=allowed_errors(len(seq), c.error_rate)))
        out += ["\t".join(map(str, (n, x, f"{total / 4.0**n:.1f}", floor(n * c.error_rate), x))) for n, x in sorted(counts.items()) if n]
        out += ["", ""]
    return "\n".join(out) + "\n"


def footer(run: Run, s: Row) -> str:
    total = s["total_reads"]
    share = lambda k: f"{s[k]} ({percent(s[k], total)})"
    out = [FOOTER.format(file=run.input_filename, total=total, length=run.config.length_cutoff, short=share("too_short"), long=share("too_long"), many_n=share("too_many_n"))]
    for key, text, bp in (("rrbs_3prime", RRBS_3, None), ("rrbs_5prime", RRBS_5, None), ("poly_a_reads", POLY_A_READS, "poly_a_bp"), ("poly_g_reads", POLY_G_READS, "poly_g_bp")):
        if s[key]:
            out.append(text.format(share=share(key), bp=s[bp] if bp else 0))
    return "\n".join([*out, "", ""])


def pair_block(p: Row) -> str:
    n = p["pairs_analyzed"]
    out = [PAIRS.format(n=n, removed=p["pairs_removed"], removed_share=percent(p["pairs_removed"], n, 2), many_n=p["pairs_removed_n"], many_n_share=percent(p["pairs_removed_n"], n, 2))]
    if p["r1_unpaired"] or p["r2_unpaired"]:
        out.append(UNPAIRED.format(one=p["r1_unpaired"], two=p["r2_unpaired"]))
    return "\n".join([*out, "", ""])


def passthrough_block(p: Row, source: str, target: str) -> str:
    n, kept, dropped = (p[f"passthrough_{k}"] for k in ("checked", "kept", "dropped"))
    if not n:
        return ""
    return PASSTHROUGH.format(source=source, target=target, n=n, kept=kept, kept_share=percent(kept, n, 2), dropped=dropped, dropped_share=percent(dropped, n, 2)) + "\n\n"


def text_report(run: Run, s: Row, side: int = 1, pair: Row | None = None, passthrough: tuple[str, str] | None = None) -> str:
    """The whole report of one file; the pair's blocks stand in read 2's."""
    out = header(run) + compatible(run, s, side) + footer(run, s)
    if pair and side == 2:
        out += pair_block(pair)
        if passthrough:
            out += passthrough_block(pair, *passthrough)
    return out


def json_report(run: Run, s: Row, side: int = 1, pair: Row | None = None) -> str:
    """Schema 1. Keys in their order."""
    c, own = run.config, _adapters(run, side)
    pairs_of = lambda adapters: [{"name": n, "sequence": q} for n, q in adapters]
    doc = {
        "tool": run.tool,
        "schema_version": 1,
        f"{run.tool.lower().replace(' ', '_')}_version": run.version,
        "input_filenames": list(run.input_filenames or (run.input_filename,)),
        "mode": "paired-end" if c.paired else "single-end",
        "read_number": side,
        "command_line": run.command_line,
        "parameters": {
            "quality_cutoff": c.quality_cutoff, "adapters": pairs_of(c.adapters), "adapters_r2": pairs_of(c.adapters_r2), "times": c.times, "error_rate": c.error_rate,
            "stringency": c.stringency, "length_cutoff": c.length_cutoff, "max_length": c.max_length, "phred_encoding": c.phred, "trim_n": c.trim_n, "nextseq": c.two_colour,
            "rrbs": c.rrbs, "non_directional": c.non_directional, "poly_a": c.poly_a, "poly_g": c.poly_g, "clip_r1": c.clip_r1, "clip_r2": c.clip_r2,
            "three_prime_clip_r1": c.three_prime_clip_r1, "three_prime_clip_r2": c.three_prime_clip_r2, "max_n": c.max_n, "discard_untrimmed": c.discard_untrimmed,
            "consider_already_trimmed": run.consider_already_trimmed,
        },
        "read_processing": {
            "total_reads": s["total_reads"], "reads_with_adapter": s["reads_with_adapter"], "reads_written": s["reads_written"], "reads_too_short": s["too_short"],
            "reads_too_long": s["too_long"], "reads_too_many_n": s["too_many_n"], "reads_discarded_untrimmed": s["discarded_untrimmed"],
        },
        "basepair_processing": {"total_bp_processed": s["bp_processed"], "quality_trimmed_bp": s["quality_bp"], "total_bp_written": s["bp_written"]},
        "adapter_trimming": [
            {
                "name": n, "sequence": q, "type": "regular 3'", "length": len(q), "times_trimmed": sum(run.histogram.get(k, {}).values()),
                "length_distribution": {str(x): v for x, v in sorted(run.histogram.get(k, {}).items()) if x and v},
            }
            for k, (n, q) in enumerate(own)
        ],
        "poly_a_trimming": {"reads_trimmed": s["poly_a_reads"], "bases_removed": s["poly_a_bp"]},
        "poly_g_trimming": {"reads_trimmed": s["poly_g_reads"], "bases_removed": s["poly_g_bp"]},
        "rrbs": {"trimmed_3prime": s["rrbs_3prime"], "trimmed_5prime": s["rrbs_5prime"], "r2_clipped_5prime": s["rrbs_r2_clipped"]},
        "pair_validation": None if pair is None else {k: pair[k] for k in ("pairs_analyzed", "pairs_removed", "pairs_removed_n", "pairs_removed_too_long", "r1_unpaired", "r2_unpaired")},
        "passthrough": None if not pair or not pair["passthrough_checked"] else {f"records_{k}": pair[f"passthrough_{k}"] for k in ("kept", "dropped", "checked")},
    }
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"
