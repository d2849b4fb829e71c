"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the relative entropy to one copy each, under one token constraint per source and
0 <= r <= CAP. The dual has one multiplier per source, r = min(CAP, exp(lambda_source * size / mean size)), and is
solved by guarded Newton steps whose sums run distributed over the table of (source, size) counts. Rates are rounded
into whole copies by systematic sampling along the sizes of a source; the words that whole copies miss or exceed are
added to, or cut from, one document of the source.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PARTS, SPACE, WORD, materialize, part_of, ranked, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
MAX_ROUNDS = 300  # a bracket is doubled, then halved: far more than any finite rates need
TOLERANCE = 1e-7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(spark: SparkSession, cells: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """(_key, source_size, _docs, target) by source; cells: (_key, size, _n)."""
    src = cells.groupBy("_key").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size"), F.sum("_n").alias("_docs"))
    # numbers along the order by key: a task of the sort holds a run of sources, and its count alone reaches the driver
    src = materialize(src.orderBy("_key").withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    task, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(src.groupBy(task).agg(F.count(F.lit(1))).collect())
    first = [0, *itertools.accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    order = src.withColumn("_i", F.element_at(F.array(*[F.lit(n).cast("long") for n in first]), task + 1) + place).drop("_at")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int"))
    src = materialize(order.withColumn("_w", w).drop("_i"), "mix-weights")
    total = src.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (total[0] or 0) / total[1] if total[1] else 0.0
    while True:  # the level only rises; scalars alone reach the driver
        full = F.col("_w") * level > cap * F.col("source_size")
        x = src.agg(F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("_w")).otherwise(0.0))).first()
        nxt = (total[0] - x[0]) / x[1] if x[0] is not None and x[1] else level
        if nxt <= level * (1 + 1e-15):
            break
        level = nxt
    return src.withColumn("target", F.least(F.col("_w") * level, F.lit(float(cap)) * F.col("source_size"))).drop("_w")


def solve(cells: DataFrame, src: DataFrame, cap: int) -> DataFrame:
    """The multiplier of each source: (_key, source_size, target, _mean, _lambda, _full). One table is written a round.

    RuntimeError if a source is further than TOLERANCE from its target after MAX_ROUNDS."""
    top = float(cap)
    state = src.withColumn("_mean", F.greatest(F.col("source_size") / F.col("_docs"), F.lit(1e-9)))
    state = state.withColumn("_full", (F.col("source_size") == 0) | (F.col("target") >= top * F.col("source_size") * (1 - 1e-12)))
    state = state.withColumn("_lambda", F.when(F.col("_full"), F.lit(0.0)).otherwise(F.log(F.col("target") / F.col("source_size"))))
    state = state.withColumn("_lo", F.lit(-1e6)).withColumn("_hi", F.lit(1e6))
    state, worst = materialize(state, "mix-dual"), None
    for _ in range(MAX_ROUNDS):
        s = state.filter(~F.col("_full"))
        x = F.col("size") / F.col("_mean")
        r = F.exp(F.least(F.col("_lambda") * x, F.log(F.lit(top))))
        open_ = F.col("_lambda") * x < F.log(F.lit(top))
        tokens = F.col("_n") * F.col("size") * r
        sums = cells.join(s.select("_key", "_lambda", "_mean"), "_key").groupBy("_key").agg(F.sum(tokens).alias("_f"), F.sum(F.when(open_, tokens * x).otherwise(0.0)).alias("_d"))
        state = state.join(sums, "_key", "left")
        gap = F.abs(F.col("_f") / F.col("target") - 1)
        lo = F.when(F.col("_f") < F.col("target"), F.col("_lambda")).otherwise(F.col("_lo"))
        hi = F.when(F.col("_f") > F.col("target"), F.col("_lambda")).otherwise(F.col("_hi"))
        # Newton on log f, which is closer to linear; bisection where a step leaves the bracket
        step = F.col("_lambda") - F.log(F.greatest(F.col("_f"), F.lit(1e-300)) / F.col("target")) * F.col("_f") / F.greatest(F.col("_d"), F.lit(1e-300))
        wide = F.when(F.col("_hi2") >= 1e6, F.greatest(F.col("_lo2") * 2, F.col("_lo2") + 1)).when(F.col("_lo2") <= -1e6, F.least(F.col("_hi2") * 2, F.col("_hi2") - 1)).otherwise((F.col("_lo2") + F.col("_hi2")) / 2)
        state = state.withColumn("_gap", F.when(F.col("_full"), 0.0).otherwise(gap)).withColumn("_lo2", lo).withColumn("_hi2", hi).withColumn("_step", step)
        inside = (F.col("_step") > F.col("_lo2")) & (F.col("_step") < F.col("_hi2"))
        nxt = F.when(F.col("_full") | (F.col("_gap") <= TOLERANCE), F.col("_lambda")).when(inside, F.col("_step")).otherwise(wide)
        state = materialize(state.withColumn("_lambda", nxt).withColumn("_lo", F.col("_lo2")).withColumn("_hi", F.col("_hi2")).drop("_f", "_d", "_lo2", "_hi2", "_step"), "mix-dual")
        worst = state.agg(F.max("_gap")).first()[0]
        state = state.drop("_gap")
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"a source is {worst:.3g} of its target away from it after {MAX_ROUNDS} rounds")
    return state.select("_key", "source_size", "target", "_mean", "_lambda", "_full")


def mix(docs: DataFrame, row: Column | None = None, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_row, size, source_size, target, copies, extra, taken) for every row of docs (doc_id, text, source, ...).

    copies: whole repeats; extra: words of one more, partial repeat (of the text's start), or if negative, words cut
    from the end of the last one; taken = copies * size + extra, at most cap * size. Null text has size 0; a null
    source is a source of its own and the last. Repeated rows count as rows. Empty tables give no rows. Documents of
    size 0 are taken once and hold no words. `row`: what to carry (default a struct of doc_id and source).
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    row = F.struct("doc_id", "source") if row is None else row
    rows = docs.select(row.alias("_row"), size_of(F.col("text")).alias("size"), key.alias("_key"), F.coalesce("doc_id", F.lit(-1)).alias("_order"), F.xxhash64("text").alias("_tie"))
    rows = rows.withColumn("_part", part_of(F.col("_order"), PARTS))
    parts = materialize(rows.groupBy("_key", "size", "_part").agg(F.count(F.lit(1)).alias("_n")), "mix-parts")
    cells = materialize(parts.groupBy("_key", "size").agg(F.sum("_n").alias("_n")), "mix-cells")
    state = solve(cells, targets(spark, cells, weights, cap), cap)
    top = float(cap)
    rate = F.when(F.col("_full"), F.lit(top)).otherwise(F.exp(F.least(F.col("_lambda") * F.col("size") / F.col("_mean"), F.log(F.lit(top)))))
    cell = cells.join(state, "_key").withColumn("_rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(rate, F.lit(top))))
    cell = cell.withColumn("_whole", F.floor("_rate").cast("long")).withColumn("_frac", F.col("_n") * (F.col("_rate") - F.floor("_rate")))
    upto = F.sum("_frac").over(Window.partitionBy("_key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    cell = cell.withColumn("_k", (F.floor(upto + 0.5) - F.floor(upto - F.col("_frac") + 0.5)).cast("long"))
    cell = cell.withColumn("_k", F.least(F.greatest(F.col("_k"), F.lit(0)), F.col("_n")))
    one = Window.partitionBy("_key")
    cell = cell.withColumn("_miss", F.round(F.col("target")).cast("long") - F.sum((F.col("_n") * F.col("_whole") + F.col("_k")) * F.col("size")).over(one))
    # the cell whose document can take up most of the words that whole copies miss or exceed
    low = F.col("_whole") + F.when(F.col("_k") >= F.col("_n"), 1).otherwise(0)
    high = F.col("_whole") + F.when(F.col("_k") > 0, 1).otherwise(0)
    cell = cell.withColumn("_room", F.when(F.col("_miss") >= 0, (cap - low) * F.col("size")).otherwise(high * F.col("size")))
    cell = cell.withColumn("_best", F.max(F.struct("_room", "size")).over(one))
    at = (F.col("_best.size") == F.col("size")) & (F.col("_miss") != 0)
    most = F.least(F.abs("_miss"), "_room") * F.signum("_miss").cast("long")
    cell = cell.withColumn("_extra", F.when(at, most).otherwise(0))
    cell = cell.withColumn("_at", F.when(F.col("_extra") > 0, F.col("_n") - 1).when(F.col("_extra") < 0, F.lit(0)).otherwise(-1))
    cell = cell.select("_key", "size", "source_size", "target", "_whole", "_k", "_extra", "_at")
    plan = materialize(parts.join(cell.hint("merge"), ["_key", "size"]), "mix-plan")
    out = ranked(rows, ["_key", "size"], ["_order", "_tie"], "_rank", plan)
    extra = F.when(F.col("_rank") == F.col("_at"), F.col("_extra")).otherwise(0).cast("long")
    copies = (F.col("_whole") + F.when(F.col("_rank") < F.col("_k"), 1).otherwise(0)).cast("long")
    return out.select("_row", "size", "source_size", "target", copies.alias("copies"), extra.alias("extra"), (copies * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: the columns of docs, one row for each repeat; a partial repeat is the text up to the end of a word.

    doc_id repeats for repeats, and n_chars, where there is one, follows a text that is cut. Documents without words,
    null texts among them, stay once. Repeated rows count as rows; a null source is one of its own; an empty table
    gives no rows.
    """
    cols = docs.columns
    out = mix(docs, F.struct(*[F.col(c) for c in cols]), weights, cap)
    words = F.greatest("size", F.lit(1))
    repeats = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / words)).cast("int")
    out = out.select("_row", repeats.alias("_repeats"), F.pmod("taken", words).cast("int").alias("_cut"))
    out = out.select("_row", "_repeats", "_cut", F.posexplode(F.array_repeat(F.lit(0), F.col("_repeats") + F.when(F.col("_cut") > 0, 1).otherwise(0))).alias("_i", "_zero"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(f"({SPACE}*{WORD})")), F.lit(1), F.col("_cut")), "")
    text = F.when(F.col("_i") < F.col("_repeats"), F.col("_row.text")).otherwise(head)
    own = {"text": text} | ({"n_chars": F.when(F.col("_i") < F.col("_repeats"), F.col("_row.n_chars")).otherwise(F.length(text))} if "n_chars" in cols else {})
    return out.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in cols])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("_row.doc_id", "size", "source_size", "target", "taken")
