"""Plans that must hold at scale: pruned scans, pushed predicates, no shuffle but those that are needed."""

import re

import pytest
from readprep.operators import detect, filters, modes, pairs, stats, trim
from readprep.options import TrimConfig
from readprep.synth import reads

C = TrimConfig(adapters=(("Illumina", "AGATCGGAAGAGC"),))


@pytest.fixture(scope="module")
def files(spark, small, tmp_path_factory):
    base = tmp_path_factory.mktemp("plans")
    for n in (1, 2):
        reads(spark, small, f"r{n}").write.parquet(str(base / str(n)))
    return base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def judged(df):
    return filters.judge(trim.trim_single(df, C), C)


def test_single_end_reads_what_it_needs_and_never_shuffles_reads(spark, files):
    df = spark.read.parquet(str(files / "1"))
    out = plan(judged(df).filter("verdict = 'pass'").select("rec_idx", "r.*"))
    assert "Exchange" not in out and out.count("ArrowEvalPython") == 1
    counted = plan(stats.single_stats(judged(df), C))
    assert counted.count("Exchange") == 1 and "SinglePartition" in counted
    assert re.search(r"ReadSchema: struct<seq:string,qual:string>", counted)


def test_predicates_on_plain_columns_reach_the_scan(spark, files):
    out = plan(judged(spark.read.parquet(str(files / "1"))).filter("rec_idx < 100").select("r.*"))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(rec_idx,100\)", out)
    probe = plan(detect.probe(spark.read.parquet(str(files / "1"))))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(rec_idx,1000000\)", probe) and "ReadSchema: struct<rec_idx:bigint,seq:string>" in probe


def test_pairs_meet_once(spark, files):
    a, b = (spark.read.parquet(str(files / str(n))) for n in (1, 2))
    t = trim.trim_pairs(pairs.zip_pairs(a, b).drop("fault"), C)
    out = plan(filters.judge_pairs(t, C).filter("v.verdict = 'pass'").select("rec_idx", "r1", "r2"))
    assert out.count("Join") == 1 and out.count("ArrowEvalPython") == 1 and len(re.findall(r"Exchange hashpartitioning", out)) == 2
    assert "BroadcastNestedLoopJoin" not in out and "CartesianProduct" not in out


def test_sheets_are_broadcast(spark, files):
    sheet = spark.createDataFrame([("a", "AC"), ("b", "GT")], "sample string, barcode string")
    out = plan(modes.demultiplex(spark.read.parquet(str(files / "1")), sheet))
    assert "BroadcastHashJoin" in out and "SortMergeJoin" not in out
