"""Every query of the read operators against its SQL, over the whole small tables; and streams against batches."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from readprep.options import TrimConfig
from readprep.plans import qc
from readprep.plans.queries import ORACLES, QUERIES
from readprep.streaming import trim as S
from readprep.synth import reads


def rows(table):
    def value(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted(repr(tuple(map(value, r.values()))) for r in table.select(sorted(table.column_names)).to_pylist())


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, small, tmp_path):
    c = TrimConfig(adapters=(("Illumina", "AGATCGGAAGAGC"),))
    reads(spark, small).repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    q = S.write_stream(S.trim_stream(S.read_stream(spark, str(tmp_path / "in")), c), lambda df, _: got.extend(df.collect()), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = S.trim_stream(reads(spark, small), c).filter("verdict = 'pass'").select("rec_idx", "r.*").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    s = S.stats_stream(S.trim_stream(S.read_stream(spark, str(tmp_path / "in")), c), c)
    m = s.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start()
    m.awaitTermination(120)
    assert spark.table("counters").first() == S.stats_stream(S.trim_stream(reads(spark, small), c), c).first()


def test_pair_stream_equals_batch(spark, small, tmp_path):
    for n in (1, 2):
        reads(spark, small, f"r{n}").withColumn("ts", F.timestamp_seconds(F.col("rec_idx") % 60 + 1_700_000_000)).repartition(2).write.parquet(str(tmp_path / str(n)))
    sides = [spark.readStream.schema(spark.read.parquet(str(tmp_path / str(n))).schema).parquet(str(tmp_path / str(n))) for n in (1, 2)]
    q = S.pair_stream(*sides).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = reads(spark, small).select("rec_idx", F.col("seq").alias("a")).join(reads(spark, small, "r2").select("rec_idx", F.col("seq").alias("b")), "rec_idx")
    assert sorted(map(tuple, spark.table("pairs").select("rec_idx", "r1.seq", F.col("r2.seq").alias("b")).collect())) == sorted(map(tuple, want.collect()))


def test_qc(spark, small):
    r = reads(spark, small)
    assert qc.lengths(r).agg(F.sum("reads")).first()[0] == r.count()
    assert qc.duplication(r).agg(F.sum(F.col("copies") * F.col("sequences"))).first()[0] == r.count()
    assert qc.gc_content(r).filter("percent < 0 or percent > 100").isEmpty()
