"""What the workers and the driver keep once a stage is done."""

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.llm import common, minhash, mixing, packing, quality, suffix_dedup

from .conftest import sentence


def kept(spark):
    """By worker that is at hand: MB of its own, and MB of cached powers."""

    def run(it):
        import os
        import time

        from readprep.llm import common as own

        for _ in it:
            time.sleep(0.5)
        mb = sum(map(int, re.findall(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text()))) / 1024
        powers = sum(x.nbytes for x in own._POWERS.values()) / 2**20
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [mb], "powers": [powers]})

    return spark.range(0, 4, 1, 4).mapInArrow(run, "pid long, mb double, powers double").collect()


STAGES = {
    "quality": lambda docs: quality.good_documents(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))),
    "minhash": minhash.near_duplicates,
    "suffix": suffix_dedup.dedup,
    "packing": lambda docs: packing.pack(docs, packing.vocabulary_path()),
}


@pytest.mark.parametrize("name", STAGES)
def test_workers_give_memory_back(spark, tmp_path, name):
    long_ = sentence(1, 40_000)
    path = str(tmp_path / "documents")
    docs = spark.range(0, 48, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit(long_), F.col("id").cast("string")).alias("text"))
    docs.write.parquet(path)
    STAGES[name](spark.read.parquet(path)).write.format("noop").mode("overwrite").save()
    found = kept(spark)
    assert max(r["powers"] for r in found) == 0
    assert max(r["mb"] for r in found) < 120, found


def test_kernels_release_when_they_fail():
    @common.released
    def fails(it):
        common.powers(common._B, 1000)
        yield from it
        raise ValueError

    with pytest.raises(ValueError):
        list(fails(iter([])))
    assert not common._POWERS


def test_sources_are_numbered_without_python(spark, tmp_path, monkeypatch):
    names = [f"0{x}" for x in ["", "B", "a", "z", "é", "日", "😀"] + [f"s{i:03}" for i in range(90)]] + ["1"]
    path = str(tmp_path / "cells")
    spark.createDataFrame([(n, 1 + i % 3, 2) for i, n in enumerate(names)], "_key string, size long, _n long").write.parquet(path)
    monkeypatch.setattr(type(spark.range(1)), "rdd", property(lambda self: pytest.fail("an RDD of Python rows")))
    for parts, coalesce in (("4", "true"), ("7", "false")):
        old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        for k, v in zip(old, (parts, coalesce), strict=True):
            spark.conf.set(k, v)
        try:
            cells = spark.read.parquet(path)
            assert isinstance(cells, DataFrame)
            got = {r["_key"]: r for r in mixing.targets(spark, cells, mixing.WEIGHTS, 10**6).collect()}
            none = mixing.targets(spark, cells.filter("false"), mixing.WEIGHTS, 3).collect()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        total = sum(r["source_size"] for r in got.values())
        weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(sorted(names))}
        assert {n: pytest.approx(total * w / sum(weight.values())) for n, w in weight.items()} == {n: r["target"] for n, r in got.items()}
        assert none == []
