"""Deterministic reads from the orders table: one SQL text that Spark and DuckDB compute alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX = "'0123456789abcdef'"


def reads_sql(orders: str, salt: str = "r1") -> str:
    """SELECT rec_idx, id, seq, qual: a read of up to 64 bases for each order.

    Every third read holds an adapter (some with a changed base), others end in poly-A or poly-G, hold Ns at an end or
    inside, start with CAA or CGA, have a poor quality tail, or are cut short.
    """
    key = "CAST(o_orderkey AS STRING)"
    md5 = lambda tag: f"md5('{salt}{tag}' || {key})"
    return f"""
    SELECT rec_idx, '@read' || CAST(rec_idx AS STRING) || CASE WHEN rec_idx % 2 = 0 THEN '/{salt[-1]}' ELSE ' {salt[-1]}:N:0:ACGT' END AS id,
           substr(seq, 1, n) AS seq, substr(qual, 1, n) AS qual
    FROM (
      SELECT rec_idx, n,
        CASE WHEN rec_idx % 7 = 3 THEN 'NN' || substr(seq, 3, CAST(30 + rec_idx % 20 AS INT)) || 'N' || substr(seq, CAST(34 + rec_idx % 20 AS INT), 28) || 'NNN'
             WHEN rec_idx % 7 = 4 THEN 'CAA' || substr(seq, 4, 61)
             WHEN rec_idx % 7 = 5 THEN 'CGA' || substr(seq, 4, 61) ELSE seq END AS seq,
        CASE WHEN rec_idx % 4 = 1 THEN substr(qual, 1, CAST(64 - rec_idx % 23 AS INT)) || repeat('#', CAST(rec_idx % 23 AS INT)) ELSE qual END AS qual
      FROM (
        SELECT rec_idx, qual, CASE WHEN rec_idx % 11 = 4 THEN CAST(rec_idx % 64 AS INT) ELSE 64 END AS n,
          CASE WHEN rec_idx % 3 = 0 THEN substr(substr(seq, 1, CAST(20 + rec_idx % 40 AS INT))
                 || CASE WHEN rec_idx % 9 = 0 THEN 'AGATCGGTAGAGC' WHEN rec_idx % 9 = 3 THEN 'CTGTCTCTTATA' ELSE 'AGATCGGAAGAGC' END || reverse(seq), 1, 64)
               WHEN rec_idx % 5 = 1 THEN substr(seq, 1, CAST(64 - rec_idx % 17 AS INT)) || repeat('A', CAST(rec_idx % 17 AS INT))
               WHEN rec_idx % 5 = 2 THEN substr(seq, 1, CAST(64 - rec_idx % 19 AS INT)) || repeat('G', CAST(rec_idx % 19 AS INT))
               WHEN rec_idx % 5 = 3 THEN repeat('T', CAST(rec_idx % 13 AS INT)) || substr(seq, 1, CAST(64 - rec_idx % 13 AS INT))
               ELSE seq END AS seq
        FROM (
          SELECT o_orderkey AS rec_idx,
                 translate({md5('a')} || {md5('b')}, {_HEX}, 'ACGTACGTACGTACGT') AS seq,
                 translate({md5('c')} || {md5('d')}, {_HEX}, '#(-27<AFIIIIIIII') AS qual
          FROM {orders}) base) spliced) shaped"""


def reads(spark: SparkSession, sf_dir: str, salt: str = "r1") -> DataFrame:
    df = spark.sql(reads_sql(f"parquet.`{sf_dir}/orders.parquet`", salt))
    # the optimiser would copy the nested text of a read into every predicate on it; it moves none past a metric
    df = df.observe(f"reads-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))
    # a driver table is one Parquet partition; kernels want all cores. On a cluster the scan itself has partitions
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
