"""Schemas of reads, pairs and matches."""

from pyspark.sql import types as T

READ = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])
READS = T.StructType([T.StructField("file_id", T.IntegerType()), T.StructField("rec_idx", T.LongType()), *READ.fields])
MATCH = "struct<read_start:int,read_end:int,overlap:int,errors:int>"
TRIM = (
    "struct<start:int,stop:int,quality_bp:int,after_adapter:int,matches:array<struct<adapter_idx:int,removed:int>>,"
    "rrbs3:boolean,rrbs5:boolean,poly_a_bp:int,poly_g_bp:int,clip5:int,clip3:int>"
)
