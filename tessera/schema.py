"""Schemas of the index tables. A file's id is a 128-bit hash of its path, a chunk's is its file's and its place there."""

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("mod_time", T.LongType()), T.StructField("size", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("chunk_count", T.IntegerType())])
CHUNKS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("file_id", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("symbol", T.StringType()), T.StructField("content", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("file_id", T.StringType()), T.StructField("pos", T.IntegerType())])
GONE = T.StructType([T.StructField("file_id", T.StringType())])
SCAN = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mod_time", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
