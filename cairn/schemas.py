"""Row types of the engine's tables."""

from pyspark.sql import types as T

_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("updated_at", T.DateType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
]
RECORD = T.StructType(_FIELDS)
STORED = T.StructType([
    *_FIELDS,
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("indexed", T.BooleanType()),
    T.StructField("embed_text", T.StringType()),
    T.StructField("index_id", T.LongType()),
])
PENDING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("record", RECORD),
    T.StructField("content_hash", T.StringType()),
    T.StructField("embed_text", T.StringType()),
])
CHUNK = T.StructType([
    T.StructField("parent_id", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("start_offset", T.LongType()),
    T.StructField("end_offset", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("deleted", T.BooleanType()),
])
OPS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("record", STORED),
])
BATCH = T.StructType([*_FIELDS[:4], T.StructField("updated_at", T.StringType()), _FIELDS[5], T.StructField("text", T.StringType())])
