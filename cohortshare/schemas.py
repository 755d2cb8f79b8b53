"""Declared schemas of the data model (names are ours)."""

from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("age_months", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("diagnosis_date", T.StringType()),
    T.StructField("disease_name_raw", T.StringType()),
    T.StructField("lab_value", T.DoubleType()),
    T.StructField("clinical_note", T.StringType()),
])

SPAN = T.StructType([
    T.StructField("start_idx", T.IntegerType()),
    T.StructField("end_idx", T.IntegerType()),
    T.StructField("type", T.StringType()),
])

EXAMPLE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("entities", T.ArrayType(SPAN)),
])

BIO_SENT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("sent_id", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

ENTITY = T.StructType([
    T.StructField("sent_id", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
])

VOCAB = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("std_name", T.StringType()),
    T.StructField("code", T.StringType()),
])

ASSET = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("data_hash", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("access_list", T.ArrayType(T.StringType())),
    T.StructField("ts", T.TimestampType()),
])

REQUEST = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("caller", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("data_hash", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("grantee", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

RESULT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("caller", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
])

# Ledger state carried between micro-batches: one row per touched id;
# ``owner`` is NULL while no asset exists under that id.
LEDGER_STATE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("data_hash", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("access_list", T.ArrayType(T.StringType())),
    T.StructField("ts", T.TimestampType()),
    T.StructField("last_seq", T.LongType()),
])
