"""Explicit schemas (§1): no inference anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

# M1 answer log
ANSWER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("student_name", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("question", T.StringType(), True),
    T.StructField("is_correct", T.IntegerType(), True),
    T.StructField("difficulty", T.StringType(), True),
    T.StructField("answered_at", T.TimestampNTZType(), True),
])

OPTIONS_TYPE = T.MapType(T.StringType(), T.StringType())

# M2 question
QUESTION_SCHEMA = T.StructType([
    T.StructField("question", T.StringType(), True),
    T.StructField("options", OPTIONS_TYPE, True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("explanation", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("difficulty", T.StringType(), True),
])

# M3 practice set document
PRACTICE_SET_SCHEMA = T.StructType([
    T.StructField("student", T.StringType(), True),
    T.StructField("generated_on", T.TimestampNTZType(), True),
    T.StructField("total_questions", T.LongType(), True),
    T.StructField("questions", T.ArrayType(QUESTION_SCHEMA), True),
])

# the fields read from a reply text
REPLY_QUESTION_SCHEMA = T.StructType([
    T.StructField("question", T.StringType(), True),
    T.StructField("options", OPTIONS_TYPE, True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("explanation", T.StringType(), True),
])
