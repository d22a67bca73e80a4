"""Practice sets as nested JSON documents.

Sink: one document per student and run, JSON Lines, partitioned by run.
Source: the same documents, or the legacy one-document-per-file form
(``multiLine``); missing ``difficulty`` / ``explanation`` read as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key
from ..functions.text import safe_name
from ..schemas import PRACTICE_SET_SCHEMA


def practice_documents(ordered: DataFrame, generated_on) -> DataFrame:
    """S5 — ``{student, generated_on, total_questions, questions[]}`` per student.

    ``ordered`` holds one row per drawn question with ``question_no``; the
    list per student is bounded by weak topics x questions per topic.
    """
    q = F.struct("question", "options", "answer", "explanation", "topic", "difficulty")
    docs = ordered.groupBy("student_name").agg(
        F.array_sort(F.collect_list(F.struct(F.col("question_no"), q.alias("q"))),
                     lambda a, b: F.signum(a["question_no"] - b["question_no"]).cast("int")).alias("items"))
    return docs.select(
        F.col("student_name").alias("student"),
        F.lit(generated_on).cast("timestamp_ntz").alias("generated_on"),
        F.size("items").cast("bigint").alias("total_questions"),
        F.transform("items", lambda x: x["q"]).alias("questions"),
    )


def write_documents(docs: DataFrame, path: str) -> None:
    (docs.withColumn("run", F.date_format("generated_on", "yyyy-MM-dd_HHmmss"))
         .write.mode("append").partitionBy("run").json(path))


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S6 — explicit schema (inference would make ``options`` a struct)."""
    return (spark.read.schema(PRACTICE_SET_SCHEMA).option("multiLine", multi_line)
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path))


def document_questions(docs: DataFrame) -> DataFrame:
    """S6 — one row per question of every document."""
    return docs.select("student", "generated_on", F.posexplode("questions").alias("pos", "q")).select(
        "student", "generated_on", (F.col("pos") + 1).cast("int").alias("question_no"), "q.*")


def manifest(docs: DataFrame) -> DataFrame:
    """S8 — the file name the original would give each document, and one that
    cannot collide (names differing only by space/underscore)."""
    stamp = F.date_format("generated_on", "yyyy-MM-dd_HHmmss")
    base = F.concat(F.lit("practice_"), safe_name("student"), F.lit("_"), stamp)
    return docs.select(
        "student",
        F.concat(base, F.lit(".json")).alias("file_name"),
        F.concat(base, F.lit("_"), F.substring(seeded_key("", "student"), 1, 8), F.lit(".json")).alias("unique_name"),
    )
