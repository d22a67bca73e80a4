"""Registered source/sink and streaming queries (§2.1, §2.7 U2, §2.6 L3, §2.10).

Each one derives its input from the driver tables, writes it under the
shared checkpoint directory (a fresh folder per run), and returns the
read-back DataFrame, so the round trip itself is what gets checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.hashing import seeded_key_sql
from ..functions.text import iso_timestamp
from ..operators import practice as P
from ..operators import reports as RP
from ..operators import sessions as SE
from ..session import scratch_path, scratch_table
from ..sources import answer_log as L
from ..sources import practice_json as PJ
from ..sources import standins as S
from ..streaming import streams as ST
from .practice_queries import SEED, _P, _drawn
from .session_queries import ORACLE as _SESSION_ORACLE
from .standin_sql import with_standins

# J6 over all clicks, without the questions that are open at the stream's watermark: a
# day behind the newest event of the side that is further back (late rows are not new)
ORACLE_TIMED = _SESSION_ORACLE["second_answers"].replace("WHERE k = 1", f"""WHERE k = 1 AND (answered_at IS NOT NULL
  OR shown_at + INTERVAL {C.ANSWER_DEADLINE_SECONDS} SECOND <= (
    SELECT date_trunc('milliseconds', least(
      (SELECT max(shown_at) FROM presentations WHERE qid % 97 <> 0),
      (SELECT max(answered_at + CASE WHEN qid % 3 = 0 THEN INTERVAL 3 SECOND ELSE INTERVAL 0 SECOND END)
       FROM presentations WHERE qid % 89 <> 0))) - INTERVAL 1 DAY))""")

CUTOFF = "2024-01-10 00:00:00"  # older log files predate the difficulty column
RUN_AT = "2026-01-01 00:00:00"  # fixed generation time of the practice documents
ANSWER_COLS = ["id", "student_name", "topic", "question", "is_correct", "difficulty", "answered_at"]
CARRIED_FROM = 1_000_000_000
ASKED_LIMITS = [0, 3, 500]
LATENESS = "1 day"  # so that many questions are still open when the stream stops
LATE_SHOWN, LATE_CLICKS = 97, 89  # every so many questions are shown, or answered, to the stream too late


def _older(c="answered_at"):
    return F.coalesce(F.col(c) < F.lit(CUTOFF).cast("timestamp_ntz"), F.lit(False))


def q_answer_log_scan(spark, sf):
    path = scratch_path(spark, "answer-log")
    L.append(S.answers(spark, sf), path)
    return L.scan(spark, path).select(*ANSWER_COLS)


def q_answer_append(spark, sf):
    path = scratch_path(spark, "answer-append")
    ans = S.answers(spark, sf)
    L.append(ans.filter(_older()), path)
    L.append(ans.filter(~_older()), path)
    return L.scan(spark, path).select(*ANSWER_COLS)


def q_schema_backfill(spark, sf):
    path = scratch_path(spark, "answer-backfill")
    ans = S.answers(spark, sf)
    L.append(ans.filter(_older()).drop("difficulty"), path, version=1)
    L.append(ans.filter(~_older()), path, version=2)
    return L.scan(spark, path).select("id", "difficulty", "schema_version")


def _fresh(spark, sf):
    """The newer answers as an application hands them over: without ids, some without a level."""
    new = S.answers(spark, sf).filter(~_older())
    return new.withColumn("difficulty", F.when(F.col("id") % 5 != 0, F.col("difficulty")))


def q_log_ids(spark, sf):
    """S9 — three appends: without ids, with ids of their own, without ids again."""
    path = scratch_path(spark, "log-ids")
    L.append(S.answers(spark, sf).filter(_older()).drop("id"), path)
    new = S.answers(spark, sf).filter(~_older())
    L.append(new.where("id % 3 = 0").withColumn("id", F.col("id") + CARRIED_FROM), path)
    L.append(new.where("id % 3 <> 0").drop("id"), path)
    return L.scan(spark, path).select(*ANSWER_COLS)


def q_setup_and_save(spark, sf):
    """S3 + S4 — a table from before ``difficulty``, upgraded, then appended to."""
    table, path = scratch_table(spark, "answers"), scratch_path(spark, "answers")
    spark.sql(f"CREATE TABLE {table} (id BIGINT, student_name STRING, topic STRING, question STRING, is_correct INT, "
              f"answered_at TIMESTAMP_NTZ) USING parquet LOCATION '{path}'")
    S.answers(spark, sf).filter(_older()).drop("difficulty").write.mode("append").insertInto(table)
    RP.setup_database(spark, table, path)
    RP.save_result(_fresh(spark, sf).drop("id"), table=table)
    return spark.table(table).select(*ANSWER_COLS)


def q_recent_activity_limits(spark, sf):
    """P11 — limits below, inside and above the allowed range."""
    parts = [RP.get_recent_activity(S.answers(spark, sf), k).select(F.lit(k).alias("asked"), "id", "line") for k in ASKED_LIMITS]
    return L.union_logs(*parts)


def q_save_practice_questions(spark, sf):
    return RP.save_practice_questions(_ordered(spark, sf), scratch_path(spark, "saved-sets"), RUN_AT)


def _ordered(spark, sf):
    return P.practice_order(_drawn(spark, sf), SEED)


def _documents(spark, sf):
    path = scratch_path(spark, "practice-sets")
    PJ.write_documents(PJ.practice_documents(_ordered(spark, sf), RUN_AT), path)
    return PJ.read_documents(spark, path)


def q_practice_sets(spark, sf):
    d = _documents(spark, sf)
    return d.select("student", "total_questions", F.size("questions").cast("bigint").alias("n_questions"))


def q_practice_set_questions(spark, sf):
    return PJ.document_questions(_documents(spark, sf)).select(
        "student", "question_no", "question", "answer", "topic")


def q_practice_manifest(spark, sf):
    return PJ.manifest(_documents(spark, sf))


def q_bank_scan(spark, sf):
    b = S.bank(spark, sf)
    return b.select("question_id", "topic", "question", "difficulty", "answer",
                    *[F.element_at("options", F.lit(k)).alias(f"option_{k.lower()}") for k in C.LETTERS])


def q_recent_activity(spark, sf):
    ra = L.recent_activity(S.answers(spark, sf), C.RECENT_LIMIT_DEFAULT)
    return ra.select("id", "student_name", "topic", "icon", iso_timestamp("answered_at").alias("answered_at"), "line")


def q_all_answers(spark, sf):
    quiz = S.answers(spark, sf).select("student_name", "topic", "question", "is_correct", "difficulty",
                                       F.lit("quiz").alias("source"))
    practice = SE.graded_responses(S.responses(spark, sf), S.bank(spark, sf)).select(
        "student_name", "topic", F.col("question_text").alias("question"), "is_correct", "difficulty",
        F.lit("practice").alias("source"))
    return L.union_logs(quiz, practice)


def _state_partitions(spark):
    # one state partition per core of the cluster (8 locally)
    return spark.sparkContext.defaultParallelism


def q_stream_answer_append(spark, sf):
    """T2 and S2 in one folder: the stream's batches beside a batch writer's append."""
    base, ans = scratch_path(spark, "stream-append"), S.answers(spark, sf)
    ans.filter(_older()).write.mode("append").parquet(f"{base}/in")
    ST.answer_append_stream(spark, f"{base}/in", f"{base}/log", f"{base}/ckpt")
    L.append(ans.filter(~_older()), f"{base}/log")
    return L.scan(spark, f"{base}/log").select(*ANSWER_COLS)


def q_stream_topic_accuracy(spark, sf):
    """T3 with a compaction between the batches."""
    base, ans = scratch_path(spark, "stream-accuracy"), S.answers(spark, sf)
    for part in (ans.filter(_older()), ans.filter(~_older() & (F.col("id") % 2 == 0)), ans.filter(~_older() & (F.col("id") % 2 == 1))):
        part.write.mode("append").parquet(f"{base}/in")
        ST.topic_accuracy_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                 state_partitions=_state_partitions(spark), compact_every=2)
    return ST.topic_accuracy_snapshot(spark, f"{base}/out")


def q_stream_timed_answers(spark, sf):
    """T1 with second clicks, with questions and answers that come behind the watermark,
    and with questions that are still open (not in the result)."""
    base = scratch_path(spark, "stream-timed")
    shown = S.presentations(spark, sf).select("qid", "session_id", "shown_at", "correct")
    clicks, parts = S.clicks(spark, sf), _state_partitions(spark)
    late_shown, late_click = F.col("qid") % LATE_SHOWN == 0, F.col("qid") % LATE_CLICKS == 0
    for first in (True, False):
        shown.where(late_shown != first).write.mode("append").parquet(f"{base}/shown")
        clicks.where(late_click != first).write.mode("append").parquet(f"{base}/answered")
        ST.timed_answer_stream(spark, f"{base}/shown", f"{base}/answered", f"{base}/out", f"{base}/ckpt",
                               lateness=LATENESS, state_partitions=parts)
    return ST.timed_answer_snapshot(spark, f"{base}/out", f"{base}/shown", f"{base}/answered")


SPARK = {
    "answer_log_scan": q_answer_log_scan,
    "answer_append": q_answer_append,
    "schema_backfill": q_schema_backfill,
    "practice_sets": q_practice_sets,
    "practice_set_questions": q_practice_set_questions,
    "practice_manifest": q_practice_manifest,
    "bank_scan": q_bank_scan,
    "recent_activity": q_recent_activity,
    "all_answers": q_all_answers,
    "stream_answer_append": q_stream_answer_append,
    "stream_topic_accuracy": q_stream_topic_accuracy,
    "stream_timed_answers": q_stream_timed_answers,
    "log_ids": q_log_ids,
    "setup_and_save": q_setup_and_save,
    "recent_activity_limits": q_recent_activity_limits,
    "save_practice_questions": q_save_practice_questions,
}

_ANS = "SELECT id, student_name, topic, question, is_correct, difficulty, answered_at FROM answers"
_ORDERED = f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY student_name ORDER BY
         {seeded_key_sql(SEED, 'student_name', 'question_id')}, question_id) AS INTEGER) AS question_no FROM drawn"""
_ISO = ("strftime(answered_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(answered_at) % 1000000 <> 0 "
        "THEN '.' || lpad(CAST(microsecond(answered_at) % 1000000 AS VARCHAR), 6, '0') ELSE '' END")

_NUMBERED = ", ".join(f"{c} NULLS FIRST" for c in [*L.ID_ORDER, "difficulty"])

ORACLE = {
    "answer_log_scan": with_standins(_ANS),
    "answer_append": with_standins(_ANS),
    "schema_backfill": with_standins(f"""
SELECT id, CASE WHEN answered_at < TIMESTAMP '{CUTOFF}' THEN '{C.DEFAULT_DIFFICULTY}' ELSE difficulty END AS difficulty,
       CASE WHEN answered_at < TIMESTAMP '{CUTOFF}' THEN 1 ELSE 2 END AS schema_version
FROM answers"""),
    "practice_sets": with_standins("""
SELECT student_name AS student, COUNT(*) AS total_questions, COUNT(*) AS n_questions FROM drawn GROUP BY student_name""", _P),
    "practice_set_questions": with_standins("""
SELECT student_name AS student, question_no, question, answer, topic FROM ordered""", _P + [("ordered", _ORDERED)]),
    "practice_manifest": with_standins(f"""
SELECT student_name AS student,
       'practice_' || replace(student_name, ' ', '_') || '_' || strftime(TIMESTAMP '{RUN_AT}', '%Y-%m-%d_%H%M%S') || '.json' AS file_name,
       'practice_' || replace(student_name, ' ', '_') || '_' || strftime(TIMESTAMP '{RUN_AT}', '%Y-%m-%d_%H%M%S')
         || '_' || substr(md5('|' || student_name), 1, 8) || '.json' AS unique_name
FROM (SELECT DISTINCT student_name FROM drawn)""", _P),
    "bank_scan": with_standins("""
SELECT question_id, topic, question, difficulty, answer, opt_a AS option_a, opt_b AS option_b,
       opt_c AS option_c, opt_d AS option_d FROM bank"""),
    "recent_activity": with_standins(f"""
SELECT id, student_name, topic, icon, answered_at,
       '  ' || answered_at || ' | ' || printf('%-10s', student_name) || ' | ' || printf('%-20s', topic) || ' | ' || icon AS line
FROM (SELECT id, student_name, topic, CASE WHEN is_correct = 1 THEN '{C.ICON_CORRECT}' ELSE '{C.ICON_WRONG}' END AS icon,
             {_ISO} AS answered_at
      FROM answers ORDER BY id DESC LIMIT {C.RECENT_LIMIT_DEFAULT})"""),
    "all_answers": with_standins("""
SELECT student_name, topic, question, is_correct, difficulty, 'quiz' AS source FROM answers
UNION ALL
SELECT student_name, topic, question_text, is_correct, difficulty, 'practice' FROM graded""", _P),
    "stream_answer_append": with_standins(_ANS),
    "stream_timed_answers": ORACLE_TIMED,
    "stream_topic_accuracy": with_standins("""
SELECT student_name, topic, COUNT(*) AS total, CAST(SUM(is_correct) AS BIGINT) AS correct
FROM answers GROUP BY student_name, topic"""),
    "log_ids": with_standins(f"""
SELECT CASE WHEN p = 1 THEN n WHEN p = 2 THEN id + {CARRIED_FROM}
            ELSE n + coalesce((SELECT max(id) + {CARRIED_FROM} FROM parts WHERE p = 2), (SELECT count(*) FROM parts WHERE p = 1)) END AS id,
       student_name, topic, question, is_correct, difficulty, answered_at
FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {_NUMBERED}) AS n FROM parts)""", [("parts", f"""
  SELECT *, CASE WHEN answered_at < TIMESTAMP '{CUTOFF}' THEN 1 WHEN id % 3 = 0 THEN 2 ELSE 3 END AS p FROM answers""")]),
    "setup_and_save": with_standins(f"""
SELECT id, student_name, topic, question, is_correct, '{C.DEFAULT_DIFFICULTY}' AS difficulty, answered_at FROM answers
WHERE answered_at < TIMESTAMP '{CUTOFF}'
UNION ALL
SELECT coalesce((SELECT max(id) FROM answers WHERE answered_at < TIMESTAMP '{CUTOFF}'), 0)
       + row_number() OVER (ORDER BY {_NUMBERED}), student_name, topic, question, is_correct, difficulty, answered_at
FROM (SELECT * REPLACE (CASE WHEN id % 5 <> 0 THEN difficulty END AS difficulty) FROM answers
      WHERE NOT coalesce(answered_at < TIMESTAMP '{CUTOFF}', FALSE))"""),
    "recent_activity_limits": with_standins(" UNION ALL ".join(f"""
SELECT asked, id, line FROM (SELECT {k} AS asked, id,
       '  ' || {_ISO} || ' | ' || printf('%-10s', student_name) || ' | ' || printf('%-20s', topic) || ' | '
       || CASE WHEN is_correct = 1 THEN '{C.ICON_CORRECT}' ELSE '{C.ICON_WRONG}' END AS line
       FROM answers ORDER BY id DESC LIMIT {max(1, min(50, k))})""" for k in ASKED_LIMITS)),
}
ORACLE["save_practice_questions"] = ORACLE["practice_manifest"]
