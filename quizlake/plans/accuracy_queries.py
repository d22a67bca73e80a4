"""Registered accuracy queries (§2.2, §2.4, X1) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import accuracy as A
from ..operators import reports as RP
from ..session import stage
from ..sources import standins as S
from .standin_sql import with_standins

T = C.WEAK_THRESHOLD
PCT = "ROUND(CAST(SUM(is_correct) AS DOUBLE) * 100.0 / COUNT(*), 1)"
TOTALS = f"COUNT(*) AS total, CAST(SUM(is_correct) AS BIGINT) AS correct, {PCT} AS pct"


def _ans(spark, sf):
    return S.answers(spark, sf)


ASKED = [*(f"student_{k}" for k in range(1, 31)), "nobody"]
CONFLICT_THRESHOLD = 66.7  # 2 of 3 answers: 66.667 is below it, the rounded 66.7 is not


def _by_sketch(spark, sf):
    """Exact counts beside whether the estimate from daily sketches is within its bound."""
    days = stage(A.daily_sketches(_ans(spark, sf)), "daily-sketches")
    guess = A.totals_from_sketches(days).select(F.lit(None).cast("bigint").alias("total_students"), F.lit(None).cast("bigint").alias("total_answers"),
                                                F.col("total_students").alias("guess"), F.col("total_answers").alias("summed"))
    both = A.class_totals(_ans(spark, sf)).unionByName(guess, allowMissingColumns=True)
    one = both.agg(*(F.max(c).alias(c) for c in both.columns))
    off = F.abs(F.col("guess") - F.col("total_students"))
    return one.select("total_students", "total_answers", (F.col("summed") == F.col("total_answers")).alias("same_answers"),
                      (off <= F.greatest(F.lit(1.0), F.col("total_students") * A.sketch_error())).alias("within_bound"))


SPARK = {
    "class_weak_topics": lambda spark, sf: A.class_weak_topics(_ans(spark, sf)),
    "topic_breakdown": lambda spark, sf: A.topic_breakdown(_ans(spark, sf)),
    "student_report": lambda spark, sf: A.student_report(_ans(spark, sf)),
    "student_leaderboard": lambda spark, sf: A.student_leaderboard(_ans(spark, sf)),
    "topic_difficulty": lambda spark, sf: A.topic_difficulty(_ans(spark, sf)),
    "class_totals": lambda spark, sf: A.class_totals(_ans(spark, sf)),
    "class_summary": lambda spark, sf: A.class_summary(_ans(spark, sf)),
    "weak_topics_rounded": lambda spark, sf: A.weak_topics_rounded(_ans(spark, sf)),
    "weak_topics_raw": lambda spark, sf: A.weak_topics_raw(_ans(spark, sf)).withColumn(
        "accuracy", F.round("accuracy", 6)),
    "weak_rule_conflicts": lambda spark, sf: A.weak_rule_conflicts(_ans(spark, sf)),
    "weak_topic_list": lambda spark, sf: A.weak_topic_list(_ans(spark, sf)).select(
        "student_name", F.concat_ws(", ", "weak_topics").alias("weak_topics"), "n_topics",
        F.col("n_weak").cast("bigint").alias("n_weak")),
    "weak_topic_text": lambda spark, sf: A.weak_topic_text(_ans(spark, sf)),
    "practice_plan_size": lambda spark, sf: A.practice_plan_size(_ans(spark, sf)).withColumn(
        "n_weak", F.col("n_weak").cast("bigint")),
    "student_status": lambda spark, sf: A.student_status(S.roster(spark, sf), _ans(spark, sf)),
    "students_without_history": lambda spark, sf: A.students_without_history(
        S.roster(spark, sf), _ans(spark, sf)),
    "progress_table": lambda spark, sf: A.progress_table(_ans(spark, sf)),
    "accuracy_map": lambda spark, sf: A.accuracy_map(_ans(spark, sf)).select(
        "student_name", F.to_json("accuracy").alias("accuracy")),
    "report_lines": lambda spark, sf: A.report_lines(_ans(spark, sf)),
    "leaderboard_bar": lambda spark, sf: A.leaderboard_bar(_ans(spark, sf)),
    "asked_students": lambda spark, sf: A.asked_students(_ans(spark, sf), ASKED),
    "asked_students_rounded": lambda spark, sf: A.asked_students(_ans(spark, sf), ASKED, "rounded"),
    "one_student_report": lambda spark, sf: RP.get_student_report(_ans(spark, sf), ASKED[0]),
    "list_students": lambda spark, sf: RP.list_students(_ans(spark, sf)),
    "analysis_lines": lambda spark, sf: A.analysis_lines(_ans(spark, sf)),
    "weak_rule_conflicts_at": lambda spark, sf: A.weak_rule_conflicts(_ans(spark, sf), CONFLICT_THRESHOLD),
    "class_totals_by_sketch": _by_sketch,
}

_BREAKDOWN = f"SELECT student_name, topic, {TOTALS} FROM answers GROUP BY student_name, topic"
_WEAK_LIST = f"""
  SELECT student_name,
         COALESCE(string_agg(CASE WHEN correct * 100 < total * {T} THEN topic END, ', ' ORDER BY topic), '') AS weak_topics,
         COUNT(*) AS n_topics,
         CAST(COUNT(CASE WHEN correct * 100 < total * {T} THEN 1 END) AS BIGINT) AS n_weak
  FROM bd GROUP BY student_name"""

ORACLE = {
    "class_weak_topics": with_standins(f"""
SELECT student_name, topic, total, correct, pct, correct * 100 < total * {T} AS weak_raw
FROM ({_BREAKDOWN}) WHERE pct < {T}"""),
    "topic_breakdown": with_standins(f"""
SELECT student_name, topic, COUNT(*) AS total, CAST(SUM(is_correct) AS BIGINT) AS correct
FROM answers GROUP BY student_name, topic"""),
    "student_report": with_standins(f"""
SELECT student_name, topic, total, correct, pct,
       CASE WHEN pct >= {T} THEN 'OK' ELSE 'WEAK' END AS status
FROM ({_BREAKDOWN}) ORDER BY student_name, pct, topic"""),
    "student_leaderboard": with_standins(f"""
SELECT student_name, {TOTALS},
       CASE WHEN {PCT} = 100 THEN '{C.BADGE_PERFECT}' WHEN {PCT} >= {T} THEN '{C.BADGE_OK}' ELSE '{C.BADGE_WARN}' END AS badge
FROM answers GROUP BY student_name ORDER BY pct DESC, student_name"""),
    "topic_difficulty": with_standins(f"""
SELECT topic, {TOTALS} FROM answers GROUP BY topic ORDER BY pct, topic"""),
    "class_totals": with_standins("""
SELECT COUNT(DISTINCT student_name) AS total_students, COUNT(*) AS total_answers FROM answers"""),
    "class_summary": with_standins(f"""
SELECT CASE GROUPING(student_name, topic) WHEN 1 THEN 'student' WHEN 2 THEN 'topic' ELSE 'overall' END AS level,
       student_name, topic, COUNT(*) AS total, CAST(SUM(is_correct) AS BIGINT) AS correct, {PCT} AS pct,
       CASE WHEN GROUPING(student_name, topic) = 3 THEN COUNT(DISTINCT student_name) END AS total_students
FROM answers GROUP BY GROUPING SETS ((student_name), (topic), ())"""),
    "weak_topics_rounded": with_standins(f"""
SELECT student_name, topic, {TOTALS} FROM answers GROUP BY student_name, topic
HAVING pct < {T} ORDER BY student_name, pct, topic"""),
    "weak_topics_raw": with_standins(f"""
SELECT student_name, topic, total, correct, ROUND(CAST(correct AS DOUBLE) / total * 100.0, 6) AS accuracy
FROM (SELECT student_name, topic, COUNT(*) AS total, CAST(SUM(is_correct) AS BIGINT) AS correct
      FROM answers GROUP BY student_name, topic)
WHERE correct * 100 < total * {T}"""),
    "weak_rule_conflicts": with_standins(f"""
SELECT student_name, topic, total, correct, pct,
       correct * 100 < total * {T} AS weak_raw, pct < {T} AS weak_rounded
FROM ({_BREAKDOWN}) WHERE (correct * 100 < total * {T}) <> (pct < {T})"""),
    "weak_topic_list": with_standins(f"SELECT * FROM ({_WEAK_LIST})",
                                     [("bd", _BREAKDOWN)]),
    "weak_topic_text": with_standins(f"""
SELECT student_name, weak_topics,
       CASE WHEN n_weak > 0 THEN '📌 Weak topics (below {T}%): ' || weak_topics
            ELSE '🎉 No weak topics! Everything is above {T}%.' END AS message
FROM ({_WEAK_LIST})""", [("bd", _BREAKDOWN)]),
    "practice_plan_size": with_standins(f"""
SELECT student_name, n_weak, CAST(n_weak * {C.QUESTIONS_PER_TOPIC} AS BIGINT) AS planned_questions
FROM ({_WEAK_LIST})""", [("bd", _BREAKDOWN)]),
    "student_status": with_standins(f"""
SELECT r.student_name,
       CASE WHEN s.n_topics IS NULL THEN 'NO_HISTORY' WHEN s.n_weak = 0 THEN 'NO_WEAK' ELSE 'HAS_WEAK' END AS status,
       CAST(COALESCE(s.n_topics, 0) AS BIGINT) AS n_topics, CAST(COALESCE(s.n_weak, 0) AS BIGINT) AS n_weak
FROM roster r LEFT JOIN (
  SELECT student_name, COUNT(*) AS n_topics,
         SUM(CAST(correct * 100 < total * {T} AS INTEGER)) AS n_weak
  FROM ({_BREAKDOWN}) GROUP BY student_name) s ON r.student_name = s.student_name"""),
    "students_without_history": with_standins("""
SELECT student_name FROM roster r
WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.student_name = r.student_name)"""),
    "progress_table": with_standins(f"""
SELECT student_name, topic AS "Topic", correct AS "Correct", total AS "Total",
       ROUND_EVEN(CAST(correct AS DOUBLE) / total * 100.0, 1) AS "Accuracy %",
       CASE WHEN ROUND_EVEN(CAST(correct AS DOUBLE) / total * 100.0, 1) >= {T} THEN '✅ OK' ELSE '⚠️ Weak' END AS "Status"
FROM (SELECT student_name, topic, COUNT(*) AS total, CAST(SUM(is_correct) AS BIGINT) AS correct
      FROM answers GROUP BY student_name, topic)"""),
    "accuracy_map": with_standins("""
SELECT student_name,
       CAST(to_json(map_from_entries(list(struct_pack(k := topic, v := acc) ORDER BY topic))) AS VARCHAR) AS accuracy
FROM (SELECT student_name, topic, ROUND_EVEN(CAST(SUM(is_correct) AS DOUBLE) / COUNT(*) * 100.0, 1) AS acc
      FROM answers GROUP BY student_name, topic) GROUP BY student_name"""),
    "report_lines": with_standins(f"""
SELECT topic, '  ' || printf('%-20s', topic) || ' | ' || CAST(correct AS VARCHAR) || '/' || CAST(total AS VARCHAR)
       || ' correct | ' || printf('%5.1f', pct) || '%' AS line
FROM (SELECT topic, {TOTALS} FROM answers GROUP BY topic)"""),
    "leaderboard_bar": with_standins(f"""
SELECT student_name, pct,
       '  ' || printf('%-15s', student_name) || ' ' || repeat('{C.BAR_FULL}', CAST(floor(pct / 10) AS INTEGER))
       || repeat('{C.BAR_EMPTY}', 10 - CAST(floor(pct / 10) AS INTEGER)) || ' ' || printf('%5.1f', pct) || '% ('
       || CAST(correct AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ')' AS line
FROM (SELECT student_name, {TOTALS} FROM answers GROUP BY student_name)"""),
}
_ASKED = "(VALUES " + ", ".join(f"('{s}')" for s in ASKED) + ") a(student_name)"


def _asked_sql(flag: str) -> str:
    return with_standins(f"""
SELECT a.student_name, CASE WHEN s.n IS NULL THEN 'NO_HISTORY' WHEN s.n_weak = 0 THEN 'NO_WEAK' ELSE 'HAS_WEAK' END AS status,
       w.topic, w.total, w.correct, w.pct
FROM {_ASKED}
LEFT JOIN (SELECT student_name, COUNT(*) AS n, COUNT(CASE WHEN {flag} THEN 1 END) AS n_weak FROM bd GROUP BY student_name) s
  ON s.student_name = a.student_name
LEFT JOIN (SELECT * FROM bd WHERE {flag}) w ON w.student_name = a.student_name""", [("bd", _BREAKDOWN)])


ORACLE |= {
    "asked_students": _asked_sql(f"correct * 100 < total * {T}"),
    "asked_students_rounded": _asked_sql(f"pct < {T}"),
    "one_student_report": with_standins(f"""
SELECT student_name, topic, total, correct, pct, CASE WHEN pct >= {T} THEN 'OK' ELSE 'WEAK' END AS status,
       '  ' || printf('%-20s', topic) || ' | ' || CAST(correct AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' correct | '
       || printf('%5.1f', pct) || '% | ' || CASE WHEN pct < {T} THEN '{C.LINE_WEAK}' ELSE '{C.LINE_OK}' END AS line
FROM ({_BREAKDOWN}) WHERE student_name = '{ASKED[0]}'"""),
    "list_students": with_standins(f"""
SELECT *, '  ' || printf('%-15s', student_name) || ' | ' || CAST(correct AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' correct | '
       || printf('%5.1f', pct) || '% ' || badge AS line
FROM (SELECT student_name, {TOTALS},
       CASE WHEN {PCT} = 100 THEN '{C.BADGE_PERFECT}' WHEN {PCT} >= {T} THEN '{C.BADGE_OK}' ELSE '{C.BADGE_WARN}' END AS badge
FROM answers GROUP BY student_name)"""),
    "analysis_lines": with_standins(f"""
SELECT student_name, topic, printf('%-20s', topic) || ' | ' || CAST(correct AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' correct | '
       || printf('%5.1f', CAST(correct AS DOUBLE) / total * 100.0) || '% | '
       || CASE WHEN correct * 100 < total * {T} THEN '{C.ANALYSIS_WEAK}' ELSE '{C.ANALYSIS_OK}' END AS line
FROM ({_BREAKDOWN})"""),
    "weak_rule_conflicts_at": with_standins(f"""
SELECT student_name, topic, total, correct, pct, correct * 100 < total * {CONFLICT_THRESHOLD} AS weak_raw,
       pct < {CONFLICT_THRESHOLD}::DOUBLE AS weak_rounded
FROM ({_BREAKDOWN}) WHERE (correct * 100 < total * {CONFLICT_THRESHOLD}) <> (pct < {CONFLICT_THRESHOLD}::DOUBLE)"""),
    "class_totals_by_sketch": with_standins("""
SELECT COUNT(DISTINCT student_name) AS total_students, COUNT(*) AS total_answers, TRUE AS same_answers, TRUE AS within_bound FROM answers"""),
}
