"""The named read-only queries (X1) and library functions (X2) as DataFrame
functions with the original names, so a user of the original can switch.

Each returns a lazy DataFrame. ``render`` turns a *bounded* result (one
student's topics, a top-k) into the original's multi-line text inside
Spark; unbounded results (every student) stay one line per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import pad_right
from ..sources import answer_log, practice_json
from . import accuracy as A
from . import practice as P


# ------------------------------------------------------------------ X1

def list_students(answers: DataFrame) -> DataFrame:
    """Every student with totals and accuracy, best first, with the badge."""
    lb = A.student_leaderboard(answers)
    line = F.concat(F.lit("  "), pad_right("student_name", 15), F.lit(" | "),
                    F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"),
                    F.lit(" correct | "), F.format_string("%5.1f", "pct"), F.lit("% "), F.col("badge"))
    return lb.withColumn("line", line)


def get_student_report(answers: DataFrame, student_name: str) -> DataFrame:
    """One student's topics, hardest first, with status."""
    rep = A.student_report(answers, student_name)
    line = F.concat(F.lit("  "), pad_right("topic", 20), F.lit(" | "), F.col("correct").cast("string"),
                    F.lit("/"), F.col("total").cast("string"), F.lit(" correct | "),
                    F.format_string("%5.1f", "pct"), F.lit("% | "),
                    F.when(F.col("status") == C.STATUS_WEAK, F.lit(C.LINE_WEAK)).otherwise(F.lit(C.LINE_OK)))
    return rep.withColumn("line", line)


def get_class_summary(answers: DataFrame) -> DataFrame:
    """Per student, per topic and overall rows from one scan."""
    return A.class_summary(answers)


def get_weak_topics(answers: DataFrame, student_name: str) -> DataFrame:
    """One student's weak topics by the rounded rule, hardest first. ``status`` tells an
    unknown name (NO_HISTORY) from a student without weak topics (NO_WEAK): one row
    without a topic each."""
    return A.asked_students(answers, [student_name], "rounded").orderBy("pct", "topic")


def get_recent_activity(answers: DataFrame, limit: int = C.RECENT_LIMIT_DEFAULT) -> DataFrame:
    """The newest answers by insertion id; the limit is clamped to 1..50."""
    return answer_log.recent_activity(answers, limit)


def render(lines: DataFrame, order_cols: list[str], header: str = "", most: int = 1000) -> DataFrame:
    """The first ``most`` values of ``line`` in order, joined into one text."""
    first = lines.orderBy(*order_cols).limit(most)
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col("line"))))
    text = F.concat_ws("\n", F.transform(items, lambda x: x["line"]))
    if header:
        text = F.concat(F.lit(header + "\n"), text)
    return first.agg(text.alias("text"))


# ------------------------------------------------------------------ X2

def get_topic_breakdown(answers: DataFrame, student_name: str | None = None) -> DataFrame:
    return A.topic_breakdown(answers, student_name)


def find_weak_topics(answers: DataFrame, student_name: str | None = None) -> DataFrame:
    """Sorted weak topic names (raw rule) and ``status``. For one student there is always
    one row: NULL names without history, none without a weak topic."""
    if student_name is None:
        found = A.weak_topic_list(answers, "raw")
        return found.withColumn("status", F.when(F.col("n_weak") == 0, F.lit(A.STATUS_NO_WEAK)).otherwise(F.lit(A.STATUS_HAS_WEAK)))
    rows = A.asked_students(answers, [student_name]).groupBy("student_name", "status").agg(
        F.sort_array(F.collect_list("topic")).alias("weak_topics"))
    return rows.select("student_name", F.when(F.col("status") != A.STATUS_NO_HISTORY, F.col("weak_topics")).alias("weak_topics"), "status")


def save_result(rows: DataFrame, path: str | None = None, table: str | None = None) -> None:
    """Append answers (without ids, if they carry none) to a log folder or to the
    table of ``setup_database``."""
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    if table is not None:
        answer_log.append_to_table(rows, table)
    else:
        answer_log.append(rows, path)


def setup_database(spark, table: str, path: str) -> list[str]:
    """Create the answer table, or add the columns that an older one lacks (returned)."""
    return answer_log.create_if_absent(spark, table, path)


def save_practice_questions(questions: DataFrame, path: str, generated_on: str) -> DataFrame:
    """Write one practice document a student (columns student_name, question_no and those
    of a question) as JSON; returns the file name of each, as ``practice_json.manifest``."""
    docs = practice_json.practice_documents(questions, generated_on)
    practice_json.write_documents(docs, path)
    return practice_json.manifest(practice_json.read_documents(questions.sparkSession, path))


def generate_quiz_questions(targets: DataFrame, bank: DataFrame, seed: str = C.QuizConfig.seed,
                            per_topic: int = C.QUESTIONS_PER_TOPIC) -> DataFrame:
    """Questions per (student, topic) drawn from the bank, topic blocks in seeded order."""
    return P.quiz_order(P.draw(targets, bank, per_topic, seed), seed)
