"""Accuracy analytics over the answer log.

Everything is one partial+final hash aggregate on (student_name, topic) or a
coarser key; a hot student or topic is absorbed by the map-side partial
aggregate, so no key ever brings its raw rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions.text import pad_right, text_bar

STATUS_NO_HISTORY = "NO_HISTORY"
STATUS_NO_WEAK = "NO_WEAK"
STATUS_HAS_WEAK = "HAS_WEAK"


def for_student(answers: DataFrame, student: str | None) -> DataFrame:
    """P1 — exact, case-sensitive name filter (pushed to the scan when stored)."""
    if student is None:
        return answers
    return answers.filter(F.col("student_name") == F.lit(student))


def _totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("is_correct").cast("bigint").alias("correct"),
    )


def topic_breakdown(answers: DataFrame, student: str | None = None) -> DataFrame:
    """A1 — ``(student_name, topic, total, correct)``; no order (as the original)."""
    return _totals(for_student(answers, student), "student_name", "topic")


def with_accuracy(df: DataFrame, threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """Adds ``pct`` (SQL rounding), both weak flags and the status label."""
    return (df.withColumn("pct", N.pct_sql("correct", "total"))
              .withColumn("weak_raw", N.weak_raw("correct", "total", threshold))
              .withColumn("weak_rounded", N.weak_rounded("pct", threshold))
              .withColumn("status", N.status_label("pct", threshold)))


def student_report(answers: DataFrame, student: str | None = None) -> DataFrame:
    """A2 — per-topic totals, percent and status, hardest first (L1)."""
    rep = with_accuracy(topic_breakdown(answers, student))
    return (rep.select("student_name", "topic", "total", "correct", "pct", "status")
               .orderBy("student_name", "pct", "topic"))


def student_leaderboard(answers: DataFrame) -> DataFrame:
    """A3 + P6 — totals per student, best first (L2)."""
    agg = _totals(answers, "student_name").withColumn("pct", N.pct_sql("correct", "total"))
    return (agg.withColumn("badge", N.badge("pct"))
               .orderBy(F.desc("pct"), F.asc("student_name")))


def topic_difficulty(answers: DataFrame) -> DataFrame:
    """A4 — totals per topic, hardest first (L1)."""
    agg = _totals(answers, "topic").withColumn("pct", N.pct_sql("correct", "total"))
    return agg.orderBy("pct", "topic")


def class_totals(answers: DataFrame) -> DataFrame:
    """A5/U1 — distinct students (NULL names not counted) and answers."""
    return answers.agg(
        F.count_distinct("student_name").alias("total_students"),
        F.count(F.lit(1)).alias("total_answers"),
    )


def class_summary(answers: DataFrame) -> DataFrame:
    """A6 — per student, per topic and overall totals from ONE scan.

    The log is aggregated to (student, topic) first; ``GROUPING SETS ((student_name), (topic), ())`` with ``grouping_id`` to tell
    a subtotal row from a NULL key (1 = per student, 2 = per topic, 3 = overall).
    The distinct-student count is a distinct aggregate inside the same
    grouping-sets aggregate; only the small breakdown is expanded, not the log.
    It is reported on the overall row, as the original's
    ``COUNT(DISTINCT student_name)``.
    """
    pairs = answers.groupBy("student_name", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("ok"))
    gs = (pairs.groupingSets([["student_name"], ["topic"], []], "student_name", "topic")
          .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
               F.sum("ok").cast("bigint").alias("correct"),
               F.count_distinct("student_name").alias("n_students"),
               F.grouping_id("student_name", "topic").alias("gid")))
    level = (F.when(F.col("gid") == 1, F.lit("student"))
             .when(F.col("gid") == 2, F.lit("topic"))
             .otherwise(F.lit("overall")))
    return gs.select(level.alias("level"), "student_name", "topic", "total", "correct",
                     N.pct_sql("correct", "total").alias("pct"),
                     F.when(F.col("gid") == 3, F.col("n_students")).alias("total_students"))


def weak_topics_rounded(answers: DataFrame, student: str | None = None,
                        threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """A7 — ``HAVING pct < 70`` on the rounded percent, hardest first."""
    rep = topic_breakdown(answers, student).withColumn("pct", N.pct_sql("correct", "total"))
    return (rep.filter(N.weak_rounded("pct", threshold))
               .select("student_name", "topic", "total", "correct", "pct")
               .orderBy("student_name", "pct", "topic"))


def weak_topics_raw(answers: DataFrame, student: str | None = None,
                    threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """P2 — weak on the unrounded percent (the practice rule)."""
    rep = topic_breakdown(answers, student)
    return (rep.filter(N.weak_raw("correct", "total", threshold))
               .withColumn("accuracy", N.pct_raw("correct", "total")))


def weak_rule_conflicts(answers: DataFrame, threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """P4 — pairs where the raw and the rounded rule disagree (data-quality report)."""
    rep = with_accuracy(topic_breakdown(answers), threshold)
    return (rep.filter(F.col("weak_raw") != F.col("weak_rounded"))
               .select("student_name", "topic", "total", "correct", "pct", "weak_raw", "weak_rounded"))


def class_weak_topics(answers: DataFrame, rule: str = "rounded",
                      threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """A13 — the classroom-wide weak-topic table: every (student, topic) weak by ``rule``."""
    rep = with_accuracy(topic_breakdown(answers), threshold)
    flag = F.col("weak_rounded") if rule == "rounded" else F.col("weak_raw")
    return rep.filter(flag).select("student_name", "topic", "total", "correct", "pct", "weak_raw")


def weak_topic_list(answers: DataFrame, rule: str = "raw",
                    threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """A8 — per student with history: the sorted list of weak topic names.

    An empty list means history without a weak topic; students without history
    have no row (see ``student_status`` for the three-way answer).
    """
    rep = with_accuracy(topic_breakdown(answers), threshold)
    flag = F.col("weak_raw") if rule == "raw" else F.col("weak_rounded")
    return rep.groupBy("student_name").agg(
        F.sort_array(F.collect_list(F.when(flag, F.col("topic")))).alias("weak_topics"),
        F.count(F.lit(1)).alias("n_topics"),
    ).withColumn("n_weak", F.size("weak_topics"))


def weak_topic_text(answers: DataFrame, threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """A11 — the alert line naming the weak topics, joined with ', '."""
    wl = weak_topic_list(answers, "raw", threshold)
    joined = F.concat_ws(", ", "weak_topics")
    text = (F.when(F.col("n_weak") > 0,
                   F.concat(F.lit(C.WEAK_MESSAGE.replace("70", str(threshold))), joined))
            .otherwise(F.lit(C.NO_WEAK_MESSAGE.replace("70", str(threshold)))))
    return wl.select("student_name", joined.alias("weak_topics"), text.alias("message"))


def practice_plan_size(answers: DataFrame, per_topic: int = C.QUESTIONS_PER_TOPIC) -> DataFrame:
    """A12 — planned practice length ``len(weak) * n`` per student."""
    wl = weak_topic_list(answers, "raw")
    return wl.select("student_name", "n_weak",
                     (F.col("n_weak") * F.lit(per_topic)).cast("bigint").alias("planned_questions"))


def student_status(roster: DataFrame, answers: DataFrame,
                   threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """J4 — NO_HISTORY / NO_WEAK / HAS_WEAK for every student on the roster."""
    per = (with_accuracy(topic_breakdown(answers), threshold)
           .groupBy("student_name")
           .agg(F.count(F.lit(1)).alias("n_topics"),
                F.sum(F.col("weak_raw").cast("int")).cast("bigint").alias("n_weak")))
    st = (F.when(F.col("n_topics").isNull(), F.lit(STATUS_NO_HISTORY))
          .when(F.col("n_weak") == 0, F.lit(STATUS_NO_WEAK))
          .otherwise(F.lit(STATUS_HAS_WEAK)))
    return (roster.join(per, "student_name", "left")
            .select("student_name", st.alias("status"),
                    F.coalesce("n_topics", F.lit(0)).cast("bigint").alias("n_topics"),
                    F.coalesce("n_weak", F.lit(0)).cast("bigint").alias("n_weak")))


def students_without_history(roster: DataFrame, answers: DataFrame) -> DataFrame:
    """J4 (no-history branch) — roster names that never answered."""
    answered = answers.select("student_name").distinct()  # pre-aggregated: a hot student is one row a task
    return roster.join(answered, "student_name", "left_anti")


def progress_table(answers: DataFrame, student: str | None = None,
                   threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """P13 — the progress page table; accuracy with Python rounding."""
    bd = topic_breakdown(answers, student)
    acc = N.pct_python("correct", "total")
    return bd.select(
        "student_name",
        F.col("topic").alias("Topic"),
        F.col("correct").alias("Correct"),
        F.col("total").alias("Total"),
        acc.alias("Accuracy %"),
        F.when(acc >= F.lit(float(threshold)), F.lit(C.PROGRESS_OK)).otherwise(F.lit(C.PROGRESS_WEAK)).alias("Status"),
    )


def accuracy_map(answers: DataFrame) -> DataFrame:
    """P14 — chart data: topic -> accuracy per student, as a map column."""
    bd = topic_breakdown(answers)
    return bd.groupBy("student_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct(F.col("topic"), N.pct_python("correct", "total"))))).alias("accuracy"))


def report_lines(answers: DataFrame) -> DataFrame:
    """N6/N7/N21 — the topic lines of the classroom report."""
    td = _totals(answers, "topic").withColumn("pct", N.pct_sql("correct", "total"))
    line = F.concat(F.lit("  "), pad_right("topic", 20), F.lit(" | "),
                    F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"),
                    F.lit(" correct | "), F.format_string("%5.1f", "pct"), F.lit("%"))
    return td.select("topic", line.alias("line"))


def analysis_lines(answers: DataFrame, student: str | None = None, threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """N6/N21 — the lines of the per-student analysis: the unrounded percent, printed
    with one decimal (ties to even, as Python prints), and the raw weak rule."""
    bd = topic_breakdown(answers, student)
    line = F.concat(pad_right("topic", 20), F.lit(" | "), F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"),
                    F.lit(" correct | "), F.format_string("%5.1f", N.pct_python("correct", "total")), F.lit("% | "),
                    F.when(N.weak_raw("correct", "total", threshold), F.lit(C.ANALYSIS_WEAK)).otherwise(F.lit(C.ANALYSIS_OK)))
    return bd.select("student_name", "topic", line.alias("line"))


def asked_students(answers: DataFrame, students: list[str], rule: str = "raw", threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """P1 + J4 — the three-way answer for the students asked for, one row each and one
    row more for each further weak topic: ``status`` (NO_HISTORY, NO_WEAK, HAS_WEAK) and
    the weak topic with its totals (NULL unless HAS_WEAK), hardest first within a name.

    The names are a literal list: they go to the scan as a filter and make the left
    side, so a name without any answer still has its row."""
    asked = answers.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(students)], "student_name string")
    rep = with_accuracy(topic_breakdown(answers.where(F.col("student_name").isin(*students))), threshold)
    flag = F.col("weak_raw") if rule == "raw" else F.col("weak_rounded")
    topic = F.struct("pct", "topic", "total", "correct")
    per = rep.groupBy("student_name").agg(F.sort_array(F.collect_list(F.when(flag, topic))).alias("weak"))
    status = (F.when(F.col("weak").isNull(), F.lit(STATUS_NO_HISTORY)).when(F.size("weak") == 0, F.lit(STATUS_NO_WEAK))
              .otherwise(F.lit(STATUS_HAS_WEAK)))
    return (asked.join(per, "student_name", "left").select("student_name", status.alias("status"), F.explode_outer("weak").alias("w"))
            .select("student_name", "status", "w.topic", "w.total", "w.correct", "w.pct"))


# --- distinct students from mergeable sketches ----------------------------------

SKETCH_LOG2 = 12


def sketch_error(log2: int = SKETCH_LOG2) -> float:
    """Three standard errors of a sketch of 2^log2 cells (relative)."""
    return 3 * 1.04 / 2 ** (log2 / 2)


def daily_sketches(answers: DataFrame, log2: int = SKETCH_LOG2) -> DataFrame:
    """A5/U1, opt-in — one row a day: its answers and a HyperLogLog sketch of its students.
    Rows of days that are over never change, so only the new day is added to the table."""
    return answers.groupBy(F.to_date("answered_at").alias("answer_date")).agg(
        F.count(F.lit(1)).alias("total_answers"), F.hll_sketch_agg("student_name", log2).alias("students"))


def totals_from_sketches(days: DataFrame) -> DataFrame:
    """``class_totals`` for any set of days from their sketches; ``total_students`` is an
    estimate within ``sketch_error`` of the exact count. The log is not read."""
    return days.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("students")), F.lit(0)).alias("total_students"),
                    F.coalesce(F.sum("total_answers"), F.lit(0)).alias("total_answers"))


def leaderboard_bar(answers: DataFrame) -> DataFrame:
    """N9 — ``name bar pct (correct/total)`` per student."""
    lb = _totals(answers, "student_name").withColumn("pct", N.pct_sql("correct", "total"))
    line = F.concat(F.lit("  "), pad_right("student_name", 15), F.lit(" "), text_bar("pct"),
                    F.lit(" "), F.format_string("%5.1f", "pct"), F.lit("% ("),
                    F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
    return lb.select("student_name", "pct", line.alias("line"))


def report_bundle(answers: DataFrame, threshold: int = C.WEAK_THRESHOLD) -> dict[str, DataFrame]:
    """Several reports from ONE scan of the log: the (student, topic) breakdown
    is persisted and every report is derived from it (per-student and per-topic
    totals are sums of the breakdown, so they need no second pass). The caller
    unpersists ``bundle["breakdown"]`` when done."""
    bd = topic_breakdown(answers).persist()
    per_student = bd.groupBy("student_name").agg(F.sum("total").alias("total"),
                                                 F.sum("correct").cast("bigint").alias("correct"))
    per_topic = bd.groupBy("topic").agg(F.sum("total").alias("total"),
                                        F.sum("correct").cast("bigint").alias("correct"))
    rep = with_accuracy(bd, threshold)
    return {
        "breakdown": bd,
        "student_report": rep.select("student_name", "topic", "total", "correct", "pct", "status"),
        "weak_topics_rounded": rep.filter("weak_rounded").select("student_name", "topic", "total", "correct", "pct"),
        "weak_topics_raw": rep.filter("weak_raw").select("student_name", "topic", "total", "correct"),
        "student_leaderboard": per_student.withColumn("pct", N.pct_sql("correct", "total"))
                                          .withColumn("badge", N.badge("pct")),
        "topic_difficulty": per_topic.withColumn("pct", N.pct_sql("correct", "total")),
    }
