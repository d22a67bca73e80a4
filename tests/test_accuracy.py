"""Golden rows and properties for the accuracy operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizlake.operators import accuracy as A
from quizlake.schemas import ANSWER_SCHEMA

T0 = dt.datetime(2026, 1, 1)


def _log(spark, groups):
    """groups: [(student, topic, correct, total)] -> answer rows."""
    rows, i = [], 0
    for student, topic, correct, total in groups:
        for k in range(total):
            rows.append((i, student, topic, f"q{i}", 1 if k < correct else 0, "beginner", T0))
            i += 1
    return spark.createDataFrame(rows, ANSWER_SCHEMA)


@pytest.fixture(scope="module")
def golden(spark):
    return _log(spark, [
        ("ana", "lists", 7, 10),        # exactly 70 %: OK by both rules
        ("ana", "numpy", 1399, 2000),   # 69.95: weak raw, 70.0 rounded -> OK rounded
        ("ana", "functions", 0, 3),
        ("bo", "lists", 5, 5),
        ("bo", "numpy", 5, 16),         # 31.25 -> 31.3 SQL, 31.2 Python
        ("bo", None, 1, 2),             # NULL topic is its own group
        ("Bo", "lists", 0, 1),          # case-sensitive names
    ])


def _rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_breakdown_and_rounding(golden):
    rep = {(r.student_name, r.topic): r for r in A.student_report(golden).collect()}
    assert rep[("ana", "lists")].pct == 70.0 and rep[("ana", "lists")].status == "OK"
    assert rep[("ana", "numpy")].pct == 70.0 and rep[("ana", "numpy")].status == "OK"
    assert rep[("ana", "functions")].pct == 0.0
    assert rep[("bo", "numpy")].pct == 31.3
    assert rep[("bo", None)].total == 2
    assert rep[("Bo", "lists")].correct == 0
    prog = {(r.student_name, r.Topic): r["Accuracy %"] for r in A.progress_table(golden).collect()}
    assert prog[("bo", "numpy")] == 31.2  # Python round half to even


def test_two_weak_rules(golden):
    raw = _rows(A.weak_topics_raw(golden), "student_name", "topic")
    rounded = _rows(A.weak_topics_rounded(golden), "student_name", "topic")
    assert ("ana", "numpy") in raw and ("ana", "numpy") not in rounded
    assert ("ana", "lists") not in raw and ("ana", "lists") not in rounded
    conflicts = _rows(A.weak_rule_conflicts(golden), "student_name", "topic")
    assert conflicts == {("ana", "numpy")}


def test_weak_list_and_status(spark, golden):
    wl = {r.student_name: r.weak_topics for r in A.weak_topic_list(golden).collect()}
    assert wl["ana"] == ["functions", "numpy"]
    assert wl["bo"] == ["numpy"]  # NULL topic (50 %) is dropped from the name list
    roster = spark.createDataFrame([("ana",), ("bo",), ("cy",), ("Bo",)], "student_name string")
    st = {r.student_name: r.status for r in A.student_status(roster, golden).collect()}
    assert st == {"ana": "HAS_WEAK", "bo": "HAS_WEAK", "cy": "NO_HISTORY", "Bo": "HAS_WEAK"}
    none = {r.student_name for r in A.students_without_history(roster, golden).collect()}
    assert none == {"cy"}


def test_no_weak_status(spark):
    log = _log(spark, [("dee", "lists", 5, 5)])
    roster = spark.createDataFrame([("dee",)], "student_name string")
    assert A.student_status(roster, log).collect()[0].status == "NO_WEAK"
    msg = A.weak_topic_text(log).collect()[0].message
    assert msg.startswith("🎉 No weak topics")


def test_class_summary_levels(golden):
    rows = A.class_summary(golden).collect()
    overall = [r for r in rows if r.level == "overall"][0]
    assert overall.total == 10 + 2000 + 3 + 5 + 16 + 2 + 1
    assert overall.total_students == 3
    topics = {r.topic for r in rows if r.level == "topic"}
    assert topics == {"lists", "numpy", "functions", None}
    # sum over topics equals the total of each student
    per_student = {r.student_name: r.total for r in rows if r.level == "student"}
    assert per_student["ana"] == 2013


def test_leaderboard_badges(golden):
    lb = {r.student_name: r.badge for r in A.student_leaderboard(golden).collect()}
    assert lb["Bo"] == "⚠️"
    totals = A.class_totals(golden).collect()[0]
    assert totals.total_students == 3


def test_report_line_padding(spark):
    long_topic = "a_really_long_topic_name_over_20"
    log = _log(spark, [("x", long_topic, 1, 3), ("x", "lists", 7, 10)])
    lines = {r.topic: r.line for r in A.report_lines(log).collect()}
    assert lines["lists"] == "  lists                | 7/10 correct |  70.0%"
    assert long_topic in lines[long_topic]  # padded, never cut
    bars = A.leaderboard_bar(log).collect()[0].line
    assert "██████░░░░" in bars or "█████░░░░░" in bars


def test_sum_over_topics_property(spark):
    from quizlake.sources import standins as S
    ans = S.answers(spark, "/root/testdata/sf0.001")
    bd = A.topic_breakdown(ans).groupBy("student_name").agg(F.sum("total").alias("t"))
    lb = A.student_leaderboard(ans).select("student_name", "total")
    diff = bd.join(lb, "student_name").filter(F.col("t") != F.col("total")).count()
    assert diff == 0
    wl = A.weak_topic_list(ans).filter(F.col("n_weak") > F.col("n_topics")).count()
    assert wl == 0


def test_named_reports(spark, golden):
    from quizlake.operators import reports as RP
    rep = RP.get_student_report(golden, "ana")
    text = RP.render(rep, ["pct", "topic"]).collect()[0].text.split("\n")
    assert text[0].startswith("  functions ") and text[0].endswith("WEAK ⚠️")
    assert len(text) == 3
    assert {r.topic for r in RP.get_weak_topics(golden, "ana").collect()} == {"functions"}
    assert RP.get_recent_activity(golden, 3).count() == 3
    assert RP.list_students(golden).count() == 3
    assert RP.find_weak_topics(golden, "bo").collect()[0].weak_topics == ["numpy"]


def test_hot_student_third_of_rows(spark):
    """One student holding a third of all answers: results equal a pandas brute force."""
    from quizlake.sources import standins as S
    ans = S.answers(spark, "/root/testdata/sf0.01")
    hot = ans.withColumn("student_name", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("student_name")))
    pdf = hot.select("student_name", "topic", "is_correct").toPandas()
    want = pdf.groupby(["student_name", "topic"]).is_correct.agg(["count", "sum"]).reset_index()
    want = {(r.student_name, r.topic): (r["count"], r["sum"]) for _, r in want.iterrows()}
    got = {(r.student_name, r.topic): (r.total, r.correct) for r in A.topic_breakdown(hot).collect()}
    assert got == want
    summary = {(r.level, r.student_name, r.topic): r.total for r in A.class_summary(hot).collect()}
    assert summary[("student", "hot", None)] == int((pdf.student_name == "hot").sum())


def test_report_bundle_matches_direct(spark, golden):
    b = A.report_bundle(golden)
    try:
        direct = {r.student_name: (r.total, r.correct, r.pct, r.badge) for r in A.student_leaderboard(golden).collect()}
        bundled = {r.student_name: (r.total, r.correct, r.pct, r.badge) for r in b["student_leaderboard"].collect()}
        assert direct == bundled
        assert {tuple(r) for r in A.student_report(golden).collect()} == {tuple(r) for r in b["student_report"].collect()}
        assert {tuple(r) for r in A.topic_difficulty(golden).collect()} == {tuple(r) for r in b["topic_difficulty"].collect()}
    finally:
        b["breakdown"].unpersist()


def test_the_three_answers_for_one_student(spark):
    from quizlake.operators import reports as RP
    rows = [("ana", "lists", 1)] * 3 + [("bo", "lists", 0), ("bo", "numpy", 1), ("bo", "data_types", 0)]
    log = spark.createDataFrame(rows, "student_name string, topic string, is_correct int")
    assert [tuple(r) for r in RP.get_weak_topics(log, "ana").select("status", "topic").collect()] == [("NO_WEAK", None)]
    assert [tuple(r) for r in RP.get_weak_topics(log, "zed").select("status", "topic").collect()] == [("NO_HISTORY", None)]
    assert [tuple(r) for r in RP.get_weak_topics(log, "bo").select("status", "topic").collect()] == [
        ("HAS_WEAK", "data_types"), ("HAS_WEAK", "lists")]
    found = {n: RP.find_weak_topics(log, n).first() for n in ("ana", "bo", "zed")}
    assert {n: (r.weak_topics, r.status) for n, r in found.items()} == {
        "ana": ([], "NO_WEAK"), "bo": (["data_types", "lists"], "HAS_WEAK"), "zed": (None, "NO_HISTORY")}
    assert {(r.student_name, r.status) for r in RP.find_weak_topics(log).collect()} == {("ana", "NO_WEAK"), ("bo", "HAS_WEAK")}


def test_render_is_bounded(spark):
    from quizlake.operators import reports as RP
    lines = spark.range(5000).select("id", F.format_string("line %d", "id").alias("line"))
    text = RP.render(lines, ["id"], "head", most=3).first().text
    assert text == "head\nline 0\nline 1\nline 2"


def test_sketches_of_days_add_up(spark):
    log = spark.range(60_000).select(F.concat(F.lit("s"), F.col("id") % 9000).alias("student_name"), F.lit("lists").alias("topic"),
                                     F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(cast(id % 30 as int))").alias("answered_at"))
    days = A.daily_sketches(log)
    assert days.count() == 30
    got = A.totals_from_sketches(days).first()
    assert got.total_answers == 60_000 and abs(got.total_students - 9000) <= 9000 * A.sketch_error()
    none = A.totals_from_sketches(A.daily_sketches(log.limit(0))).first()
    assert (none.total_students, none.total_answers) == (0, 0)
    unnamed = log.withColumn("student_name", F.lit(None).cast("string"))
    assert A.totals_from_sketches(A.daily_sketches(unnamed)).first().total_students == 0
