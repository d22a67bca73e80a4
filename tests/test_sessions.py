"""Session properties: running score at the last row equals the session
score; last answer equals the last numbered row; deadlines at the edges."""

import datetime as dt

from pyspark.sql import functions as F

from quizlake.operators import sessions as SE
from quizlake.sources import standins as S

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1, 9, 0, 0)
ORDER = [*SE.ORDER, "supplier_key", "quantity", "price"]


def test_running_score_ends_at_session_score(spark):
    g = SE.graded_responses(S.responses(spark, SF), S.bank(spark, SF))
    rs = SE.running_score(g, ORDER)
    last = (rs.groupBy("session_id").agg(F.max_by(F.struct("score_feedback", "question_no"), "question_no").alias("l"))
            .select("session_id", F.col("l.score_feedback").alias("fb"), F.col("l.question_no").alias("qn")))
    sc = SE.session_scores(g).select("session_id", "score", "total")
    bad = last.join(sc, "session_id").filter((F.col("fb") != F.col("score")) | (F.col("qn") != F.col("total")))
    assert bad.count() == 0
    # before-score of the last row plus the last answer gives the session score too
    la = SE.last_answer(g, ORDER).select("session_id", F.col("is_correct").alias("last_ok"))
    before = (rs.groupBy("session_id").agg(F.max_by("score_before", "question_no").alias("b")))
    chk = before.join(la, "session_id").join(sc, "session_id").filter(F.col("b") + F.col("last_ok") != F.col("score"))
    assert chk.count() == 0


def test_progress_and_numbers(spark):
    g = SE.graded_responses(S.responses(spark, SF), S.bank(spark, SF))
    p = SE.session_progress(g, ORDER)
    assert p.filter((F.col("question_no") < 1) | (F.col("question_no") > F.col("n_questions"))).count() == 0
    assert p.filter(F.col("question_no") == F.col("n_questions")).count() == SE.session_scores(g).count()


def test_deadline_edges(spark):
    shown = spark.createDataFrame([(i, 1, T0, "A") for i in range(4)],
                                  "qid long, session_id long, shown_at timestamp_ntz, correct string")
    answered = spark.createDataFrame([
        (0, T0, "A"), (1, T0 + dt.timedelta(seconds=19.999999), "A"), (2, T0 + dt.timedelta(seconds=20), "A")],
        "qid long, answered_at timestamp_ntz, selected string")
    out = {r.qid: r for r in SE.timed_answers(shown, answered).collect()}
    assert [out[i].status for i in range(4)] == ["answered", "answered", "timed_out", "timed_out"]
    assert out[2].selected is None and out[2].is_correct == 0 and out[0].is_correct == 1


def test_rejects_and_normalisation(spark):
    r = S.responses(spark, SF)
    valid = SE.valid_responses(r)
    rej = SE.rejected_responses(r)
    assert valid.count() + rej.count() == r.count()
    assert rej.filter(F.col("selected_raw") != "x").count() == 0
    assert valid.filter(~F.col("selected").isin("A", "B", "C", "D")).count() == 0


def test_nothing_is_lost_between_valid_rejected_and_unknown(spark):
    r = spark.createDataFrame([(1, "ana", 7, 1, "a"), (1, "ana", 7, 2, None), (1, "ana", 7, 3, "x"), (1, "ana", 99, 4, "B")],
                              "session_id long, student_name string, question_id long, slot int, selected_raw string")
    bank = spark.createDataFrame([(7, "lists", "Q?", "A", "beginner")],
                                 "question_id long, topic string, question string, answer string, difficulty string")
    graded = SE.graded_responses(r, bank)
    assert [(x.slot, x.is_correct) for x in graded.collect()] == [(1, 1)]
    assert {(x.slot, x.reason) for x in SE.all_rejects(r, bank).collect()} == {
        (2, "invalid_letter"), (3, "invalid_letter"), (4, "unknown_question")}
    # the library's defaults need only the session's own columns
    assert [(x.question_no, x.score_before) for x in SE.running_score(graded).collect()] == [(1, 0)]
    assert SE.answer_review(graded).columns == ["session_id", "question_id", "slot", "line"]


def test_rejects_with_repeated_and_missing_questions(spark):
    """A question held twice or a null one: each reject comes once, and a null question is known to no bank."""
    r = spark.createDataFrame([(1, "ana", 7, 1, "a"), (1, "ana", 7, 2, "?"), (1, "ana", None, 3, "b"), (1, "ana", None, 4, None),
                               (2, "ben", 8, 1, " c\t"), (2, "ben", 8, 1, " c\t"), (2, "ben", 9, 2, "")],
                              "session_id long, student_name string, question_id long, slot int, selected_raw string")
    bank = spark.createDataFrame([(7,), (7,), (None,)], "question_id long")
    columns = ["session_id", "student_name", "question_id", "slot", "selected_raw", "selected", "reason"]
    out = SE.all_rejects(r, bank)
    unknown = [(1, "ana", None, 3, "b", "B", "unknown_question")] + [(2, "ben", 8, 1, " c\t", "C", "unknown_question")] * 2
    invalid = [(1, "ana", 7, 2, "?", "?", "invalid_letter"), (1, "ana", None, 4, None, None, "invalid_letter"),
               (2, "ben", 9, 2, "", "", "invalid_letter")]
    assert out.columns == columns and sorted(map(tuple, out.collect()), key=str) == sorted(unknown + invalid, key=str)
    assert sorted(map(tuple, SE.unknown_questions(r, bank).collect()), key=str) == sorted(unknown, key=str)


def test_reject_reasons_sort_no_responses(spark):
    """The responses are read once for the graded and once for all rejects, and no task sorts them
    or the orders: the reject branches did, in one task, as they are small only once joined."""
    from quizlake.plans.session_queries import SPARK
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = SPARK["response_outcomes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("FileScan parquet [l_orderkey") == 2
    assert "SortMergeJoin" not in plan and "Sort [" not in plan and plan.count("ShuffledHashJoin") == 4


def test_only_the_earliest_answer_in_time_counts(spark):
    shown = spark.createDataFrame([(1, 1, T0, "A"), (2, 1, T0, "B")], "qid long, session_id long, shown_at timestamp_ntz, correct string")
    answered = spark.createDataFrame([
        (1, T0 + dt.timedelta(seconds=9), "B"), (1, T0 + dt.timedelta(seconds=2), "A"), (2, T0 + dt.timedelta(seconds=30), "A"),
        (2, T0 + dt.timedelta(seconds=3), "B")], "qid long, answered_at timestamp_ntz, selected string")
    out = {r.qid: (r.selected, r.is_correct, r.status) for r in SE.timed_answers(shown, answered).collect()}
    assert out == {1: ("A", 1, "answered"), 2: ("B", 1, "answered")}


def test_lookup_default_and_decode(spark):
    df = spark.createDataFrame([("advanced",), ("expert",), (None,)], "difficulty string")
    out = SE.difficulty_lookup(df, SE.difficulty_dimension(spark)).collect()
    sym = {r.difficulty: r.symbol for r in out}
    assert sym["advanced"] == "🔴" and sym["expert"] == "🟢" and sym[None] == "🟢"
    ch = spark.createDataFrame([("1",), ("3",), ("4",), ("x",), (" 2",)], "c string")
    got = [r.d for r in ch.select(SE.difficulty_decode("c").alias("d")).collect()]
    assert got == ["beginner", "advanced", None, None, "intermediate"]


def test_abandoned_drop(spark):
    shown = spark.createDataFrame([(i, 1, T0, "A") for i in range(3)],
                                  "qid long, session_id long, shown_at timestamp_ntz, correct string")
    answered = spark.createDataFrame([(0, T0, "A"), (1, T0 + dt.timedelta(seconds=30), "B")],
                                     "qid long, answered_at timestamp_ntz, selected string")
    keep = {r.qid: r.status for r in SE.timed_answers(shown, answered).collect()}
    drop = {r.qid: r.status for r in SE.timed_answers(shown, answered, abandoned="drop").collect()}
    assert keep == {0: "answered", 1: "timed_out", 2: "timed_out"}
    assert drop == {0: "answered", 1: "timed_out"}


def test_question_key(spark):
    from quizlake.functions.hashing import question_key
    df = spark.createDataFrame([("lists", "Q?"), ("numpy", "Q?"), ("lists", "Q?")], "t string, q string")
    keys = [r.k for r in df.select(question_key("t", "q").alias("k")).collect()]
    assert keys[0] == keys[2] != keys[1] and len(keys[0]) == 64
