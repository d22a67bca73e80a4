"""Answer-log sink/source with schema evolution, JSON practice sets."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from quizlake.operators import accuracy as A
from quizlake.sources import answer_log as L
from quizlake.sources import practice_json as PJ

T0 = dt.datetime(2026, 1, 5, 10, 15, 0)


def test_log_generations_and_backfill(spark, scratch):
    path = scratch("log")
    old = spark.createDataFrame([(1, "ana", "lists", "q1", True, T0)],
                                "id long, student_name string, topic string, question string, "
                                "is_correct boolean, answered_at timestamp_ntz")
    L.append(old, path, version=1)  # written before the difficulty column existed
    new = spark.createDataFrame([(2, "ana", "numpy", "q2", 0, "advanced", T0), (3, "cy", "lists", "q3", 5, None, T0)],
                                "id long, student_name string, topic string, question string, "
                                "is_correct int, difficulty string, answered_at timestamp_ntz")
    L.append(new, path)
    no_diff = spark.createDataFrame([(4, "cy", "numpy", "q4", 1, None)],
                                    "id long, student_name string, topic string, question string, "
                                    "is_correct int, answered_at timestamp_ntz")
    L.append(no_diff, path)  # omitted column -> default, missing time -> now
    got = {r.id: r for r in L.scan(spark, path).collect()}
    assert got[1].difficulty == "beginner" and got[1].is_correct == 1
    assert got[2].difficulty == "advanced" and got[2].is_correct == 0
    assert got[3].difficulty is None and got[3].is_correct == 1  # explicit NULL stays NULL
    assert got[4].difficulty == "beginner" and got[4].answered_at is not None


def test_student_filter_pushed_to_scan(spark, scratch):
    path = scratch("log-push")
    df = spark.createDataFrame([(1, "ana", "lists", "q", 1, "beginner", T0)],
                               "id long, student_name string, topic string, question string, "
                               "is_correct int, difficulty string, answered_at timestamp_ntz")
    L.append(df, path)
    plan = A.student_report(L.scan(spark, path), "ana")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(student_name), EqualTo(student_name,ana)]" in plan


def test_create_if_absent(spark, scratch):
    path = scratch("table")
    L.create_if_absent(spark, "quiz_results_t", path)
    L.create_if_absent(spark, "quiz_results_t", path)  # idempotent
    assert spark.table("quiz_results_t").count() == 0


def _no_ids(spark, rows):
    return spark.createDataFrame(rows, "student_name string, topic string, question string, is_correct int, difficulty string, "
                                       "answered_at timestamp_ntz")


def test_ids_are_dense_and_follow_the_time_of_the_answers(spark, scratch):
    path = scratch("log-ids")
    at = dt.datetime(2077, 5, 1)  # any year
    L.append(_no_ids(spark, [(f"s{k % 7}", "lists", "same second", k % 2, None, at) for k in range(3000)]).repartition(5), path)
    L.append(_no_ids(spark, [("ana", "lists", f"q{k}", 1, "advanced", at - dt.timedelta(days=k)) for k in range(40)]), path)
    carried = _no_ids(spark, [("bo", "lists", "carried", 1, None, at), ("bo", "lists", "none", 0, None, at)])
    L.append(carried.withColumn("id", F.when(F.col("question") == "carried", F.lit(50_000).cast("bigint"))), path)
    L.append(_no_ids(spark, [("cy", "lists", "after", 1, None, at)]), path)
    L.append(_no_ids(spark, []), path)
    rows = L.scan(spark, path).collect()
    ids = sorted(r.id for r in rows)
    assert ids == [*range(1, 3041), 50_000, 50_001, 50_002]
    by_id = {r.id: r for r in rows}
    second = [by_id[k] for k in range(3001, 3041)]
    assert [r.answered_at for r in second] == sorted(r.answered_at for r in second)
    assert [by_id[k].question for k in (50_000, 50_001, 50_002)] == ["carried", "none", "after"]
    assert [r.id for r in L.recent_activity(L.scan(spark, path), 2).collect()] == [50_002, 50_001]
    moved = scratch("log-ids-moved")  # a compacted log continues the sequence
    L.compact(spark, path, moved, files=2)
    L.append(_no_ids(spark, [("di", "lists", "later", 1, None, at)]), moved)
    assert max(r.id for r in L.scan(spark, moved).collect()) == 50_003


def test_two_writers_never_get_the_same_ids(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    from quizlake.sources.log_ids import IdMarks
    root = scratch("marks")
    marks = [IdMarks(spark, root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        first = list(pool.map(lambda k: marks[k % 4].reserve(10, f"b{k}", lambda: None), range(24)))
    assert sorted(first) == [1 + 10 * k for k in range(24)]
    assert marks[0].reserve(10, "b5", lambda: None) == first[5]  # the same batch again
    marks[0].raise_to(5)  # already behind
    assert marks[1].newest()[1] == 240


def test_one_mark_is_created_by_one_writer(spark, scratch):
    """Many writers create one and the same mark at a time: one succeeds, and its value stays."""
    from concurrent.futures import ThreadPoolExecutor

    from quizlake.sources.log_ids import IdMarks
    root = scratch("one-mark")
    marks = [IdMarks(spark, root) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        for k in range(1, 101):
            won = list(pool.map(lambda w: marks[w]._create(f"{k:012d}", {"first": w, "last": w}), range(8)))
            assert won.count(True) == 1 and marks[0].newest() == (k, won.index(True))


def test_an_old_table_gets_the_missing_column(spark, scratch):
    from quizlake.operators import reports as RP
    table, path = "quiz_results_old", scratch("old-table")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} (id BIGINT, student_name STRING, topic STRING, question STRING, is_correct INT, note STRING, "
              f"answered_at TIMESTAMP_NTZ) USING parquet LOCATION '{path}'")
    spark.sql(f"INSERT INTO {table} VALUES (4, 'ana', 'lists', 'q1', 1, 'kept', TIMESTAMP_NTZ '2020-01-01 00:00:00')")
    assert RP.setup_database(spark, table, path) == ["difficulty"]
    assert RP.setup_database(spark, table, path) == []  # idempotent
    RP.save_result(_no_ids(spark, [("bo", "lists", "q2", 0, None, T0)]), table=table)
    RP.save_result(_no_ids(spark, [("cy", "lists", "q3", 1, None, T0)]).drop("difficulty"), table=table)
    got = {r.id: (r.student_name, r.difficulty, r.note) for r in spark.table(table).collect()}
    assert got == {4: ("ana", "beginner", "kept"), 5: ("bo", None, None), 6: ("cy", "beginner", None)}
    spark.sql(f"DROP TABLE {table}")


def test_new_table_appends(spark, scratch):
    from quizlake.operators import reports as RP
    table, path = "quiz_results_new", scratch("new-table")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    assert RP.setup_database(spark, table, path) == []
    for k in range(2):
        RP.save_result(_no_ids(spark, [("ana", "lists", f"q{k}", 1, None, T0)]), table=table)
    assert sorted((r.id, r.question, r.schema_version) for r in spark.table(table).collect()) == [(1, "q0", 2), (2, "q1", 2)]
    spark.sql(f"DROP TABLE {table}")


def test_recent_activity_topk(spark):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("s"), F.col("id")).alias("student_name"),
                                 F.lit("lists").alias("topic"), (F.col("id") % 2).cast("int").alias("is_correct"),
                                 F.lit(T0).cast("timestamp_ntz").alias("answered_at"))
    ra = L.recent_activity(df, 500)
    assert [r.id for r in ra.collect()] == list(range(99, 49, -1))  # clamped to 50
    assert "TakeOrderedAndProject" in ra._jdf.queryExecution().executedPlan().toString()
    assert L.recent_activity(df, 0).count() == 1


def test_union_logs(spark):
    a = spark.createDataFrame([("x", 1)], "student_name string, is_correct int")
    b = spark.createDataFrame([("y", 0, "advanced")], "student_name string, is_correct int, difficulty string")
    u = L.union_logs(a, b).collect()
    assert len(u) == 2 and {r.difficulty for r in u} == {None, "advanced"}


def _legacy_doc():
    # the shape of a committed practice set: no difficulty, no explanation
    return {"student": "ana", "generated_on": "2026-01-05T10:15:00.123456", "total_questions": 2,
            "questions": [{"question": "Q1?", "options": {"A": "1", "B": "2", "C": "3", "D": "4"},
                           "answer": "A", "topic": "numpy"},
                          {"question": "Q2?", "options": {"A": "x", "B": "y", "C": "z", "D": "w"},
                           "answer": "C", "topic": "lists"}]}


def test_legacy_multiline_documents(spark, scratch):
    path = scratch("legacy")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "practice_ana_2026-01-05_101500.json"), "w") as f:
        json.dump(_legacy_doc(), f, indent=2)
    docs = PJ.read_documents(spark, path, multi_line=True)
    qs = PJ.document_questions(docs).orderBy("question_no").collect()
    assert [q.question for q in qs] == ["Q1?", "Q2?"]
    assert qs[0].options == {"A": "1", "B": "2", "C": "3", "D": "4"}
    assert qs[0].difficulty is None and qs[0].explanation is None
    assert docs.collect()[0].generated_on == dt.datetime(2026, 1, 5, 10, 15, 0, 123456)


def test_documents_round_trip_and_manifest(spark, scratch):
    rows = [("ana b", 2, "Q2", {"A": "a"}, "A", None, "lists", "beginner"),
            ("ana b", 1, "Q1", {"A": "a"}, "B", "why", "numpy", "advanced"),
            ("ana_b", 1, "Q3", {"A": "a"}, "C", None, "lists", None)]
    ordered = spark.createDataFrame(rows, "student_name string, question_no int, question string, "
                                          "options map<string,string>, answer string, explanation string, "
                                          "topic string, difficulty string")
    docs = PJ.practice_documents(ordered, "2026-01-06 08:30:05")
    path = scratch("sets")
    PJ.write_documents(docs, path)
    back = PJ.read_documents(spark, path)
    got = {r.student: r for r in back.collect()}
    assert got["ana b"].total_questions == 2
    assert [q.question for q in got["ana b"].questions] == ["Q1", "Q2"]
    man = {r.student: r for r in PJ.manifest(back).collect()}
    assert man["ana b"].file_name == "practice_ana_b_2026-01-06_083005.json"
    assert man["ana b"].file_name == man["ana_b"].file_name  # the original's collision
    assert man["ana b"].unique_name != man["ana_b"].unique_name


def test_clean_names(spark):
    names = [" Alex", "Alex\t", "", "   ", "alex", None, "a name of seventeen+"]
    df = spark.createDataFrame([(n,) for n in names], "student_name string")
    got = [r.student_name for r in L.clean_names(df).collect()]
    assert got == ["Alex", "Alex", "alex", "a name of seventeen+"]


def test_compaction_and_partition_pruning(spark, scratch):
    src, dst = scratch("log-small"), scratch("log-compact")
    df = spark.createDataFrame([(i, f"s{i % 3}", "lists", "q", i % 2, "beginner",
                                 T0 + dt.timedelta(days=i % 4)) for i in range(40)],
                               "id long, student_name string, topic string, question string, "
                               "is_correct int, difficulty string, answered_at timestamp_ntz")
    for k in range(4):  # many small appends
        L.append(df.filter(F.col("id") % 4 == k), src)
    L.compact(spark, src, dst, files=3)
    a = sorted(map(tuple, L.scan(spark, src).collect()))
    b = sorted(map(tuple, L.scan(spark, dst).collect()))
    assert a == b
    one_day = L.scan(spark, dst).filter(F.col("answer_date") == F.lit(T0.date()))
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(answer_date" in plan
    assert one_day.count() == 10
