"""Structured Streaming operators (T1-T3): two rounds on one checkpoint."""

import datetime as dt


from quizlake.operators import accuracy as A
from quizlake.operators import sessions as SE
from quizlake.schemas import ANSWER_SCHEMA
from quizlake.sources import answer_log
from quizlake.sources import standins as S
from quizlake.streaming import streams as ST

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)
SF = "/root/testdata/sf0.001"


def _answers(spark, ids, student="ana"):
    return spark.createDataFrame([(i, student, "lists", f"q{i}", i % 2, "beginner", T0) for i in ids], ANSWER_SCHEMA)


def test_append_stream_exactly_once(spark, scratch):
    base = scratch("t2")
    _answers(spark, range(5)).write.parquet(f"{base}/in", mode="append")
    ST.answer_append_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    _answers(spark, range(5, 8)).write.parquet(f"{base}/in", mode="append")
    ST.answer_append_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    ST.answer_append_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")  # restart, no new data
    ids = sorted(r.id for r in spark.read.parquet(f"{base}/out").collect())
    assert ids == list(range(8))


def test_topic_accuracy_stream_equals_batch(spark, scratch):
    base = scratch("t3")
    ans = S.answers(spark, SF)
    ans.filter("id < 500").write.parquet(f"{base}/in")
    ST.topic_accuracy_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    ans.filter("id >= 500").write.mode("append").parquet(f"{base}/in")
    ST.topic_accuracy_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    snap = ST.topic_accuracy_snapshot(spark, f"{base}/out")
    batch = A.topic_breakdown(ans)
    assert snap.exceptAll(batch).count() == 0 and batch.exceptAll(snap).count() == 0


def test_timed_answers_stream_equals_batch_after_flush(spark, scratch):
    base = scratch("t1")
    shown = spark.createDataFrame([
        (1, 10, T0, "A"),                              # answered after 0 s
        (2, 10, T0, "B"),                              # answered after 19.999999 s
        (3, 10, T0, "C"),                              # answered at exactly 20 s -> late
        (4, 10, T0, "D"),                              # never answered
    ], ST.SHOWN_SCHEMA)
    answered = spark.createDataFrame([
        (1, T0 + dt.timedelta(seconds=5), "B"),        # a second answer does not count
        (1, T0, "A"), (1, T0, "A"),                    # duplicate delivery
        (2, T0 + dt.timedelta(seconds=40), "B"),       # a late click that may arrive first
        (2, T0 + dt.timedelta(seconds=19.999999), "A"),
        (3, T0 + dt.timedelta(seconds=20), "C"),
    ], ST.ANSWERED_SCHEMA)
    shown.write.parquet(f"{base}/shown")
    answered.write.parquet(f"{base}/answered")
    ST.timed_answer_stream(spark, f"{base}/shown", f"{base}/answered", f"{base}/out", f"{base}/ckpt")
    first = spark.read.parquet(f"{base}/out").collect() if _exists(spark, f"{base}/out") else []
    assert {r.qid for r in first if r.answered_at is None} == set()  # waits for the watermark
    far = dt.datetime(2999, 1, 1)
    spark.createDataFrame([(-1, -1, far, None)], ST.SHOWN_SCHEMA).write.mode("append").parquet(f"{base}/shown")
    spark.createDataFrame([(-1, far, None)], ST.ANSWERED_SCHEMA).write.mode("append").parquet(f"{base}/answered")
    ST.timed_answer_stream(spark, f"{base}/shown", f"{base}/answered", f"{base}/out", f"{base}/ckpt")
    out = {r.qid: r for r in ST.timed_answer_snapshot(spark, f"{base}/out").filter("qid >= 0").collect()}
    assert {q: out[q].status for q in out} == {1: "answered", 2: "answered", 3: "timed_out", 4: "timed_out"}
    assert out[1].is_correct == 1 and out[2].is_correct == 0 and out[3].selected is None
    batch = {r.qid: r.status for r in SE.timed_answers(shown, answered).collect()}
    assert batch == {q: out[q].status for q in out}
    # a question shown behind the watermark is in no output; the snapshot settles it from the input
    spark.createDataFrame([(9, 10, T0, "A")], ST.SHOWN_SCHEMA).write.mode("append").parquet(f"{base}/shown")
    spark.createDataFrame([(9, T0 + dt.timedelta(seconds=1), "A")], ST.ANSWERED_SCHEMA).write.mode("append").parquet(f"{base}/answered")
    ST.timed_answer_stream(spark, f"{base}/shown", f"{base}/answered", f"{base}/out", f"{base}/ckpt")
    whole = {r.qid: r.status for r in ST.timed_answer_snapshot(
        spark, f"{base}/out", f"{base}/shown", f"{base}/answered").filter("qid >= 0").collect()}
    assert whole == batch | {9: "answered"}


def test_stream_and_batch_share_a_folder_and_replays_add_nothing(spark, scratch):
    base = scratch("t2-mixed")
    _answers(spark, [1]).write.parquet(f"{base}/in")
    ST.answer_append_stream(spark, f"{base}/in", f"{base}/log", f"{base}/ckpt")
    answer_log.append(_answers(spark, [2]), f"{base}/log")
    assert sorted(r.id for r in answer_log.scan(spark, f"{base}/log").collect()) == [1, 2]
    rows = _answers(spark, [3, 4]).drop("id")  # a batch that failed after its write, run again
    for _ in range(3):
        answer_log.append(rows, f"{base}/log", batch="some-stream-7")
    assert sorted(r.id for r in answer_log.scan(spark, f"{base}/log").collect()) == [1, 2, 3, 4]
    # the stream itself: forget the commit of its batch, so that it runs the batch again
    import os
    folder = f"{base}/ckpt/commits".removeprefix("file:")
    for name in os.listdir(folder):
        if name.lstrip(".").startswith("0"):
            os.remove(os.path.join(folder, name))
    q = ST.answer_append_stream(spark, f"{base}/in", f"{base}/log", f"{base}/ckpt")
    assert q.lastProgress.numInputRows >= 1  # it did run again
    assert sorted(r.id for r in answer_log.scan(spark, f"{base}/log").collect()) == [1, 2, 3, 4]


def test_accuracy_log_is_compacted(spark, scratch):
    base = scratch("t3-compact")
    sink = f"{base}/out"
    for k in range(5):
        _answers(spark, range(10 * k, 10 * k + 10), f"s{k % 2}").write.mode("append").parquet(f"{base}/in")
        ST.topic_accuracy_stream(spark, f"{base}/in", sink, f"{base}/ckpt", state_partitions=2)
        want = {(r.student_name, r.total, r.correct) for r in ST.topic_accuracy_snapshot(spark, sink).collect()}
        before = ST.topic_accuracy_snapshot(spark, sink)  # a reader from before the switch
        if k in (1, 3, 4):
            assert ST.compact_topic_accuracy(spark, sink) == ST.compact_topic_accuracy(spark, sink)
        for df in (before, ST.topic_accuracy_snapshot(spark, sink)):
            assert {(r.student_name, r.total, r.correct) for r in df.collect()} == want
    assert want == {("s0", 30, 15), ("s1", 20, 10)}
    done = ST._versions(spark, sink)
    assert len(done) == 2 and len(ST._batches(spark, sink)) < 5  # the last snapshot and the one before it
    assert spark.read.parquet(f"{sink}/snapshot/upto={done[-1]}").count() == 2  # a row a key
    files = ST.topic_accuracy_snapshot(spark, sink).inputFiles()
    assert files and all("/snapshot/" in f for f in files)  # the snapshot alone is read
    # a compaction that broke off before its marker changes nothing and is done again
    ST._delete(spark, f"{sink}/_versions/{done[-1]:020d}")
    assert {(r.student_name, r.total, r.correct) for r in ST.topic_accuracy_snapshot(spark, sink).collect()} == want
    assert ST.compact_topic_accuracy(spark, sink) == done[-1]


def _settled(shown, clicks, mark):
    """J6 in plain Python over the input so far, without the open questions."""
    out = {}
    for qid, _, at, correct in shown:
        good = sorted((t, s) for q, t, s in clicks if q == qid and at <= t < at + dt.timedelta(seconds=20))
        if good:
            out[qid] = ("answered", good[0][1], int(good[0][1] == correct))
        elif at + dt.timedelta(seconds=20) <= mark:
            out[qid] = ("timed_out", None, 0)
    return out


def test_timed_answers_at_every_watermark(spark, scratch):
    """Open questions are not reported, late questions and late answers are."""
    base, at = scratch("t1-rounds"), lambda s: T0 + dt.timedelta(seconds=s)
    rounds = [
        ([(1, 10, at(0), "A"), (2, 10, at(50), "B")], [(1, at(5), "A"), (1, at(2), "B")]),
        ([(3, 10, at(200), "A"), (4, 10, at(201), "A")], [(4, at(230), "A"), (2, at(200), "B")]),  # 2 has timed out
        ([(5, 10, at(1), "C"), (6, 10, at(3), "C")], [(2, at(60), "B"), (5, at(4), "C")]),  # all behind the watermark
        ([(7, 10, at(900), "D")], [(1, at(1), "A"), (7, at(901), "D"), (3, at(210), "A")]),
        ([(8, 10, at(2000), "D")], [(99, at(2001), "D")]),
    ]
    shown, clicks, seen_open = [], [], False
    for s, c in rounds:
        spark.createDataFrame(s, ST.SHOWN_SCHEMA).write.mode("append").parquet(f"{base}/shown")
        spark.createDataFrame(c, ST.ANSWERED_SCHEMA).write.mode("append").parquet(f"{base}/answered")
        shown, clicks = shown + s, clicks + c
        ST.timed_answer_stream(spark, f"{base}/shown", f"{base}/answered", f"{base}/out", f"{base}/ckpt")
        mark = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ST.stored_watermark(spark, f"{base}/out") or -1)
        got = {r.qid: (r.status, r.selected, r.is_correct) for r in ST.timed_answer_snapshot(
            spark, f"{base}/out", f"{base}/shown", f"{base}/answered").collect()}
        assert got == _settled(shown, clicks, mark)
        seen_open |= len(got) < len(shown)
    assert seen_open and got[2] == ("answered", "B", 1) and got[5][0] == "answered" and got[6][0] == "timed_out" and 8 not in got


def _exists(spark, path):
    try:
        spark.read.parquet(path)
        return True
    except Exception:  # noqa: BLE001
        return False
