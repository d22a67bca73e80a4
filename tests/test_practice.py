"""The seeded draw against a brute-force model, and its properties."""

import hashlib

from pyspark.sql import functions as F

from quizlake import config as C
from quizlake.operators import practice as P

SEED = "t-seed"


def _bank(spark, sizes):
    rows, qid = [], 0
    for topic, n in sizes.items():
        for _ in range(n):
            rows.append((qid, topic, f"question {qid}", "A", {"A": "a", "B": "b", "C": "c", "D": "d"},
                         "beginner", None))
            qid += 7  # sparse ids
    return spark.createDataFrame(rows, "question_id long, topic string, question string, answer string, "
                                       "options map<string,string>, difficulty string, explanation string")


def _md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def brute_force(targets, bank_rows, n, seed):
    """All candidate pairs, per-topic permutation, window of n after the start."""
    by_topic = {}
    for qid, topic in bank_rows:
        by_topic.setdefault(topic, []).append(qid)
    perm = {t: sorted(q, key=lambda x: (_md5(seed, x), x)) for t, q in by_topic.items()}
    out = set()
    for student, topic in targets:
        if topic not in perm:
            continue
        qs = perm[topic]
        start = int(_md5(seed, student, topic)[:15], 16) % len(qs)
        for j in range(min(n, len(qs))):
            out.add((student, topic, j + 1, qs[(start + j) % len(qs)]))
    return out


def test_draw_matches_brute_force(spark):
    sizes = {"lists": 1, "numpy": 3, "functions": 50, "data_types": 600}
    bank = _bank(spark, sizes)
    targets = [(f"s{i}", t) for i in range(40) for t in sizes] + [("s1", "missing_topic")]
    tdf = spark.createDataFrame(targets, "student_name string, topic string")
    got = {(r.student_name, r.topic, r.slot, r.question_id)
           for r in P.draw(tdf, bank, 2, SEED).collect()}
    bank_rows = [(r.question_id, r.topic) for r in bank.collect()]
    assert got == brute_force(targets, bank_rows, 2, SEED)


def test_draw_properties(spark):
    bank = _bank(spark, {"lists": 30, "numpy": 1})
    targets = spark.createDataFrame([(f"s{i}", t) for i in range(25) for t in ("lists", "numpy")],
                                    "student_name string, topic string")
    a = P.draw(targets, bank, 3, SEED)
    per = a.groupBy("student_name", "topic").agg(F.count("*").alias("n"),
                                                 F.countDistinct("question_id").alias("d")).collect()
    for r in per:
        assert r.n == r.d  # distinct questions
        assert r.n == (3 if r.topic == "lists" else 1)  # capped only by the topic size
    # unchanged under repartition of the inputs
    b = P.draw(targets.repartition(7), bank.repartition(5), 3, SEED)
    assert sorted(a.collect()) == sorted(b.collect())


def test_positions_are_dense(spark):
    bank = _bank(spark, {"big": 5000, "small": 3})
    pos, sizes = P.bank_positions(bank, SEED, bucket_digits=2)
    chk = pos.groupBy("topic").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                                   F.countDistinct("pos").alias("d"), F.count("*").alias("n")).collect()
    for r in chk:
        assert r.lo == 0 and r.hi == r.n - 1 and r.d == r.n


def test_orders_and_slots(spark):
    bank = _bank(spark, {"lists": 10, "numpy": 10})
    weak = spark.createDataFrame([("s1", "lists"), ("s1", "numpy"), ("s2", "numpy")],
                                 "student_name string, topic string")
    slots = P.practice_slots(weak, C.QUESTIONS_PER_TOPIC).collect()
    assert len(slots) == 6 and {r.slot for r in slots} == {1, 2}
    drawn = P.draw(weak, bank, 2, SEED)
    qo = P.quiz_order(drawn, SEED).filter("student_name = 's1'").orderBy("question_no").collect()
    topics = [r.topic for r in qo]
    assert topics[0] == topics[1] and topics[2] == topics[3]  # blocks stay together
    po = P.practice_order(drawn, SEED).collect()
    assert sorted(r.question_no for r in po if r.student_name == "s1") == [1, 2, 3, 4]
    cands = {(r.student_name, r.topic): r.n_candidates for r in P.practice_candidates(weak, bank).collect()}
    assert cands[("s2", "numpy")] == 10
    assert P.weak_for_anyone(bank, weak).count() == 20


def test_prompts(spark):
    slots = spark.createDataFrame([("s1", "lists", 1), ("s1", "lists", 2)], "student_name string, topic string, slot int")
    reqs = P.practice_requests(slots, "advanced", SEED).collect()
    for r in reqs:
        assert C.SEED_HINT_MIN <= r.seed_hint <= C.SEED_HINT_MAX
        expected = P.seeded_template().format(topic="lists", difficulty="advanced",
                                              diff_instruction=C.DIFFICULTY_INSTRUCTIONS_SHORT["advanced"],
                                              seed_hint=r.seed_hint)
        assert r.prompt == expected
        assert "seed-" in r.prompt and '"answer": "A"\n}' in r.prompt
    plain = P.practice_requests(slots, "unknown-level", SEED, template="plain").collect()[0].prompt
    assert C.DIFFICULTY_INSTRUCTIONS_LONG["beginner"] in plain  # unknown level falls back
    assert plain.endswith("learning Python.")


def test_stored_positions_draw_the_same_without_numbering_again(spark, scratch):
    from quizlake.sources import standins as S
    sf = "/root/testdata/sf0.001"
    bank = S.bank(spark, sf)
    targets = spark.range(40).select(F.concat(F.lit("s"), F.col("id")).alias("student_name")).crossJoin(bank.select("topic").distinct().limit(5))
    table = "stored_positions"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"DROP TABLE IF EXISTS {table}_sizes")
    P.store_positions(bank, "seed", table, scratch("positions"), buckets=4)
    cols = ["student_name", "topic", "slot", "question_id"]
    stored = P.draw_stored(targets, table, 3, "seed").select(*cols)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, P.draw(targets, bank, 3, "seed").select(*cols).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = P.draw_stored(targets, table, 3, "seed").select(*cols)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("SortMergeJoin [topic"):]
    assert "Window" not in plan and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan and side
    for t in (table, f"{table}_sizes"):
        spark.sql(f"DROP TABLE {t}")
