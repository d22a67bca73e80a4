"""Practice planning: weak pairs, slots, seeded draws, orders, requests
(J3, J5, W4, L4, L5, A8 on graded sessions, D1, N20).

The draw is exact and never pairs every student with every question of a
topic. Each bank question gets a dense position inside its topic under a
seeded permutation; positions are computed with a small (topic, bucket)
count table and a window per bucket, so even a topic holding most of the
bank is split over many tasks. A (student, topic) target then draws the
``n`` consecutive positions after a seeded start: ``n`` keys per target,
an equi-join on (topic, position), no cartesian product and no cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions.hashing import seeded_int, seeded_key
from ..functions.template import fill


def weak_pairs(graded: DataFrame, threshold: int = C.WEAK_THRESHOLD) -> DataFrame:
    """A1 + P2 over graded sessions: (student, topic) pairs weak by the raw rule."""
    agg = graded.groupBy("student_name", "topic").agg(
        F.count(F.lit(1)).alias("total"), F.sum("is_correct").cast("bigint").alias("correct"))
    return agg.filter(N.weak_raw("correct", "total", threshold))


def practice_slots(weak: DataFrame, per_topic: int = C.QUESTIONS_PER_TOPIC) -> DataFrame:
    """J3 — ``for topic in weak: for _ in range(n)`` as a generator, not a join."""
    return weak.select("student_name", "topic",
                       F.explode(F.sequence(F.lit(1), F.lit(per_topic))).alias("slot"))


def bank_positions(bank: DataFrame, seed: str,
                   bucket_digits: int = C.DEFAULT_CONFIG.position_bucket_digits):
    """Dense 0-based position of every question inside its topic, ordered by
    ``(md5(seed|question_id), question_id)``; returns (positioned bank, topic sizes)."""
    keyed = (bank.withColumn("draw_key", seeded_key(seed, "question_id"))
                 .withColumn("bucket", F.substring("draw_key", 1, bucket_digits)))
    counts = keyed.groupBy("topic", "bucket").agg(F.count(F.lit(1)).alias("n_bucket"))
    # one window pass over the small count table gives both the offset of each
    # bucket and the topic size (at most 16^digits = 65,536 rows per topic; a
    # topic of 10^10 questions still has only ~150k rows per bucket window)
    w = Window.partitionBy("topic").orderBy("bucket")
    offsets = counts.select(
        "topic", "bucket",
        F.coalesce(F.sum("n_bucket").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("n_bucket").over(Window.partitionBy("topic")).cast("bigint").alias("n_topic"))
    # already partitioned by topic: the distinct adds no shuffle
    sizes = offsets.select("topic", "n_topic").distinct()
    offsets = offsets.drop("n_topic")
    within = Window.partitionBy("topic", "bucket").orderBy("draw_key", "question_id")
    positioned = (keyed.join(offsets, ["topic", "bucket"])
                  .withColumn("pos", (F.col("offset") + F.row_number().over(within) - 1).cast("bigint"))
                  .drop("offset", "bucket"))
    return positioned, sizes


def draw(targets: DataFrame, bank: DataFrame, per_topic: int = C.QUESTIONS_PER_TOPIC,
         seed: str = C.QuizConfig.seed,
         bucket_digits: int = C.DEFAULT_CONFIG.position_bucket_digits) -> DataFrame:
    """W4 — ``per_topic`` distinct questions for every (student_name, topic) target
    (fewer only when the topic has fewer questions). Repeatable for a seed."""
    return _picked(targets, *bank_positions(bank, seed, bucket_digits), per_topic, seed)


def store_positions(bank: DataFrame, seed: str, table: str, path: str, buckets: int | None = None) -> None:
    """W4 — the bank's positions under a seed, computed once: the table ``table``,
    bucketed and sorted by (topic, pos), and the topic sizes in ``table``_sizes. Both
    columns are in the bucket key, so a topic that holds most of the bank is in all buckets."""
    positioned, sizes = bank_positions(bank, seed)
    n = buckets or int(bank.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of a bucket meet before they are written: one file a bucket
    (positioned.drop("draw_key").repartition(n, "topic", "pos").write.bucketBy(n, "topic", "pos").sortBy("topic", "pos")
     .option("path", f"{path}/positions").mode("overwrite").saveAsTable(table))
    sizes.coalesce(1).write.option("path", f"{path}/sizes").mode("overwrite").saveAsTable(f"{table}_sizes")  # a row a topic


def draw_stored(targets: DataFrame, table: str, per_topic: int = C.QUESTIONS_PER_TOPIC, seed: str = C.QuizConfig.seed) -> DataFrame:
    """W4 from ``store_positions`` under the same seed: the bank is neither numbered nor
    shuffled again, only the keys of the targets move to its buckets. Equals ``draw``."""
    spark = targets.sparkSession
    return _picked(targets, spark.table(table), spark.table(f"{table}_sizes"), per_topic, seed)


def _picked(targets: DataFrame, positioned: DataFrame, sizes: DataFrame, per_topic: int, seed: str) -> DataFrame:
    t = targets.select("student_name", "topic").join(sizes, "topic")
    start = F.pmod(seeded_int(seed, "student_name", "topic"), F.col("n_topic"))
    picks = t.select(
        "student_name", "topic", "n_topic", start.alias("start"),
        F.explode(F.sequence(F.lit(0).cast("bigint"),
                             F.least(F.lit(per_topic).cast("bigint"), F.col("n_topic")) - 1)).alias("draw_no"))
    picks = picks.withColumn("pos", F.pmod(F.col("start") + F.col("draw_no"), F.col("n_topic")))
    return (picks.join(positioned, ["topic", "pos"])
            .select("student_name", "topic", (F.col("draw_no") + 1).cast("int").alias("slot"),
                    "question_id", "question", "answer", "options", "difficulty", "explanation"))


def quiz_order(drawn: DataFrame, seed: str = C.QuizConfig.seed) -> DataFrame:
    """L4 — topic blocks in seeded random order; a topic's questions stay adjacent."""
    w = Window.partitionBy("student_name").orderBy(seeded_key(seed, "student_name", "topic"), "topic", "slot")
    return drawn.withColumn("question_no", F.row_number().over(w))


def practice_order(drawn: DataFrame, seed: str = C.QuizConfig.seed) -> DataFrame:
    """L5 — full seeded shuffle of a student's practice questions."""
    w = Window.partitionBy("student_name").orderBy(seeded_key(seed, "student_name", "question_id"), "question_id")
    return drawn.withColumn("question_no", F.row_number().over(w))


def practice_candidates(weak: DataFrame, bank: DataFrame) -> DataFrame:
    """J5 — the candidate pool of each weak pair, as a count per (student, topic)
    (the bank is aggregated per topic first; pairs are never materialised)."""
    sizes = bank.groupBy("topic").agg(F.count(F.lit(1)).alias("n_candidates"))
    return weak.select("student_name", "topic").join(sizes, "topic", "left").select(
        "student_name", "topic", F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"))


def weak_for_anyone(bank: DataFrame, weak: DataFrame) -> DataFrame:
    """J5 (semi) — bank questions whose topic is weak for at least one student.
    The weak side is first reduced to its distinct topics (a partial aggregate),
    so the semi-join build side is as small as the topic list."""
    return bank.join(weak.select("topic").distinct(), "topic", "left_semi")


def _instruction(difficulty_col, long: bool) -> F.Column:
    table = C.DIFFICULTY_INSTRUCTIONS_LONG if long else C.DIFFICULTY_INSTRUCTIONS_SHORT
    m = F.create_map(*[x for lvl in C.DIFFICULTY_LEVELS for x in (F.lit(lvl), F.lit(table[lvl]))])
    return F.coalesce(F.element_at(m, difficulty_col), F.lit(table[C.DEFAULT_DIFFICULTY]))


def seeded_template() -> str:
    return C.PROMPT_TEMPLATE_SEEDED


def plain_template() -> str:
    return C.PROMPT_TEMPLATE


def plain_prompts(asked: DataFrame) -> DataFrame:
    """D1 — the unseeded prompt for each (topic, difficulty) asked for; an unknown level
    gets the beginner's instruction and keeps its own name in the text."""
    prompt = fill(plain_template(), topic=F.col("topic"), difficulty=F.col("difficulty"),
                  diff_instruction=_instruction(F.col("difficulty"), long=True))
    return asked.select("topic", "difficulty", prompt.alias("prompt"))


def practice_requests(slots: DataFrame, difficulty: str = C.DEFAULT_DIFFICULTY,
                      seed: str = C.QuizConfig.seed, template: str = "seeded") -> DataFrame:
    """D1 + N20 — one generation request per (student, weak topic, slot) with its prompt."""
    diff = F.lit(difficulty)
    seed_hint = (F.lit(C.SEED_HINT_MIN)
                 + F.pmod(seeded_int(seed, "student_name", "topic", "slot"),
                          F.lit(C.SEED_HINT_MAX - C.SEED_HINT_MIN + 1))).cast("bigint")
    out = slots.withColumn("difficulty", diff).withColumn("seed_hint", seed_hint)
    if template == "seeded":
        prompt = fill(seeded_template(), topic=F.col("topic"), difficulty=F.col("difficulty"),
                      diff_instruction=_instruction(F.col("difficulty"), long=False),
                      seed_hint=F.col("seed_hint"))
    else:
        prompt = fill(plain_template(), topic=F.col("topic"), difficulty=F.col("difficulty"),
                      diff_instruction=_instruction(F.col("difficulty"), long=True))
    return out.withColumn("prompt", prompt)
