"""Numbering block by block equals the plain window, whatever the blocks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quizlake.operators import ordered as O
from quizlake.operators import sessions as SE
from quizlake.sources import standins as S

SF = "/root/testdata/sf0.001"
COLS = ("session_id", "k1", "k2", "v", "_rn", "_cum", "_size")


def _rows(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def _plain(df):
    w = Window.partitionBy("session_id").orderBy("k1", "k2")
    return (df.withColumn("_rn", F.row_number().over(w).cast("bigint"))
            .withColumn("_cum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("session_id"))))


@pytest.mark.parametrize("width, whole", [(1, 0), (7, 100), (100, 0), (10**9, 55), (100, 10**9)])
def test_equals_the_plain_window_for_every_block_width(spark, width, whole):
    hot = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.lit(1)).alias("session_id"), (F.col("id") % 17).alias("k1"),
                                   F.col("id").alias("k2"), (F.col("id") % 3 == 0).cast("int").alias("v"))  # 60 rows without a group
    cold = spark.range(500).select((F.col("id") % 50 + 2).alias("session_id"), (F.col("id") % 5).alias("k1"),
                                   F.col("id").alias("k2"), (F.col("id") % 2).cast("int").alias("v"))
    # a session in which every slot is used once, and one with columns named like the helper's own
    unique = spark.range(900).select(F.lit(99).cast("bigint").alias("session_id"), F.col("id").alias("k1"), (F.col("id") * 7919 % 1000).alias("k2"),
                                     (F.col("id") % 5 == 0).cast("int").alias("v"))
    df = hot.unionByName(cold).unionByName(unique).repartition(6).withColumn("g", F.lit("x")).withColumn("b0", F.lit(1)).withColumn("size", F.lit(2))
    got = O.ordered_prefix(df, "session_id", ["k1", "k2"], "v", [F.struct("k1", F.floor(F.col("k2") / width)), F.floor(F.col("k1") / 3)], whole_rows=whole)
    assert _rows(got) == _rows(_plain(df))


def test_sessions_do_not_depend_on_the_block_width(spark, monkeypatch):
    graded = SE.graded_responses(S.responses(spark, SF), S.bank(spark, SF))
    order = [*SE.ORDER, "supplier_key", "quantity", "price"]
    seen = []
    for width in (1, 50, 65_536):
        monkeypatch.setattr(O, "WHOLE_ROWS", width // 25)
        monkeypatch.setattr(SE, "BLOCK_KEYS", width)
        monkeypatch.setattr(SE, "BLOCK_SLOTS", max(1, width // 25))
        out = SE.running_score(graded, order).select("session_id", "question_id", "question_no", "score_before")
        seen.append(sorted(map(tuple, out.collect())))
    assert seen[0] == seen[1] == seen[2]


def test_a_session_of_distinct_slots_is_spread_and_graded_once(spark):
    """A million rows of one session, each in a slot of its own: no window holds more than
    a block of them, and the grading join runs a single time."""
    n = 1_000_000
    graded = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("slot"), (F.col("id") * 31 % n).alias("question_id"),
                                   (F.col("id") % 4 == 0).cast("int").alias("is_correct"))
    calls = spark.sparkContext.accumulator(0)
    counted = graded.rdd.map(lambda r: (calls.add(1), r)[1]).toDF(graded.schema)
    out = SE.running_score(counted)
    row = out.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("question_no") - 1 - F.col("slot"))).alias("off"),
                  F.sum(F.abs(F.col("score_feedback") - F.floor(F.col("slot") / 4) - 1)).alias("wrong"), F.countDistinct("question_no").alias("d")).first()
    assert (row.n, row.off, row.wrong, row.d) == (n, 0, 0, n)
    assert calls.value == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small here, so AQE would put the parts together
    spread = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 8 and max(r["count"] for r in spread) < n / 4
