"""Scalar functions against Python's own behaviour."""

import pytest
from pyspark.sql import functions as F

from quizlake.functions import numeric as N
from quizlake.functions import text as X

STRIP_CORPUS = [" Alex", "Alex\t", "", "alex", "  \n b \r\n", " x　", "\x1cy\x1f", "x​",
                "a very long student name", " z ", "\x85w"]


def test_py_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in STRIP_CORPUS], "s string")
    got = [r.t for r in df.select(X.py_strip("s").alias("t")).collect()]
    assert got == [s.strip() for s in STRIP_CORPUS]


def test_normalise_letter(spark):
    df = spark.createDataFrame([(" b\t",), ("x",), ("C",)], "s string")
    got = [r.t for r in df.select(X.normalise_letter("s").alias("t")).collect()]
    assert got == ["B", "X", "C"]


def test_pad_and_preview(spark):
    df = spark.createDataFrame([("Al",), ("x" * 17,)], "s string")
    got = df.select(X.pad_right("s", 15).alias("p"), X.preview("s", 5).alias("v")).collect()
    assert got[0].p == f"{'Al':15s}" and got[1].p == f"{'x' * 17:15s}"
    assert got[0].v == "Al..." and got[1].v == "xxxxx..."


@pytest.mark.parametrize("score,total,band,text", [
    (10, 10, 0, "10/10 (100%)"), (8, 10, 1, "8/10 (80%)"), (799, 1000, 2, "799/1000 (80%)"),
    (6, 10, 2, "6/10 (60%)"), (599, 1000, 3, "599/1000 (60%)"), (1, 8, 3, "1/8 (12%)"), (0, 0, 3, "0/0 (0%)"),
])
def test_bands_and_score_text(spark, score, total, band, text):
    df = spark.createDataFrame([(score, total)], "score bigint, total bigint")
    pct = N.pct_guarded("score", "total")
    r = df.select(N.score_band("score", "total").alias("b"),
                  F.concat(F.col("score").cast("string"), F.lit("/"), F.col("total").cast("string"),
                           F.lit(" ("), N.whole_percent_text(pct), F.lit("%)")).alias("t")).collect()[0]
    py_pct = (score / total) * 100 if total else 0
    assert r.t == f"{score}/{total} ({py_pct:.0f}%)" == text
    assert r.b == band


def test_rounding_regimes_sweep(spark):
    pairs = [(c, t) for t in range(1, 121) for c in range(0, t + 1)]
    df = spark.createDataFrame(pairs, "c bigint, t bigint")
    got = df.select("c", "t", N.pct_python("c", "t").alias("py"), N.pct_sql("c", "t").alias("sql")).collect()
    for r in got:
        assert r.py == round((r.c / r.t) * 100, 1)
    one16 = [r for r in got if (r.c, r.t) == (1, 16)][0]
    assert (one16.sql, one16.py) == (6.3, 6.2)


def test_weak_raw_matches_float_rule(spark):
    pairs = [(c, t) for t in range(1, 201) for c in range(0, t + 1)]
    df = spark.createDataFrame(pairs, "c bigint, t bigint")
    for r in df.select("c", "t", N.weak_raw("c", "t").alias("w")).collect():
        assert r.w == ((r.c / r.t) * 100 < 70)


@pytest.mark.parametrize("elapsed,left,cls", [
    (0.0, 20.0, "timer-normal"), (9.5, 10.5, "timer-normal"), (10.0, 10.0, "timer-warning"),
    (15.0, 5.0, "timer-critical"), (19.999999, 0.000001, "timer-critical"), (25.0, 0.0, "timer-critical"),
])
def test_timer(spark, elapsed, left, cls):
    df = spark.createDataFrame([(elapsed,)], "e double")
    r = df.select(N.seconds_left("e").alias("l"), N.timer_class(N.seconds_left("e")).alias("c")).collect()[0]
    assert abs(r.l - max(0, 20 - elapsed)) < 1e-9 and abs(r.l - left) < 1e-6
    assert r.c == cls


def test_bar_and_symbols(spark):
    df = spark.createDataFrame([(73.4, None, 1), (100.0, "B", 0)], "p double, s string, k int")
    got = df.select(X.text_bar("p").alias("b"), X.selected_symbol("s").alias("y"),
                    X.correct_icon("k").alias("i")).collect()
    assert got[0].b == "█" * 7 + "░" * 3 and got[1].b == "█" * 10
    assert got[0].y == "⏰" and got[1].y == "B"
    assert got[0].i == "✅" and got[1].i == "❌"


def test_clamp():
    assert [N.clamp_value(x) for x in (-5, 0, 1, 10, 50, 51, 1000)] == [1, 1, 1, 10, 50, 50, 50]
