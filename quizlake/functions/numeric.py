"""Percentages, rounding regimes, predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import col_


def _hundred() -> Column:
    return F.lit(100.0)  # a DOUBLE literal; 100.0 in SQL text would be DECIMAL


def pct_sql(correct, total) -> Column:
    """N3 — ``ROUND(SUM(is_correct) * 100.0 / COUNT(*), 1)`` (half away from zero)."""
    return F.round(col_(correct).cast("double") * _hundred() / col_(total), 1)


def pct_raw(correct, total) -> Column:
    """N10 — ``(correct / total) * 100`` unrounded."""
    return col_(correct).cast("double") / col_(total) * _hundred()


def pct_python(correct, total, digits: int = 1) -> Column:
    """N4 — Python ``round((correct / total) * 100, 1)`` (half to even)."""
    return F.bround(pct_raw(correct, total), digits)


def pct_guarded(score, total) -> Column:
    """A9 — session percent, 0 when a session has no question (ANSI division)."""
    return F.when(col_(total) > 0, pct_raw(score, total)).otherwise(F.lit(0.0))


def weak_raw(correct, total, threshold: int = C.WEAK_THRESHOLD) -> Column:
    """P2 — ``(correct/total)*100 < threshold`` evaluated exactly in integers."""
    return col_(correct) * 100 < col_(total) * threshold


def weak_rounded(pct, threshold: int = C.WEAK_THRESHOLD) -> Column:
    """P3 — ``HAVING pct < threshold`` on the one-decimal value."""
    return col_(pct) < F.lit(float(threshold))


def status_label(pct, threshold: int = C.WEAK_THRESHOLD) -> Column:
    """P5 — OK at or above the threshold, else WEAK."""
    return F.when(col_(pct) >= F.lit(float(threshold)), F.lit(C.STATUS_OK)).otherwise(F.lit(C.STATUS_WEAK))


def badge(pct, threshold: int = C.WEAK_THRESHOLD) -> Column:
    """P6 — perfect / ok / warn."""
    p = col_(pct)
    return (F.when(p == F.lit(100.0), F.lit(C.BADGE_PERFECT))
            .when(p >= F.lit(float(threshold)), F.lit(C.BADGE_OK))
            .otherwise(F.lit(C.BADGE_WARN)))


def score_band(score, total) -> Column:
    """P7 — band index 0..3 on the unrounded percent, in exact integers.

    0 = perfect (100 %), 1 = >= 80 %, 2 = >= 60 %, 3 = below. A session with
    no question has percent 0 and falls in band 3.
    """
    s, t = col_(score), col_(total)
    return (F.when((t > 0) & (s == t), F.lit(0))
            .when((t > 0) & (s * 100 >= t * 80), F.lit(1))
            .when((t > 0) & (s * 100 >= t * 60), F.lit(2))
            .otherwise(F.lit(3)))


def band_message(band) -> Column:
    msgs = F.array(*[F.lit(m) for m in C.BAND_MESSAGES])
    return F.element_at(msgs, col_(band) + 1)


def whole_percent_text(pct) -> Column:
    """N5 — ``f"{pct:.0f}"``: Python rounds half to even."""
    return F.bround(col_(pct), 0).cast("bigint").cast("string")


def clamp(x, lo: int, hi: int) -> Column:
    """P11 — ``max(lo, min(x, hi))`` as a column."""
    return F.greatest(F.lit(lo), F.least(col_(x), F.lit(hi)))


def clamp_value(x: int, lo: int = C.RECENT_LIMIT_MIN, hi: int = C.RECENT_LIMIT_MAX) -> int:
    """P11 on the driver-side scalar parameter."""
    return max(lo, min(int(x), hi))


def seconds_left(elapsed, deadline: int = C.ANSWER_DEADLINE_SECONDS) -> Column:
    """N11 — ``max(0, deadline - elapsed)``."""
    return F.greatest(F.lit(0.0), F.lit(float(deadline)) - col_(elapsed))


def timer_class(left) -> Column:
    """N12 — > 10 s normal, > 5 s warning, else critical."""
    x = col_(left)
    return (F.when(x > F.lit(float(C.TIMER_NORMAL_ABOVE)), F.lit(C.TIMER_CLASSES[0]))
            .when(x > F.lit(float(C.TIMER_WARNING_ABOVE)), F.lit(C.TIMER_CLASSES[1]))
            .otherwise(F.lit(C.TIMER_CLASSES[2])))
