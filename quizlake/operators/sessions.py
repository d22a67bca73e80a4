"""Sessions: grading, scores, numbering, running score, deadlines
(J1, J2, J6, A9, P7-P9, W1-W3, W5, N5, N8, N11-N12, N15-N18, N22-N23).

Ordered operators are partitioned by session, never global. A session is
normally one quiz (a few dozen questions); ``ordered.ordered_prefix`` numbers
it block by block, so that no session has to fit one task, neither one of many
slots nor one of many rows in a slot. They read the graded rows twice, so these
are staged once: the grading join runs a single time. They stage the columns they
are given, so select the needed ones first.
Grading joins the bank by key and leaves the strategy to AQE (broadcast when
the bank is below the broadcast threshold at run time, otherwise sort-merge
with skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions.text import (correct_icon, levels_array, normalise_letter, preview, py_strip,
                              selected_symbol)
from ..session import stage
from .ordered import ordered_prefix

ORDER = ["slot", "question_id"]
BLOCK_KEYS, BLOCK_SLOTS = 65_536, 4_096  # question keys and slots a block; any values give the same result


def normalise_responses(responses: DataFrame) -> DataFrame:
    """N1+N2+P8 — ``strip().upper()`` and validity of the chosen letter."""
    sel = normalise_letter("selected_raw")
    return (responses.withColumn("selected", sel)
            .withColumn("is_valid", F.coalesce(F.col("selected").isin(*C.LETTERS), F.lit(False))))


def valid_responses(responses: DataFrame) -> DataFrame:
    """P8 — responses whose letter is one of A-D (the others are never stored)."""
    return normalise_responses(responses).filter(F.col("is_valid")).drop("is_valid")


def rejected_responses(responses: DataFrame) -> DataFrame:
    """P8 reject output — invalid letters with the raw input kept."""
    return (normalise_responses(responses).filter(~F.col("is_valid"))
            .select("session_id", "student_name", "question_id", "slot", "selected_raw", "selected",
                    F.lit("invalid_letter").alias("reason")))


def all_rejects(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """Every response that is not graded, with the reason: with ``graded_responses`` the
    whole input. One pass: a branch for each reason would read and join the responses anew."""
    known = bank.select("question_id").distinct().withColumn("is_known", F.lit(True))
    reason = (F.when(~F.col("is_valid"), F.lit("invalid_letter"))
              .when(F.col("is_known").isNull(), F.lit("unknown_question")))
    return (normalise_responses(responses).join(known, "question_id", "left").withColumn("reason", reason)
            .filter(F.col("reason").isNotNull())
            .select("session_id", "student_name", "question_id", "slot", "selected_raw", "selected", "reason"))


def unknown_questions(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """J1 reject output — valid letters for a question that the bank does not hold."""
    return all_rejects(responses, bank).filter(F.col("reason") == "unknown_question")


def graded_responses(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """J1 — join the bank by key and compare the chosen letter with the answer."""
    b = bank.select("question_id", "topic", F.col("question").alias("question_text"),
                    "answer", "difficulty")
    g = valid_responses(responses).join(b, "question_id", "inner")
    return g.withColumn("is_correct", (F.col("selected") == F.col("answer")).cast("int"))


def session_scores(graded: DataFrame) -> DataFrame:
    """A9 + P7 + N5 + N23 — score, total, percent, band and score text per session."""
    s = graded.groupBy("session_id", "student_name").agg(
        F.sum("is_correct").cast("bigint").alias("score"),
        F.count(F.lit(1)).alias("total"))
    pct = N.pct_guarded("score", "total")
    band = N.score_band("score", "total")
    return s.select(
        "session_id", "student_name", "score", "total",
        F.round(pct, 6).alias("pct"),
        band.alias("band"),
        N.band_message(band).alias("message"),
        F.concat(F.col("score").cast("string"), F.lit("/"), F.col("total").cast("string"),
                 F.lit(" ("), N.whole_percent_text(pct), F.lit("%)")).alias("score_text"),
    )


def _numbered(graded: DataFrame, order, **names) -> DataFrame:
    order = list(order)
    slot = F.col(order[0])
    fine = F.struct(slot, *(F.floor(F.col(c) / BLOCK_KEYS) for c in order[1:2]))
    return ordered_prefix(stage(graded, "graded"), "session_id", order, "is_correct", [fine, F.floor(slot / BLOCK_SLOTS)], **names)


def question_numbers(graded: DataFrame, order=ORDER) -> DataFrame:
    """W1 — ``enumerate(start=1)`` within a session (a session of any size is
    numbered block by block, see ordered.py). ``order`` is the slot and a numeric
    question key, then any tie-breaks."""
    return _numbered(graded, order, number="question_no").drop("_cum", "_size")


def running_score(graded: DataFrame, order=ORDER) -> DataFrame:
    """W2 — correct answers before question k, and the feedback-mode numerator
    (which already counts question k while the denominator stays k-1)."""
    out = (_numbered(graded, order, number="question_no", running="score_feedback").drop("_size")
           .withColumn("score_before", F.col("score_feedback") - F.col("is_correct")))
    return out.withColumn("badge", F.concat(
        F.lit("⭐ "), F.col("score_before").cast("string"), F.lit("/"),
        (F.col("question_no") - 1).cast("string")))


def session_progress(graded: DataFrame, order=ORDER) -> DataFrame:
    """W3 — ``q_num / total`` for the progress bar; the session size comes with the numbers."""
    return (_numbered(graded, order, number="question_no", size="n_questions").drop("_cum")
            .withColumn("progress", F.round(F.col("question_no") / F.col("n_questions"), 6)))


def last_answer(graded: DataFrame, order=ORDER) -> DataFrame:
    """W5 — ``answers[-1]``: an aggregate (max_by), so no window and partial-aggregable."""
    key = F.struct(*order)
    return graded.groupBy("session_id").agg(
        F.max_by(F.struct("question_id", "selected", "answer", "is_correct"), key).alias("last"))\
        .select("session_id", "last.*")


def answer_review(graded: DataFrame, keep=("session_id", "question_id", "slot")) -> DataFrame:
    """N8 + N18 — one review line per answer, with the columns of ``keep``."""
    line = F.concat(correct_icon("is_correct"), F.lit(" "), F.col("topic"), F.lit(" — "),
                    preview("question_text"), F.lit(" → You answered: "), selected_symbol("selected"))
    return graded.select(*keep, line.alias("line"))


# ---------------------------------------------------------------- deadlines

def deadline_of(shown_col: str, deadline: int) -> F.Column:
    return F.col(shown_col) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(deadline))


def on_time_clicks(shown: DataFrame, answered: DataFrame, deadline: int = C.ANSWER_DEADLINE_SECONDS, how: str = "inner") -> DataFrame:
    """The columns of ``shown`` with each ``click`` (answered_at, selected) within the deadline."""
    a = answered.select(F.col("qid").alias("a_qid"), F.struct("answered_at", "selected").alias("click"))
    on_time = ((F.col("qid") == F.col("a_qid")) & (F.col("click.answered_at") >= F.col("shown_at"))
               & (F.col("click.answered_at") < deadline_of("shown_at", deadline)))
    return shown.join(a, on_time, how).select(*shown.columns, "click")


def timed_answers(shown: DataFrame, answered: DataFrame,
                  deadline: int = C.ANSWER_DEADLINE_SECONDS, abandoned: str = "timeout") -> DataFrame:
    """J6 — a presentation is answered iff an answer arrives within the deadline;
    otherwise it is a timeout: wrong, with ``selected`` NULL.

    ``shown``: (qid, session_id, shown_at, correct); ``answered``: (qid, answered_at, selected).
    The join is on the question key plus the time range, so a stream version
    (streaming/streams.py) can keep bounded state. ``abandoned="drop"`` keeps
    the original page's behaviour for a question with no answer at all (never
    recorded); the default records it as a timeout.
    """
    if abandoned not in ("timeout", "drop"):
        raise ValueError("abandoned must be 'timeout' or 'drop'")
    shown = shown.select("qid", "session_id", "shown_at", "correct")
    if abandoned == "drop":
        shown = shown.join(answered.select("qid").distinct(), "qid", "left_semi")
    # a second answer is not taken: the earliest one before the deadline counts
    j = (on_time_clicks(shown, answered, deadline, "left").groupBy("qid", "session_id", "shown_at", "correct")
         .agg(F.min("click").alias("click")))
    return timed_columns(j)


def timed_columns(j: DataFrame) -> DataFrame:
    """The answer columns from the shown question and its earliest on-time ``click``."""
    answered = F.col("click").isNotNull()
    return j.select(
        "qid", "session_id", "shown_at", F.col("click.answered_at").alias("answered_at"),
        F.col("click.selected").alias("selected"),
        F.when(answered, (F.col("click.selected") == F.col("correct")).cast("int")).otherwise(F.lit(0)).alias("is_correct"),
        F.when(answered, F.lit("answered")).otherwise(F.lit("timed_out")).alias("status"))


def timer_state(presentations: DataFrame, deadline: int = C.ANSWER_DEADLINE_SECONDS) -> DataFrame:
    """N11 + N12 — seconds left when the answer came, its display and colour class."""
    elapsed = F.timestamp_diff("MICROSECOND", F.col("shown_at"), F.col("answered_at")) / F.lit(1e6)
    left = N.seconds_left(elapsed, deadline)
    return presentations.select(
        "qid", F.round(elapsed, 6).alias("elapsed_s"), F.round(left, 6).alias("seconds_left"),
        left.cast("int").alias("display_seconds"), N.timer_class(left).alias("timer_class"))


# ---------------------------------------------------------------- lookups

def difficulty_dimension(spark) -> DataFrame:
    """The three difficulty levels with their symbol and short instruction
    (a fixed three-row table: safe to broadcast)."""
    rows = [(lvl, C.DIFFICULTY_SYMBOLS[lvl], C.DIFFICULTY_INSTRUCTIONS_SHORT[lvl])
            for lvl in C.DIFFICULTY_LEVELS]
    return spark.createDataFrame(rows, "difficulty string, symbol string, instruction string")


def difficulty_lookup(df: DataFrame, dim: DataFrame) -> DataFrame:
    """J2 — look up symbol and instruction; an unknown level falls back to beginner."""
    d = F.broadcast(dim)
    known = df.join(d, "difficulty", "left")
    default = C.DEFAULT_DIFFICULTY
    return known.select(
        *[c for c in df.columns],
        F.coalesce("symbol", F.lit(C.DIFFICULTY_SYMBOLS[default])).alias("symbol"),
        F.coalesce("instruction", F.lit(C.DIFFICULTY_INSTRUCTIONS_SHORT[default])).alias("instruction"),
    )


def difficulty_decode(choice) -> F.Column:
    """P9 — ``input().strip()`` in '1'/'2'/'3' to a level, anything else NULL (asked again)."""
    c = py_strip(F.col(choice) if isinstance(choice, str) else choice)
    return F.when(c.isin("1", "2", "3"), F.element_at(levels_array(), c.try_cast("int")))


def bank_defaults(bank: DataFrame) -> DataFrame:
    """N22 — ``q.get('difficulty', 'beginner')``, ``q.get('explanation', '')``."""
    return bank.select("question_id",
                       F.coalesce("difficulty", F.lit(C.DEFAULT_DIFFICULTY)).alias("difficulty"),
                       F.coalesce("explanation", F.lit("")).alias("explanation"))
