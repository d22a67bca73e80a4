"""Registered session queries (§2.2 P7-P9, §2.3 J1/J2/J6, §2.4 A9, §2.5, §2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..operators import sessions as SE
from ..sources import standins as S
from ..sources.answer_log import clean_names
from ..sources.tables import read_table
from .standin_sql import LEVELS, STRIP_SQL, with_standins

T = C.WEAK_THRESHOLD
_MSGS = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in C.BAND_MESSAGES) + "]"
_STRIP = STRIP_SQL


_RESPONSE_ORDER = [*SE.ORDER, "supplier_key", "quantity", "price"]  # the stand-in has ties without these


def _graded(spark, sf):
    return SE.graded_responses(S.responses(spark, sf), S.bank(spark, sf))


def _graded_keys(spark, sf):
    return _graded(spark, sf).select("session_id", *_RESPONSE_ORDER, "is_correct")


def _shown(spark, sf):
    return S.presentations(spark, sf).select("qid", "session_id", "shown_at", "correct")


def _answered(spark, sf):
    return S.presentations(spark, sf).select("qid", "answered_at", "selected")


def _reject_reasons(spark, sf):
    # the bank is the whole part table here: a hash of a partition's questions, no sort of the responses
    r, bank = S.responses_with_gaps(spark, sf), S.bank(spark, sf).hint("shuffle_hash")
    graded = SE.graded_responses(r, bank).select("session_id", "slot", "question_id", F.lit("graded").alias("outcome"))
    return graded.unionByName(SE.all_rejects(r, bank).select("session_id", "slot", "question_id", F.col("reason").alias("outcome")))


SPARK = {
    "valid_responses": lambda spark, sf: SE.valid_responses(S.responses(spark, sf)).select(
        "session_id", "student_name", "question_id", "slot", "selected"),
    "rejected_responses": lambda spark, sf: SE.rejected_responses(S.responses(spark, sf)),
    "graded_responses": lambda spark, sf: _graded(spark, sf).select(
        "session_id", "student_name", "question_id", "slot", "selected", "answer", "topic", "is_correct"),
    "session_scores": lambda spark, sf: SE.session_scores(_graded(spark, sf)),
    "question_numbers": lambda spark, sf: SE.question_numbers(_graded_keys(spark, sf), _RESPONSE_ORDER).select(
        "session_id", "slot", "question_id", "supplier_key", "question_no"),
    "running_score": lambda spark, sf: SE.running_score(_graded_keys(spark, sf), _RESPONSE_ORDER).select(
        "session_id", "question_no", "question_id", "is_correct", "score_before", "score_feedback", "badge"),
    "session_progress": lambda spark, sf: SE.session_progress(_graded_keys(spark, sf), _RESPONSE_ORDER).select(
        "session_id", "question_no", "n_questions", "progress"),
    "last_answer": lambda spark, sf: SE.last_answer(_graded(spark, sf), _RESPONSE_ORDER),
    "answer_review": lambda spark, sf: SE.answer_review(
        _graded(spark, sf), ("session_id", "question_id", "slot", "supplier_key")),
    "timed_answers": lambda spark, sf: SE.timed_answers(_shown(spark, sf), _answered(spark, sf)),
    "second_answers": lambda spark, sf: SE.timed_answers(_shown(spark, sf), S.clicks(spark, sf)),
    "response_outcomes": lambda spark, sf: _reject_reasons(spark, sf),
    "timer_state": lambda spark, sf: SE.timer_state(S.presentations(spark, sf)),
    "difficulty_lookup": lambda spark, sf: SE.difficulty_lookup(
        S.answers(spark, sf).select("id", "difficulty"), SE.difficulty_dimension(spark)),
    "difficulty_decode": lambda spark, sf: read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.substring("o_orderpriority", 1, 1).alias("choice"),
    ).withColumn("difficulty", SE.difficulty_decode("choice")),
    "bank_defaults": lambda spark, sf: SE.bank_defaults(S.bank(spark, sf)),
    "option_lines": lambda spark, sf: S.bank(spark, sf).select(
        "question_id", F.posexplode(X.option_lines("options")).alias("pos", "line")).select(
        "question_id", F.col("pos").cast("int").alias("pos"), "line", X.first_letter("line").alias("letter")),
    "bank_answer_text": lambda spark, sf: S.bank(spark, sf).select(
        "question_id", "answer", F.element_at("options", F.col("answer")).alias("answer_text")),
    "clean_names": lambda spark, sf: clean_names(
        read_table(spark, sf, "customer").select(F.col("c_name").alias("student_name"))),
    "clean_names_padded": lambda spark, sf: clean_names(S.padded_names(spark, sf)),
}

_NR = f"""SELECT *, upper({_STRIP.format(x='selected_raw')}) AS selected FROM responses"""
_GRADED = """
  SELECT nr.*, b.topic, b.question AS question_text, b.answer, b.difficulty,
         CAST(nr.selected = b.answer AS INTEGER) AS is_correct
  FROM nr JOIN bank b ON nr.question_id = b.question_id
  WHERE nr.selected IN ('A', 'B', 'C', 'D')"""
_G = [("nr", _NR), ("graded", _GRADED)]
_ORDER = "slot, question_id, supplier_key, quantity, price"

ORACLE = {
    "valid_responses": with_standins(
        "SELECT session_id, student_name, question_id, slot, selected FROM nr WHERE selected IN ('A','B','C','D')", _G),
    "rejected_responses": with_standins("""
SELECT session_id, student_name, question_id, slot, selected_raw, selected, 'invalid_letter' AS reason
FROM nr WHERE selected NOT IN ('A','B','C','D') OR selected IS NULL""", _G),
    "graded_responses": with_standins(
        "SELECT session_id, student_name, question_id, slot, selected, answer, topic, is_correct FROM graded", _G),
    "session_scores": with_standins(f"""
SELECT session_id, student_name, score, total, ROUND(pct, 6) AS pct, band, {_MSGS}[band + 1] AS message,
       CAST(score AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' (' || CAST(CAST(ROUND_EVEN(pct, 0) AS BIGINT) AS VARCHAR) || '%)' AS score_text
FROM (SELECT *, CASE WHEN total > 0 AND score = total THEN 0 WHEN total > 0 AND score * 100 >= total * 80 THEN 1
                     WHEN total > 0 AND score * 100 >= total * 60 THEN 2 ELSE 3 END AS band,
             CASE WHEN total > 0 THEN CAST(score AS DOUBLE) / total * 100.0 ELSE 0.0 END AS pct
      FROM (SELECT session_id, student_name, CAST(SUM(is_correct) AS BIGINT) AS score, COUNT(*) AS total
            FROM graded GROUP BY session_id, student_name))""", _G),
    "question_numbers": with_standins(f"""
SELECT session_id, slot, question_id, supplier_key,
       CAST(row_number() OVER (PARTITION BY session_id ORDER BY {_ORDER}) AS BIGINT) AS question_no
FROM graded""", _G),
    "running_score": with_standins(f"""
SELECT session_id, question_no, question_id, is_correct, score_before, score_feedback,
       '⭐ ' || CAST(score_before AS VARCHAR) || '/' || CAST(question_no - 1 AS VARCHAR) AS badge
FROM (SELECT session_id, question_id, is_correct,
             CAST(row_number() OVER w AS BIGINT) AS question_no,
             CAST(COALESCE(SUM(is_correct) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS score_before,
             CAST(SUM(is_correct) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS score_feedback
      FROM graded WINDOW w AS (PARTITION BY session_id ORDER BY {_ORDER}))""", _G),
    "session_progress": with_standins(f"""
SELECT session_id, question_no, n_questions, ROUND(question_no / n_questions, 6) AS progress
FROM (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY {_ORDER}) AS BIGINT) AS question_no,
             COUNT(*) OVER (PARTITION BY session_id) AS n_questions FROM graded)""", _G),
    "last_answer": with_standins(f"""
SELECT session_id, question_id, selected, answer, is_correct
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY slot DESC, question_id DESC,
                 supplier_key DESC, quantity DESC, price DESC) AS rn FROM graded) WHERE rn = 1""", _G),
    "answer_review": with_standins(f"""
SELECT session_id, question_id, slot, supplier_key,
       CASE WHEN is_correct = 1 THEN '{C.ICON_CORRECT}' ELSE '{C.ICON_WRONG}' END || ' ' || topic || ' — '
       || substr(question_text, 1, {C.PREVIEW_CHARS}) || '...' || ' → You answered: '
       || CASE WHEN selected IS NULL OR selected = '' THEN '{C.TIMEOUT_SYMBOL}' ELSE selected END AS line
FROM graded""", _G),
    "timed_answers": with_standins(f"""
SELECT s.qid, s.session_id, s.shown_at, a.answered_at, a.selected,
       CASE WHEN a.qid IS NOT NULL THEN CAST(a.selected = s.correct AS INTEGER) ELSE 0 END AS is_correct,
       CASE WHEN a.qid IS NOT NULL THEN 'answered' ELSE 'timed_out' END AS status
FROM presentations s LEFT JOIN presentations a
  ON s.qid = a.qid AND a.answered_at >= s.shown_at
 AND a.answered_at < s.shown_at + INTERVAL {C.ANSWER_DEADLINE_SECONDS} SECOND"""),
    "second_answers": with_standins(f"""
SELECT qid, session_id, shown_at, answered_at, selected,
       CASE WHEN answered_at IS NOT NULL THEN CAST(selected = correct AS INTEGER) ELSE 0 END AS is_correct,
       CASE WHEN answered_at IS NOT NULL THEN 'answered' ELSE 'timed_out' END AS status
FROM (SELECT s.qid, s.session_id, s.shown_at, s.correct, c.answered_at, c.selected,
             row_number() OVER (PARTITION BY s.qid, s.session_id, s.shown_at ORDER BY c.answered_at, c.selected) AS k
      FROM presentations s LEFT JOIN (
        SELECT qid, answered_at, selected FROM presentations UNION ALL
        SELECT qid, answered_at + INTERVAL 3 SECOND, CASE WHEN selected = 'A' THEN 'B' ELSE 'A' END
        FROM presentations WHERE qid % 3 = 0) c
      ON s.qid = c.qid AND c.answered_at >= s.shown_at
     AND c.answered_at < s.shown_at + INTERVAL {C.ANSWER_DEADLINE_SECONDS} SECOND) WHERE k = 1"""),
    "response_outcomes": with_standins(f"""
SELECT r.session_id, r.slot, r.question_id,
       CASE WHEN r.letter IS NULL OR r.letter NOT IN ('A', 'B', 'C', 'D') THEN 'invalid_letter'
            WHEN b.question_id IS NULL THEN 'unknown_question' ELSE 'graded' END AS outcome
FROM (SELECT session_id, slot, CASE WHEN quantity = 50 THEN -question_id ELSE question_id END AS question_id,
             CASE WHEN quantity <> 49 THEN upper({_STRIP.format(x='selected_raw')}) END AS letter FROM responses) r
LEFT JOIN bank b ON b.question_id = r.question_id"""),
    "timer_state": with_standins(f"""
SELECT qid, ROUND(e, 6) AS elapsed_s, ROUND(l, 6) AS seconds_left, CAST(trunc(l) AS INTEGER) AS display_seconds,
       CASE WHEN l > {C.TIMER_NORMAL_ABOVE} THEN '{C.TIMER_CLASSES[0]}'
            WHEN l > {C.TIMER_WARNING_ABOVE} THEN '{C.TIMER_CLASSES[1]}' ELSE '{C.TIMER_CLASSES[2]}' END AS timer_class
FROM (SELECT qid, e, greatest(0.0, {C.ANSWER_DEADLINE_SECONDS}.0 - e) AS l
      FROM (SELECT qid, date_diff('microsecond', shown_at, answered_at) / 1e6 AS e FROM presentations))"""),
    "difficulty_lookup": with_standins(
        "SELECT a.id, a.difficulty, COALESCE(d.symbol, '{sym}') AS symbol, COALESCE(d.instruction, '{ins}') AS instruction "
        "FROM answers a LEFT JOIN (VALUES {vals}) d(difficulty, symbol, instruction) ON a.difficulty = d.difficulty".format(
            sym=C.DIFFICULTY_SYMBOLS[C.DEFAULT_DIFFICULTY],
            ins=C.DIFFICULTY_INSTRUCTIONS_SHORT[C.DEFAULT_DIFFICULTY],
            vals=", ".join(f"('{lv}', '{C.DIFFICULTY_SYMBOLS[lv]}', '{C.DIFFICULTY_INSTRUCTIONS_SHORT[lv]}')"
                           for lv in C.DIFFICULTY_LEVELS))),
    "difficulty_decode": f"""
SELECT session_id, choice,
       CASE WHEN c IN ('1', '2', '3') THEN {LEVELS}[CAST(c AS INTEGER)] END AS difficulty
FROM (SELECT o_orderkey AS session_id, substr(o_orderpriority, 1, 1) AS choice,
             {_STRIP.format(x='substr(o_orderpriority, 1, 1)')} AS c FROM orders)""",
    "bank_defaults": with_standins(f"""
SELECT question_id, COALESCE(difficulty, '{C.DEFAULT_DIFFICULTY}') AS difficulty, COALESCE(explanation, '') AS explanation
FROM bank"""),
    "option_lines": with_standins("""
SELECT question_id, pos, line, substr(line, 1, 1) AS letter FROM (
SELECT question_id, 0 AS pos, 'A. ' || opt_a AS line FROM bank UNION ALL
SELECT question_id, 1, 'B. ' || opt_b FROM bank UNION ALL
SELECT question_id, 2, 'C. ' || opt_c FROM bank UNION ALL
SELECT question_id, 3, 'D. ' || opt_d FROM bank)"""),
    "bank_answer_text": with_standins("""
SELECT question_id, answer, CASE answer WHEN 'A' THEN opt_a WHEN 'B' THEN opt_b WHEN 'C' THEN opt_c
                                        WHEN 'D' THEN opt_d END AS answer_text FROM bank"""),
    "clean_names": f"""
SELECT student_name FROM (SELECT {_STRIP.format(x='c_name')} AS student_name FROM customer)
WHERE student_name <> ''""",
    "clean_names_padded": f"""
SELECT student_name FROM (SELECT {_STRIP.format(x='typed')} AS student_name FROM (
  SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' ' || chr(9)
              WHEN c_custkey % 3 = 0 THEN '  ' || c_name || chr(10) WHEN c_custkey % 3 = 1 THEN chr(9) || c_name
              ELSE c_name END AS typed FROM customer))
WHERE student_name <> ''""",
}
