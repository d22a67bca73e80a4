"""Registered practice and reply queries (§2.3 J3/J5, §2.5 W4, §2.6 L4/L5, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.hashing import seeded_int_sql, seeded_key_sql
from ..functions.template import fill_sql
from ..operators import practice as P
from ..operators import replies as R
from ..operators import sessions as SE
from ..session import scratch_path, scratch_table
from ..sources import standins as S
from .session_queries import _G
from .standin_sql import STANDINS, STRIP_SQL, VARIED_ATTEMPTS, with_standins

SEED = C.QuizConfig.seed
N = C.QUESTIONS_PER_TOPIC
T = C.WEAK_THRESHOLD
OTHER_LEVEL = "expert"  # not a level: gets the beginner's instruction


def _weak(spark, sf):
    return P.weak_pairs(SE.graded_responses(S.responses(spark, sf), S.bank(spark, sf)))


def _drawn(spark, sf):
    return P.draw(_weak(spark, sf), S.bank(spark, sf), N, SEED)


def _outcomes(spark, sf):
    return R.attempt_outcomes(S.llm_attempts(spark, sf))


def _varied(spark, sf):
    return R.attempt_outcomes(S.llm_attempts_varied(spark, sf))


def _drawn_stored(spark, sf):
    """W4 twice from positions stored once; the second draw reads the table alone."""
    table = scratch_table(spark, "positions")
    P.store_positions(S.bank(spark, sf), SEED, table, scratch_path(spark, "positions"))
    return P.draw_stored(_weak(spark, sf), table, N, SEED)


def _asked_prompts(spark, sf):
    asked = S.answers(spark, sf).select("topic", "difficulty").distinct()
    other = asked.select("topic", F.lit(OTHER_LEVEL).alias("difficulty")).distinct()
    return P.plain_prompts(asked.unionByName(other))


def _opts(prefix=""):
    return [F.element_at(F.col(prefix + "options"), F.lit(k)).alias(f"option_{k.lower()}") for k in C.LETTERS]


SPARK = {
    "practice_slots": lambda spark, sf: P.practice_slots(_weak(spark, sf), N),
    "quiz_draw": lambda spark, sf: _drawn(spark, sf).select(
        "student_name", "topic", "slot", "question_id", "question", "answer"),
    "quiz_order": lambda spark, sf: P.quiz_order(_drawn(spark, sf), SEED).select(
        "student_name", "question_no", "topic", "slot", "question_id"),
    "practice_order": lambda spark, sf: P.practice_order(_drawn(spark, sf), SEED).select(
        "student_name", "question_no", "question_id"),
    "practice_candidates": lambda spark, sf: P.practice_candidates(_weak(spark, sf), S.bank(spark, sf)),
    "weak_for_anyone": lambda spark, sf: P.weak_for_anyone(S.bank(spark, sf), _weak(spark, sf)).select(
        "question_id", "topic"),
    "practice_requests": lambda spark, sf: P.practice_requests(
        P.practice_slots(_weak(spark, sf), N), C.DEFAULT_DIFFICULTY, SEED),
    "attempt_outcomes": lambda spark, sf: _outcomes(spark, sf).select(
        "request_id", "parse_attempt", "http_try", "status", "outcome", "error"),
    "reply_text": lambda spark, sf: _outcomes(spark, sf).select(
        "request_id", "parse_attempt", "http_try", "reply_text"),
    "unfenced_reply": lambda spark, sf: _outcomes(spark, sf).select(
        "request_id", "parse_attempt", "http_try", "clean_text"),
    "parsed_questions": lambda spark, sf: R.parsed_questions(_outcomes(spark, sf)).select(
        "request_id", "parse_attempt", "http_try", "topic", "difficulty", "question", "answer", *_opts()),
    "first_valid_reply": lambda spark, sf: R.first_valid_reply(_outcomes(spark, sf)).select(
        "request_id", "topic", "difficulty", "question", "answer", *_opts(), "parse_attempt", "http_try"),
    "failed_requests": lambda spark, sf: R.failed_requests(_outcomes(spark, sf)),
    "bank_quality": lambda spark, sf: R.bank_quality(R.first_valid_reply(_outcomes(spark, sf))).select(
        "request_id", "answer", "is_valid"),
    "attempt_outcomes_varied": lambda spark, sf: _varied(spark, sf).select(
        "request_id", "parse_attempt", "http_try", "status", "outcome", "error"),
    "first_valid_reply_varied": lambda spark, sf: R.first_valid_reply(_varied(spark, sf)).select(
        "request_id", "topic", "difficulty", "question", "answer", *_opts(), "parse_attempt", "http_try"),
    "failed_requests_varied": lambda spark, sf: R.failed_requests(_varied(spark, sf)),
    "bank_quality_varied": lambda spark, sf: R.bank_quality(R.first_valid_reply(_varied(spark, sf))).select(
        "request_id", "answer", "is_valid"),
    "quiz_draw_stored": lambda spark, sf: _drawn_stored(spark, sf).select(
        "student_name", "topic", "slot", "question_id", "question", "answer"),
    "plain_prompts": _asked_prompts,
}

# ------------------------------------------------------------------ oracle
_WP = f"""
  SELECT student_name, topic FROM (
    SELECT student_name, topic, COUNT(*) AS total, SUM(is_correct) AS correct
    FROM graded GROUP BY student_name, topic) WHERE correct * 100 < total * {T}"""
_BP = f"""
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {seeded_key_sql(SEED, 'question_id')}, question_id) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY topic) AS n_topic FROM bank"""
_PK = f"""
  SELECT w.student_name, w.topic, s.n_topic, {seeded_int_sql(SEED, 'w.student_name', 'w.topic')} % s.n_topic AS start,
         unnest(generate_series(0, least({N}, s.n_topic) - 1)) AS draw_no
  FROM wp w JOIN (SELECT DISTINCT topic, n_topic FROM bp) s ON w.topic = s.topic"""
_DRAWN = """
  SELECT pk.student_name, pk.topic, CAST(pk.draw_no + 1 AS INTEGER) AS slot, bp.question_id, bp.question, bp.answer
  FROM pk JOIN bp ON pk.topic = bp.topic AND (pk.start + pk.draw_no) % pk.n_topic = bp.pos"""
_P = _G + [("wp", _WP), ("bp", _BP), ("pk", _PK), ("drawn", _DRAWN)]

_SLOTS = f"SELECT student_name, topic, CAST(unnest(generate_series(1, {N})) AS INTEGER) AS slot FROM wp"
_INSTR = "CASE d {cases} ELSE '{default}' END".format(
    cases=" ".join(f"WHEN '{lv}' THEN '{C.DIFFICULTY_INSTRUCTIONS_SHORT[lv]}'" for lv in C.DIFFICULTY_LEVELS),
    default=C.DIFFICULTY_INSTRUCTIONS_SHORT[C.DEFAULT_DIFFICULTY])
_SEED_HINT = f"CAST({C.SEED_HINT_MIN} + {seeded_int_sql(SEED, 'student_name', 'topic', 'slot')} % {C.SEED_HINT_MAX - C.SEED_HINT_MIN + 1} AS BIGINT)"

_STRIP = STRIP_SQL

_REPLY = [
    ("att", """SELECT *, from_json(CASE WHEN json_valid(raw_body) THEN raw_body END,
                  '{"content":[{"type":"VARCHAR","text":"VARCHAR"}]}') AS body
           FROM llm_attempts"""),
    ("rt", f"""SELECT *, COALESCE(
                  (list_filter(body.content, lambda b: b.type = 'text' AND {_STRIP.format(x='b.text')} <> ''))[1].text,
                  CASE WHEN {_STRIP.format(x='body.content[1].text')} <> '' THEN body.content[1].text END) AS reply_text
           FROM att"""),
    ("st", f"SELECT *, {_STRIP.format(x='reply_text')} AS s FROM rt"),
    ("dr", "SELECT *, regexp_replace(s, '^```[^\\n]*\\n', '') AS d FROM st"),
    ("un", f"""SELECT *, CASE WHEN starts_with(s, '```')
                  THEN {_STRIP.format(x="CASE WHEN ends_with(d, '```') THEN substr(d, 1, length(d) - 3) ELSE d END")}
                  ELSE s END AS clean_text FROM dr"""),
    ("oc", """SELECT *, CASE WHEN status IS NULL THEN 'retry_error'
                  WHEN status = 502 THEN 'retry_502' WHEN status >= 400 THEN 'fatal_http'
                  WHEN body IS NULL OR body.content IS NULL OR (reply_text IS NULL AND len(body.content) = 0) THEN 'retry_error'
                  WHEN reply_text IS NULL THEN 'retry_empty'
                  WHEN starts_with(clean_text, '{') AND ends_with(clean_text, '}') AND json_valid(clean_text) THEN 'parsed'
                  WHEN NOT starts_with(clean_text, '{') AND json_valid(clean_text) THEN 'fatal_type'
                  ELSE 'parse_error' END AS base FROM un"""),
    ("o1", f"""SELECT *, CASE WHEN base IN ('retry_502', 'retry_empty', 'retry_error') AND http_try >= {C.MAX_HTTP_TRIES}
                  THEN 'fatal_exhausted' ELSE base END AS outcome,
                  CASE base WHEN 'retry_502' THEN '502 Bad Gateway (attempt ' || CAST(http_try AS VARCHAR) || ')'
                            WHEN 'fatal_http' THEN 'API error ' || CAST(status AS VARCHAR) || ': ' || COALESCE(raw_body, '')
                            WHEN 'retry_empty' THEN 'Empty response from API (attempt ' || CAST(http_try AS VARCHAR) || ')'
                            WHEN 'retry_error' THEN 'Unreadable response (attempt ' || CAST(http_try AS VARCHAR) || ')'
                            WHEN 'parse_error' THEN 'JSON parse error (attempt ' || CAST(parse_attempt AS VARCHAR) || ')'
                            WHEN 'retry_error' THEN '{C.ERROR_UNREADABLE}' || CAST(http_try AS VARCHAR) || ')'
                            WHEN 'fatal_type' THEN 'reply is not a JSON object' END AS err0
           FROM oc"""),
    ("outc", """SELECT *, CASE WHEN outcome = 'fatal_exhausted' THEN 'Failed after 3 attempts: ' || err0 ELSE err0 END AS error,
                  parse_attempt * 1000 + http_try AS k,
                  parse_attempt <= 3 AND outcome IN ('fatal_http', 'fatal_type', 'fatal_exhausted') AS is_fatal,
                  parse_attempt <= 3 AND outcome = 'parsed' AS is_ok,
                  parse_attempt <= 3 AS in_budget
           FROM o1"""),
    ("summ", """SELECT request_id, topic, difficulty,
                  min(k) FILTER (WHERE is_fatal) AS fatal_key, min(k) FILTER (WHERE is_ok) AS ok_key,
                  arg_min(clean_text, k) FILTER (WHERE is_ok) AS win_text,
                  arg_min(parse_attempt, k) FILTER (WHERE is_ok) AS win_pa,
                  arg_min(http_try, k) FILTER (WHERE is_ok) AS win_ht,
                  arg_min(error, k) FILTER (WHERE is_fatal) AS fatal_error,
                  arg_max(error, k) FILTER (WHERE in_budget) AS last_error
           FROM outc GROUP BY request_id, topic, difficulty"""),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _opt_sql(src):
    return ", ".join(f"json_extract_string({src}, '$.options.{k}') AS option_{k.lower()}" for k in C.LETTERS)


_SUCCESS = "ok_key IS NOT NULL AND (fatal_key IS NULL OR ok_key < fatal_key)"

ORACLE = {
    "practice_slots": with_standins(_SLOTS, _P),
    "quiz_draw": with_standins("SELECT * FROM drawn", _P),
    "quiz_order": with_standins(f"""
SELECT student_name, CAST(row_number() OVER (PARTITION BY student_name ORDER BY
         {seeded_key_sql(SEED, 'student_name', 'topic')}, topic, slot) AS INTEGER) AS question_no, topic, slot, question_id
FROM drawn""", _P),
    "practice_order": with_standins(f"""
SELECT student_name, CAST(row_number() OVER (PARTITION BY student_name ORDER BY
         {seeded_key_sql(SEED, 'student_name', 'question_id')}, question_id) AS INTEGER) AS question_no, question_id
FROM drawn""", _P),
    "practice_candidates": with_standins("""
SELECT w.student_name, w.topic, CAST(COALESCE(s.n, 0) AS BIGINT) AS n_candidates
FROM wp w LEFT JOIN (SELECT topic, COUNT(*) AS n FROM bank GROUP BY topic) s ON w.topic = s.topic""", _P),
    "weak_for_anyone": with_standins("""
SELECT question_id, topic FROM bank b WHERE EXISTS (SELECT 1 FROM wp WHERE wp.topic = b.topic)""", _P),
    "practice_requests": with_standins(f"""
SELECT student_name, topic, slot, d AS difficulty, seed_hint,
       {fill_sql(P.seeded_template(), topic='topic', difficulty='d', diff_instruction=_INSTR, seed_hint='seed_hint')} AS prompt
FROM (SELECT *, '{C.DEFAULT_DIFFICULTY}' AS d, {_SEED_HINT} AS seed_hint FROM ({_SLOTS}))""", _P),
    "attempt_outcomes": with_standins(
        "SELECT request_id, parse_attempt, http_try, status, outcome, error FROM outc", _REPLY),
    "reply_text": with_standins("SELECT request_id, parse_attempt, http_try, reply_text FROM outc", _REPLY),
    "unfenced_reply": with_standins("SELECT request_id, parse_attempt, http_try, clean_text FROM outc", _REPLY),
    "parsed_questions": with_standins(f"""
SELECT request_id, parse_attempt, http_try, topic, difficulty,
       json_extract_string(clean_text, '$.question') AS question, json_extract_string(clean_text, '$.answer') AS answer,
       {_opt_sql('clean_text')}
FROM outc WHERE outcome = 'parsed'""", _REPLY),
    "first_valid_reply": with_standins(f"""
SELECT request_id, topic, difficulty, json_extract_string(win_text, '$.question') AS question,
       json_extract_string(win_text, '$.answer') AS answer, {_opt_sql('win_text')},
       win_pa AS parse_attempt, win_ht AS http_try
FROM summ WHERE {_SUCCESS}""", _REPLY),
    "failed_requests": with_standins(f"""
SELECT request_id, topic, difficulty, CASE WHEN fatal_key IS NOT NULL THEN 'fatal' ELSE 'exhausted' END AS reason,
       CASE WHEN fatal_key IS NOT NULL THEN fatal_error ELSE '{C.GIVEN_UP}' || COALESCE(last_error, '') END AS error
FROM summ WHERE NOT ({_SUCCESS})""", _REPLY),
    "bank_quality": with_standins(f"""
SELECT request_id, answer, answer IN ('A', 'B', 'C', 'D')
         AND json_extract_string(win_text, '$.options.' || answer) IS NOT NULL
         AND json_exists(win_text, '$.options.' || answer)
         AND (SELECT COUNT(*) FROM (SELECT unnest(json_keys(win_text, '$.options')))) = 4 AS is_valid
FROM (SELECT *, json_extract_string(win_text, '$.answer') AS answer FROM summ WHERE {_SUCCESS})""", _REPLY),
}
_LONG = "CASE difficulty {cases} ELSE {default} END".format(
    cases=" ".join(f"WHEN '{lv}' THEN {_quoted(C.DIFFICULTY_INSTRUCTIONS_LONG[lv])}" for lv in C.DIFFICULTY_LEVELS),
    default=_quoted(C.DIFFICULTY_INSTRUCTIONS_LONG[C.DEFAULT_DIFFICULTY]))
ORACLE |= {f"{name}_varied": sql for name, sql in {
    "attempt_outcomes": with_standins("SELECT request_id, parse_attempt, http_try, status, outcome, error FROM outc", _REPLY,
                                      llm_attempts=VARIED_ATTEMPTS),
    "first_valid_reply": ORACLE["first_valid_reply"].replace(STANDINS["llm_attempts"], VARIED_ATTEMPTS),
    "failed_requests": ORACLE["failed_requests"].replace(STANDINS["llm_attempts"], VARIED_ATTEMPTS),
    "bank_quality": ORACLE["bank_quality"].replace(STANDINS["llm_attempts"], VARIED_ATTEMPTS)}.items()}
ORACLE |= {
    "quiz_draw_stored": ORACLE["quiz_draw"],
    "plain_prompts": with_standins(f"""
SELECT topic, difficulty, {fill_sql(P.plain_template(), topic='topic', difficulty='difficulty', diff_instruction=_LONG)} AS prompt
FROM (SELECT DISTINCT topic, difficulty FROM answers UNION ALL SELECT DISTINCT topic, '{OTHER_LEVEL}' FROM answers)"""),
}
