"""The stand-in views of sources/standins.py written once more for DuckDB,
as a ``WITH`` prefix for the oracle queries (FIXTURES.md §2)."""

from __future__ import annotations

from .. import config as C
from ..functions.text import PY_WHITESPACE


def _arr(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


LEVELS = _arr(C.DIFFICULTY_LEVELS)
# str.strip() in DuckDB: trim the same character set, spelled with chr()
STRIP_SQL = "trim({x}, " + " || ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE) + ")"
TOPICS = _arr(C.TOPICS)

STANDINS = {
    "answers": f"""
  SELECT event_id AS id, 'student_' || CAST(user_id AS VARCHAR) AS student_name,
         event_type AS topic, props AS question, CAST(value < 60 AS INTEGER) AS is_correct,
         {LEVELS}[CAST(event_id % 3 AS INTEGER) + 1] AS difficulty, ts AS answered_at
  FROM events""",
    "roster": """
  SELECT 'student_' || CAST(c_custkey AS VARCHAR) AS student_name FROM customer""",
    "bank": f"""
  SELECT p_partkey AS question_id, p_type AS topic, p_name AS question,
         {LEVELS}[CAST(p_size % 3 AS INTEGER) + 1] AS difficulty,
         substr('ABCD', CAST(p_partkey % 4 AS INTEGER) + 1, 1) AS answer,
         p_brand AS opt_a, p_type AS opt_b, p_name AS opt_c, 'none' AS opt_d,
         CAST(NULL AS VARCHAR) AS explanation
  FROM part""",
    "responses": """
  SELECT l_orderkey AS session_id, o_custkey AS student_id,
         'student_' || CAST(o_custkey AS VARCHAR) AS student_name,
         l_partkey AS question_id, l_linenumber AS slot,
         CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 'x'
              WHEN l_linenumber = 6 THEN ' ' || lower(substr('ABCD', CAST((l_partkey + CAST(l_quantity > 36 AS INTEGER)) % 4 AS INTEGER) + 1, 1)) || chr(9)
              ELSE substr('ABCD', CAST((l_partkey + CAST(l_quantity > 36 AS INTEGER)) % 4 AS INTEGER) + 1, 1)
         END AS selected_raw,
         l_suppkey AS supplier_key, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "presentations": """
  SELECT event_id AS qid, user_id AS session_id, event_type AS topic, ts AS shown_at,
         ts + to_microseconds(CAST(round(value * 250000) AS BIGINT)) AS answered_at,
         substr('ABCD', CAST(event_id % 4 AS INTEGER) + 1, 1) AS selected,
         substr('ABCD', CAST(user_id % 4 AS INTEGER) + 1, 1) AS correct
  FROM events""",
    "conv_assistant": """
  SELECT conv_id, turn, CAST((conv_id + turn) % 5 AS INTEGER) AS kind,
         CAST(to_json({'question': text,
                  'options': {'A': 'first ' || CAST(turn AS VARCHAR), 'B': 'second ' || CAST(conv_id AS VARCHAR),
                              'C': 'third', 'D': 'none'},
                  'answer': substr('ABCD', CAST(turn % 4 AS INTEGER) + 1, 1)}) AS VARCHAR) AS qjson
  FROM conversations WHERE role = 'assistant'""",
    "llm_attempts": f"""
  SELECT conv_id AS request_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS parse_attempt,
         1 AS http_try,
         CASE WHEN kind = 4 THEN 502 ELSE 200 END AS status,
         CASE WHEN kind = 4 THEN ''
              ELSE CAST(to_json({{'content': [{{'type': 'text', 'text':
                   CASE kind WHEN 0 THEN qjson
                             WHEN 1 THEN '```json' || chr(10) || qjson || chr(10) || '```'
                             WHEN 2 THEN substr(qjson, 1, length(qjson) // 2)
                             WHEN 3 THEN '   '
                             ELSE '' END}}]}}) AS VARCHAR) END AS raw_body,
         {TOPICS}[CAST(conv_id % 5 AS INTEGER) + 1] AS topic,
         {LEVELS}[CAST(conv_id % 3 AS INTEGER) + 1] AS difficulty
  FROM conv_assistant""",
}

# the same with every outcome (standins.llm_attempts_varied): put in place of llm_attempts
_QJSON = """CAST(to_json({{'question': text, 'options': {{'A': 'first ' || CAST(turn AS VARCHAR), 'B': 'second ' || CAST(conv_id AS VARCHAR),
                  'C': 'third'{more}}}, 'answer': {answer}}}) AS VARCHAR)"""
_GOOD = _QJSON.format(more=", 'D': 'none'", answer="substr('ABCD', CAST(turn % 4 AS INTEGER) + 1, 1)")
_BODY = "CAST(to_json({{'content': [{{'type': 'text', 'text': {text}}}]}}) AS VARCHAR)"
VARIED_ATTEMPTS = f"""
  SELECT conv_id AS request_id, CAST((n - 1) // 3 + 1 AS INTEGER) AS parse_attempt, CAST((n - 1) % 3 + 1 AS INTEGER) AS http_try,
         CASE kind WHEN 4 THEN 502 WHEN 5 THEN 500 WHEN 6 THEN NULL ELSE 200 END AS status,
         CASE kind WHEN 0 THEN {_BODY.format(text='good')}
                   WHEN 1 THEN {_BODY.format(text="'```json' || chr(10) || good || chr(10) || '```'")}
                   WHEN 2 THEN {_BODY.format(text="substr(good, 1, length(good) // 2)")}
                   WHEN 3 THEN {_BODY.format(text="'   '")} WHEN 4 THEN '' WHEN 5 THEN 'overloaded' WHEN 6 THEN NULL
                   WHEN 7 THEN {_BODY.format(text="'[1, 2]'")} WHEN 8 THEN 'oops'
                   WHEN 9 THEN {_BODY.format(text=_QJSON.format(more=", 'D': 'none'", answer="'E'"))}
                   WHEN 10 THEN {_BODY.format(text=_QJSON.format(more='', answer="'A'"))} WHEN 11 THEN '{{"content":[]}}'
                   ELSE CAST(to_json({{'content': [{{'type': 'image', 'text': 'x'}}, {{'type': 'text', 'text': good}}]}}) AS VARCHAR) END AS raw_body,
         {TOPICS}[CAST(conv_id % 5 AS INTEGER) + 1] AS topic, {LEVELS}[CAST(conv_id % 3 AS INTEGER) + 1] AS difficulty
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST((conv_id * 7 + turn) % 13 AS INTEGER) AS kind,
               {_GOOD} AS good FROM conversations WHERE role = 'assistant')"""


def with_standins(body: str, extra: list[tuple[str, str]] | None = None, **other: str) -> str:
    """Prefix ``body`` with every stand-in view (DuckDB inlines unused ones); ``other``
    puts other definitions in place of some."""
    ctes = [f"{name} AS ({sql}\n)" for name, sql in {**STANDINS, **other}.items()]
    ctes += [f"{name} AS ({sql}\n)" for name, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body
