"""Stored model replies -> question bank, with a dead-letter output.

One row per attempt ``(request_id, parse_attempt, http_try, status, raw_body)``.
The outcome of an attempt is a long chain of JSON expressions, so the outcomes are
settled once (``settle``: staged with a row number). Per request the decision is ONE
hash aggregation over numeric attempt keys (min / min_by / max_by of whole numbers
are partial-aggregable, so a request with many rows never lands whole in one task);
the winner's body or error is fetched by its row number afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import json_reply as J
from ..session import stage

OK = "parsed"
RETRY_502 = "retry_502"
RETRY_EMPTY = "retry_empty"
RETRY_ERROR = "retry_error"
PARSE_ERROR = "parse_error"
FATAL_HTTP = "fatal_http"
FATAL_TYPE = "fatal_type"
EXHAUSTED = "fatal_exhausted"


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """D2 + D3 + D4 + D5 — per attempt: reply text, unfenced text, parse and outcome."""
    a = (attempts
         .withColumn("reply_text", J.reply_text("raw_body"))
         .withColumn("clean_text", J.unfence("reply_text"))
         .withColumn("parsed", J.parse_question("clean_text")))
    status = F.col("status")
    base = (F.when(status.isNull(), F.lit(RETRY_ERROR))  # no HTTP response at all
            .when(status == C.RETRY_STATUS, F.lit(RETRY_502))
            .when(status >= 400, F.lit(FATAL_HTTP))
            .when(J.reply_raises("raw_body"), F.lit(RETRY_ERROR))
            .when(F.col("reply_text").isNull(), F.lit(RETRY_EMPTY))
            .when(J.parsed_ok("clean_text", "parsed"), F.lit(OK))
            .when(J.non_object_json("clean_text"), F.lit(FATAL_TYPE))
            .otherwise(F.lit(PARSE_ERROR)))
    a = a.withColumn("base_outcome", base)
    retry = F.col("base_outcome").isin(RETRY_502, RETRY_EMPTY, RETRY_ERROR)
    # three failed HTTP tries end the request (the inner error is not caught outside)
    outcome = F.when(retry & (F.col("http_try") >= C.MAX_HTTP_TRIES), F.lit(EXHAUSTED)).otherwise(F.col("base_outcome"))
    attempt_s = F.col("http_try").cast("string")
    err = (F.when(F.col("base_outcome") == RETRY_502, F.concat(F.lit(C.ERROR_502), attempt_s, F.lit(")")))
           .when(F.col("base_outcome") == FATAL_HTTP,
                 F.concat(F.lit(C.ERROR_HTTP), status.cast("string"), F.lit(": "), F.coalesce("raw_body", F.lit(""))))
           .when(F.col("base_outcome") == RETRY_EMPTY, F.concat(F.lit(C.ERROR_EMPTY), attempt_s, F.lit(")")))
           .when(F.col("base_outcome") == RETRY_ERROR, F.concat(F.lit(C.ERROR_UNREADABLE), attempt_s, F.lit(")")))
           .when(F.col("base_outcome") == PARSE_ERROR,
                 F.concat(F.lit(C.ERROR_PARSE), F.col("parse_attempt").cast("string"), F.lit(")")))
           .when(F.col("base_outcome") == FATAL_TYPE, F.lit("reply is not a JSON object")))
    err = F.when(F.col("outcome") == EXHAUSTED, F.concat(F.lit(C.HTTP_GIVEN_UP), err)).otherwise(err)
    return a.withColumn("outcome", outcome).withColumn("error", err).drop("base_outcome")


def settle(outcomes: DataFrame) -> DataFrame:
    """The outcomes computed once and staged, each with its number ``attempt_row``.
    Filters on them then read columns instead of repeating the parse."""
    if "attempt_row" in outcomes.columns:
        return outcomes
    kept = ("request_id", "topic", "difficulty", "parse_attempt", "http_try", "outcome", "error", "parsed")
    return stage(outcomes.select(*kept, F.monotonically_increasing_id().alias("attempt_row")), "reply-outcomes")


def _question(*more: str) -> list:
    return [*(F.col(f"parsed.{f}").alias(f) for f in ("question", "options", "answer", "explanation")), *more]


def parsed_questions(outcomes: DataFrame) -> DataFrame:
    """D5 + D6 — every parsable attempt, tagged with the request's topic and difficulty."""
    return settle(outcomes).where(F.col("outcome") == OK).select(
        "request_id", "parse_attempt", "http_try", *_question("topic", "difficulty"))


def _request_summary(outcomes: DataFrame) -> DataFrame:
    """One row a request: whether it succeeded, and the ``attempt_row`` that decided it."""
    attempt = F.col("parse_attempt").cast("bigint") * F.lit(1 << 31) + F.col("http_try")
    key = F.when(F.col("parse_attempt") <= C.MAX_PARSE_ATTEMPTS, attempt)
    fatal = F.when(F.col("outcome").isin(FATAL_HTTP, FATAL_TYPE, EXHAUSTED), key)
    ok = F.when(F.col("outcome") == OK, key)
    return (outcomes.groupBy("request_id", "topic", "difficulty").agg(
        F.min(ok).alias("ok_key"), F.min_by("attempt_row", ok).alias("ok_row"),
        F.min(fatal).alias("fatal_key"), F.min_by("attempt_row", fatal).alias("fatal_row"),
        F.max_by("attempt_row", key).alias("last_row"))
        .withColumn("success", F.col("ok_key").isNotNull() & (F.col("fatal_key").isNull() | (F.col("ok_key") < F.col("fatal_key")))))


def first_valid_reply(outcomes: DataFrame) -> DataFrame:
    """D7 — the first parsable reply within three attempts, before any fatal one."""
    outcomes = settle(outcomes)
    won = _request_summary(outcomes).where("success").select("request_id", "topic", "difficulty", F.col("ok_row").alias("attempt_row"))
    bodies = outcomes.where(F.col("outcome") == OK).select("attempt_row", *_question("parse_attempt", "http_try"))
    return won.join(bodies, "attempt_row").drop("attempt_row")


def failed_requests(outcomes: DataFrame) -> DataFrame:
    """D8 — the dead-letter table: requests without a question, with the last error. A
    request that used up its three replies says so before the error."""
    outcomes = settle(outcomes)
    fatal = F.col("fatal_key").isNotNull()
    lost = _request_summary(outcomes).where(~F.col("success")).select(
        "request_id", "topic", "difficulty", F.when(fatal, F.lit("fatal")).otherwise(F.lit("exhausted")).alias("reason"),
        F.when(fatal, F.col("fatal_row")).otherwise(F.col("last_row")).alias("attempt_row"))
    errors = outcomes.where(F.col("error").isNotNull()).select("attempt_row", "error")
    given_up = F.when(F.col("reason") == "exhausted", F.concat(F.lit(C.GIVEN_UP), F.coalesce("error", F.lit("")))).otherwise(F.col("error"))
    return lost.join(errors, "attempt_row", "left").withColumn("error", given_up).drop("attempt_row")


def bank_quality(questions: DataFrame) -> DataFrame:
    """D9 — the promised contract: answer in A-D, present among four options."""
    ok = (F.col("answer").isin(*C.LETTERS)
          & F.coalesce(F.map_contains_key("options", F.col("answer")), F.lit(False))
          & (F.coalesce(F.size("options"), F.lit(0)) == 4))
    return questions.withColumn("is_valid", ok)
