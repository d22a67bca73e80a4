"""Stand-in views over the driver tables (FIXTURES.md §2).

No driver table is an answer log, so each operator family reads one of
these derived views. Every definition is a projection (plus, for
``responses``, the lineitem-orders key join), so the views grow with the
tables and add no shuffle of their own except that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import levels_array
from .tables import read_table

STUDENT_PREFIX = "student_"


def _letter(idx_col) -> F.Column:
    """``substr('ABCD', idx + 1, 1)`` for a 0-based index column."""
    return F.substring(F.lit("".join(C.LETTERS)), (idx_col).cast("int") + 1, 1)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.1 — the answer log ``quiz_results`` from ``events``."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit(STUDENT_PREFIX), F.col("user_id").cast("string")).alias("student_name"),
        F.col("event_type").alias("topic"),
        F.col("props").alias("question"),
        (F.col("value") < 60).cast("int").alias("is_correct"),
        F.element_at(levels_array(), (F.col("event_id") % 3).cast("int") + 1).alias("difficulty"),
        F.col("ts").alias("answered_at"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.2 — every known student, with or without history."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit(STUDENT_PREFIX), F.col("c_custkey").cast("string")).alias("student_name"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.3 — the question bank from ``part`` (key ``question_id``)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_type").alias("topic"),
        F.col("p_name").alias("question"),
        F.element_at(levels_array(), (F.col("p_size") % 3).cast("int") + 1).alias("difficulty"),
        _letter(F.col("p_partkey") % 4).alias("answer"),
        F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"),
                     F.lit("C"), F.col("p_name"), F.lit("D"), F.lit("none")).alias("options"),
        F.lit(None).cast("string").alias("explanation"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.4 — raw session responses from ``lineitem`` joined to ``orders``."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # hash of a partition's orders: no sort, and no broadcast of what is small only as a compressed file
    j = li.join(o.hint("shuffle_hash"), li.l_orderkey == o.o_orderkey, "inner")
    wrong = (F.col("l_quantity") > 36).cast("int")
    letter = _letter((F.col("l_partkey") + wrong) % 4)
    selected_raw = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), F.lit("x"))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit(" "), F.lower(letter), F.char(F.lit(9))))
        .otherwise(letter)
    )
    return j.select(
        F.col("l_orderkey").alias("session_id"),
        F.col("o_custkey").alias("student_id"),
        F.concat(F.lit(STUDENT_PREFIX), F.col("o_custkey").cast("string")).alias("student_name"),
        F.col("l_partkey").alias("question_id"),
        F.col("l_linenumber").alias("slot"),
        selected_raw.alias("selected_raw"),
        F.col("l_suppkey").alias("supplier_key"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.5 — question shown / answered times from ``events``."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("qid"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("topic"),
        F.col("ts").alias("shown_at"),
        F.timestamp_add("MICROSECOND", F.round(F.col("value") * 250000).cast("bigint"),
                       F.col("ts")).alias("answered_at"),
        _letter(F.col("event_id") % 4).alias("selected"),
        _letter(F.col("user_id") % 4).alias("correct"),
    )


def llm_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.6 — stored reply attempts from the assistant turns of ``conversations``.

    One row per attempt: ``(request_id, parse_attempt, http_try, status, raw_body)``
    plus the request's ``topic`` and ``difficulty`` (derived from the id).
    """
    conv = _assistant_turns(spark, sf_dir)
    kind = ((F.col("conv_id") + F.col("turn")) % 5).cast("int")
    qjson = _question_json(_letter(F.col("turn") % 4))
    inner = (F.when(kind == 0, qjson)
             .when(kind == 1, F.concat(F.lit("```json\n"), qjson, F.lit("\n```")))
             .when(kind == 2, F.substring(qjson, 1, (F.length(qjson) / 2).cast("int")))
             .when(kind == 3, F.lit("   "))
             .otherwise(F.lit("")))
    return conv.select(
        F.col("conv_id").alias("request_id"),
        F.col("attempt").cast("int").alias("parse_attempt"),
        F.lit(1).alias("http_try"),
        F.when(kind == 4, F.lit(C.RETRY_STATUS)).otherwise(F.lit(200)).alias("status"),
        F.when(kind == 4, F.lit("")).otherwise(_body(_block("text", inner))).alias("raw_body"),
        *_request_columns(),
    )


def _assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turns with ``attempt``, their number in the conversation, block by
    block for a conversation with very many turns."""
    from ..operators.ordered import ordered_prefix
    conv = (read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
            .select("conv_id", "turn", "text", F.lit(1).alias("_one")))
    return ordered_prefix(conv, "conv_id", ["turn"], "_one", [F.floor(F.col("turn") / 65_536)], number="attempt")


def _question_json(answer, last_option: bool = True) -> F.Column:
    options = [F.lit("A"), F.concat(F.lit("first "), F.col("turn").cast("string")),
               F.lit("B"), F.concat(F.lit("second "), F.col("conv_id").cast("string")), F.lit("C"), F.lit("third")]
    if last_option:
        options += [F.lit("D"), F.lit("none")]
    return F.to_json(F.named_struct(F.lit("question"), F.col("text"), F.lit("options"), F.create_map(*options),
                                    F.lit("answer"), answer))


def _block(kind: str, text) -> F.Column:
    return F.named_struct(F.lit("type"), F.lit(kind), F.lit("text"), text)


def _body(*blocks) -> F.Column:
    return F.to_json(F.named_struct(F.lit("content"), F.array(*blocks)))


def _request_columns() -> list[F.Column]:
    return [F.element_at(F.array(*[F.lit(t) for t in C.TOPICS]), (F.col("conv_id") % 5).cast("int") + 1).alias("topic"),
            F.element_at(levels_array(), (F.col("conv_id") % 3).cast("int") + 1).alias("difficulty")]


def llm_attempts_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.6 with every outcome: three HTTP tries an attempt, statuses 200, 500, 502 and
    none, bodies that are no JSON, hold no content, an array, a block of another type
    first, an answer outside A-D or three options."""
    conv = _assistant_turns(spark, sf_dir)
    kind = ((F.col("conv_id") * 7 + F.col("turn")) % 13).cast("int")
    good = _question_json(_letter(F.col("turn") % 4))
    body = (F.when(kind == 0, _body(_block("text", good)))
            .when(kind == 1, _body(_block("text", F.concat(F.lit("```json\n"), good, F.lit("\n```")))))
            .when(kind == 2, _body(_block("text", F.substring(good, 1, (F.length(good) / 2).cast("int")))))
            .when(kind == 3, _body(_block("text", F.lit("   "))))
            .when(kind == 4, F.lit("")).when(kind == 5, F.lit("overloaded")).when(kind == 6, F.lit(None).cast("string"))
            .when(kind == 7, _body(_block("text", F.lit("[1, 2]"))))
            .when(kind == 8, F.lit("oops"))
            .when(kind == 9, _body(_block("text", _question_json(F.lit("E")))))
            .when(kind == 10, _body(_block("text", _question_json(F.lit("A"), last_option=False))))
            .when(kind == 11, F.lit('{"content":[]}'))
            .otherwise(_body(_block("image", F.lit("x")), _block("text", good))))
    status = (F.when(kind == 4, F.lit(C.RETRY_STATUS)).when(kind == 5, F.lit(500)).when(kind == 6, F.lit(None).cast("int"))
              .otherwise(F.lit(200)))
    return conv.select(
        F.col("conv_id").alias("request_id"), (F.floor((F.col("attempt") - 1) / 3) + 1).cast("int").alias("parse_attempt"),
        ((F.col("attempt") - 1) % 3 + 1).cast("int").alias("http_try"), status.alias("status"), body.alias("raw_body"), *_request_columns())


def padded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.2 as typed: names with blanks of several kinds around them, blank ones, none."""
    c = read_table(spark, sf_dir, "customer")
    name, key = F.col("c_name"), F.col("c_custkey")
    return c.select(F.when(key % 11 == 0, F.lit(None).cast("string")).when(key % 7 == 0, F.concat(F.lit(" "), F.char(F.lit(9))))
                    .when(key % 3 == 0, F.concat(F.lit("  "), name, F.char(F.lit(10)))).when(key % 3 == 1, F.concat(F.char(F.lit(9)), name))
                    .otherwise(name).alias("student_name"))


def responses_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses with letters missing (quantity 49) and questions that the
    bank does not hold (quantity 50), for the reject outputs."""
    r = responses(spark, sf_dir)
    return (r.withColumn("selected_raw", F.when(F.col("quantity") != 49, F.col("selected_raw")))
            .withColumn("question_id", F.when(F.col("quantity") == 50, -F.col("question_id")).otherwise(F.col("question_id"))))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the presentations and a second click on every third: a later
    one with another letter, on time or not."""
    p = presentations(spark, sf_dir)
    first = p.select("qid", "answered_at", "selected")
    second = p.where(F.col("qid") % 3 == 0).select(
        "qid", F.timestamp_add("SECOND", F.lit(3), F.col("answered_at")).alias("answered_at"),
        F.when(F.col("selected") == "A", F.lit("B")).otherwise(F.lit("A")).alias("selected"))
    return first.unionByName(second)
