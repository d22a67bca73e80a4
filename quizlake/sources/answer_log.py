"""The answer log on storage.

Layout: Parquet under one folder, partitioned by ``answer_date``,
``schema_version`` (1 = written before ``difficulty`` existed, 2 = current) and
``batch`` (one value an append). An append overwrites the partitions of its own
batch alone, so a batch that is written again adds nothing: batch and streaming
writers share one folder. Readers pass the schema explicitly (no inference) and
let Catalyst push student filters and date ranges into the scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..schemas import ANSWER_SCHEMA
from .log_ids import IdMarks, dense_ids

CURRENT_VERSION = 2
LOG_SCHEMA = T.StructType(ANSWER_SCHEMA.fields + [
    T.StructField("answer_date", T.DateType(), True),
    T.StructField("schema_version", T.IntegerType(), True),
])
PARTITIONS = ["answer_date", "schema_version", "batch"]
ID_ORDER = ["answered_at", "student_name", "topic", "question", "is_correct"]  # newer answers get larger ids


def _truthy(c: F.Column, dtype: T.DataType) -> F.Column:
    """N19 — ``1 if is_correct else 0`` for booleans, numbers and text."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit(1)).otherwise(F.lit(0))
    if isinstance(dtype, T.StringType):
        return F.when(c.isNotNull() & (c != ""), F.lit(1)).otherwise(F.lit(0))
    return F.when(c.isNotNull() & (c != 0), F.lit(1)).otherwise(F.lit(0))


def normalise(df: DataFrame, version: int = CURRENT_VERSION) -> DataFrame:
    """S2 — one log row per answer: 0/1 correctness, default difficulty when the
    column is omitted (an explicit NULL stays NULL), stamp ``now`` when no time. The
    id is NULL where the answer carries none; ``append`` fills it."""
    types = {f.name: f.dataType for f in df.schema.fields}
    diff = F.col("difficulty") if "difficulty" in types else F.lit(C.DEFAULT_DIFFICULTY)
    ts = F.coalesce(F.col("answered_at"), F.localtimestamp()) if "answered_at" in types else F.localtimestamp()
    cols = [
        F.col("id").cast("bigint").alias("id") if "id" in types else F.lit(None).cast("bigint").alias("id"),
        F.col("student_name").cast("string").alias("student_name"),
        F.col("topic").cast("string").alias("topic"),
        F.col("question").cast("string").alias("question"),
        _truthy(F.col("is_correct"), types["is_correct"]).alias("is_correct"),
    ]
    if version >= 2:
        cols.append(diff.cast("string").alias("difficulty"))
    cols += [ts.alias("answered_at")]
    out = df.select(*cols)
    return (out.withColumn("answer_date", F.to_date("answered_at"))
               .withColumn("schema_version", F.lit(version)))


def _number(rows: DataFrame, marks: IdMarks, batch: str, carried) -> DataFrame:
    """S9 — fill the ids of normalised rows from the log's sequence."""
    dealt = dense_ids(rows, [c for c in [*ID_ORDER, "difficulty"] if c in rows.columns])
    first = marks.reserve(dealt.count(), batch, carried)
    return dealt.withColumn("id", F.col("id") + F.lit(first))


def _parts(df: DataFrame, version: int, marks: IdMarks, batch: str, carried):
    """(batch, rows) to write: the rows that carry an id, then those that get one."""
    rows = normalise(df, version)
    missing, last = True, None
    if "id" in df.columns:
        last, missing = rows.agg(F.max("id"), F.count_if(F.col("id").isNull())).first()
        yield batch, rows.where("id IS NOT NULL")
    if last is not None:
        if marks.newest()[1] is None:
            last = max(last, carried() or 0)
        marks.raise_to(last)
    if missing:
        yield f"{batch}-numbered", _number(rows.where("id IS NULL"), marks, batch, carried)


def append(df: DataFrame, path: str, version: int = CURRENT_VERSION, max_records_per_file: int = 5_000_000,
           batch: str | None = None) -> None:
    """S2 — append normalised rows; rows without an id get the next ones (S9). No
    repartition of rows that carry ids, so a hot date is written by every task that
    holds it. Appending the same ``batch`` again writes the same rows over themselves."""
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex

    def carried():
        log = spark.read.schema(LOG_SCHEMA)
        return log.parquet(path).agg(F.max("id")).first()[0] if _exists(spark, path) else None

    for name, rows in _parts(df, version, IdMarks(spark, path), batch, carried):
        (rows.withColumn("batch", F.lit(f"b-{name}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("maxRecordsPerFile", max_records_per_file).partitionBy(*PARTITIONS).parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# --- a table of the catalog -----------------------------------------------------

def create_if_absent(spark: SparkSession, table: str, path: str) -> list[str]:
    """S3 + S4 — idempotent table creation in the session catalog; a table that is
    older than a column of the log gets that column. Returns the added columns.

    An added ``difficulty`` reads as 'beginner' in the rows written before it (the
    column's default at that time), while an explicit NULL written later stays NULL."""
    default = {"difficulty": f" DEFAULT '{C.DEFAULT_DIFFICULTY}'"}
    ddl = {f.name: f"`{f.name}` {f.dataType.simpleString()}{default.get(f.name, '')}" for f in LOG_SCHEMA.fields}
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} ({', '.join(ddl.values())}) USING parquet "
                  f"PARTITIONED BY (answer_date, schema_version) LOCATION '{path}'")
        return []
    there = {c.lower() for c in spark.table(table).columns}
    missing = [n for n in ANSWER_SCHEMA.names if n not in there]
    if missing:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(ddl[n] for n in missing)})")
    return missing


def append_to_table(df: DataFrame, table: str) -> None:
    """S2 into a table of the catalog, also one made elsewhere: columns are matched by
    name (a column that the log does not have is NULL), ids continue the table's own."""
    spark = df.sparkSession
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    fields = spark.table(table).schema.fields

    def carried():
        return spark.table(table).agg(F.max("id")).first()[0]

    for _, rows in _parts(df, CURRENT_VERSION, IdMarks(spark, where), uuid.uuid4().hex, carried):
        have = set(rows.columns)
        rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)) \
            .write.mode("append").insertInto(table)


def compact(spark: SparkSession, src: str, dst: str, files: int) -> None:
    """Rewrite a log made of many small appends as about ``files`` files.
    Range partitioning on (answer_date, id) keeps each date's rows together
    but splits a hot date over several files instead of one task."""
    log = spark.read.schema(LOG_SCHEMA).parquet(src).select(*LOG_SCHEMA.names).withColumn("batch", F.lit("b-compacted"))
    log.repartitionByRange(files, "answer_date", "id").write.mode("overwrite").partitionBy(*PARTITIONS).parquet(dst)
    last = IdMarks(spark, src).newest()[1]
    if last is not None:
        IdMarks(spark, dst).raise_to(last)


def scan(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """S1 + S4 — read one or several log folders, every generation with one explicit
    schema; files written before ``difficulty`` existed read as 'beginner' (as SQLite's
    added default does), an explicit NULL written later stays NULL."""
    raw = spark.read.schema(LOG_SCHEMA).parquet(path, *more).select(*LOG_SCHEMA.names)
    return raw.withColumn(
        "difficulty",
        F.when(F.col("schema_version") < 2, F.coalesce("difficulty", F.lit(C.DEFAULT_DIFFICULTY)))
         .otherwise(F.col("difficulty")))


def clean_names(df: DataFrame, column: str = "student_name") -> DataFrame:
    """N1 + P10 — ``name.strip()``, and an empty name is rejected."""
    from ..functions.text import py_strip
    return df.withColumn(column, py_strip(column)).filter(F.col(column) != F.lit(""))


def union_logs(*frames: DataFrame) -> DataFrame:
    """U2 — main-quiz and practice answers into one log."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def recent_activity(answers: DataFrame, limit: int = C.RECENT_LIMIT_DEFAULT) -> DataFrame:
    """L3 + P11 — the newest answers by insertion id (top-k, no full sort)."""
    from ..functions.numeric import clamp_value
    from ..functions.text import correct_icon, iso_timestamp, pad_right
    k = clamp_value(limit)
    top = answers.orderBy(F.desc("id")).limit(k)
    line = F.concat(F.lit("  "), iso_timestamp("answered_at"), F.lit(" | "),
                    pad_right("student_name", 10), F.lit(" | "), pad_right("topic", 20),
                    F.lit(" | "), correct_icon("is_correct"))
    return top.select("id", "answered_at", "student_name", "topic",
                      correct_icon("is_correct").alias("icon"), line.alias("line"))
