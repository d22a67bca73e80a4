"""Structured Streaming operators.

Sources are file folders (Parquet) with explicit schemas. T1 writes through Spark's
file sink; T2 and T3 write each micro-batch under its own name, so a batch that is
replayed after a failure overwrites itself (exactly once across restarts). Tests and
the registered queries run with ``availableNow``; pass ``processing_time`` (e.g.
"30 seconds") to start a continuous query and get its handle back.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from .. import config as C
from ..operators import sessions as S
from ..schemas import ANSWER_SCHEMA
from ..sources import answer_log

SHOWN_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType(), True),
    T.StructField("session_id", T.LongType(), True),
    T.StructField("shown_at", T.TimestampNTZType(), True),
    T.StructField("correct", T.StringType(), True),
])
ANSWERED_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType(), True),
    T.StructField("answered_at", T.TimestampNTZType(), True),
    T.StructField("selected", T.StringType(), True),
])
TOPIC_STATE_SCHEMA = "student_name string, topic string, total bigint, correct bigint"
TIMED_SCHEMA = T.StructType([*SHOWN_SCHEMA.fields, *ANSWERED_SCHEMA.fields[1:]])


def _stream_session(spark: SparkSession, state_partitions: int | None) -> SparkSession:
    """A session for one stateful stream. The number of state partitions is
    fixed by ``spark.sql.shuffle.partitions`` when a checkpoint is created;
    a separate session (same SparkContext) sets it without changing the
    caller's session. Restarts keep the checkpoint's own value."""
    if state_partitions is None:
        return spark
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", str(int(state_partitions)))
    return s


def _run(writer, processing_time: str | None = None):
    """``processing_time=None``: process what is there now and stop (tests,
    batch-like runs). Otherwise start a continuous query with that trigger
    interval and return its handle without waiting."""
    if processing_time is None:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.trigger(processingTime=processing_time).start()


# small files beside a sink, hidden from scans by the underscore

def _path(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _mark(spark: SparkSession, name: str) -> None:
    p, fs = _path(spark, name)
    fs.create(p, True).close()


def _delete(spark: SparkSession, name: str) -> None:
    p, fs = _path(spark, name)
    fs.delete(p, True)


# ----------------------------------------------------------------- T2

def answer_append_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                         processing_time: str | None = None):
    """T2 — every arriving answer is normalised (S2), gets an id if it has none
    and is appended to the log that batch writers use too (``answer_log.scan``). A
    micro-batch is an append named after the stream and its number: a replay writes
    the same rows with the same ids over themselves."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, batch_id: int) -> None:
        answer_log.append(batch, sink, batch=f"{stream}-{batch_id}")

    w = (spark.readStream.schema(ANSWER_SCHEMA).parquet(source).writeStream
         .option("checkpointLocation", checkpoint).foreachBatch(add))
    return _run(w, processing_time)


# ----------------------------------------------------------------- T3

def topic_accuracy_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                          processing_time: str | None = None, state_partitions: int | None = None,
                          compact_every: int | None = None):
    """T3 — running (student, topic) totals over the whole history.

    Update mode: each micro-batch emits only the keys it changed, written to a folder
    of its own (``log/batch_id=N``; a replay overwrites it). The current table is the
    latest row per key, see ``topic_accuracy_snapshot``. State is bounded by the number
    of (student, topic) keys; no watermark since all history counts. With
    ``compact_every`` the log is folded into a snapshot after every so many batches.
    """
    spark = _stream_session(spark, state_partitions)
    src = spark.readStream.schema(ANSWER_SCHEMA).parquet(source)
    agg = src.groupBy("student_name", "topic").agg(
        F.count(F.lit(1)).alias("total"), F.sum("is_correct").cast("bigint").alias("correct"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/log/batch_id={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_topic_accuracy(spark, sink)

    w = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(upsert))
    return _run(w, processing_time)


def _versions(spark: SparkSession, sink: str) -> list[int]:
    """Numbers of the finished snapshots, oldest first (a snapshot counts once its
    marker is there)."""
    return sorted(int(n) for n in _names(spark, f"{sink}/_versions"))


def _batches(spark: SparkSession, sink: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, f"{sink}/log") if n.startswith("batch_id="))


def _current_keys(spark: SparkSession, sink: str, base: int | None, batches: list[int]) -> DataFrame:
    rows = []
    if base is not None:
        rows.append(spark.read.schema(TOPIC_STATE_SCHEMA).parquet(f"{sink}/snapshot/upto={base}").withColumn("batch_id", F.lit(base).cast("bigint")))
    if any(base is None or b > base for b in batches):
        after = spark.read.schema(f"{TOPIC_STATE_SCHEMA}, batch_id bigint").parquet(f"{sink}/log")
        rows.append(after.where(F.col("batch_id").between(-1 if base is None else base + 1, batches[-1])))  # prunes folders
    if not rows:
        return spark.createDataFrame([], TOPIC_STATE_SCHEMA)
    log = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    # hash aggregates of whole numbers
    latest = log.groupBy("student_name", "topic").agg(F.max_by("total", "batch_id").alias("total"),
                                                      F.max_by("correct", "batch_id").alias("correct"))
    return latest.select("student_name", "topic", "total", "correct")


def topic_accuracy_snapshot(spark: SparkSession, sink: str) -> DataFrame:
    """The current accuracy table: the last snapshot (a row a key) and the batches after it."""
    done = _versions(spark, sink)
    return _current_keys(spark, sink, done[-1] if done else None, _batches(spark, sink))


def compact_topic_accuracy(spark: SparkSession, sink: str) -> int | None:
    """Fold the log into a snapshot and return the last batch in it. The marker, written
    last, switches readers over; what the snapshot before it had replaced is deleted only
    now, so a reader that began before the switch still finds all its files. A
    compaction that broke off leaves no marker and is done again."""
    done, batches = _versions(spark, sink), _batches(spark, sink)
    base = done[-1] if done else None
    if not batches or base is not None and batches[-1] <= base:
        return base
    _current_keys(spark, sink, base, batches).write.mode("overwrite").parquet(f"{sink}/snapshot/upto={batches[-1]}")
    _mark(spark, f"{sink}/_versions/{batches[-1]:020d}")
    if base is not None:
        for b in (b for b in batches if b <= base):
            _delete(spark, f"{sink}/log/batch_id={b}")
    for old in done[:-1]:
        _delete(spark, f"{sink}/_versions/{old:020d}")
        _delete(spark, f"{sink}/snapshot/upto={old}")
    return batches[-1]


# ----------------------------------------------------------------- T1

def timed_answer_stream(spark: SparkSession, shown_dir: str, answered_dir: str, sink: str,
                        checkpoint: str, deadline: int = C.ANSWER_DEADLINE_SECONDS,
                        lateness: str = "1 minute", processing_time: str | None = None,
                        state_partitions: int | None = None):
    """T1 — stream-stream left outer join of shown questions with the answers that
    arrive within the deadline: a row per on-time answer, and a timeout once the
    watermark passes an unmatched question's deadline. The deadline is applied
    before anything is reduced; ``timed_answer_snapshot`` reads the current table
    (second and repeated clicks reduced to the earliest on-time one). The watermark is
    kept beside the sink, so that the snapshot can tell open questions from late ones."""
    spark = _stream_session(spark, state_partitions)
    # watermarks need TIMESTAMP (session time zone); the NTZ columns are kept for output
    shown = (spark.readStream.schema(SHOWN_SCHEMA).parquet(shown_dir)
             .withColumn("shown_ts", F.col("shown_at").cast("timestamp"))
             .withWatermark("shown_ts", lateness))
    answered = (spark.readStream.schema(ANSWERED_SCHEMA).parquet(answered_dir)
                .withColumn("answered_ts", F.col("answered_at").cast("timestamp"))
                .withWatermark("answered_ts", lateness))
    s, a = shown.alias("s"), answered.alias("a")
    limit = F.col("s.shown_ts") + F.expr(f"INTERVAL {int(deadline)} SECONDS")
    cond = ((F.col("s.qid") == F.col("a.qid")) & (F.col("a.answered_ts") >= F.col("s.shown_ts"))
            & (F.col("a.answered_ts") < limit))
    out = s.join(a, cond, "leftOuter").select(
        "s.qid", "s.session_id", "s.shown_at", "s.correct", "a.answered_at", "a.selected")
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink))
    query = _run(w, processing_time)
    if processing_time is None:
        for progress in query.recentProgress:
            _keep_watermark(spark, sink, progress)
    else:
        spark.streams.addListener(_WatermarkKeeper(spark, sink, str(query.id)))
    return query


WATERMARK = "%Y-%m-%dT%H:%M:%S.%fZ"  # as progress reports print it, UTC


def _keep_watermark(spark: SparkSession, sink: str, progress) -> None:
    text = (progress.eventTime if hasattr(progress, "eventTime") else progress["eventTime"]).get("watermark")
    if text:
        at = dt.datetime.strptime(text, WATERMARK).replace(tzinfo=dt.timezone.utc)
        millis = (at - dt.datetime.fromtimestamp(0, dt.timezone.utc)) // dt.timedelta(milliseconds=1)
        if millis > (stored_watermark(spark, sink) or 0):
            _mark(spark, f"{sink}_watermark/{millis}")


class _WatermarkKeeper(StreamingQueryListener):
    """Keeps the watermark of a continuous query beside its sink."""

    def __init__(self, spark, sink, query):
        self.spark, self.sink, self.query = spark, sink, query

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if str(event.progress.id) == self.query:
            _keep_watermark(self.spark, self.sink, event.progress)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def stored_watermark(spark: SparkSession, sink: str) -> int | None:
    """The largest watermark that a batch of the sink's stream ran with, in milliseconds.
    It is written after the batch, so it is never ahead of the output."""
    return max((int(n) for n in _names(spark, f"{sink}_watermark")), default=None)


def timed_answer_snapshot(spark: SparkSession, sink: str, shown_dir: str | None = None,
                          answered_dir: str | None = None, deadline: int = C.ANSWER_DEADLINE_SECONDS) -> DataFrame:
    """One row a question from the sink of ``timed_answer_stream``: questions with an
    on-time answer, and timeouts of questions whose deadline the watermark has passed.

    With the input folders, rows that the stream dropped because they came behind its
    watermark are brought in: a question shown too late for it is settled, and an answer
    that came after its question was settled still counts. A question that is open (no
    on-time answer yet, deadline not behind the watermark) is not reported. So at every
    watermark the result is the batch match J6 over the input so far, without the open
    questions. Only clicks that are not in the sink are matched again."""
    key = SHOWN_SCHEMA.names
    click = F.struct("answered_at", "selected")
    rows = spark.read.schema(TIMED_SCHEMA).parquet(sink)
    found = rows.select(*key, F.when(F.col("answered_at").isNotNull(), click).alias("click"), F.col("answered_at").isNull().alias("settled"))
    if shown_dir is not None:
        shown = spark.read.schema(SHOWN_SCHEMA).parquet(shown_dir)
        answered = spark.read.schema(ANSWERED_SCHEMA).parquet(answered_dir)
        known = rows.where(F.col("answered_at").isNotNull()).select(*ANSWERED_SCHEMA.names)
        missed = S.on_time_clicks(shown, answered.join(known, ANSWERED_SCHEMA.names, "left_anti"), deadline)
        millis = stored_watermark(spark, sink)
        mark = F.timestamp_millis(F.lit(-1 if millis is None else millis)).cast("timestamp_ntz")
        closed = F.coalesce(S.deadline_of("shown_at", deadline) <= mark, F.lit(False))
        found = (found.unionByName(missed.select(*key, "click", F.lit(False).alias("settled")))
                 .unionByName(shown.select(*key, F.lit(None).cast(missed.schema["click"].dataType).alias("click"), closed.alias("settled"))))
    each = found.groupBy(*key).agg(F.min("click").alias("click"), F.max("settled").alias("settled"))
    return S.timed_columns(each.where(F.col("click").isNotNull() | F.col("settled")))
