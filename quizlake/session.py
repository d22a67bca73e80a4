"""Session construction and the shared scratch location.

Library code never creates its own session; tests and bench.py do, through
``build_session``. Scratch output (stream checkpoints, written tables that cut
lineage) goes under the cluster's ``spark.checkpoint.dir``. Only a session on a
local master may go without it (tests); on a cluster a machine-local folder
would not be shared, so a missing setting is an error there.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


# Settings for a large cluster (e.g. 1,000 executors over ~100 TB of logs).
# AQE starts from many shuffle partitions and coalesces them to the advisory
# size, splits skewed join partitions, and picks broadcast joins only from
# runtime sizes under the threshold. These are applied by the deployment,
# not by library code.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",          # ~100 TB / 5 GB; AQE coalesces down
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app: str = "quizlake",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    if not master.startswith("local"):
        settings = dict(CLUSTER_SETTINGS)
        if shuffle_partitions:
            settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIZLAKE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory; a local one is set only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not target:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        target = tempfile.mkdtemp(prefix="quizlake-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory, removed by
    ``clean_scratch`` or when the driver process ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/quizlake/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = []
        atexit.register(clean_scratch, spark)
    _SCRATCH[app].append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh table name in the session catalog, dropped with the scratch folders."""
    table = f"quizlake_{name}_{uuid.uuid4().hex[:12]}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def clean_scratch(spark: SparkSession) -> int:
    """Delete this application's scratch folders; frames that read them end
    here too. Returns how many were given out since the last call."""
    sc = spark.sparkContext
    if sc._jsc is None:  # already stopped
        return 0
    paths, _SCRATCH[sc.applicationId] = _SCRATCH.get(sc.applicationId, []), []
    for table in _TABLES.pop(sc.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and read it back: cuts
    the lineage, survives lost executors and computes the plan a single time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the table of a frame that ``stage`` returned and that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _SCRATCH[sc.applicationId].remove(df._staged_at)
