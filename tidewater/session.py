"""Spark session construction and the few session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here assumes.  They are session-scoped SQL confs, so they can
# be applied to a session the caller already owns (the driver's, a notebook's).
REQUIRED_CONF = {
    # A later key overrides an earlier one in map_concat.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Settings of the queries on documents (``tidewater.plans``); the training-data operators run
# with Spark's own, under which they were measured.
PLAN_CONF = {
    # HotSpot never compiles a method of more than 8,000 bytes of bytecode: a stage of long
    # expressions runs interpreted as one method, and many times faster as several.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows that are already sorted by the key are aggregated as they come, without a hash table
    # that falls back to a second sort
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


#: Tasks a core that small partitions are joined to at least: documents are rendered and parsed
#: after a shuffle of plain columns, so a task's time is no matter of the bytes it reads, and
#: with a task a core one that is left over doubles the time of its stage.
TASKS_PER_CORE = 4
MIN_TASKS = "spark.sql.adaptive.coalescePartitions.minPartitionNum"


def configure(spark: SparkSession, documents: bool = True) -> SparkSession:
    plan = PLAN_CONF | {MIN_TASKS: str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)}
    for key, value in (REQUIRED_CONF | (plan if documents else {})).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key in () if documents else plan:
        spark.conf.unset(key)
    return spark


def build_session(
    master: str | None = None,
    app: str = "tidewater",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local / test session.  On a cluster, pass the cluster's own master and let
    ``shuffle_partitions`` follow the data size (AQE coalesces small ones)."""
    master = master or os.environ.get("TIDEWATER_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEMORY", "16g"))
    )
    for key, value in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A cluster must name one: a machine-local folder would be lost with its executor, so
    an unset option is an error there.  Only a local master (tests, one machine) gets a
    scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidewater-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system for ``path`` (any store that Spark can write to)."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def qualified_path(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of its file system."""
    jpath, fs = _file_system(spark, path)
    return fs.makeQualified(jpath).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _file_system(spark, path)
    return fs.exists(jpath)


def remove_path(spark: SparkSession, path: str) -> None:
    jpath, fs = _file_system(spark, path)
    fs.delete(jpath, True)
