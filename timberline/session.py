"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rest on. All can be changed on a live session.
SESSION_CONF = {
    # timestamp_ntz columns hold UTC; casts to timestamp must not shift them.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Where stateful streams keep their state.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)

# Physical settings that suit log tables: let AQE size shuffles and split skew.
PHYSICAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not compile larger methods; without whole-stage code the many
    # expressions of an extraction run as small compiled ones (1.5 times faster).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Do not record the Python call site of every column: plans build faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session of one's own."""
    for key, value in [*SESSION_CONF.items(), STATE_STORE]:
        spark.conf.set(key, value)
    return spark


def require(spark: SparkSession) -> SparkSession:
    """Raise where a session lacks a setting that right results need; nothing is changed."""
    for key, value in SESSION_CONF.items():
        found = spark.conf.get(key, None)
        if found != value and not (key.endswith("timeZone") and found in ("Etc/UTC", "GMT", "Z")):
            raise RuntimeError(f"{key} is {found!r} and must be {value!r}: use build_session or prepare")
    return spark


def build_session(app: str = "timberline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PHYSICAL_CONF, **SESSION_CONF, **dict([STATE_STORE]), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or what
    ``SparkContext.setCheckpointDir`` was given. There is no other choice."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """File system and path of a name, by the session's own Hadoop settings."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()), named


_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. All such paths of a session are
    deleted when its driver ends; keep nothing there."""
    application = spark.sparkContext.applicationId
    if application not in _SCRATCH:
        root = f"{shared_root(spark)}/timberline/{application}-{uuid.uuid4().hex}"
        files, path = hadoop_path(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _SCRATCH[application] = re.sub("^file:/+", "file:///", files.makeQualified(path).toString())
    return f"{_SCRATCH[application]}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Freeze ``df`` in reliable storage, so recomputation cannot change it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Freeze ``df`` as a table below the scratch folder: the table and its path, for :func:`removed`.

    Unlike a checkpoint it can be given back at once, tells Spark its size, and carries nothing of the plan
    that made it, so plans of many rounds stay small."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`written` that nothing needs any more."""
    for path in paths:
        files, named = hadoop_path(spark, path)
        files.delete(named, True)
