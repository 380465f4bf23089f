"""Session construction and lineage cuts.

The library never assumes a particular cluster. It reads what the session already
has (``spark.checkpoint.dir`` in particular) and only fills in defaults where a
setting is missing, which is the case for local tests.
"""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "pairshift",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session; a default below is set only where nothing was submitted, the arguments always.

    AQE stays on so that shuffle partitions are coalesced at runtime and skewed
    joins are split; the web UI is off because nothing here needs a server.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Text stages are CPU-heavy per byte (regex, md5, array lambdas): keep
        # small post-shuffle partitions instead of coalescing them into one task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("PAIRSHIFT_DRIVER_MEMORY", "16g"),
    }
    given = dict(extra or {})
    if shuffle_partitions is not None:
        given["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    submitted = _submitted()
    for k, v in {**{k: v for k, v in conf.items() if k not in submitted}, **given}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def _submitted() -> set[str]:
    """Names of the settings that are there already: of the running context, or of the submitted command."""
    if SparkContext._active_spark_context is not None:
        return {k for k, _ in SparkContext._active_spark_context.getConf().getAll()}
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its JVM knows them
        SparkContext._ensure_initialized()
        return {k for k, _ in SparkConf().getAll()}
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    names = {args[i + 1].split("=", 1)[0] for i, a in enumerate(args[:-1]) if a in ("--conf", "-c")}
    return names | ({"spark.driver.memory"} if "--driver-memory" in args else set())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only when nothing is configured on a local master (tests) is a fresh scratch folder made; on a cluster a
    machine-local folder would lose rows, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pairshift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table under the checkpoint folder.

    One pass (a reliable ``checkpoint()`` of an unpersisted plan computes it
    twice), columnar and compressed, and readable by every executor. Used
    where a result feeds several later stages and must be identical in each
    of them (e.g. positions derived from physical partitioning), and to keep
    recovery after executor loss from replaying a long plan.
    """
    path = shared_path(df.sparkSession, name)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, which ``cleanup_materialized`` removes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairshift-{name}-{uuid.uuid4().hex}"
    _MATERIALIZED.append(path)
    return path


_MATERIALIZED: list[str] = []


def materialized_paths() -> list[str]:
    """Tables written by ``materialize`` in this process (oldest first)."""
    return list(_MATERIALIZED)


def cleanup_materialized(spark: SparkSession) -> int:
    """Delete the tables this process materialised (call once their results are consumed).

    Uses the Hadoop FileSystem of each path, so it works for shared storage as
    well as local folders. Returns the number of tables removed.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _MATERIALIZED:
        p = jvm.org.apache.hadoop.fs.Path(_MATERIALIZED.pop())
        if p.getFileSystem(conf).delete(p, True):
            removed += 1
    return removed
