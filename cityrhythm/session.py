"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. Shuffle partitions are sized for the
# local test box; on a cluster pass a number matching the data (AQE coalesces
# small partitions and splits skewed ones at runtime either way).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast is decided from plan statistics (file sizes / exact sizes of
    # literal dimensions) and at runtime from measured shuffle sizes; both are
    # size-checked against these limits (static: Spark's 10 MB default).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # compiled whole-stage code is reused across repeated report queries
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "cityrhythm",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the platform and is shared by all
    executors; it is only read here (and its absence is an error). Only in
    local mode, when it is unset (tests), a fresh folder is created and
    registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:       # a remote (Spark Connect) session: the server's setting applies
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("spark.checkpoint.dir is not set on the server") from None
        return current
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        # executors cannot see a folder on the driver's disk
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for the cluster")
    local = tempfile.mkdtemp(prefix="cityrhythm-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def work_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cityrhythm/{name}"


def cluster_sizing(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Scan and shuffle sizing for a job reading ``input_bytes`` on ``total_cores``.

    * scan splits: at least three waves of tasks over all cores, each split
      between 128 MB and 1 GB (a split's decoded columns must fit a task's
      memory share);
    * shuffles: plans aggregate map-side, so post-shuffle data is small; the
      initial partition count follows the input (256 MB per partition, at
      least one per core), AQE then coalesces to ~256 MB partitions and splits
      any partition over 1 GB that is 5x the median (skew join).
    Pass the result as ``build_session(extra=...)``.
    """
    mb = 1024 * 1024
    split = min(max(input_bytes // max(3 * total_cores, 1), 128 * mb), 1024 * mb)
    parts = max(total_cores, input_bytes // (256 * mb))
    return {
        "spark.sql.files.maxPartitionBytes": str(int(split)),
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(int(parts)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    }


def default_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
