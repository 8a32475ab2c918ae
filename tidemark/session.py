"""Session construction and shared scratch locations.

Every run that writes (replay input, sinks, checkpoints, round-trip tables)
gets its own directory below the cluster's shared checkpoint folder, read
from ``spark.checkpoint.dir``. Only when the session has none (unit tests on
a laptop) do we create a local one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every tidemark session wants. Event time is rendered and compared
# in UTC (F5 formats with a literal 'Z'), AQE re-plans shuffles at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = "local[*]",
    app_name: str = "tidemark",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    partition_bytes: str | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the tidemark defaults.

    ``master=None`` leaves the master to spark-submit, as on a cluster.
    Sizing is the caller's: ``shuffle_partitions`` and ``partition_bytes``
    (of scans and of AQE's merged partitions) are set only when given, so what
    spark-submit says holds. On a laptop (a ``local`` master named here)
    there are 8 shuffle partitions unless told otherwise. AQE merges small
    partitions, so for a large job set the count to its shuffle bytes / 128 MB.
    """
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = 8
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if partition_bytes is not None:
        conf["spark.sql.files.maxPartitionBytes"] = partition_bytes
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = partition_bytes
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("WARN")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Event-time rendering and NTZ<->LTZ casts assume a UTC session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _context(spark: SparkSession):
    """The SparkContext, or None where the session has none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # Connect sessions raise instead of returning one
        return None


def parallelism(spark: SparkSession) -> int:
    """Cores the cluster offers (``defaultParallelism``), at least 1."""
    sc = _context(spark)
    if sc is not None:
        return max(int(sc.defaultParallelism), 1)
    conf = spark.conf.get("spark.default.parallelism", None)
    return max(int(conf) if conf else os.cpu_count() or 1, 1)


def is_local(spark: SparkSession) -> bool:
    """Whether the driver is also the only executor."""
    sc = _context(spark)
    return sc is not None and sc.master.startswith("local") and "cluster" not in sc.master


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "app")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local session may do without: it gets a
    folder of its own, which on a cluster the executors would not share.
    """
    sc = _context(spark)
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return configured.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, never reused directory for one run (input, sink, checkpoint)."""
    return f"{shared_root(spark)}/tidemark/{label}-{uuid.uuid4().hex[:12]}"
