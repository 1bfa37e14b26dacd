"""Session construction and the shared checkpoint folder.

Library code never builds its own session: it receives one. ``get_spark`` is for
tests, scripts and the benchmark. ``checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir``; only a local-mode session without one gets a fresh
temporary folder (tests), never a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is known small; AQE re-plans from real sizes.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Checkpoint files of intermediates are removed once their RDDs are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Suggested settings for a large cluster (100 TB inputs); the session owner applies them.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "contentlake") -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``contentlake`` importable in executor Python workers (pandas UDFs), once per context.

    The package is zipped and added with ``addPyFile`` -- the same mechanism as ``--py-files``."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext in the client
        sc = None
    key = id(sc) if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    import zipfile

    import contentlake
    pkg_dir = os.path.dirname(os.path.abspath(contentlake.__file__))
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="contentlake-")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> None:
    """Settings every registered query relies on (UTC wall clock, AQE) and the package on executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    ship_package(spark)


def materialize(df):
    """Compute a (small) intermediate once and cut its lineage: ``checkpoint()`` into the shared
    ``spark.checkpoint.dir`` (reliable storage, so a lost executor does not recompute it)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session. Only a local-mode session
    without it gets a new temporary folder; on a cluster a missing setting is an
    error, since a machine-local folder would not survive a lost executor.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint setting
        if not d:
            raise RuntimeError("spark.checkpoint.dir must be set for this session") from None
        return d
    if not d:
        d = sc.getCheckpointDir()
    if d:
        sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="contentlake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d
