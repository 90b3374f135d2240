"""Session helpers.

On a cluster the session is built by the platform; ``configure`` only sets
SQL knobs the operators rely on.  ``local_session`` is for tests and the
bench.  Shared scratch space (checkpoints, materialised intermediates) is
always taken from ``spark.checkpoint.dir``; only a local session without one
gets a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # all timestamps in the ledger contract are zone-less (timestamp_ntz)
    "spark.sql.session.timeZone": "UTC",
}


MB = 1 << 20


def scale_conf(input_bytes: int, partition_bytes: int = 256 * MB,
               min_partitions: int = 200) -> dict[str, str]:
    """Shuffle / split sizing for a job reading ``input_bytes``.

    The initial shuffle partition count is sized so that a shuffle of the
    whole input (W1, the only operator that shuffles every line) lands at
    about ``partition_bytes`` per task; AQE coalesces the small shuffles of
    the pre-aggregated operators down to the advisory size and splits
    skewed join partitions.
    """
    parts = max(min_partitions, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    if input_bytes:
        for k, v in scale_conf(input_bytes).items():
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fundflow") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:  # classic sessions only; Spark Connect has no SparkContext
        return spark.sparkContext
    except Exception:
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, as the session names it.

    Where it names none, a local master gets a folder of its own; on a
    cluster that is an error, as executors share no local folder.
    """
    sc = _context(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all "
                               "executors share")
        path = tempfile.mkdtemp(prefix="fundflow-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
