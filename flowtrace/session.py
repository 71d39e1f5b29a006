"""Session construction and the shared folder.

The library never creates its own SparkSession on a cluster: every
operator takes DataFrames and uses the session they belong to. ``get_session``
is a convenience for tests, ``bench.py`` and local runs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every run relies on: UTC wall clock (block times are UTC),
# adaptive execution for runtime re-planning, ANSI arithmetic.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Remove checkpoint files once the DataFrame that wrote them is gone, so
    # repeated runs do not pile up data in the shared checkpoint folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_settings(input_bytes: int, total_cores: int,
                   target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of Parquet on
    ``total_cores`` executor cores.

    Shuffle partitions start at enough ~256 MiB partitions for the whole
    input (and at least three waves of tasks); AQE coalesces them to the
    advisory size after each stage and splits skewed ones, so the number is
    an upper bound rather than a guess, and a task's share stays bounded at
    any size. Scan splits use the same size. Where map-status bookkeeping
    matters more, pass a larger ``target_partition_bytes``.
    """
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flowtrace", settings: dict[str, str] | None = None
                ) -> SparkSession:
    """Build (or fetch) a session with the library defaults; ``settings``
    (e.g. from :func:`scale_settings`) are applied on top."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(settings or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` (or a folder already set on the context) wins.
    Only a local-mode session without one gets a fresh scratch folder; on a
    cluster a machine-local folder would not survive executor loss, so the
    setting is required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "(HDFS/S3/ABFS) so checkpointed lineage survives executor loss")
    folder = tempfile.mkdtemp(prefix="flowtrace-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
