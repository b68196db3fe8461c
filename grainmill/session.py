"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app_name: str = "grainmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# What Spark hands to Python at once. A task's worker holds a batch, and a part of what it makes.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of BATCH_BYTES at most, if it does not already.

    Up to a full batch a worker's memory grows with the rows of a task, so a batch should be small.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = str(spark.conf.get(key))
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


# The folder that a local session without a checkpoint folder uses; settings of a running session
# cannot be changed.
_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path for intermediate tables, under the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names storage that every executor sees and that outlives any of
    them. A temporary local folder is used only in local mode, where there is one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="grainmill-")
        root = _local_scratch[app]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
