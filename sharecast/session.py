"""Session and shared-folder helpers.

Checkpoints and written tables go to the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (local runs, tests)
a private temporary folder is created.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "sharecast") -> SparkSession:
    """Local session for tests, bench and examples (UI off, AQE on, UTC)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    builder = SparkSession.builder
    event_dir = os.environ.get("SHARECAST_EVENT_LOG_DIR")
    if event_dir:   # stage/task timings for offline reading (no UI server)
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_dir))
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.retainedJobs", os.environ.get("SHARECAST_RETAINED", "200"))
        .config("spark.ui.retainedStages", os.environ.get("SHARECAST_RETAINED", "200"))
        .config("spark.sql.ui.retainedExecutions", os.environ.get("SHARECAST_RETAINED", "200"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` and written tables have a shared target;
    return the base folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Without that
    setting a private temporary folder is created — but only in local mode:
    on a cluster a machine-local folder would not be shared, so it is an error.
    """
    sc = spark.sparkContext
    base = _configured_dir(spark)
    one_machine = re.fullmatch(r"local(\[.*\])?", sc.master) is not None
    if base is None and sc.getCheckpointDir() is not None:
        base = os.path.dirname(sc.getCheckpointDir().rstrip("/"))
        if not one_machine and re.match(r"(file:|/)", base):
            raise ValueError(f"{base} is a machine's own folder; set spark.checkpoint.dir to one shared by the cluster")
    if base is None:
        if not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="sharecast-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/sharecast-tables/{name}-{uuid.uuid4().hex}"
