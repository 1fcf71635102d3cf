"""A session with the settings the operators assume."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Shuffles are dealt to at least this many parts, which Spark joins again up to these bytes for a task.
# Both bound what a task holds: with a fixed number of parts it would grow with the tables, and the bytes are counted
# compressed, where a sort holds twenty times as many.  A table of few compressed bytes is no small table in memory either,
# so it is broadcast from its file size only up to BROADCAST; what Spark has counted may be larger.
PARTS, TASK_BYTES = 512, "8m"
BROADCAST = "1m"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings any session can take: UTC, adaptive execution with skew-join handling, tasks of bounded size."""
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10MB"):   # a session's own stays
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST)
    for key, value in {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
                       "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
                       "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
                       "spark.sql.adaptive.skewJoin.enabled": "true",
                       "spark.sql.adaptive.coalescePartitions.enabled": "true"}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
             .config("spark.sql.shuffle.partitions", str(partitions or cpus))
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Only a local session may make its own, where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, for clusters whose workers do not have it installed."""
    home = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="ship-"))   # the driver's own; Spark copies the archive to the workers
    archive = folder / "tidemark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    return spark
