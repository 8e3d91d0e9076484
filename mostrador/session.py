"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def settings_for(input_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle settings for a job that reads ``input_bytes``: start with enough partitions
    that each fits in memory, and let adaptive execution merge the small ones."""
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(2 * partition_bytes),
    }


def build_session(app: str = "mostrador", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only in local mode, where driver and
    executors are one process; on a cluster the setting must be present.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="mostrador-")
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def store_parts(spark: SparkSession, parts, name: str):
    """Write the DataFrames ``parts`` (one at least, of one schema) to one table in the shared folder, one after the other,
    and read it back."""
    path = scratch_path(spark, name)
    for df in parts:
        # Rows may be wide; without this a page is closed after 100 rows at the earliest and read back whole.
        df.write.mode("append").option("parquet.page.size.row.check.min", "4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(spark: SparkSession, df, name: str):
    """Write ``df`` to the shared folder and read it back: survives lost executors."""
    return store_parts(spark, [df], name)


@contextmanager
def held(spark: SparkSession, df, name: str):
    """``df`` written to the shared folder for as long as the block lasts, where ``persist`` would fill the executors' memory."""
    path = scratch_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
