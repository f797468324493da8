"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"

OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shape reports keep one sample text per group.  String samples need the object hash
    # aggregate; the default of 128 groups per task would send it to a sort too early.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}


def build_session(app: str = "opslens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**OPTIONS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, or below the warehouse where the user has set only that.

    The default warehouse is a folder of the driver's machine, which only executors of a local master can read.
    """
    given = spark.sparkContext.getConf()
    base = spark.conf.get(CHECKPOINT_DIR, None) or given.get(CHECKPOINT_DIR)
    if not base and (given.contains(WAREHOUSE_DIR) or spark.sparkContext.master.split("[")[0] == "local"):
        base = spark.conf.get(WAREHOUSE_DIR, None)
    if not base:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
