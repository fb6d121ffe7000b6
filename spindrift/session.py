"""Sessions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "spindrift", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution and ANSI semantics; on a cluster, pass your own session instead."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Shuffled joins of large scans get Bloom filters of the other side's keys while they run.
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
