"""A local session for tests, benchmarks and trials; on a cluster the session is given."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "tidemark", cores: str | int = 8, shuffle: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")  # small data, several cores
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())
