"""Session settings for local runs, tests and the benchmark."""

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "levelmark") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEVELMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
