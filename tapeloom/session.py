"""Session construction for local runs and tests; clusters bring their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "tapeloom", **conf: str) -> SparkSession:
    """A local session with the settings the engine's results rely on (UTC, adaptive plans)."""
    base = {
        "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("TAPELOOM_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
