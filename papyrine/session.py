"""A session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "papyrine", master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master or os.environ.get("PAPYRINE_MASTER"):
        builder = builder.master(master or os.environ["PAPYRINE_MASTER"])
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
