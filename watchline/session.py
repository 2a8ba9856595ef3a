"""Session defaults for local runs; on a cluster the session is given."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "watchline", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and as many shuffle partitions as cores."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    base = {
        "spark.sql.shuffle.partitions": n,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "watchline-checkpoints"),
    }
    builder = SparkSession.builder.master(f"local[{n}]").appName(name)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
