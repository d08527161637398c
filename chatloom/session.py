"""Session set-up and the few settings that the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "chatloom", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the session that the cluster gives.

    UTC is not a matter of taste: naive timestamps mean UTC throughout the engine.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHATLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given tables, by the path that Spark's readers get."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, wherever the driver was started; done once a session."""
    if spark.conf.get("chatloom.shipped", "") == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    there = Path(tempfile.mkdtemp(prefix="spark-package-"))  # the driver serves it from here to executors that come later
    atexit.register(shutil.rmtree, there, ignore_errors=True)
    packed = there / "chatloom_package.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for module in sorted(root.rglob("*.py")):
            z.write(module, module.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    spark.conf.set("chatloom.shipped", spark.sparkContext.applicationId)
