"""A session with the settings the queries assume; any other session with the same time zone works too."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of the widest tables are kilobytes: fewer of them in a batch keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.pyspark.udf.faulthandler.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("dieflow").config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder; elsewhere a
    missing setting is an error, since executors would not see each other's files.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="dieflow-scratch-"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to Python workers that have no path to it, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return spark
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.dirname(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="dieflow-ship-")), "dieflow.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("dieflow", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(at)
    return spark
