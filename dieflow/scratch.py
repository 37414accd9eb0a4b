"""Tables in the folder that driver and executors share, to cut lineage; they go when the driver ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from dieflow.session import shared_dir


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before; the folder is then the cluster's to clean
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet and read again: a lost executor costs a reread, and a loop's plan doesn't grow."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dieflow-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
