"""Latency and accuracy while the stream runs: by windows of time, in parts that merge.

Times are event times in microseconds; a watermark says how late a row may be.
What comes later than that isn't counted, as its window is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.operators.metrics import histogram
from dieflow.patterns import UNKNOWN
from dieflow.streaming.pipeline import stages


def _timed(rows: DataFrame, at_us: str, late: str, name: str = "on_time") -> DataFrame:
    return rows.withColumn(name, F.timestamp_micros(at_us)).withWatermark(name, late)


def latency_windows(verdicts: DataFrame, width: str = "1 minute", late: str = "10 minutes", at_us: str = "scheduled_us") -> DataFrame:
    """(window_us, stage, bucket, n, low, high) of a stream of verdicts with the times of their way: log-linear histograms of each stage's nanoseconds, a window when it closes.

    Histograms of windows merge like any other (metrics.merge), so those of an
    hour, a day or a whole run come from these without the verdicts.
    """
    timed = _timed(verdicts, at_us, late)
    each = stages(timed, ("on_time",)).withColumn("window", F.window("on_time", width))
    return histogram(each, "latency_ns", ("window", "stage")).select(F.unix_micros("window.start").alias("window_us"), "stage", "bucket", "n", "low", "high")


def accuracy_windows(verdicts: DataFrame, truths: DataFrame, width: str = "1 minute", late: str = "10 minutes", apart: str = "10 minutes", at_us: str = "at_us") -> DataFrame:
    """(window_us, scored, correct, paired, agree) of streams of verdicts (wafer_id, pattern, second) and truths (wafer_id, truth), both with a time.

    A truth that comes within `apart` of its verdict's time is joined to it;
    the state of either side goes once the other can't come any more.  A window
    is that of the verdict's time.  Unknown truths aren't scored, verdicts
    without a known second opinion aren't paired.
    """
    v = _timed(verdicts.select("wafer_id", "pattern", "second", at_us), at_us, late).drop(at_us)
    t = _timed(truths.select(F.col("wafer_id").alias("__wafer"), "truth", at_us), at_us, late, "told").drop(at_us)
    near = F.expr(f"told BETWEEN on_time - INTERVAL {apart} AND on_time + INTERVAL {apart}")
    both = v.join(t, (F.col("wafer_id") == F.col("__wafer")) & near)
    known, paired = F.col("truth") != UNKNOWN, F.col("second") != UNKNOWN
    same = lambda a: F.col("pattern") == F.col(a)
    counts = (F.count_if(known).alias("scored"), F.count_if(known & same("truth")).alias("correct"), F.count_if(paired).alias("paired"), F.count_if(paired & same("second")).alias("agree"))
    return both.groupBy(F.window("on_time", width)).agg(*counts).select(F.unix_micros("window.start").alias("window_us"), "scored", "correct", "paired", "agree")
