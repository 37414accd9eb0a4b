"""Confusion, precision, recall, F1, and what conformal sets and histograms report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.functions.ranks import holds_place, with_ranks
from dieflow.patterns import PATTERNS, UNKNOWN

SUB_BITS = 7
SUB = 1 << SUB_BITS


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", weight: Column | None = None) -> DataFrame:
    """(truth, pred, n) over rows whose truth isn't unknown; n is a count, or the sum of a weight."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.where(F.col(truth) != UNKNOWN).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(n.alias("n"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(counts: DataFrame) -> DataFrame:
    """(pattern, support, hits, predicted, precision, recall, f1) for all nine classes, from confusion()."""
    sides = F.array(F.struct(F.col("truth").alias("pattern"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("pred").alias("pattern"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits")))
    every = counts.sparkSession.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    summed = counts.select(F.explode(sides).alias("s")).select("s.*").groupBy("pattern").agg(*(F.sum(c).alias(c) for c in ("support", "hits", "predicted")))
    both = every.join(summed, "pattern", "left").select("pattern", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hits", "predicted")))
    both = both.withColumns({"precision": _safe(F.col("hits"), F.col("predicted")), "recall": _safe(F.col("hits"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", _safe(2 * p * r, p + r))


def summary(counts: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1): the mean F1 of the classes that occur as truth."""
    return per_class(counts).agg(F.sum("support").alias("n"), _safe(F.sum("hits"), F.sum("support")).alias("accuracy"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def rules_fired(classified: DataFrame) -> DataFrame:
    return classified.groupBy("rule").agg(F.count("*").alias("n"))


# --- class scores ---


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, in double."""
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def prediction_set(p: Column, thresholds: list[float]) -> Column:
    """Bit k is set where 1 - p_k is at most the class's threshold."""
    q = F.array(*(F.lit(float(t)) for t in thresholds))
    bits = F.transform(p, lambda x, k: F.when(1.0 - x <= F.get(q, k), F.call_function("shiftleft", F.lit(1), k)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def conformal_metrics(scored: DataFrame, accept: float) -> DataFrame:
    """coverage, worst_class_coverage, mean_set_size, accept_rate and error_among_accepted.

    scored has truth_code (0 to 8; others are left out), p (probabilities) and
    set (a bit mask).
    """
    known = scored.where(F.col("truth_code").between(0, len(PATTERNS) - 1))
    covered = F.call_function("shiftright", F.col("set"), F.col("truth_code")).bitwiseAND(F.lit(1))
    accepted = (F.array_max("p") >= accept).cast("int")
    each = known.select("truth_code", covered.alias("covered"), F.bit_count("set").alias("size"), accepted.alias("accepted"), (argmax(F.col("p")) != F.col("truth_code")).cast("int").alias("wrong"))
    by_class = each.groupBy("truth_code").agg(F.count("*").alias("n"), F.sum("covered").alias("covered"), F.sum("size").alias("size"), F.sum("accepted").alias("accepted"), F.sum(F.col("accepted") * F.col("wrong")).alias("wrong"))
    n = F.sum("n")
    return by_class.agg(F.coalesce(n, F.lit(0)).alias("n"), (F.sum("covered") / n).alias("coverage"), F.min(F.col("covered") / F.col("n")).alias("worst_class_coverage"), (F.sum("size") / n).alias("mean_set_size"), (F.sum("accepted") / n).alias("accept_rate"), _safe(F.sum("wrong"), F.sum("accepted")).alias("error_among_accepted"))


def agreement(a: DataFrame, b: DataFrame, key: str = "wafer_id") -> DataFrame:
    """(n, agree, changed, max_diff) of two tables (key, logits)."""
    both = a.select(key, F.col("logits").alias("la")).join(b.select(key, F.col("logits").alias("lb")), key)
    same = argmax(F.col("la")) == argmax(F.col("lb"))
    gap = F.array_max(F.zip_with("la", "lb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return both.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agree"), F.count_if(~same).alias("changed"), F.max(gap).alias("max_diff"))


# --- latency histogram ---


def bucket(v: Column) -> Column:
    """Exact below 256, then 128 buckets an octave."""
    shift = F.length(F.bin(v)) - (SUB_BITS + 1)
    return F.when(v < 2 * SUB, v).otherwise(shift * SUB + F.call_function("shiftright", v, shift)).cast("bigint")


def bucket_upper(i: Column) -> Column:
    """The largest value of a bucket."""
    shift = (F.floor(i / SUB) - 1).cast("int")
    return F.when(i < 2 * SUB, i).otherwise(F.call_function("shiftleft", i - shift * SUB + 1, shift) - 1).cast("bigint")


def histogram(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bucket, n, low, high); negative values count as 0.  Histograms merge by adding n up and taking low's least and high's greatest."""
    v = F.greatest(F.col(value).cast("bigint"), F.lit(0).cast("bigint"))
    return df.where(F.col(value).isNotNull()).groupBy(*by, bucket(v).alias("bucket")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    by = [c for c in out.columns if c not in ("n", "low", "high")]
    return out.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def percentiles(h: DataFrame, ps: tuple[float, ...] = (0.5, 0.99, 0.999), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, p, value): the upper edge of the first bucket with at least that share at or below it, at most the maximum.

    A histogram has at most some thousands of buckets, so its windows are small.
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    run = h.select(*by, "bucket", F.sum("n").over(w.orderBy("bucket")).alias("seen"), F.sum("n").over(w).alias("total"), F.max("high").over(w).alias("most"))
    each = run.select(*by, "bucket", "seen", "total", "most", F.explode(F.array(*(F.lit(p) for p in ps))).alias("p"))
    reached = each.where(F.col("seen") >= F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("total"))))
    best = reached.groupBy(*by, "p").agg(F.min("bucket").alias("bucket"), F.max("most").alias("most"))
    return best.select(*by, "p", F.when(F.col("p") >= 1.0, F.col("most")).otherwise(F.least(bucket_upper(F.col("bucket")), F.col("most"))).alias("value"))


def medians(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, median, median_upper): the mean of the two middle values, and the upper of them, for each of a few groups.

    Equal values are counted first and ranked by slices, so no task holds a group.  Nulls don't count.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranked = with_ranks(counted, [by], "v")
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = ranked.where(holds_place(low) | holds_place(high)).groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return middle.select(by, ((F.col("low") + F.col("high")) / 2).alias("median"), F.col("high").alias("median_upper"))
