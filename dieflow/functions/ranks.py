"""Exact ranks without one task that sorts a group: values are sliced at approximate quantiles, counted by slice, and ordered within slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 256


def with_ranks(counted: DataFrame, by: list[str], at: str, order: tuple[str, ...] = (), slices: int = SLICES) -> DataFrame:
    """counted plus `before` and `total`, from distinct rows with a number n of copies each.

    before counts the copies, in the row's group, of rows that come before it
    by `at`, a number, and then by `order`.  The groups are few: classes,
    signals, or one if `by` is empty.  Rows with equal `at` share a slice.
    """
    group = by or ["__all"]
    rows = counted if by else counted.withColumn("__all", F.lit(0))
    cuts = F.percentile_approx(F.col(at).cast("double"), [k / slices for k in range(1, slices)], 4 * slices)
    few = rows.groupBy(*group).agg(F.array_distinct(cuts).alias("__cuts"))  # a row a group
    placed = rows.join(F.broadcast(few), group).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.col(at)))).drop("__cuts")
    sizes = placed.groupBy(*group, "__slice").agg(F.sum("n").alias("__n"))  # at most `slices` rows a group
    w = W.partitionBy(*group)
    first = sizes.select(*group, "__slice", (F.sum("__n").over(w.orderBy("__slice")) - F.col("__n")).alias("__first"), F.sum("__n").over(w).alias("total"))
    own = F.sum("n").over(W.partitionBy(*group, "__slice").orderBy(at, *order)) - F.col("n")
    ranked = placed.withColumn("__own", own).join(F.broadcast(first), [*group, "__slice"])
    return ranked.select(*counted.columns, (F.col("__first") + F.col("__own")).alias("before"), "total")


def holds_place(place: Column) -> Column:
    """Whether a ranked row covers a place, counted from 0."""
    return (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
