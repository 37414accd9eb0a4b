"""Equi-joins whose key may be hot: heavy hitters are found exactly, and their rows dealt out over salts.

Adaptive execution splits a hot partition only where both sides of a join come
straight from an exchange; a side that is an aggregate on the join key, or a
result that is aggregated on it again, keeps the partition whole.  These joins
don't depend on that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys held by fewer rows are never salted: a task of that many rows is no burden.
LEAST_ROWS = 100_000
_SALT = "__salt"


def pieces(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_hitters(counted: DataFrame, on: Sequence[str], n: str = "count", slots: int | None = None, least: int = LEAST_ROWS) -> list[tuple[tuple, int]]:
    """(key, salts) for each key that holds over 1/slots of all rows, and over `least` rows; nulls in keys are no keys.

    counted has one row a key and its number of rows, or several to be added.
    Counting combines before it shuffles, and fewer than `slots` keys can hold
    that much, so the list has a bound.  A key gets a salt for each 1/slots of
    the rows it holds.
    """
    slots = slots or pieces(counted)
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    most = counted.where(known).groupBy(*on).agg(F.sum(n).alias("__n")).where(F.col("__n") > least).orderBy(F.desc("__n")).limit(slots).collect()
    if not most:
        return []
    floor = max(least, counted.agg(F.sum(n)).first()[0] // slots)
    return [(tuple(r)[:-1], -(-r["__n"] // floor)) for r in most if r["__n"] > floor]


def count_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).count()


def _is(on: Sequence[str], key: tuple) -> Column:
    return reduce(Column.__and__, (F.col(c) == F.lit(v) for c, v in zip(on, key)))


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], hot: Sequence[tuple[tuple, int]], salt: str = _SALT, by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: rows of left that have a hot key are dealt out by a hash of the row (of its columns `by`, if given), and right's row of that key is there once a salt.

    Rows of left with a null in the key match nothing and are dealt out too.
    The hash depends on the row alone, so a task that runs again deals alike.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in by or left.columns))
    spread = F.lit(0)
    for key, salts in hot:
        spread = F.when(_is(on, key), F.pmod(row, F.lit(salts))).otherwise(spread)
    null = reduce(Column.__or__, (F.col(c).isNull() for c in on))
    spread = F.when(null, F.pmod(row, F.lit(pieces(left)))).otherwise(spread).cast("int")
    copies = F.lit(1)
    for key, salts in hot:
        copies = F.when(_is(on, key), F.lit(salts)).otherwise(copies)
    here = right.withColumn(salt, F.explode(F.sequence(F.lit(0), copies - 1))) if hot else right.withColumn(salt, F.lit(0))
    return left.withColumn(salt, spread), here


def hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", counted: DataFrame | None = None, slots: int | None = None, least: int = LEAST_ROWS, by: Sequence[str] | None = None) -> DataFrame:
    """left joined with right on equal keys, no key's rows of left all in one task.

    how is inner, left, left_semi or left_anti.  right should have few rows a
    key: those of a hot key are copied, once for each 1/slots of all rows that
    the key holds in left.  counted (keys and `count`) saves a count of left's
    keys where the caller has one; `by` names
    columns that tell left's rows apart, to save a hash of wide ones.  Same rows as left.join(right, on, how).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} keeps rows of right: it can't be salted")
    hot = heavy_hitters(counted if counted is not None else count_keys(left, on), on, slots=slots, least=least)
    salt = _SALT
    while salt in left.columns or salt in right.columns:
        salt = f"_{salt}"
    a, b = salted(left, right, on, hot, salt, by)
    return a.join(b, [*on, salt], how).drop(salt)
