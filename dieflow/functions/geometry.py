"""Zones, rings and octants of a die, exact in 64-bit integers.

With x and y the doubled offsets of a die from the wafer's centre, the squared
normalised radius is num / den for integers num and den; every bucket below is
an integer comparison on those.  Columns are bigint throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ZONES, SECTORS, RINGS = 5, 8, 10
ANGLES, FRACTION_BITS = 180, 14


def doubled(r: Column, c: Column, rows: Column, cols: Column) -> tuple[Column, Column]:
    return 2 * c - (cols - 1), (rows - 1) - 2 * r


def radius(x: Column, y: Column, rows: Column, cols: Column) -> tuple[Column, Column]:
    """num and den of the squared radius."""
    return x * x * rows * rows + y * y * cols * cols, rows * rows * cols * cols


def zone(num: Column, den: Column) -> Column:
    """Equal-area rings, 0 to 4."""
    return F.least(F.lit(ZONES - 1).cast("bigint"), _div(ZONES * num, den))


def _div(a: Column, b: Column) -> Column:
    # Operands are never negative and the quotient is small, so the double quotient's floor, put right by one step, is exact.
    q = F.floor(a / b)
    return q + F.when((q + 1) * b <= a, 1).otherwise(0) - F.when(q * b > a, 1).otherwise(0)


def ring(num: Column, den: Column) -> Column:
    """Equal-width rings, 0 to 9: how many k from 1 to 9 have (k / 10)^2 at most the squared radius."""
    # The root's floor, put right by one step, is exact, and it is one condition a side instead of nine.
    k = F.least(F.floor(RINGS * F.sqrt(num / den)), F.lit(RINGS - 1).cast("bigint"))
    scaled = RINGS * RINGS * num
    return k + F.when((k < RINGS - 1) & ((k + 1) * (k + 1) * den <= scaled), 1).otherwise(0) - F.when(k * k * den > scaled, 1).otherwise(0)


def sector(x: Column, y: Column, rows: Column, cols: Column) -> Column:
    """Octant counter-clockwise from east, 0 to 7; the centre is 0."""
    u, v = x * rows, y * cols
    q = F.when((u == 0) & (v == 0), F.struct(F.lit(0).alias("q"), F.lit(0).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b")))
    for k, (holds, a, b) in enumerate((((u > 0) & (v >= 0), u, v), ((u <= 0) & (v > 0), v, -u), ((u < 0) & (v <= 0), -u, -v))):
        q = q.when(holds, F.struct(F.lit(k).alias("q"), a.alias("a"), b.alias("b")))
    q = q.otherwise(F.struct(F.lit(3).alias("q"), (-v).alias("a"), u.alias("b")))
    return (2 * q["q"] + F.when(q["b"] >= q["a"], 1).otherwise(0)).cast("bigint")


@lru_cache
def hough_table() -> tuple[np.ndarray, np.ndarray]:
    """Rounded cosines and sines of 0 to 179 degrees, in units of 2^-14."""
    rad = np.arange(ANGLES) * np.pi / 180.0
    half_away = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    return half_away(np.cos(rad) * (1 << FRACTION_BITS)), half_away(np.sin(rad) * (1 << FRACTION_BITS))


def hough_angles(spark: SparkSession):
    """(angle, cos, sin): 180 rows."""
    cos, sin = hough_table()
    return spark.createDataFrame([(k, int(cos[k]), int(sin[k])) for k in range(ANGLES)], "angle bigint, cos bigint, sin bigint")


def rho(x: Column, y: Column, cos: Column, sin: Column) -> Column:
    return F.shiftright(x * cos + y * sin, FRACTION_BITS + 1)


def geometry_table(spark: SparkSession, shapes):
    """(rows, cols, r, c, zone, sector, ring) of every grid position of the distinct shapes in a DataFrame.

    Shapes are few however many wafers there are; join it, or replace it by a
    table of your own with the same columns.
    """
    s = shapes.select(F.col("rows").cast("bigint"), F.col("cols").cast("bigint")).distinct()
    die = s.select("rows", "cols", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") * F.col("cols") - 1)).alias("i"))
    die = die.select("rows", "cols", _div(F.col("i"), F.col("cols")).alias("r"), F.pmod("i", "cols").alias("c"))
    return with_buckets(die).select("rows", "cols", "r", "c", "zone", "sector", "ring")


def with_buckets(die):
    """die rows (rows, cols, r, c) plus x, y, zone, sector and ring."""
    rows, cols = F.col("rows"), F.col("cols")
    x, y = doubled(F.col("r"), F.col("c"), rows, cols)
    die = die.withColumn("x", x).withColumn("y", y)
    num, den = radius(F.col("x"), F.col("y"), rows, cols)
    die = die.withColumns({"__num": num, "__den": den})
    num, den = F.col("__num"), F.col("__den")
    return die.withColumns({"zone": zone(num, den), "sector": sector(F.col("x"), F.col("y"), rows, cols), "ring": ring(num, den)}).drop("__num", "__den")


@lru_cache(maxsize=512)
def tables(rows: int, cols: int) -> dict[str, np.ndarray]:
    """The same buckets as arrays over the flattened grid, with the rho bin of every (angle, die) and the accumulator's places by die."""
    r, c = np.divmod(np.arange(rows * cols, dtype=np.int64), cols)
    x, y = 2 * c - (cols - 1), (rows - 1) - 2 * r
    num, den = x * x * rows * rows + y * y * cols * cols, rows * rows * cols * cols
    u, v = x * rows, y * cols
    quadrant = np.select([(u > 0) & (v >= 0), (u <= 0) & (v > 0), (u < 0) & (v <= 0)], [0, 1, 2], 3)
    a, b = np.choose(quadrant, [u, v, -u, -v]), np.choose(quadrant, [v, -u, -v, u])
    octant = np.where((u == 0) & (v == 0), 0, 2 * quadrant + (b >= a))
    cos, sin = hough_table()
    offset = (rows + cols) // 2 + 1
    rho = ((cos[:, None] * x + sin[:, None] * y) >> (FRACTION_BITS + 1)) + offset
    return {
        "r": r,
        "c": c,
        "zone": np.minimum(ZONES - 1, ZONES * num // den),
        "sector": octant,
        "ring": sum((k * k * den <= RINGS * RINGS * num).astype(np.int64) for k in range(1, RINGS)),
        "rho": rho,
        # A die's 180 places in the flattened accumulator lie together.
        "votes": np.ascontiguousarray((np.arange(ANGLES)[:, None] * (2 * offset + 1) + rho).T),
        "offset": np.int64(offset),
    }
