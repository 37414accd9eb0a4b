"""The column functions as SQL functions: zone_of, sector_of, ring_of, hough_rho, join_count_z."""

from __future__ import annotations

from pyspark.sql import SparkSession

_X, _Y = "(2 * c - (cols - 1))", "((rows - 1) - 2 * r)"
_NUM, _DEN = f"({_X} * {_X} * rows * rows + {_Y} * {_Y} * cols * cols)", "(rows * rows * cols * cols)"
_U, _V = f"({_X} * rows)", f"({_Y} * cols)"
_GRID = "r BIGINT, c BIGINT, rows BIGINT, cols BIGINT"


def _drawn(k: int) -> str:
    p = "1.0D"
    for i in range(k):
        p = f"(CASE WHEN n - {i} <= 0 THEN 0.0D ELSE {p} * ((f - {i}) / (n - {i})) END)"
    return f"greatest({p}, 0.0D)"


_VAR = f"(j * {_drawn(2)} + 2.0D * k * {_drawn(3)} + (j * (j - 1.0D) - 2.0D * k) * {_drawn(4)} - j * {_drawn(2)} * j * {_drawn(2)})"
FUNCTIONS = (
    f"zone_of({_GRID}) RETURNS BIGINT RETURN least(4L, 5 * {_NUM} div {_DEN})",
    f"ring_of({_GRID}) RETURNS BIGINT RETURN CAST(size(filter(sequence(1L, 9L), i -> i * i * {_DEN} <= 100 * {_NUM})) AS BIGINT)",
    f"sector_of({_GRID}) RETURNS BIGINT RETURN CASE WHEN {_U} = 0 AND {_V} = 0 THEN 0L WHEN {_U} > 0 AND {_V} >= 0 THEN IF({_V} >= {_U}, 1L, 0L) "
    f"WHEN {_U} <= 0 AND {_V} > 0 THEN IF(-{_U} >= {_V}, 3L, 2L) WHEN {_U} < 0 AND {_V} <= 0 THEN IF(-{_V} >= -{_U}, 5L, 4L) ELSE IF({_U} >= -{_V}, 7L, 6L) END",
    f"hough_rho({_GRID}, cos BIGINT, sin BIGINT) RETURNS BIGINT RETURN shiftright({_X} * cos + {_Y} * sin, 15)",
    f"join_count_z(n DOUBLE, f DOUBLE, j DOUBLE, k DOUBLE, bb DOUBLE) RETURNS DOUBLE RETURN CASE WHEN f >= 2 AND {_VAR} > 1e-9 THEN (bb - j * {_drawn(2)}) / sqrt({_VAR}) ELSE 0.0D END",
)


def register(spark: SparkSession) -> list[str]:
    """Register the functions for this session; returns their names."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    return [f.split("(")[0] for f in FUNCTIONS]
