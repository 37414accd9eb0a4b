"""Names, codes and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in class order: a pattern's code is its index; unknown is 255.
PATTERNS = ("none", "center", "donut", "edge_loc", "edge_ring", "loc", "near_full", "random", "scratch")
UNKNOWN, UNKNOWN_CODE = "unknown", 255
SPLITS = ("train", "val", "test", "unsplit")
SIGNALS = ("density", "center", "edge", "sector", "inner", "ring", "cluster_share", "cluster_size", "cluster_rho", "elongation", "line", "line_length", "z")

MAX_DIES = 4096
MAX_LOT_CHARS = 32

WAFERS = "wafer_id int, lot_id int, tested_at_us bigint, truth string, split string, rows int, cols int, bins binary"
VERDICTS = "seq bigint, lot string, wafer bigint, pattern string, at_us bigint"


def pattern_code(name: Column) -> Column:
    """0 to 8, or 255 for unknown; null for other names."""
    out = F.when(name == UNKNOWN, UNKNOWN_CODE)
    for code, p in enumerate(PATTERNS):
        out = out.when(name == p, code)
    return out


def pattern_name(code: Column) -> Column:
    """The name of a code; unknown for any other."""
    out = None
    for k, p in enumerate(PATTERNS):
        out = F.when(code == k, p) if out is None else out.when(code == k, p)
    return out.otherwise(UNKNOWN)


def patterned(name: Column) -> Column:
    """Whether a verdict says anything: neither none nor unknown."""
    return ~name.isin("none", UNKNOWN)


def lot_name(lot_id: Column) -> Column:
    return F.format_string("LOT-%06d", lot_id)


def guard(wafers):
    """Rows with a fault column: oversized, bad_shape or null.  Filter on it or count it; nothing is cut short."""
    dies = F.col("rows") * F.col("cols")
    return wafers.withColumn("fault", F.when(F.octet_length("bins") != dies, "bad_shape").when(dies > MAX_DIES, "oversized").when(dies < 1, "bad_shape"))
