"""Forgetting lots, for any number of verdicts a tool.

A tool remembers so many lots and forgets the one seen longest ago.  So a lot
is forgotten at a visit exactly if at least that many other lots came since
its last one: if its reuse distance is at least the capacity.  Distances don't
depend on one another, so they are counted in parallel.

With visits ranked in order, prev(i) the rank of the lot's visit before i (0
without), the distinct lots between prev(i) and i are the visits there whose
own prev lies before prev(i).  All visits up to prev(i) have that too, so

    distance(i) = #{j < i : prev(j) < prev(i)} - prev(i).

Ranks are cut into slices of `rows`.  Visits j of earlier slices count by the
slice of prev(j): whole slices by a table of sums, those whose prev lies in
the slice of prev(i) among themselves, and those of i's own slice among
themselves.  Both are an order statistic within a slice; a task sees a slice.

Between two forgettings a lot's verdicts are an episode, and the hold rule is
a window over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.functions.ranks import with_ranks
from dieflow.operators.hold import HoldConfig, across_lots
from dieflow.patterns import patterned
from dieflow.scratch import written

#: Visits of a slice, and slices of a tool; beyond their product slices grow.
ROWS, SLICES = 1 << 18, 2048


def smaller_before(values: np.ndarray) -> np.ndarray:
    """How many earlier elements are smaller, for each element of a permutation of 0..n-1.

    Bit by bit from the top: among elements equal so far, a one counts the
    zeros before it; then zeros and ones part, in order.
    """
    n = len(values)
    order, out = np.arange(n), np.zeros(n, np.int64)
    for b in range(max(1, int(n - 1).bit_length()) - 1, -1, -1) if n > 1 else ():
        v = values[order]
        one = v >> b & 1
        zeros = np.cumsum(1 - one) - (1 - one)
        group = v >> (b + 1)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        base = np.repeat(zeros[starts], np.diff(np.r_[starts, n]))
        ones = one == 1
        out[order[ones]] += (zeros - base)[ones]
        order = order[np.argsort(v >> b, kind="stable")]
    return out


def places(*keys: np.ndarray) -> np.ndarray:
    """Each element's place in the order of the keys, the last of which counts first."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys)] = np.arange(len(keys[0]))
    return out


def _sums(cells: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each cell (s, t) the n of all cells with smaller s and smaller t."""
    size = int(cells.max()) + 2
    grid = np.zeros((size + 1, size + 1), np.int64)
    np.add.at(grid, (cells + 1, before + 2), n)  # t is -1 for first visits
    total = grid.cumsum(0).cumsum(1)
    return total[cells, before + 1]


def _within(columns: list[str], count, added: str):
    """A function for applyInArrow: a group's rows sorted by the first column, `added` being count() of the others as arrays."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(columns[0])
        arrays = [rows.column(c).to_numpy(zero_copy_only=False) for c in columns]
        return rows.append_column(added, pa.array(count(*arrays), pa.int64()))

    return run


def ranked(visits: DataFrame, order: tuple[str, str]) -> DataFrame:
    """visits of (tool, lot) plus rank, from 1 by `order` in their tool; ranks are exact, and no task sorts a tool."""
    return with_ranks(visits.withColumn("n", F.lit(1)), ["tool"], order[0], order[1:]).withColumn("rank", F.col("before") + 1).drop("before", "n")


def with_previous(visits: DataFrame) -> DataFrame:
    """visits with rank and slice plus prev, the rank of the lot's visit before, 0 without; a lot is taken slice by slice, so none is one task."""
    w = W.partitionBy("tool", "lot", "slice").orderBy("rank")
    last = visits.groupBy("tool", "lot", "slice").agg(F.max("rank").alias("last"))
    carried = last.select("tool", "lot", "slice", F.lag("last").over(W.partitionBy("tool", "lot").orderBy("slice")).alias("carried"))
    inside = visits.withColumn("inside", F.lag("rank").over(w))
    return inside.join(carried, ["tool", "lot", "slice"]).withColumn("prev", F.coalesce("inside", "carried", F.lit(0))).drop("inside", "carried")


def reuse_distances(visits: DataFrame, order: tuple[str, str] = ("at_us", "pos"), rows: int = ROWS, slices: int = SLICES) -> DataFrame:
    """visits (tool, lot, order and more) plus rank, prev and distance, how many other lots of the tool came since the lot's last visit; null at its first.

    tool must not be null, and rows must be distinct in (tool, order).
    """
    numbered = ranked(visits, order)
    width = F.greatest(F.lit(rows), F.ceil(F.col("total") / slices))
    sliced = numbered.withColumn("slice", F.floor((F.col("rank") - 1) / width)).withColumn("width", width)
    base = written(with_previous(sliced.drop("total")).withColumn("prev_slice", F.when(F.col("prev") > 0, F.floor((F.col("prev") - 1) / F.col("width"))).otherwise(-1)).drop("width"), "visits")
    cells = base.groupBy("tool", "slice", "prev_slice").agg(F.count("*").alias("n"))

    def sums(table: pa.Table) -> pa.Table:
        s, t, n = (table.column(c).to_numpy() for c in ("slice", "prev_slice", "n"))
        return table.select(["tool", "slice", "prev_slice"]).append_column("earlier", pa.array(_sums(s, t, n)))

    earlier = cells.groupBy("tool").applyInArrow(sums, "tool string, slice long, prev_slice long, earlier long")  # at most slices**2 / 2 rows a tool
    narrow = base.select("tool", "rank", "slice", "prev", "prev_slice")
    own = narrow.groupBy("tool", "slice").applyInArrow(_within(["rank", "prev"], lambda rank, prev: smaller_before(places(np.arange(len(prev)), prev)), "own"), f"{_ddl(narrow)}, own long")
    # Among visits whose prev lies in one slice, in order of prev: those of a smaller slice; of equal slices none counts, so later ones come first.
    met = narrow.where("prev > 0").groupBy("tool", "prev_slice").applyInArrow(_within(["prev", "slice"], lambda prev, slice_: smaller_before(places(-np.arange(len(slice_)), slice_)), "crossed"), f"{_ddl(narrow)}, crossed long")
    counted = own.where("prev > 0").join(met.select("tool", "rank", "crossed"), ["tool", "rank"]).join(earlier, ["tool", "slice", "prev_slice"])
    distance = counted.select("tool", "rank", (F.col("own") + F.col("crossed") + F.col("earlier") - F.col("prev")).alias("distance"))
    return base.join(distance, ["tool", "rank"], "left").drop("prev_slice")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _running(rows: DataFrame, flag: Column, by: list[str], name: str) -> DataFrame:
    """rows plus name: how many rows of their group, up to and with this one by rank, have the flag; counted slice by slice."""
    marked = rows.withColumn(name, flag.cast("long"))
    sums = marked.groupBy(*by, "slice").agg(F.sum(name).alias("__n"))
    ahead = sums.select(*by, "slice", (F.sum("__n").over(W.partitionBy(*by).orderBy("slice")) - F.col("__n")).alias("__ahead"))
    own = F.sum(name).over(W.partitionBy(*by, "slice").orderBy("rank"))
    return marked.withColumn(name, own).join(ahead, [*by, "slice"]).withColumn(name, F.col(name) + F.col("__ahead")).drop("__ahead")


def episodes(verdicts: DataFrame, lots: int, **sizes: int) -> DataFrame:
    """verdicts plus rank, slice, episode (the how-manieth time the tool has the lot in mind) and evictions (lots forgotten so far, this visit's included)."""
    known = reuse_distances(verdicts, **sizes)
    fresh = F.col("distance").isNull() | (F.col("distance") >= lots)
    met = _running(known.withColumn("fresh", fresh), F.col("fresh"), ["tool"], "evictions")
    told = _running(met, F.col("fresh"), ["tool", "lot"], "episode")
    return told.withColumn("evictions", F.greatest(F.lit(0), F.col("evictions") - lots)).drop("fresh", "prev", "distance")


def holds_forgetting(verdicts: DataFrame, config: HoldConfig, key: str | None = None, **sizes: int) -> DataFrame:
    """What holds_in_order gives, by windows: a hold is the first firing verdict of an episode, and a forgotten lot may be held anew.

    Columns: key if given, lot, at_us, pos, pattern, by_tool and evictions so
    far.  A null key counts as the empty one.  No verdicts give no holds.
    """
    tool = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    given = verdicts.select(tool.alias("tool"), "lot", "pattern", F.col("at_us").cast("bigint").alias("at_us"), F.col("pos").cast("bigint").alias("pos"))
    known = episodes(given, config.lots, **sizes)
    w = W.partitionBy("tool", "lot", "episode").orderBy("rank").rowsBetween(1 - config.window, 0)
    same = F.size(F.filter(F.collect_list("pattern").over(w), lambda p: p == F.col("pattern")))
    inside = known.withColumn("in_lot", patterned(F.col("pattern")) & (same >= config.k))
    firing = across_lots(inside, config, ("tool",), "tool_fires").where(F.col("in_lot") | F.col("tool_fires"))
    first = firing.groupBy("tool", "lot", "episode").agg(F.min(F.struct("at_us", "pos", "pattern", "in_lot", "evictions")).alias("f"))
    held = first.select("tool", "lot", "f.at_us", "f.pos", "f.pattern", (~F.col("f.in_lot")).alias("by_tool"), "f.evictions")
    return held.withColumnRenamed("tool", key) if key else held.drop("tool")
