"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on vertex keys.  Minima are
aggregated before any join, and the edges of a vertex that has many are dealt
out over salts to meet its minimum (see functions/skew.py).  Nothing but two
numbers a round and those few vertices reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS, hot_join
from dieflow.llm.common import cut, discard


def _met(edges: DataFrame, least: DataFrame, slots: int | None, hot: int | None) -> DataFrame:
    """edges with m, the least neighbour of their a; least has a row (a, m, count) a vertex.  Without `hot` no vertex can have many edges."""
    if hot is None:
        return edges.join(least.select("a", "m"), "a")
    return hot_join(edges, least.select("a", "m"), ["a"], counted=least.select("a", "count"), slots=slots, least=hot)


def _large_star(edges: DataFrame, slots: int | None = None, hot: int | None = LEAST_ROWS) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count")).select("a", F.least("a", "m").alias("m"), "count")
    return _met(both.where("b > a"), least, slots, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, slots: int | None = None, hot: int | None = LEAST_ROWS) -> DataFrame:
    """edges point from the larger vertex a to the smaller vertex b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count"))
    moved = _met(edges, least, slots, hot).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", slots: int | None = None, hot: int = LEAST_ROWS) -> DataFrame:
    """(node, root) for every vertex of an edge table; root is the component's smallest vertex.

    Self-loops and repeated edges are harmless; null ends are ignored; an empty
    table gives an empty table.  Vertices are longs.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    given = cut(now.distinct(), "edges")
    loops = given.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now, seen = given.where("a <> b"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        before, seen = now if seen else None, mark
        few = mark[0] <= hot  # then no vertex has more edges, and none need be counted
        starred = _large_star(now, slots, None if few else hot)
        # Large-star leaves no more edges than it found, so the same holds for the second half.
        now = cut(_small_star(starred if few else cut(starred, "stars"), slots, None if few else hot), "edges")
        if before is not None:
            discard(before)
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return tied.unionAll(roots).unionAll(loops).groupBy("node").agg(F.min("root").alias("root"))
