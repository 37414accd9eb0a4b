"""Which lots to hold: k of the last W in a lot, or K across lots within H.

Verdicts are rows (lot, pattern, at_us, pos); pos breaks ties of time.  Without
forgetting, both rules are windows.  The cross-lot rule looks back over at most
H, so its rows are windowed by (pattern, time slice of H) with the slice before
as context: no pattern, however common, is one task.  Forgetting lots is in
forgetting.py; the sequential rule here says what both must give.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.patterns import patterned


@dataclass(frozen=True)
class HoldConfig:
    k: int = 3
    window: int = 5
    lots: int = 64
    tool_k: int = 0
    tool_window_us: int = 0

    def __post_init__(self) -> None:
        if not (1 <= self.k <= self.window <= 64 and self.lots >= 1 and 0 <= self.tool_k <= 64 and self.tool_window_us >= 0):
            raise ValueError(f"not a hold rule: {self}")


class HoldRule:
    """One verdict at a time, in order; remembers `lots` lots and forgets the one seen longest ago."""

    def __init__(self, config: HoldConfig) -> None:
        self.config = config
        self.recent: OrderedDict[str, deque | None] = OrderedDict()  # None once held
        self.arrivals: dict[str, deque] = defaultdict(lambda: deque(maxlen=max(1, config.tool_k)))
        self.evictions = self.tool_holds = 0

    def observe(self, lot: str, pattern: str, at_us: int) -> str | None:
        """The pattern the lot is held for, if this verdict holds it."""
        c, says = self.config, pattern not in ("none", "unknown")
        tool = False
        if says and c.tool_k:
            seen = self.arrivals[pattern]
            seen.append(at_us)
            tool = len(seen) == c.tool_k and at_us - seen[0] <= c.tool_window_us
        if lot not in self.recent:
            if len(self.recent) >= c.lots:
                self.recent.popitem(last=False)
                self.evictions += 1
            self.recent[lot] = deque(maxlen=c.window)
        self.recent.move_to_end(lot)
        window = self.recent[lot]
        if window is None:
            return None
        window.append(pattern)
        if not says:
            return None
        in_lot = window.count(pattern) >= c.k
        if not in_lot and not tool:
            return None
        self.tool_holds += not in_lot
        self.recent[lot] = None
        return pattern

    def held(self, lot: str) -> bool:
        return lot in self.recent and self.recent[lot] is None


def same_in_window(config: HoldConfig) -> Column:
    """How many of the lot's last W verdicts, this one included, have this one's pattern."""
    w = W.partitionBy("lot").orderBy("at_us", "pos").rowsBetween(1 - config.window, 0)
    return F.size(F.filter(F.collect_list("pattern").over(w), lambda p: p == F.col("pattern")))


def in_lot(verdicts: DataFrame, config: HoldConfig) -> DataFrame:
    """verdicts plus same and in_lot."""
    return verdicts.withColumn("same", same_in_window(config)).withColumn("in_lot", patterned(F.col("pattern")) & (F.col("same") >= config.k))


def across_lots(verdicts: DataFrame, config: HoldConfig, by: tuple[str, ...] = (), name: str = "tool") -> DataFrame:
    """verdicts plus a boolean `name`: whether this is the K-th arrival of its pattern within H, over all lots, or those of equal `by`."""
    if not config.tool_k:
        return verdicts.withColumn(name, F.lit(False))
    if config.tool_k == 1:
        return verdicts.withColumn(name, patterned(F.col("pattern")))
    hits = arrivals_in_time(verdicts.where(patterned(F.col("pattern"))).select(*by, "lot", "pos", "pattern", "at_us"), config, by)
    return verdicts.join(hits.select(*by, "lot", "pos", F.lit(True).alias("hit")), [*by, "lot", "pos"], "left").withColumn(name, F.coalesce("hit", F.lit(False))).drop("hit")


def arrivals_in_time(says: DataFrame, config: HoldConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of says that are the K-th arrival of their pattern within H, K of 2 or more: windows over (pattern, slice of H), the slice before being context."""
    slice_ = F.floor(F.col("at_us") / F.lit(max(1, config.tool_window_us)))
    sliced = says.withColumn("slice", slice_)
    both = sliced.withColumn("seen_in", F.explode(F.array(F.col("slice"), F.col("slice") + 1)))
    w = W.partitionBy(*by, "pattern", "seen_in").orderBy("at_us", "pos")
    due = both.withColumn("since", F.col("at_us") - F.lag("at_us", config.tool_k - 1).over(w)).where(F.col("seen_in") == F.col("slice"))
    return due.where(F.col("since") <= config.tool_window_us).select(*says.columns)


def firing(verdicts: DataFrame, config: HoldConfig) -> DataFrame:
    """Verdicts at which either rule holds, whether the lot is held by then or not."""
    return across_lots(in_lot(verdicts, config), config).where(F.col("in_lot") | F.col("tool"))


def holds(verdicts: DataFrame, config: HoldConfig) -> DataFrame:
    """(lot, at_us, pos, pattern, by_tool): the first firing verdict of each lot.

    Nothing is forgotten, which equals the sequential rule when it remembers at
    least as many lots as there are.
    """
    first = firing(verdicts, config).groupBy("lot").agg(F.min(F.struct("at_us", "pos", "pattern", "in_lot")).alias("f"))
    return first.select("lot", "f.at_us", "f.pos", "f.pattern", (~F.col("f.in_lot")).alias("by_tool"))


def held(verdicts: DataFrame, holding: DataFrame) -> DataFrame:
    """The verdicts of lots that are held at some time."""
    return verdicts.join(holding.select("lot"), "lot", "left_semi")


def holds_in_order(verdicts: DataFrame, config: HoldConfig, key: str | None = None) -> DataFrame:
    """The same by the sequential rule, forgetting included; one order a tool (`key`), so one task a tool.

    Columns: key if given, lot, at_us, pos, pattern, by_tool and evictions so far.
    """
    keyed = verdicts.withColumn("__tool", F.col(key).cast("string") if key else F.lit(""))
    schema = "tool string, lot string, at_us bigint, pos bigint, pattern string, by_tool boolean, evictions bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rule, out = HoldRule(config), []
        for v in pdf.sort_values(["at_us", "pos"], kind="stable").itertuples(index=False):
            before = rule.tool_holds
            if hit := rule.observe(v.lot, v.pattern, v.at_us):
                out.append((v[0], v.lot, v.at_us, v.pos, hit, rule.tool_holds > before, rule.evictions))
        return pd.DataFrame(out, columns=["tool", "lot", "at_us", "pos", "pattern", "by_tool", "evictions"])

    found = keyed.select(F.col("__tool").alias("tool"), "lot", "pattern", F.col("at_us").cast("bigint"), F.col("pos").cast("bigint")).groupBy("tool").applyInPandas(run, schema)
    return found.withColumnRenamed("tool", key) if key else found.drop("tool")
