"""The tool's side: an open-loop schedule over sent wafers, and hold and release of lots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Replay:
    """Wafers (wafer, lot, at_us) in sort-time order; the k-th sent is due at start + k / rate.

    A late sender catches up; wafers of held lots are skipped and use no slot.
    """

    wafers: list[tuple[int, str, int]]
    rate: float
    start_us: int = 0
    held: set[str] = field(default_factory=set)
    sent: int = 0
    withheld: int = 0
    _at: int = 0
    _paused: int | None = None

    def __post_init__(self) -> None:
        if not self.rate > 0:
            raise ValueError("rate must be positive")
        self.wafers = sorted(self.wafers, key=lambda w: w[2])
        self._lots = {w[1] for w in self.wafers}

    def due_us(self, k: int) -> int:
        return self.start_us + round(k * 1e6 / self.rate)

    def next(self, now_us: int) -> tuple[int, int] | None:
        """(wafer, due time) if one is due."""
        if self._paused is not None or self.due_us(self.sent) > now_us:
            return None
        while self._at < len(self.wafers):
            wafer, lot, _ = self.wafers[self._at]
            self._at += 1
            if lot in self.held:
                self.withheld += 1
                continue
            self.sent += 1
            return wafer, self.due_us(self.sent - 1)
        return None

    @property
    def finished(self) -> bool:
        return self._at >= len(self.wafers)

    def hold(self, lot: str) -> str:
        if lot not in self._lots:
            return "no_such_object"
        if lot in self.held:
            return "already_in_condition"
        self.held.add(lot)
        return "done"

    def release(self, lot: str) -> str:
        if lot not in self._lots:
            return "no_such_object"
        if lot not in self.held:
            return "already_in_condition"
        self.held.discard(lot)
        return "done"

    def pause(self, now_us: int) -> None:
        self._paused = now_us if self._paused is None else self._paused

    def resume(self, now_us: int) -> None:
        """The schedule starts anew from the next wafer: time spent paused isn't caught up."""
        if self._paused is not None:
            self.start_us = now_us - round(self.sent * 1e6 / self.rate)
            self._paused = None


def schedule(wafers: DataFrame, rate: float, start_us: int = 0, held: DataFrame | None = None) -> DataFrame:
    """wafers (lot, at_us, pos) that are sent, plus slot and scheduled_us.

    held has (lot, from_us): wafers tested after it aren't sent and use no slot.
    Slots number the sent wafers in one order: places are counted by hour first,
    so that the numbering window sees one hour of rows at a time.
    """
    sent = wafers
    if held is not None:
        sent = wafers.join(held.select("lot", "from_us"), "lot", "left").where(F.col("from_us").isNull() | (F.col("at_us") <= F.col("from_us"))).drop("from_us")
    hour = F.floor(F.col("at_us") / F.lit(3_600_000_000))
    timed = sent.withColumn("__hour", hour)
    counts = timed.groupBy("__hour").agg(F.count("*").alias("n"))
    before = counts.select("__hour", (F.sum("n").over(W.orderBy("__hour")) - F.col("n")).alias("__first"))  # a row an hour
    place = F.row_number().over(W.partitionBy("__hour").orderBy("at_us", "pos")) - 1
    slots = timed.withColumn("__place", place).join(before, "__hour").withColumn("slot", (F.col("__first") + F.col("__place")).cast("bigint"))
    return slots.withColumn("scheduled_us", (F.lit(start_us) + F.round(F.col("slot") * 1e6 / rate)).cast("bigint")).drop("__hour", "__place", "__first")
