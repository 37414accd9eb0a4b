"""Closed-loop replay: what would have been sorted had the holds been obeyed.

Wafers are rows (wafer_id, lot, at_us, pos, pattern), pattern being the verdict.
A hold lands `latency_us` after its verdict; the lot's later wafers are then
withheld and never observed.  Without the cross-lot rule lots don't affect one
another and everything is a window; with it one lot's hold changes what others
see, and holds are supposed and found anew until they agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.operators.hold import HoldConfig, HoldRule, arrivals_in_time, holds
from dieflow.patterns import patterned
from dieflow.scratch import written

HOUR_US = 3_600_000_000


def replay(wafers: DataFrame, config: HoldConfig, latency_us: int, key: str | None = None) -> DataFrame:
    """wafers plus withheld, holds (this verdict held the lot), by_tool and lands_us (of the lot's hold, or null).

    The cross-lot rule looks at the lots of one `key`, such as a tool; without one, at all lots.
    With that rule there is evictions too, the lots forgotten so far.  Lots are
    forgotten only where a key has more than config.lots; then each key is one
    order, and one task.
    """
    if config.tool_k:
        return replay_in_order(wafers, config, latency_us, key) if _most_lots(wafers, key) > config.lots else replay_to_fixed_point(wafers, config, latency_us, key)[0]
    held = holds(wafers, config).select("lot", F.col("pos").alias("held_pos"), (F.col("at_us") + latency_us).alias("lands_us"))
    both = wafers.join(held, "lot", "left")
    return both.select(*wafers.columns, F.coalesce(F.col("at_us") > F.col("lands_us"), F.lit(False)).alias("withheld"), F.coalesce(F.col("pos") == F.col("held_pos"), F.lit(False)).alias("holds"), F.lit(False).alias("by_tool"), "lands_us")


def _most_lots(wafers: DataFrame, key: str | None) -> int:
    tool = F.col(key).cast("string") if key else F.lit("")
    return wafers.groupBy(tool.alias("tool")).agg(F.countDistinct("lot").alias("n")).agg(F.max("n")).first()[0] or 0


def replay_to_fixed_point(wafers: DataFrame, config: HoldConfig, latency_us: int, key: str | None = None, most_rounds: int = 1000) -> tuple[DataFrame, int]:
    """The replay with both rules where nothing is forgotten, in parallel; and how many rounds it took.

    A round supposes when each lot's hold lands, and finds from the wafers
    observed then when each lot is first held.  What the rule within a lot says
    depends on no other lot, so only arrivals of the cross-lot rule are found
    anew.  A hold changes nothing before it lands, so all holds up to the first
    landing that two rounds disagree about are final: the next round reads only
    what comes after, and one rule's reach before it.  That time grows with
    every round, by one hold at least; when a round changes nothing, the
    supposition is the sequential rule's result.

    An error is raised after most_rounds.  A null key counts as the empty one.
    """
    keyed, held, rounds = _fixed_points(wafers, [config], latency_us, key, most_rounds)
    mine = held.select(F.col("tool").alias("__tool"), "lot", F.col("pos").alias("__pos"), F.col("by_tool").alias("__by"), (F.col("at_us") + latency_us).alias("lands_us"))
    both = keyed.join(mine, ["__tool", "lot"], "left")
    return both.select(*wafers.columns, *_seen("__pos", "__by", "lands_us"), "lands_us", F.lit(0).cast("bigint").alias("evictions")), rounds[0]


def _seen(pos: str, by_tool: str, lands_us: str) -> list[Column]:
    """withheld, holds and by_tool of a wafer whose lot is first held so, or never where these are null."""
    here = F.coalesce(F.col("pos") == F.col(pos), F.lit(False))
    return [F.coalesce(F.col("at_us") > F.col(lands_us), F.lit(False)).alias("withheld"), here.alias("holds"), (here & F.coalesce(by_tool, F.lit(False))).alias("by_tool")]


def _fixed_points(wafers: DataFrame, configs: Sequence[HoldConfig], latency_us: int, key: str | None, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame, list[int]]:
    """wafers plus __tool, the first holds (config, tool, lot, at_us, pos, by_tool) by the config's place, and the rounds of each config.

    The configs have one k and one window: what the rule within a lot says is
    found once for all, and a round is one job for all that still change.  A
    lot is held by that rule at the latest, whatever the other says, so its
    wafers after that hold has landed are never observed and are left out.
    """
    k, window = configs[0].k, configs[0].window
    tool = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    keyed = wafers.withColumn("__tool", tool)
    narrow = keyed.select(F.col("__tool").alias("tool"), "lot", "pattern", F.col("at_us").cast("bigint").alias("at_us"), F.col("pos").cast("bigint").alias("pos"))
    order = W.partitionBy("tool", "lot").orderBy("at_us", "pos")
    same = F.size(F.filter(F.collect_list("pattern").over(order.rowsBetween(1 - window, 0)), lambda p: p == F.col("pattern")))
    told = narrow.withColumn("in_lot", (same >= k) & patterned(F.col("pattern")))
    told = told.withColumn("latest_us", F.min(F.when(F.col("in_lot"), F.col("at_us") + max(0, latency_us))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    says = written(told.where(patterned(F.col("pattern")) & (F.col("latest_us").isNull() | (F.col("at_us") <= F.col("latest_us")))).drop("latest_us"), "says")
    held, since, rounds, active = None, {}, [0] * len(configs), list(range(len(configs)))
    while active:
        if rounds[active[0]] == most_rounds:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds, final up to {min(since.values())}")
        of = lambda i: None if held is None else held.where(F.col("config") == i).drop("config")  # noqa: B023, E731
        parts = [_first_holds(says, of(i), since.get(i), configs[i], latency_us).select(F.lit(i).alias("config"), "*") for i in active]
        if len(active) < len(configs):
            parts.append(held.where(~F.col("config").isin(active)))
        new = written(reduce(DataFrame.unionByName, parts), "held")
        for i in active:
            rounds[i] += 1
        since = _first_changes(held, new, latency_us)
        held, active = new, [i for i in active if i in since]
    return keyed, held, rounds


def _first_holds(says: DataFrame, held: DataFrame | None, since: int | None, config: HoldConfig, latency_us: int) -> DataFrame:
    """(tool, lot, at_us, pos, by_tool) of each lot's first hold, given the holds supposed so far, of which those up to `since` are final."""
    rows = says if since is None else says.where(F.col("at_us") > since - config.tool_window_us)
    if held is not None:
        lands = held.select("tool", "lot", (F.col("at_us") + latency_us).alias("lands_us"))
        rows = rows.join(lands, ["tool", "lot"], "left").where(F.col("lands_us").isNull() | (F.col("at_us") <= F.col("lands_us"))).drop("lands_us")
    across = rows if config.tool_k == 1 else arrivals_in_time(rows, config, ("tool",))
    fires = across.unionAll(rows.where("in_lot"))
    columns = ("tool", "lot", "at_us", "pos", (~F.col("in_lot")).alias("by_tool"))
    found = fires.select(*columns)
    if since is not None:
        found = found.where(F.col("at_us") > since).unionAll(held.where(F.col("at_us") <= since))
    return found.groupBy("tool", "lot").agg(F.min(F.struct("at_us", "pos", "by_tool")).alias("f")).select("tool", "lot", "f.*")


def _first_changes(before: DataFrame | None, after: DataFrame, latency_us: int) -> dict[int, int]:
    """By config, the first landing that one of two suppositions has and the other hasn't; those without any are left out."""
    if before is None:
        found = after
    else:
        columns = ["config", "tool", "lot", "at_us", "pos", "by_tool"]
        found = before.select(*columns, F.lit(1).alias("n")).unionAll(after.select(*columns, F.lit(-1).alias("n"))).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    first = found.groupBy("config").agg(F.min("at_us").alias("at_us")).where("at_us is not null")
    return {r.config: r.at_us + latency_us for r in first.collect()}


def replay_in_order(wafers: DataFrame, config: HoldConfig, latency_us: int, key: str | None = None) -> DataFrame:
    """The same one wafer after the other, with forgetting and the cross-lot rule; adds evictions, the count at that wafer.

    Spark sorts each key's wafers, and they are read a batch at a time: a task
    holds what the rule remembers and the held lots, however many wafers a key has.
    """
    names = wafers.columns
    at_column = names.index("at_us")

    def run(batches):
        tool, rule, lands = object(), None, {}
        for batch in batches:
            rows = []
            for own, lot, pattern, at in zip(*(batch.column(c).to_pylist() for c in (len(names), names.index("lot"), names.index("pattern"), at_column))):
                if own != tool:
                    tool, rule, lands = own, HoldRule(config), {}
                if lot in lands and at > lands[lot]:
                    rows.append((True, False, False, rule.evictions))
                    continue
                before = rule.tool_holds
                hit = rule.observe(lot, pattern, at)
                if hit:
                    lands[lot] = at + latency_us
                rows.append((False, hit is not None, rule.tool_holds > before, rule.evictions))
            more = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "__tool", "withheld", "holds", "by_tool", "evictions"])

    keyed = wafers.withColumn("__tool", F.col(key).cast("string") if key else F.lit(""))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    seen = keyed.repartition("__tool").sortWithinPartitions("__tool", "at_us", "pos").mapInArrow(run, f"{kinds}, withheld boolean, holds boolean, by_tool boolean, evictions bigint")
    # A lot that was forgotten may be held again: its last hold counts.
    lands = (F.max(F.when(F.col("holds"), F.col("at_us"))).over(W.partitionBy("__tool", "lot")) + latency_us).cast("bigint")
    return seen.select(*names, "withheld", "holds", "by_tool", lands.alias("lands_us"), "evictions")


def outcomes(replayed: DataFrame, excursion_of: DataFrame, excursions: DataFrame) -> DataFrame:
    """One row an excursion: id, pattern, wafers, first_sorted_us, sorted, lots_held, hold_us, sorted_before_hold.

    Withheld wafers count as wafers and for first_sorted_us.  A hold is
    credited to the excursion of the wafer that triggered it.
    """
    at = replayed.join(excursion_of, "wafer_id").withColumn("hold_at", F.when(F.col("holds"), F.col("lands_us")))
    first = at.groupBy("excursion_id").agg(F.min("hold_at").alias("hold_us"))
    by = at.join(first, "excursion_id").groupBy("excursion_id", "hold_us").agg(
        F.count("*").alias("wafers"),
        F.min("at_us").alias("first_sorted_us"),
        F.count_if(~F.col("withheld")).alias("sorted"),
        F.count_if("holds").alias("lots_held"),
        F.count_if(~F.col("withheld") & (F.col("hold_us").isNull() | (F.col("at_us") < F.col("hold_us")))).alias("sorted_before_hold"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("wafers", "sorted", "lots_held", "sorted_before_hold")]
    return excursions.join(by, excursions["id"] == by["excursion_id"], "left").select("id", "pattern", *zero, "first_sorted_us", "hold_us")


def totals(replayed: DataFrame, excursion_of: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(sorted, holds, false_holds, tool_holds, lots, min_lot_gap_us, withheld) in one row, or one for each `by`."""
    known = replayed.join(excursion_of.select("wafer_id", F.lit(True).alias("__known")).distinct(), "wafer_id", "left") if excursion_of is not None else replayed.withColumn("__known", F.lit(None).cast("boolean"))
    gap = F.col("at_us") - F.lag("at_us").over(W.partitionBy(*by, "lot", "withheld").orderBy("at_us", "pos"))
    rows = known.select(*by, "lot", "withheld", "holds", "by_tool", "__known", gap.alias("gap"))
    seen = ~F.col("withheld")
    return rows.groupBy(*by).agg(
        F.count_if(seen).alias("sorted"),
        F.count_if(seen & F.col("holds")).alias("holds"),
        F.count_if(seen & F.col("holds") & F.col("__known").isNull()).alias("false_holds"),
        F.count_if(seen & F.col("by_tool")).alias("tool_holds"),
        F.countDistinct(F.when(seen, F.col("lot"))).alias("lots"),
        F.min(F.when(seen, F.col("gap"))).alias("min_lot_gap_us"),
        F.count_if("withheld").alias("withheld"),
    )


def sweep(wafers: DataFrame, configs: Sequence[HoldConfig], latency_us: int, key: str | None = None) -> DataFrame:
    """totals() of every config: columns k, window, tool_k, tool_window_us and the totals.

    Configs with the cross-lot rule that forget nothing are replayed together, as many as have one k and window.
    """
    most = _most_lots(wafers, key) if any(c.tool_k for c in configs) else 0
    together: dict[tuple[int, int], list[HoldConfig]] = {}
    rows = []
    for c in configs:
        if c.tool_k and most <= c.lots:
            together.setdefault((c.k, c.window), []).append(c)
        else:
            rows.append(totals(replay(wafers, c, latency_us, key)).select(F.lit(c.k).alias("k"), F.lit(c.window).alias("window"), F.lit(c.tool_k).alias("tool_k"), F.lit(c.tool_window_us).cast("bigint").alias("tool_window_us"), "*"))
    return reduce(DataFrame.unionByName, [*rows, *(_sweep_together(wafers, own, latency_us, key) for own in together.values())])


def _sweep_together(wafers: DataFrame, configs: Sequence[HoldConfig], latency_us: int, key: str | None) -> DataFrame:
    keyed, held, _ = _fixed_points(wafers, configs, latency_us, key)
    hold = F.struct(F.col("pos").alias("p"), F.col("by_tool").alias("b"), (F.col("at_us") + latency_us).alias("lands_us"))
    # A lot's holds under all configs are one row, so the wafers are joined once.
    by_lot = held.groupBy(F.col("tool").alias("__tool"), "lot").agg(*(F.max(F.when(F.col("config") == i, hold)).alias(f"__h{i}") for i in range(len(configs))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("config"), *(F.col(f"__h{i}.{f}").alias(f) for f in ("p", "b", "lands_us"))) for i in range(len(configs))))).alias("h")
    both = keyed.join(by_lot.hint("shuffle_hash"), ["__tool", "lot"], "left").select("lot", "at_us", "pos", each)
    replayed = both.select(F.col("h.config").alias("__config"), "lot", "at_us", "pos", *_seen("h.p", "h.b", "h.lands_us"))
    names = ("k", "window", "tool_k")
    rows = (F.struct(F.lit(i).alias("__config"), *(F.lit(getattr(c, n)).alias(n) for n in names), F.lit(c.tool_window_us).cast("bigint").alias("tool_window_us")) for i, c in enumerate(configs))
    given = wafers.sparkSession.range(1).select(F.inline(F.array(*rows)))
    counts = totals(replayed, by=("__config",))
    zero = [c if c == "min_lot_gap_us" else F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns[1:]]
    return given.join(counts, "__config", "left").select("k", "window", "tool_k", "tool_window_us", *zero)


def report(outcome: DataFrame, excursions: DataFrame, alarms: DataFrame, wafers: DataFrame, excursion_of: DataFrame) -> DataFrame:
    """outcomes beside published alarms: hours from the excursion's start to hold and alarm, and wafers tested before the alarm."""
    timed = outcome.join(excursions.select("id", "start_us"), "id").join(alarms.select(F.col("excursion_id").alias("id"), "alarm_h"), "id", "left")
    timed = timed.withColumn("alarm_us", (F.col("start_us") + F.col("alarm_h") * HOUR_US).cast("bigint"))
    own = wafers.join(excursion_of, "wafer_id").select(F.col("excursion_id").alias("id"), F.col("at_us").alias("tested"))
    before = own.join(timed.select("id", "alarm_us"), "id").groupBy("id").agg(F.count_if(F.col("tested") < F.col("alarm_us")).alias("before_alarm"))
    hours = lambda c: F.round((F.col(c) - F.col("start_us")) / HOUR_US, 6)
    return timed.join(before, "id", "left").select("id", "pattern", "wafers", "lots_held", "sorted_before_hold", hours("first_sorted_us").alias("first_sorted_h"), hours("hold_us").alias("hold_h"), "alarm_h", F.coalesce("before_alarm", F.lit(0)).alias("before_alarm"))


def summary(outcome: DataFrame, excursions: DataFrame) -> DataFrame:
    """(excursions, held, median_inline_h, median_start_h, sorted_before_hold)."""
    both = outcome.join(excursions.select("id", "start_us"), "id")
    hours = lambda since: F.median((F.col("hold_us") - F.col(since)) / HOUR_US)
    return both.agg(F.count("*").alias("excursions"), F.count("hold_us").alias("held"), hours("first_sorted_us").alias("median_inline_h"), hours("start_us").alias("median_start_h"), F.sum("sorted_before_hold").alias("sorted_before_hold"))
