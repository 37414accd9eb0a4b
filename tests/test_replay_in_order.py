"""Replays in order hold what the rule remembers, not a tool's wafers."""

import random

from dieflow.operators import replay
from dieflow.operators.hold import HoldConfig, HoldRule


def test_in_order_by_batches(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abc") if i % 50 else None, f"L{rng.randrange(12)}", rng.randrange(4000), rng.choice(["scratch", "center", "none"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "pos bigint, tool string, lot string, at_us bigint, pattern string").repartition(5)
    config = HoldConfig(k=2, window=3, lots=4, tool_k=3, tool_window_us=9)
    want = {}
    for tool in {r[1] for r in rows}:
        rule, lands, own = HoldRule(config), {}, sorted((r for r in rows if r[1] == tool), key=lambda r: (r[3], r[0]))
        for pos, _, lot, at, pattern in own:
            if lot in lands and at > lands[lot]:
                want[pos] = [True, False, False, rule.evictions]
                continue
            before = rule.tool_holds
            hit = rule.observe(lot, pattern, at)
            if hit:
                lands[lot] = at + 300
            want[pos] = [False, hit is not None, rule.tool_holds > before, rule.evictions]
        for r in own:
            want[r[0]].append(lands.get(r[2]))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = replay.replay_in_order(df, config, 300, "tool")
        got = {r.pos: [r.withheld, r.holds, r.by_tool, r.evictions, r.lands_us] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == want and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
