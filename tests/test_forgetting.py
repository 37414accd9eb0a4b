"""Forgetting by reuse distances and replay by supposition, against the sequential rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dieflow.operators import forgetting, hold, replay
from dieflow.operators.hold import HoldConfig

SCHEMA = "tool string, lot string, pattern string, at_us bigint, pos bigint"
PATTERNS = ("none", "none", "scratch", "center", "unknown")


def random_verdicts(seed, n=600, lots=25, tools=("a", "b", None)):
    # Lots come in bursts, one of them a third of the time; times tie.
    rng, rows, at = random.Random(seed), [], 0
    for pos in range(n):
        at += rng.choice([0, 1, 2, 30])
        lot = 0 if rng.random() < 0.33 else min(lots - 1, int(rng.expovariate(0.15)) + pos // 60)
        rows.append((rng.choice(tools), f"L{lot}", rng.choice(PATTERNS), at, pos))
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 500])
def test_smaller_before(n):
    v = np.random.default_rng(n).permutation(n)
    assert forgetting.smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("rows,slices", [(1, 7), (13, 4096), (1 << 18, 2048)])
def test_distances_equal_brute_force(spark, rows, slices):
    given = [(t or "", *r) for t, *r in random_verdicts(1)]
    got = {r.pos: r.distance for r in forgetting.reuse_distances(spark.createDataFrame(given, SCHEMA), rows=rows, slices=slices).collect()}
    last, want = {}, {}
    for i, (tool, lot, _, _, pos) in enumerate(given):
        since = last.get((tool, lot))
        want[pos] = None if since is None else len({g[1] for g in given[since + 1 : i] if g[0] == tool})
        last[tool, lot] = i
    assert got == want


@pytest.mark.parametrize("lots,tool_k", [(1, 0), (3, 2), (6, 3), (40, 1)])
def test_holds_equal_the_sequential_rule(spark, lots, tool_k):
    df = spark.createDataFrame(random_verdicts(lots), SCHEMA)
    config = HoldConfig(k=2, window=4, lots=lots, tool_k=tool_k, tool_window_us=15)
    want = hold.holds_in_order(df.withColumn("tool", F.coalesce("tool", F.lit(""))), config, "tool")
    got = forgetting.holds_forgetting(df.repartition(3), config, "tool", rows=37)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = forgetting.holds_forgetting(df, config, rows=101)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, hold.holds_in_order(df, config).collect()))


def test_no_verdicts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert forgetting.holds_forgetting(none, HoldConfig(), "tool").count() == 0
    done, rounds = replay.replay_to_fixed_point(none, HoldConfig(tool_k=2), 5, "tool")
    assert done.count() == 0 and rounds == 1


@pytest.mark.parametrize("seed,latency,tool_k", [(1, 0, 2), (2, 40, 3), (3, 1000, 3), (4, 7, 1)])
def test_replay_equals_the_sequential_replay(spark, seed, latency, tool_k):
    df = spark.createDataFrame([(t or "", *r) for t, *r in random_verdicts(seed)], SCHEMA).withColumn("n", F.lit(1))
    config = HoldConfig(k=3, window=4, lots=1 << 20, tool_k=tool_k, tool_window_us=25)
    got, rounds = replay.replay_to_fixed_point(df, config, latency, "tool")
    want = replay.replay_in_order(df, config, latency, "tool")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    holds = got.where("holds").count()
    assert holds and rounds <= holds + 2


def test_rounds_are_bounded(spark):
    df = spark.createDataFrame([(t or "", *r) for t, *r in random_verdicts(2)], SCHEMA)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        replay.replay_to_fixed_point(df, HoldConfig(k=3, window=4, lots=1 << 20, tool_k=3, tool_window_us=25), 7, "tool", most_rounds=1)


def test_few_lots_are_replayed_in_order(spark):
    df = spark.createDataFrame([(t or "", *r) for t, *r in random_verdicts(5)], SCHEMA)
    config = HoldConfig(k=2, window=4, lots=3, tool_k=2, tool_window_us=15)
    got = replay.replay(df, config, 10, "tool")
    assert got.agg(F.max("evictions")).first()[0] > 0


def test_swept_configs_are_replayed_together(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, f"L{rng.integers(30)}", i, int(t), str(rng.choice(["scratch", "center", "none"], p=[0.2, 0.2, 0.6]))) for i, t in enumerate(np.sort(rng.integers(0, 3000, 600)))]
    df = spark.createDataFrame(rows, "wafer_id long, lot string, pos long, at_us long, pattern string").withColumn("tool", F.right("lot", F.lit(1)))
    configs = [HoldConfig(k=3, window=5, lots=1 << 20, tool_k=k, tool_window_us=h) for k, h in ((2, 5), (2, 40), (3, 40))] + [HoldConfig(k=3, window=5, lots=1 << 20)]
    want = [(c.k, c.window, c.tool_k, c.tool_window_us, *replay.totals(replay.replay_in_order(df, c, 20, "tool")).first()) for c in configs]
    labels, sizes = [], []

    def counted(df, label, own=replay.written):
        labels.append(label)
        done = own(df, label)
        sizes.append(done.count())
        return done

    monkeypatch.setattr(replay, "written", counted)
    got = replay.sweep(df, configs, 20, "tool")
    assert labels.count("says") == 1 and sorted(map(tuple, got.collect())) == sorted(want)
    # Wafers after a hold within the lot has landed are left out of what rounds read.
    assert sizes[labels.index("says")] < df.where("pattern <> 'none'").count()
