"""Relational signatures at size: dies of a map stay where the map is, and give what a plain count gives."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dieflow.functions.geometry import hough_table
from dieflow.operators import signatures
from dieflow.plans.derive import wafers
from dieflow.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """What is sent from task to task: the exchanges' lines, without broadcasts."""
    return [x for x in plan(df).splitlines() if re.search(r"(?<!Broadcast)Exchange ", x)]


@pytest.fixture(scope="module")
def maps(spark):
    rng = np.random.default_rng(8)
    rows = [(k, r, c, bytes(rng.choice([0, 1, 2, 5, 200], r * c, p=[0.2, 0.4, 0.2, 0.1, 0.1]).astype(np.uint8))) for k, (r, c) in enumerate([(5, 7), (1, 1), (12, 12), (40, 3)] * 3)]
    return rows, spark.createDataFrame([*rows, (99, 2, 2, b"\0\1\1\0")], "wafer_id int, rows int, cols int, bins binary")


def votes_of(r, c, bins):
    cos, sin = hough_table()
    at = [(2 * (i % c) - (c - 1), (r - 1) - 2 * (i // c)) for i, b in enumerate(bins) if b >= 2]
    return Counter((a, (int(cos[a]) * x + int(sin[a]) * y) >> 15) for x, y in at for a in range(180))


@pytest.mark.parametrize("shuffled", [False, True])
def test_votes_and_peaks(maps, shuffled):
    rows, df = maps
    die = signatures.dies(df)
    die = die.repartition(5, "r") if shuffled else die  # dies from elsewhere need not lie together
    got = {(v.wafer_id, v.angle, v.rho): v.votes for v in signatures.hough_votes(die).collect()}
    each = {k: votes_of(r, c, bins) for k, r, c, bins in rows}
    assert got == {(k, *at): n for k, v in each.items() for at, n in v.items()}
    peaks = {p.wafer_id: (p.votes, p.angle, p.rho) for p in signatures.hough_peaks(die).collect()}
    assert peaks == {k: min(((n, a, o) for (a, o), n in v.items()), key=lambda t: (-t[0], t[1], t[2])) for k, v in each.items() if v}


def test_votes_of_a_very_large_map(spark):
    side = 33000  # doubled offsets over 16 bits
    die = spark.createDataFrame([(1, side, side, r, c, 3) for r, c in ((0, 0), (0, side - 1), (5, 9))], "wafer_id int, rows bigint, cols bigint, r bigint, c bigint, bin bigint")
    cos, sin = hough_table()
    at = [(2 * c - (side - 1), (side - 1) - 2 * r) for r, c in ((0, 0), (0, side - 1), (5, 9))]
    want = Counter((a, (int(cos[a]) * x + int(sin[a]) * y) >> 15) for x, y in at for a in range(180))
    assert {(v.angle, v.rho): v.votes for v in signatures.hough_votes(die).collect()} == want


@pytest.mark.parametrize("form", ["hough_votes", "join_counts", "count_features", "hough_peaks"])
def test_dies_are_not_sent_and_votes_not_listed(spark, form):
    df = getattr(signatures, form)(signatures.dies(wafers(spark, SF)))
    sent = [x for x in exchanges(df) if "REPARTITION_BY_NUM" not in x]
    # hough_peaks may send its peaks, a row a map.
    assert len(sent) <= (form == "hough_peaks") and "NestedLoop" not in plan(df)


def test_tasks_grow_with_the_maps(spark, maps, monkeypatch):
    monkeypatch.setattr(signatures, "TASK_MAPS", 1)
    rows, df = maps
    die = signatures.dies(df)
    assert die.rdd.getNumPartitions() == len(rows) + 1
    got = Counter((d.wafer_id, d.r, d.c, d.bin) for d in die.collect())
    assert got == Counter((k, i // c, i % c, b) for k, r, c, bins in [*rows, (99, 2, 2, b"\0\1\1\0")] for i, b in enumerate(bins))


def test_dies_stay_with_any_geometry_and_meet_few_conditions(spark):
    from dieflow.functions import geometry

    w = wafers(spark, SF)
    table = geometry.geometry_table(spark, w.select("rows", "cols"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = signatures.count_features(signatures.dies(w), geometry=table)
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    first = [x for x in text.splitlines() if "HashAggregate(keys=[wafer_id" in x and "zone" in x.split("functions=")[0]]
    assert first and all(x.count("count(") + x.count("count_if(") <= 2 for x in first)
    assert sorted(joined.collect()) == sorted(signatures.count_features(signatures.dies(w)).collect())


def test_imported_maps_are_listed_once(spark):
    from dieflow.plans import queries as Q

    assert "conv(" not in plan(Q.QUERIES["fab_import"](spark, SF))


def test_dies_are_read_once_for_peaks(spark):
    text = plan(signatures.hough_peaks(signatures.dies(wafers(spark, SF))))
    assert text.count("hashpartitioning(wafer_id") == 1 and "Join" not in text


def test_places_are_not_listed_die_by_die(spark):
    """What the joins' Generate copies is a word of dies: dies are counted into words below it."""
    text = plan(signatures.join_counts(signatures.dies(wafers(spark, SF))))
    assert "bit_or" in text.split("explode(array(")[1]


def test_joins_across_words(spark):
    """Maps wider than a word, and with empty places at its ends."""
    rng = np.random.default_rng(3)
    maps = {k: rng.choice([0, 1, 2, 7], (r, c), p=[0.2, 0.3, 0.3, 0.2]) for k, (r, c) in enumerate([(3, 31), (3, 32), (4, 33), (2, 64), (5, 97), (70, 1)])}
    rows = [(k, *m.shape, r, c, int(m[r, c])) for k, m in maps.items() for r, c in np.ndindex(m.shape)]
    got = {j.wafer_id: (j.dies, j.fails, j.joins, j.join_pairs, j.fail_joins) for j in signatures.join_counts(spark.createDataFrame(rows, "wafer_id int, rows bigint, cols bigint, r bigint, c bigint, bin bigint")).collect()}
    want = {}
    for k, m in maps.items():
        on = {at for at in np.ndindex(m.shape) if m[at]}
        near = {(r, c): [at for at in ((r - 1, c), (r, c - 1), (r + 1, c), (r, c + 1)) if at in on] for r, c in on}
        pairs = [(a, b) for a, n in near.items() for b in n if a < b]
        want[k] = (len(on), sum(m[at] >= 2 for at in on), len(pairs), sum(len(n) * (len(n) - 1) // 2 for n in near.values()), sum(m[a] >= 2 and m[b] >= 2 for a, b in pairs))
    assert got == want


def test_known_counts_make_no_map_twice(spark):
    w = wafers(spark, SF)
    spark.sparkContext.setJobGroup("dealt", "")
    signatures.dies(w, maps=200)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("dealt")


def test_a_ring_is_two_conditions(spark):
    from dieflow.functions import geometry

    shapes = spark.createDataFrame([(1, 1), (2, 7), (20, 20), (25, 27), (60, 40)], "rows int, cols int")
    table = geometry.geometry_table(spark, shapes)
    for s in ((1, 1), (2, 7), (20, 20), (25, 27), (60, 40)):
        of = geometry.tables(*s)
        got = table.where((F.col("rows") == s[0]) & (F.col("cols") == s[1])).orderBy("r", "c").select("ring", "zone").collect()
        assert [tuple(g) for g in got] == list(zip(of["ring"].tolist(), of["zone"].tolist()))
    num, den = F.col("num"), F.col("den")
    assert str(geometry.ring(num, den)).upper().count("WHEN") <= 2
