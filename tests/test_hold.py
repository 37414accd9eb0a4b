import pytest

from dieflow.operators import hold, replay
from dieflow.operators.hold import HoldConfig, HoldRule
from dieflow.plans import queries
from dieflow.plans.derive import verdicts
from dieflow.streaming.emulator import Replay

NAMES = {"n": "none", "c": "center", "s": "scratch", "d": "donut", "e": "edge_ring", "l": "loc", "u": "unknown"}


def observed(config, sequence):
    rule = HoldRule(config)
    return rule, [rule.observe(lot, NAMES[p], at) for lot, p, at in sequence]


def in_one_lot(text):
    return [("A", p, i) for i, p in enumerate(text)]


@pytest.mark.parametrize("k,w,text,held_at", [(3, 5, "cnccc", 3), (2, 4, "n" * 10 + "csds", 13), (2, 3, "ennee", 4), (1, 1, "unc", 2)])
def test_in_lot(k, w, text, held_at):
    _, out = observed(HoldConfig(k=k, window=w), in_one_lot(text))
    assert [i for i, x in enumerate(out) if x] == [held_at]


def test_forgetting():
    rule, out = observed(HoldConfig(k=1, window=1, lots=2), [("A", "c", 0), ("B", "n", 1), ("B", "n", 2), ("C", "n", 3), ("A", "c", 4)])
    assert out == ["center", None, None, None, "center"] and rule.evictions == 2 and rule.held("A") and not rule.held("B")


def test_across_lots():
    c = HoldConfig(k=3, window=5, tool_k=3, tool_window_us=100)
    rule, out = observed(c, [("A", "d", 0), ("B", "n", 10), ("B", "d", 20), ("C", "s", 30), ("C", "d", 100), ("D", "d", 110)])
    assert out == [None, None, None, None, "donut", "donut"] and rule.tool_holds == 2
    _, out = observed(HoldConfig(k=3, window=5, tool_k=2, tool_window_us=50), [("A", "l", 0), ("B", "l", 51), ("C", "l", 101)])
    assert out == [None, None, "loc"]
    rule, out = observed(HoldConfig(k=1, window=1, tool_k=3, tool_window_us=1000), [("A", "c", 0), ("A", "c", 1), ("B", "c", 2)])
    assert out == ["center", None, "center"] and rule.tool_holds == 0


def test_bad_configs():
    for bad in ({"k": 0}, {"k": 6, "window": 5}, {"lots": 0}, {"tool_k": -1}):
        with pytest.raises(ValueError):
            HoldConfig(**bad)


@pytest.mark.parametrize("config", [HoldConfig(lots=1 << 20), HoldConfig(k=2, window=4, lots=1 << 20, tool_k=3, tool_window_us=600_000_000), HoldConfig(k=3, window=3, lots=1 << 20, tool_k=1, tool_window_us=0)])
def test_windows_equal_the_sequential_rule(spark, config):
    v = verdicts(spark, "/root/testdata/sf0.001")
    want = sorted(tuple(r) for r in hold.holds_in_order(v, config).select("lot", "at_us", "pos", "pattern", "by_tool").collect())
    assert sorted(tuple(r) for r in hold.holds(v, config).select("lot", "at_us", "pos", "pattern", "by_tool").collect()) == want
    assert hold.holds(v.limit(0), config).count() == 0 and hold.holds_in_order(v.limit(0), config).count() == 0


MINUTE = 60_000_000


def scenario(spark, lot3_scratch=False):
    rows = []
    for i in range(30):
        lot, k = 1 + i // 10, i % 10
        pattern = "center" if lot == 2 and k >= 3 and k != 4 else "scratch" if lot3_scratch and lot == 3 and k < 3 else "none"
        rows.append((100 + i, f"LOT-{lot:06d}", (1000 + i) * MINUTE, i, pattern))
    wafers = spark.createDataFrame(rows, "wafer_id bigint, lot string, at_us bigint, pos bigint, pattern string")
    of = spark.createDataFrame([(100 + i, 7) for i in range(13, 20)], "wafer_id bigint, excursion_id bigint")
    return wafers, of, spark.createDataFrame([(7, "center")], "id bigint, pattern string")


@pytest.mark.parametrize(
    "config,latency,lot3,hold_us,before,withheld,holds,false,tool",
    [
        (HoldConfig(), 5000, False, 1016 * MINUTE + 5000, 4, 3, 1, 0, 0),
        (HoldConfig(), 90_000_000, False, 1016 * MINUTE + 90_000_000, 5, 2, 1, 0, 0),
        (HoldConfig(), 5000, True, 1016 * MINUTE + 5000, 4, 10, 2, 1, 0),
        (HoldConfig(tool_k=2, tool_window_us=2 * MINUTE), 5000, False, 1015 * MINUTE + 5000, 3, 4, 1, 0, 1),
        (HoldConfig(tool_k=2, tool_window_us=MINUTE), 5000, False, 1016 * MINUTE + 5000, 4, 3, 1, 0, 0),
    ],
)
def test_scenario(spark, config, latency, lot3, hold_us, before, withheld, holds, false, tool):
    wafers, of, excursions = scenario(spark, lot3)
    done = replay.replay(wafers, config, latency)
    o = replay.outcomes(done, of, excursions).first()
    assert (o.wafers, o.hold_us, o.sorted_before_hold, o.lots_held) == (7, hold_us, before, 1)
    t = replay.totals(done, of).first()
    assert (t.withheld, t.sorted, t.holds, t.false_holds, t.tool_holds, t.min_lot_gap_us) == (withheld, 30 - withheld, holds, false, tool, MINUTE)
    again = replay.totals(replay.replay_in_order(wafers, config, latency), of).first()
    assert again == t


def test_emulator_replay():
    r = Replay([(12, "1", 3), (10, "1", 1), (20, "2", 4), (11, "1", 2), (13, "1", 6), (21, "2", 5)], rate=10)
    assert r.next(0) == (10, 0) and r.next(0) is None
    assert (r.hold("1"), r.hold("1"), r.hold("9")) == ("done", "already_in_condition", "no_such_object")
    assert r.next(100_000) == (20, 100_000) and r.next(1_000_000) == (21, 200_000)
    assert r.next(2_000_000) is None and r.withheld == 3 and r.finished
    assert r.release("1") == "done" and r.release("1") == "already_in_condition"


def run_by_hand(rows, k, window, lots, tool_k, within_us, latency_us=None):
    """Each verdict's (withheld, holds, by_tool, evictions so far), tool by tool: lists of all a lot showed, and a list of lots from the oldest to the newest."""
    out = {}
    for tool in {r.lot[-1] for r in rows}:
        shown, order, lands, said, held, gone = {}, [], {}, {}, set(), 0
        for r in rows:
            if r.lot[-1] != tool:
                continue
            if latency_us is not None and r.at_us > lands.get(r.lot, r.at_us):
                out[r.pos] = (True, False, False, gone)
                continue
            if r.lot in order:
                order.remove(r.lot)
            elif len(order) == lots:
                old = order.pop(0)
                held.discard(old)
                shown.pop(old)
                gone += 1
            order.append(r.lot)
            shown.setdefault(r.lot, []).append(r.pattern)
            says = r.pattern not in ("none", "unknown")
            if says:
                said.setdefault(r.pattern, []).append(r.at_us)
            fires = across = False
            if says and r.lot not in held:
                last = said[r.pattern][-tool_k:]
                inside = shown[r.lot][-window:].count(r.pattern) >= k
                across = not inside and len(last) == tool_k and r.at_us - last[0] <= within_us
                fires = inside or across
            if fires:
                held.add(r.lot)
                lands[r.lot] = r.at_us + (latency_us or 0)
            out[r.pos] = (False, fires, across, gone)
    return out


@pytest.fixture(scope="module")
def ordered(spark):
    return sorted(verdicts(spark, "/root/testdata/sf0.01").collect(), key=lambda r: (r.at_us, r.pos))


def test_forgetting_equals_brute_force(spark, ordered):
    want = {p: (x[2], x[3]) for p, x in run_by_hand(ordered, 3, 5, 5, 3, 600_000_000).items() if x[1]}
    got = {r.pos: (r.by_tool, r.evictions) for r in queries.holds_forgetting(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and any(e for _, e in got.values())


def test_replay_of_both_rules_equals_brute_force(spark, ordered):
    want = run_by_hand(ordered, 3, 5, 1 << 20, 3, 600_000_000, queries.LATENCY_US)
    got = {r.pos: (r.withheld, r.holds, r.by_tool, r.evictions) for r in queries.replay_both_rules(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and any(x[2] for x in got.values())


def test_sweep_across_lots_equals_brute_force(spark, ordered):
    want = set()
    for k in (2, 3, 5):
        for minutes in (1, 10):
            of = run_by_hand(ordered, 3, 5, 1 << 20, k, minutes * 60_000_000, queries.LATENCY_US).values()
            want.add((k, minutes * 60_000_000, sum(not x[0] for x in of), sum(x[0] for x in of), sum(x[1] for x in of), sum(x[2] for x in of)))
    got = queries.sweep_across_lots(spark, "/root/testdata/sf0.01").select("tool_k", "tool_window_us", "sorted", "withheld", "holds", "tool_holds")
    assert {tuple(r) for r in got.collect()} == want
