"""Holds that wait for answers and batches that close at a deadline: the rules alone, and as streams with timers."""

import time

import pytest

from dieflow.protocol import gem, hsms
from dieflow.streaming import capture, lifecycle
from dieflow.streaming.lifecycle import ACKED, FAILED, SENT, UNRECORDED, WAITING, Cutter, Desk, Entry, Link


def entry(n, lot=None):
    return Entry(n, n, lot or f"L{n}", "scratch")


def states(changes):
    return [(e.lot, s, h) for e, s, h in changes]


def test_window_and_order():
    d = Desk(Link(window=2))
    for n in (3, 1, 2):
        assert states(d.hold(entry(n), 0)) == [(f"L{n}", WAITING, None)]
    assert states(d.send(0)) == [("L1", SENT, None), ("L2", SENT, None)] and d.send(0) == []
    assert states(d.answer(1, 0)) == [("L1", ACKED, 0)] and d.answer(1, 0) == [] and d.answer(77, 0) == []
    assert states(d.send(5)) == [("L3", SENT, None)]
    assert states(d.answer(2, 2)) == [("L2", FAILED, 2)] and states(d.answer(3, 5)) == [("L3", ACKED, 5)]
    assert not d.open and d.alarm() is None


def test_timeouts_and_tries():
    d = Desk(Link(window=1, reply_ms=100, tries=2))
    d.hold(entry(1), 0), d.hold(entry(2), 0)
    d.send(0)
    assert d.alarm() == 100 and d.expire(99) == []
    assert [(e.lot, s, e.system, e.tries) for e, s, _ in d.expire(100)] == [("L1", SENT, 2, 2)]
    assert d.answer(1, 0) == []  # an answer to the first command comes too late
    assert states(d.expire(200)) == [("L1", FAILED, None)] and states(d.send(200)) == [("L2", SENT, None)]


def test_capacity_and_repeats():
    d = Desk(Link(window=5, capacity=2))
    d.hold(entry(1), 0), d.hold(entry(2), 0)
    assert d.hold(entry(1), 0) == []
    assert states(d.hold(entry(3), 0)) == [("L3", UNRECORDED, None)] and len(d.open) == 2


def test_bad_links():
    for bad in ({"window": 0}, {"reply_ms": 0}, {"tries": 0}, {"capacity": 0}):
        with pytest.raises(ValueError):
            Link(**bad)


def test_cutter():
    c = Cutter(3, 10)
    assert c.close([], 5) == [] and c.close([0, 1], 9) == [] and c.close([0, 1], 10) == [(2, "deadline")]
    assert c.close([0] * 7, 3) == [(3, "size"), (3, "size")] and c.close([0] * 6, 99) == [(3, "size")] * 2


@pytest.fixture
def timers(spark):
    before = spark.conf.get(lifecycle.STORE[0])
    spark.conf.set(*lifecycle.STORE)
    yield spark
    spark.conf.set(lifecycle.STORE[0], before)


def until(done, seconds=90):
    for _ in range(seconds * 5):
        if done():
            return
        time.sleep(0.2)
    raise AssertionError("not in time")


HOLDS = "tool string, lot string, at_us bigint, seq bigint, pattern string"


def test_holds_are_answered_sent_again_or_fail(timers, tmp_path):
    spark = timers
    (tmp_path / "links").mkdir()
    spark.createDataFrame([("t", f"L{n}", n, n, "scratch") for n in range(5)] + [("u", "M", 9, 9, "donut")], HOLDS).coalesce(1).write.parquet(f"{tmp_path}/holds")
    holds = spark.readStream.schema(HOLDS).parquet(f"{tmp_path}/holds")
    answers = lifecycle.answers_of(capture.live_frames(spark, f"{tmp_path}/links"))
    sent = []

    def send(tool, system, body):
        action, values = gem.decode_host_command(body)
        assert action == gem.HOLD
        sent.append((tool, system, str(body)))
        lot = body[-2:].decode() if tool == "t" else "M"
        code = {"L0": 0, "L1": 4, "L2": 2}.get(lot)  # L3, L4 and M never get an answer
        if code is not None:
            with open(tmp_path / "links" / f"{tool}-1.bin", "ab") as f:
                f.write(hsms.frame(hsms.data_header(0, 2, 42, False, system), gem.encode_command_ack(code)))

    moves = lifecycle.track_holds(holds, answers, Link(window=2, reply_ms=3000, tries=2))
    q = lifecycle.deliver(moves, send, f"{tmp_path}/cp", f"{tmp_path}/record", compact_every=3, every="500 milliseconds")
    record = lifecycle.Record(spark, f"{tmp_path}/record")
    try:
        until(lambda: q.exception() or {r.lot: r.state for r in record.states().collect()} == {"L0": ACKED, "L1": ACKED, "L2": FAILED, "L3": FAILED, "L4": FAILED, "M": FAILED})
        assert q.exception() is None
        # The same holds again are known.
        spark.createDataFrame([("t", "L0", 0, 0, "scratch")], HOLDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/holds")
        n = q.lastProgress["batchId"]
        until(lambda: q.lastProgress["batchId"] > n + 4)  # with timers of processing time a query is never idle
    finally:
        q.stop()
    got = {r.lot: (r.state, r.hcack, r.tries) for r in record.states().collect()}
    assert got == {"L0": (ACKED, 0, 1), "L1": (ACKED, 4, 1), "L2": (FAILED, 2, 1), "L3": (FAILED, None, 2), "L4": (FAILED, None, 2), "M": (FAILED, None, 2)}
    assert len(sent) == 5 + 2 + 2  # two commands without answer on t, and one on u, are sent twice
    for n in (900, 901):
        record.write(n, record.states().limit(0).drop("batch"))
        record.compact()
    assert record._parts() == (901, ["base-000000000901"]) and [n for n in record._names() if n < "base-1"] == ["base-000000000900", "base-000000000901"]
    assert [n for n in record._names() if n.startswith("batch-")] == ["batch-000000000901"]
    assert {r.lot: (r.state, r.hcack, r.tries) for r in record.states().collect()} == got


def test_batches_close_by_size_or_deadline(timers, tmp_path):
    spark = timers
    schema = "tool string, n bigint, bins binary"
    spark.createDataFrame([("t", n, bytes([n])) for n in range(7)] + [("u", 9, b"x")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    given = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = lifecycle.batched(given, "tool", size=3, deadline_ms=2500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    read = lambda: {(r.tool, r.n): (r.batch, r.closed_by, bytes(r.bins)) for r in spark.read.schema(f"{schema}, batch bigint, closed_by string").parquet(f"{tmp_path}/out").collect()}
    try:
        until(lambda: q.exception() or (tmp_path / "out").exists() and len(read()) == 8)
        assert q.exception() is None
    finally:
        q.stop()
    got = read()
    assert {k: v[:2] for k, v in got.items()} == {**{("t", n): (n // 3, "size") for n in range(6)}, ("t", 6): (2, "deadline"), ("u", 9): (0, "deadline")}
    assert got["t", 4][2] == b"\x04"
    with pytest.raises(ValueError):
        lifecycle.batched(given, "tool", size=0)
