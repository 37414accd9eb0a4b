import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dieflow.operators import messages
from dieflow.protocol import gem, hsms, secs
from dieflow.protocol.secs import A, B, Item, L, SecsError, U


def test_golden_bytes():
    assert secs.encode(L()).hex() == "0100" and secs.encode(A("LOT-1")).hex() == "41054c4f542d31" and secs.encode(U("U4", 1)).hex() == "b10400000001"
    assert gem.encode_lot_command("HOLD", "LOT-0042").hex().upper() == "01024104484F4C450101010241054C4F54494441084C4F542D30303432".replace("4C45", "4C44")
    assert gem.encode_command_ack(0).hex() == "01022101000100"
    r = gem.WaferReport(1, "LOT-0042", 17, 3, 3, bytes([0, 1, 0, 1, 2, 1, 0, 1, 0]))
    assert len(gem.encode_wafer_report(r)) == 61 and gem.decode_wafer_report(gem.encode_wafer_report(r)) == r


@pytest.mark.parametrize(
    "data,code,offset",
    [("", "truncated", 0), ("40", "zero_length_bytes", 0), ("0D00", "unknown_format", 0), ("41", "truncated", 0), ("4105414243", "truncated", 0), ("A90101", "bad_array_length", 0), ("0102A50101", "truncated", 5), ("010141", "truncated", 2), ("A5010100", "trailing_bytes", 3)],
)
def test_error_offsets(data, code, offset):
    with pytest.raises(SecsError) as e:
        secs.decode(bytes.fromhex(data))
    assert (e.value.code, e.value.offset) == (code, offset)


def test_depth():
    assert secs.validate(b"\x01\x01" * 64 + b"\x01\x00") == 130
    with pytest.raises(SecsError, match="too_deep at 128"):
        secs.validate(b"\x01\x01" * 65 + b"\x01\x00")


ints = {"I1": 8, "I2": 16, "I4": 32, "I8": 64}
leaf = st.one_of(
    st.text(st.characters(max_codepoint=255), max_size=20).map(A),
    st.binary(max_size=9).map(lambda b: Item("B", b)),
    st.lists(st.booleans(), max_size=5).map(lambda v: Item("BOOLEAN", tuple(v))),
    *(st.lists(st.integers(-(1 << n - 1), (1 << n - 1) - 1), max_size=4).map(lambda v, f=f: Item(f, tuple(v))) for f, n in ints.items()),
    *(st.lists(st.integers(0, (1 << n) - 1), max_size=4).map(lambda v, f=f: Item("U" + f[1], tuple(v))) for f, n in ints.items()),
    st.lists(st.floats(allow_nan=False), max_size=3).map(lambda v: Item("F8", tuple(v))),
)
tree = st.recursive(leaf, lambda c: st.lists(c, max_size=4).map(lambda v: L(*v)), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(tree)
def test_random_trees(item):
    data = secs.encode(item)
    assert secs.decode(data) == item and secs.validate(data) == len(data) and secs.to_sml(item)
    assert len(secs.nodes(data)) == data_items(item)
    for n in range(0, len(data), max(1, len(data) // 7)):
        with pytest.raises(SecsError):
            secs.decode(data[:n])


def data_items(item):
    return 1 + (sum(map(data_items, item.value)) if item.format == "L" else 0)


def test_text():
    assert secs.to_sml(L(A('a"b'), L(), B(1, 255), Item("BOOLEAN", (True, False)), Item("F8", (1.0, 0.5)), Item("I2", (-5,)))) == '<L [6]\n  <A "a" 0x22 "b">\n  <L [0]>\n  <B 0x01 0xFF>\n  <BOOLEAN T F>\n  <F8 1 0.5>\n  <I2 -5>\n>'
    with pytest.raises(SecsError):
        A("x").unsigned()
    with pytest.raises(SecsError):
        L(A("x")).at(1)


def test_alarm():
    assert gem.decode_alarm(gem.encode_alarm(True, 5, 9, "hot")) == (True, 5, 9, "hot")
    with pytest.raises(gem.GemError):
        gem.decode_alarm(gem.encode_ack(0))


def test_native_encoders_equal_the_codec(spark):
    from pyspark.sql import functions as F

    bins = bytes(i % 4 for i in range(20 * 20))
    df = spark.createDataFrame([(7, "LOT-é", 9, 20, 20, bytearray(bins))], "d int, lot string, w int, r int, c int, b binary")
    row = df.select(messages.wafer_report(*(F.col(x) for x in "d lot w r c b".split())).alias("body"), messages.alarm(F.lit(True), F.lit(3), F.lit(5), F.col("lot")).alias("alarm"), messages.lot_command(F.lit("RELEASE"), F.col("lot")).alias("cmd")).first()
    assert bytes(row.body) == gem.encode_wafer_report(gem.WaferReport(7, "LOT-é", 9, 20, 20, bins))
    assert bytes(row.alarm) == gem.encode_alarm(True, 3, 5, "LOT-é") and bytes(row.cmd) == gem.encode_lot_command("RELEASE", "LOT-é")
    bodies = spark.createDataFrame([(row.body,), (bytearray(b"\x41"),), (None,)], "body binary")
    got = bodies.select(messages.validate("body").alias("v"), messages.canonical("body").alias("c"), messages.wafer_reports("body").alias("r")).collect()
    assert [(g.v.length, g.v.code) for g in got] == [(len(row.body), None), (None, "truncated"), (None, "truncated")]
    assert bytes(got[0].c) == bytes(row.body) and got[1].c is None and got[0].r.wafer == 9 and got[1].r.wafer is None
    assert messages.node_rows(bodies).count() == 12


def pair(**config):
    a, b = hsms.Protocol(hsms.Config(active=True, **config)), hsms.Protocol(hsms.Config(**config))
    a.connected(0.0)
    b.connected(0.0)
    return a, b


def pump(a, b, now, ends=()):
    events = {0: [], 1: []}
    moved = True
    while moved:
        moved = False
        for i, (p, q) in enumerate(((a, b), (b, a))):
            if out := p.take_output():
                q.received(out, now)
                moved = True
        for i, p in enumerate((a, b)):
            for e in p.advance(now):
                events[i].append(e)
                if ends:
                    ends[i].on_hsms(e, now)
                moved = True
    return events


def kinds(p, now):
    return [e.kind for e in p.advance(now)]


def reasons(p, now):
    return [e.reason for e in p.advance(now)]


def test_select_data_and_timers():
    a, b = pair(linktest=30.0)
    ev = pump(a, b, 0.1)
    assert [e.kind for e in ev[0]] == ["selected"] and [e.kind for e in ev[1]] == ["selected"]
    system = a.send(1, 1, True, b"x", 1.0)
    ev = pump(a, b, 1.0)
    assert ev[1][0].kind == "primary" and ev[1][0].body == b"x"
    assert a.next_deadline() == pytest.approx(30.1)
    b.reply(ev[1][0].header, b"y")
    assert [(e.kind, e.header.system) for e in pump(a, b, 2.0)[0]] == [("reply", system)]
    a.send(1, 1, True, b"", 3.0)
    assert kinds(a, 47.9) == [] and kinds(a, 48.0) == ["reply_timeout"]
    a2, b2 = pair()
    pump(a2, b2, 0.0)
    a2.send(1, 1, True, b"", 0.0)
    a2.take_output()
    assert kinds(a2, 44.9) == [] and kinds(a2, 45.0) == ["reply_timeout"] and a2.counts["reply_timeouts"] == 1
    a3 = hsms.Protocol()
    a3.connected(0.0)
    assert kinds(a3, 9.9) == [] and a3.next_deadline() == 10.0 and reasons(a3, 10.0) == ["t7_not_selected"] and a3.reconnect_at == 20.0
    a4 = hsms.Protocol(hsms.Config(active=True))
    a4.connected(0.0)
    assert reasons(a4, 5.0) == ["t6_control"] and a4.next_deadline() is None
    a5, b5 = pair()
    pump(a5, b5, 0.0)
    b5.received(b"\0\0", 1.0)
    assert kinds(b5, 5.9) == [] and reasons(b5, 6.0) == ["t8_intercharacter"]


def test_rejects_separate_and_limits():
    a, b = pair()
    b.received(hsms.frame(hsms.data_header(0, 1, 1, True, 9)), 0.0)
    assert kinds(b, 0.0) == [] and b.counts["rejects_sent"] == 1
    with pytest.raises(hsms.SendError):
        a.send(1, 1, False, b"", 0.0)
    pump(a, b, 0.0)
    for _ in range(64):
        a.send(1, 1, True, b"", 0.0)
    with pytest.raises(hsms.SendError, match="too_many_open"):
        a.send(1, 1, True, b"", 0.0)
    a.take_output()
    a.separate(1.0)
    ev = pump(a, b, 1.0)
    assert ev[0][0].reason == "local" and ev[1][0].reason == "peer_separate"
    for bad, why in ((b"\0\0\0\x09", "bad_length"), (b"\xff\0\0\0", "too_long")):
        p = hsms.Protocol()
        p.connected(0.0)
        p.received(bad, 0.0)
        assert reasons(p, 0.0) == [why]


def test_deselect_and_linktest():
    a, b = pair()
    pump(a, b, 0.0)
    a.linktest(1.0)
    with pytest.raises(hsms.SendError, match="control_pending"):
        a.deselect(1.0)
    pump(a, b, 1.0)
    a.deselect(2.0)
    ev = pump(a, b, 2.0)
    assert [e.kind for e in ev[0]] == [e.kind for e in ev[1]] == ["deselected"]


def test_frames_are_split_invariant():
    rng = random.Random(5)
    sent = [(hsms.data_header(1, 6, 11, True, i), bytes(rng.randrange(256) for _ in range(rng.randrange(50)))) for i in range(20)]
    data = b"".join(hsms.frame(h, b) for h, b in sent)
    for step in (1, 3, 17, len(data)):
        f, got = hsms.Frames(), []
        for at in range(0, len(data), step):
            f.feed(data[at : at + step])
            while (x := f.next()) is not None:
                got.append(x)
        assert got == sent
    assert hsms.split_frames(data[:-1]) == sent[:-1]


def ends():
    a, b = pair()
    host, tool = gem.Host(a), gem.Equipment(b, identity=("TESTER", "1.0"))
    pump(a, b, 0.0, (host, tool))
    return a, b, host, tool


def test_gem_loop():
    a, b, host, tool = ends()
    assert host.communicating and tool.communicating
    tool.go_online(1.0)
    pump(a, b, 1.0, (host, tool))
    assert tool.control == "online_remote"
    r = gem.WaferReport(3, "LOT-1", 5, 1, 2, b"\x01\x02")
    tool.report(r, 2.0)
    host.command("HOLD", "LOT-1", 2.0)
    pump(a, b, 2.0, (host, tool))
    assert gem.Event("wafer_reported", (r,)) in host.events
    assert any(e.kind == "reply_received" and e.values[1:] == (6, 12, 0) for e in tool.events)
    command = next(e for e in tool.events if e.kind == "command")
    tool.answer(command.values[2], gem.HCACK["done"])
    pump(a, b, 3.0, (host, tool))
    assert any(e.kind == "reply_received" and e.values[1:] == (2, 42, 0) for e in host.events)
    a.send(2, 41, True, gem.encode_lot_command("JUMP", "x"), 4.0)
    a.send(2, 41, True, gem.encode_ack(1), 4.0)
    a.send(7, 1, True, b"", 4.0)
    pump(a, b, 4.0, (host, tool))
    kinds = [(e.kind, e.values[0]) for e in host.events if e.kind == "error_reported"]
    assert kinds == [("error_reported", 7), ("error_reported", 3)]
    host.request_offline(5.0)
    pump(a, b, 5.0, (host, tool))
    assert tool.control == "host_offline"
    tool.set_remote(False)
    host.request_online(6.0)
    pump(a, b, 6.0, (host, tool))
    assert tool.control == "online_local"
    a.send(2, 41, True, gem.encode_lot_command("HOLD", "L"), 7.0)
    pump(a, b, 7.0, (host, tool))
    assert host.events[-1].values[3] == gem.HCACK["cannot_do_now"]


def test_gem_disabled_and_retry():
    a, b = pair()
    host, tool = gem.Host(a), gem.Equipment(b, comm="disabled")
    pump(a, b, 0.0, (host, tool))
    assert host.comm == "wait_delay" and not tool.enabled
    tool.enable(1.0)
    host.tick(10.1)
    pump(a, b, 10.1, (host, tool))
    assert host.communicating and tool.communicating
    a.close(11.0)
    pump(a, b, 11.0, (host, tool))
    assert host.comm == "not_communicating"


def test_late_bytes_beat_a_deadline_and_refusals_close():
    a, b = pair()
    pump(a, b, 0.0)
    system = a.send(1, 1, True, b"", 0.0)
    a.take_output()
    a.received(hsms.frame(hsms.data_header(0, 1, 2, False, system), b"late"), 45.0)
    assert [(e.kind, e.body) for e in a.advance(45.0)] == [("reply", b"late")] and a.next_deadline() is None
    a.received(hsms.frame(hsms.data_header(0, 1, 2, False, system)), 46.0)
    assert kinds(a, 46.0) == ["unmatched_reply"]
    for answer in (hsms.Header(0xFFFF, 0, 3, 0, hsms.SELECT_RSP, 1), hsms.Header(0xFFFF, hsms.SELECT_REQ, 1, 0, hsms.REJECT_REQ, 1)):
        p = hsms.Protocol(hsms.Config(active=True))
        p.connected(0.0)
        p.received(hsms.frame(answer), 1.0)
        assert reasons(p, 1.0) == ["select_refused"] and p.state == "not_connected"
    for odd, why in ((hsms.Header(0, ptype=1, system=5), hsms.PTYPE_NOT_SUPPORTED), (hsms.Header(0, stype=8, system=5), hsms.STYPE_NOT_SUPPORTED), (hsms.Header(0, stype=hsms.LINKTEST_RSP, system=5), hsms.TRANSACTION_NOT_OPEN)):
        b.received(hsms.frame(odd), 47.0)
        assert kinds(b, 47.0) == [] and hsms.Header.unpack(b.take_output()[4:]).byte3 == why
    b.received(hsms.frame(hsms.Header(0, 0, 1, 0, hsms.REJECT_REQ, 5)), 48.0)
    assert kinds(b, 48.0) == ["rejected"] and b.take_output() == b""


def test_linktest_repeats():
    a, b = pair(linktest=30.0)
    pump(a, b, 0.0)
    for k in range(1, 4):
        assert a.next_deadline() == b.next_deadline() == 30.0 * k
        for _ in range(2):  # the requests go out without an event
            pump(a, b, 30.0 * k)
    assert a.counts["linktests_sent"] == b.counts["linktests_sent"] == 3 and a.state == "selected"


def test_every_communication_state():
    a, b, host, tool = ends()
    host.disable()
    assert host.comm == "disabled" and host.events[-1].kind == "not_communicating"
    b.send(1, 13, True, gem.encode_identity("T", "1"), 1.0)
    b.send(6, 11, True, b"", 1.0)
    ev = pump(a, b, 1.0, (host, tool))
    assert host.comm == "disabled" and [(e.header.function, e.header.stream) for e in ev[1] if e.kind == "reply"] == [(14, 1), (0, 6)]
    host.enable(2.0)
    pump(a, b, 2.0, (host, tool))
    assert host.communicating and tool.communicating
    # A request that is refused, or not answered, is made again after the delay.
    lone, peer = pair()
    end = gem.Host(lone)
    pump(lone, peer, 0.0, (end, gem.Equipment(peer, comm="disabled")))
    assert end.comm == "wait_delay" and end.rested_at == 10.0
    end.tick(10.0)
    assert end.comm == "wait_cra"
    lone.take_output()
    for e in lone.advance(55.0):
        end.on_hsms(e, 55.0)
    assert end.comm == "wait_delay" and end.rested_at == 65.0


def test_every_control_state():
    a, b, host, tool = ends()
    host.request_online(0.5)
    pump(a, b, 0.5, (host, tool))
    assert host.events[-1].values[1:] == (1, 18, 1) and tool.control == "equipment_offline"
    host.command("HOLD", "L", 0.6)
    pump(a, b, 0.6, (host, tool))
    assert host.events[-1].values[1] == "aborted"
    tool.go_online(1.0)
    assert tool.control == "attempt_online" and tool.attempt
    b.take_output()
    for e in b.advance(46.0):
        tool.on_hsms(e, 46.0)
    assert tool.control == "host_offline"
    pump(a, b, 46.0, (host, tool))
    host.request_online(47.0)
    pump(a, b, 47.0, (host, tool))
    host.request_online(48.0)
    pump(a, b, 48.0, (host, tool))
    assert host.events[-1].values[1:] == (1, 18, 2) and tool.control == "online_remote"
    tool.go_offline()
    assert tool.control == "equipment_offline" and not tool.online
    tool.disable()
    tool.go_online(49.0)
    assert tool.control == "host_offline"


def test_linktest_comes_after_a_refused_deselect():
    a, b = pair(linktest=30.0)
    pump(a, b, 0.0)
    began = a.next_deadline()
    a.deselect(began - 1)
    list(a.advance(began))  # the linktest's time, while the deselect is open
    assert a.counts["linktests_sent"] == 0
    (asked, _), = hsms.split_frames(a.take_output())
    a.received(hsms.frame(hsms.Header(0xFFFF, 0, 1, 0, hsms.DESELECT_RSP, asked.system)), began + 1)
    list(a.advance(began + 1))
    assert a.state == "selected" and a.counts["linktests_sent"] == 1
    (test, _), = hsms.split_frames(a.take_output())
    assert test.stype == hsms.LINKTEST_REQ
    a.received(hsms.frame(hsms.Header(0xFFFF, 0, 0, 0, hsms.LINKTEST_RSP, test.system)), began + 2)
    list(a.advance(began + 2))
    assert a.next_deadline() == began + 32


def test_no_linktest_is_owed_once_deselected():
    a, b = pair(linktest=30.0)
    pump(a, b, 0.0)
    began = a.next_deadline()
    a.deselect(began - 1)
    list(a.advance(began))
    (asked, _), = hsms.split_frames(a.take_output())
    a.received(hsms.frame(hsms.Header(0xFFFF, 0, 0, 0, hsms.DESELECT_RSP, asked.system)), began + 1)
    list(a.advance(began + 1))
    assert a.state == "not_selected" and a.counts["linktests_sent"] == 0


def test_items_nested_as_deep_as_may_be():
    deep = b"\x01\x01" * secs.MAX_DEPTH + b"\x41\x01x"
    assert secs.validate(deep) == len(deep) and len(secs.nodes(deep)) == secs.MAX_DEPTH + 1
    item = secs.decode(deep)
    for _ in range(secs.MAX_DEPTH):
        item = item.at(0)
    assert item.text() == "x"
    for read in (secs.validate, secs.decode, secs.nodes):
        with pytest.raises(secs.SecsError, match="too_deep at 128"):
            read(b"\x01\x01" + deep)
    assert secs.decode(b"\x01\x01" * secs.MAX_DEPTH + b"\x01\x00").format == "L"
    with pytest.raises(secs.SecsError, match="truncated at 4"):
        secs.validate(b"\x03\xff\xff\xff")
