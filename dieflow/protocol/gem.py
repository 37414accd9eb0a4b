"""GEM messages and the two ends' state machines, without I/O."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

from dieflow.protocol import hsms, secs
from dieflow.protocol.secs import A, B, Item, L, SecsError, U

CEID_WAFER_SORTED, RPTID_WAFER = 100, 10
HOLD, RELEASE, LOTID = "HOLD", "RELEASE", "LOTID"
#: HCACK and CPACK codes.
HCACK = {"done": 0, "invalid_command": 1, "cannot_do_now": 2, "parameter_invalid": 3, "will_finish_later": 4, "already_in_condition": 5, "no_such_object": 6}
CPACK = {"no_such_name": 1, "illegal_value": 2, "illegal_format": 3}


class GemError(ValueError):
    """A body that isn't the message it should be."""


def _shape(fn: Callable):
    def read(body):
        try:
            return fn(secs.decode(body) if isinstance(body, (bytes, bytearray)) else body)
        except SecsError as e:
            raise GemError(f"malformed {fn.__name__.removeprefix('decode_')}: {e}") from None

    read.__name__, read.__doc__ = fn.__name__, fn.__doc__
    return read


@dataclass(frozen=True)
class WaferReport:
    data_id: int
    lot: str
    wafer: int
    rows: int
    cols: int
    bins: bytes


def encode_wafer_report(r: WaferReport) -> bytes:
    values = L(A(r.lot), U("U4", r.wafer), U("U2", r.rows), U("U2", r.cols), U("U1", *r.bins))
    return secs.encode(L(U("U4", r.data_id), U("U4", CEID_WAFER_SORTED), L(L(U("U4", RPTID_WAFER), values))))


@_shape
def decode_event_report(item: Item) -> tuple[int, int, tuple[Item, ...]]:
    """(data id, event id, reports)"""
    data_id, event, reports = item.items(3)
    return data_id.unsigned(), event.unsigned(), reports.items()


@_shape
def decode_wafer_report(item: Item) -> WaferReport:
    data_id, event, reports = decode_event_report(item)
    if event != CEID_WAFER_SORTED or len(reports) != 1:
        raise SecsError("unexpected_format")
    report, values = reports[0].items(2)
    if report.unsigned() != RPTID_WAFER:
        raise SecsError("unexpected_format")
    lot, wafer, rows, cols, bins = values.items(5)
    out = WaferReport(data_id, lot.text(), wafer.unsigned(), rows.unsigned(), cols.unsigned(), bytes(bins.values("U1")))
    if out.rows > 0xFFFF or out.cols > 0xFFFF or len(out.bins) != out.rows * out.cols:
        raise SecsError("unexpected_format")
    return out


def encode_alarm(set_: bool, category: int, alarm_id: int, text: str) -> bytes:
    return secs.encode(L(B(0x80 * bool(set_) | category & 0x7F), U("U4", alarm_id), A(text)))


@_shape
def decode_alarm(item: Item) -> tuple[bool, int, int, str]:
    """(set, category, id, text)"""
    code, alarm, text = item.items(3)
    c = code.scalar("B")
    return bool(c & 0x80), c & 0x7F, alarm.unsigned(), text.text()


def encode_lot_command(action: str, lot: str) -> bytes:
    return secs.encode(L(A(action), L(L(A(LOTID), A(lot)))))


@_shape
def decode_host_command(item: Item) -> tuple[str, dict[str, Item]]:
    """(command, parameters by name; the first of equal names)"""
    command, parameters = item.items(2)
    out: dict[str, Item] = {}
    for p in parameters.items():
        name, value = p.items(2)
        out.setdefault(name.text(), value)
    return command.text(), out


def encode_command_ack(ack: int, errors: tuple[tuple[str, int], ...] = ()) -> bytes:
    return secs.encode(L(B(ack), L(*(L(A(n), B(c)) for n, c in errors))))


@_shape
def decode_command_ack(item: Item) -> tuple[int, tuple[Item, ...]]:
    ack, errors = item.items(2)
    return ack.scalar("B"), errors.items()


def encode_ack(code: int) -> bytes:
    return secs.encode(B(code))


@_shape
def decode_ack(item: Item) -> int:
    return item.scalar("B")


def encode_identity(model: str | None = None, software: str = "") -> bytes:
    """The equipment's model and software; the host's is an empty list."""
    return secs.encode(L() if model is None else L(A(model), A(software)))


@_shape
def decode_identity(item: Item) -> tuple[str, str] | None:
    if not item.items():
        return None
    model, software = item.items(2)
    return model.text(), software.text()


def encode_establish_ack(code: int, identity: tuple[str, str] | None = None) -> bytes:
    return secs.encode(L(B(code), L(*(A(x) for x in identity or ()))))


@_shape
def decode_establish_ack(item: Item) -> tuple[int, tuple[str, str] | None]:
    code, identity = item.items(2)
    return code.scalar("B"), decode_identity(identity)


def encode_mhead(header: hsms.Header) -> bytes:
    return secs.encode(B(*header.pack()))


@dataclass(frozen=True)
class Event:
    """What an end reports: a kind and its values."""

    kind: str
    values: tuple = ()


#: Establishing communication: (state, what happened) to (what to do, next state).  The rows of "*" hold for all states not listed.
COMMUNICATION = {
    ("disabled", "enabled"): ("ask", "not_communicating"),
    ("disabled", "peer asks"): ("deny", "disabled"),
    ("disabled", "*"): (None, "disabled"),
    ("not_communicating", "link up"): ("ask", "not_communicating"),
    ("wait_cra", "granted"): (None, "communicating"),
    ("wait_cra", "refused"): ("rest", "wait_delay"),
    ("wait_delay", "rested"): ("ask", "not_communicating"),
    ("wait_delay", "link up"): ("ask", "not_communicating"),
    ("*", "peer asks"): ("grant", "communicating"),
    ("*", "link down"): (None, "not_communicating"),
    ("*", "disabled"): (None, "disabled"),
}


@dataclass
class End:
    """One end's communication: COMMUNICATION says what happens next; `asked` is the open request to communicate.

    A state's name is comm; a request that could be sent leads to wait_cra.
    """

    link: hsms.Protocol
    identity: tuple[str, str] | None = None
    delay: float = 10.0
    comm: str = "not_communicating"
    events: list[Event] = field(default_factory=list)
    asked: int | None = None
    rested_at: float = 0.0

    @property
    def communicating(self) -> bool:
        return self.comm == "communicating"

    @property
    def enabled(self) -> bool:
        return self.comm != "disabled"

    def _happened(self, what: str, now: float = 0.0, about: hsms.Header | None = None) -> None:
        row = next((COMMUNICATION[k] for k in ((self.comm, what), (self.comm, "*"), ("*", what)) if k in COMMUNICATION and (k != (self.comm, "*") or what != "enabled")), None)
        if row is None:
            return
        action, state = row
        was, self.comm, self.asked = self.communicating, state, None
        if action == "ask":
            self._try(lambda: self._asking(now))
        elif action == "rest":
            self.rested_at = now + self.delay
        elif action in ("grant", "deny"):
            self._reply(about, encode_establish_ack(int(action == "deny"), self.identity if action == "grant" else None))
        if was != self.communicating:
            self._report("communicating" if self.communicating else "not_communicating")

    def _asking(self, now: float) -> None:
        if self.link.state == hsms.SELECTED:
            self.asked = self.link.send(1, 13, True, encode_identity(*(self.identity or (None,))), now)
            self.comm = "wait_cra"

    def enable(self, now: float) -> None:
        self._happened("enabled", now) if not self.enabled else None

    def disable(self) -> None:
        self._happened("disabled")

    def tick(self, now: float) -> None:
        if self.comm == "wait_delay" and now >= self.rested_at:
            self._happened("rested", now)

    def on_hsms(self, e: hsms.Event, now: float) -> None:
        """Take one of the link's events; the establishing of communication uses up some, the rest go to handlers."""
        if e.kind == "selected":
            self._happened("link up", now)
        elif e.kind in ("deselected", "closed"):
            self._happened("link down")
            self._handled(e, now)
        elif self.asked is not None and e.header.system == self.asked:
            granted = e.kind == "reply" and e.header.function == 14 and self._granted(e.body)
            self._happened("granted" if granted else "refused", now)
        elif e.kind == "primary" and (e.header.stream, e.header.function) == (1, 13):
            self._happened("peer asks", now, e.header)
        elif self.communicating or e.kind in ("reply_timeout", "rejected"):
            self._handled(e, now)
        elif e.kind == "primary":
            self._refuse(e.header)

    @staticmethod
    def _granted(body: bytes) -> bool:
        try:
            return decode_establish_ack(body)[0] == 0
        except GemError:
            return False

    def _handled(self, e: hsms.Event, now: float) -> None:
        if handler := getattr(self, f"_on_{e.kind}", None):
            handler(e.header, e.body, now)

    def _report(self, kind: str, *values) -> None:
        self.events.append(Event(kind, values))

    @staticmethod
    def _try(send: Callable[[], object]) -> bool:
        """Whether a message could be sent; if the link is down, the peer's own timer ends the transaction."""
        try:
            send()
        except hsms.SendError:
            return False
        return True

    def _reply(self, primary: hsms.Header, body: bytes) -> None:
        self._try(lambda: self.link.reply(primary, body))

    def _refuse(self, primary: hsms.Header) -> None:
        if primary.reply_expected:
            self._try(lambda: self.link.abort(primary))

    def _on_rejected(self, h: hsms.Header, body: bytes, now: float) -> None:
        self._report("transaction_failed", h.system, "rejected")

    def _on_reply_timeout(self, h: hsms.Header, body: bytes, now: float) -> None:
        self._report("transaction_failed", h.system, "timeout")

    #: How to read the code in an answer of this stream and function.
    CODES: ClassVar[dict[tuple[int, int], Callable[[bytes], int]]] = {}

    def _on_reply(self, h: hsms.Header, body: bytes, now: float) -> None:
        at = (h.stream, h.function)
        if h.function == 0:
            self._report("transaction_failed", h.system, "aborted")
            return
        try:
            self._report("reply_received", h.system, *at, self.CODES.get(at, decode_ack)(body))
        except GemError:
            self._report("transaction_failed", h.system, "malformed_reply")


@dataclass
class Host(End):
    """Acknowledges reports and alarms, sends commands."""

    CODES = {(1, 2): lambda body: 0, (2, 42): lambda body: decode_command_ack(body)[0]}

    def _on_primary(self, h: hsms.Header, body: bytes, now: float) -> None:
        at = (h.stream, h.function)
        if at == (1, 1):
            self._reply(h, encode_identity())
        elif h.stream == 9 or at in self.READERS:
            try:
                event = self.READERS.get(at, _error_about)(body)
                event = Event(event.kind, (h.function, *event.values)) if h.stream == 9 else event
            except GemError:
                event = Event("malformed", (h,))
            if h.stream != 9:
                self._reply(h, encode_ack(int(event.kind == "malformed")))
            self.events.append(event)
        else:
            self._refuse(h)

    def ask(self, stream: int, function: int, body: bytes, now: float) -> int:
        """Send a primary; the system bytes of it."""
        if not self.communicating:
            raise hsms.SendError("not_communicating")
        return self.link.send(stream, function, True, body, now)

    def command(self, action: str, lot: str, now: float) -> int:
        return self.ask(2, 41, encode_lot_command(action, lot), now)

    def are_you_there(self, now: float) -> int:
        return self.ask(1, 1, b"", now)

    def request_online(self, now: float) -> int:
        return self.ask(1, 17, b"", now)

    def request_offline(self, now: float) -> int:
        return self.ask(1, 15, b"", now)


def _event_of_report(body: bytes) -> Event:
    data_id, event, _ = decode_event_report(body)
    return Event("wafer_reported", (decode_wafer_report(body),)) if event == CEID_WAFER_SORTED else Event("event_reported", (event, data_id))


def _error_about(body: bytes) -> Event:
    try:
        return Event("error_reported", (hsms.Header.unpack(bytes(secs.decode(body).values("B"))),))
    except (SecsError, ValueError) as e:
        raise GemError(str(e)) from None


#: The event that a report of the equipment's makes, by stream and function.
Host.READERS = {(6, 11): _event_of_report, (5, 1): lambda body: Event("alarm_reported", decode_alarm(body))}

#: The equipment's control: (state, what happened) to the next state; "online" stands for the local or remote one.
CONTROL = {
    ("equipment_offline", "switched on"): "attempt_online",
    ("host_offline", "switched on"): "attempt_online",
    ("attempt_online", "host is there"): "online",
    ("attempt_online", "host isn't there"): "host_offline",
    ("host_offline", "host wants it online"): "online",
    ("attempt_online", "host wants it online"): "online",
    ("online", "host wants it offline"): "host_offline",
    ("online", "local or remote"): "online",
}
#: What the equipment answers to a request to be online, by the state it finds.
ONLACK = {"equipment_offline": 1, "online": 2}


@dataclass
class Equipment(End):
    """Reports, alarms and the control state: equipment_offline, attempt_online, host_offline, online_local or online_remote."""

    control: str = "equipment_offline"
    remote: bool = True
    attempt: int | None = None

    @property
    def online(self) -> bool:
        return self._at == "online"

    @property
    def _at(self) -> str:
        return "online" if self.control.startswith("online") else self.control

    def _control(self, what: str) -> None:
        state = "equipment_offline" if what == "switched off" else CONTROL.get((self._at, what))
        if state is None:
            return
        self.attempt = None
        state = f"online_{'remote' if self.remote else 'local'}" if state == "online" else state
        if state != self.control:
            self.control = state
            self._report("control", state)

    def go_online(self, now: float) -> None:
        was = self.control
        self._control("switched on")
        if self.control == "attempt_online" != was:

            def greet() -> None:
                self.attempt = self.link.send(1, 1, True, b"", now)

            if not (self.communicating and self._try(greet)):
                self._control("host isn't there")

    def go_offline(self) -> None:
        self._control("switched off")

    def set_remote(self, remote: bool) -> None:
        self.remote = remote
        self._control("local or remote")

    def report(self, r: WaferReport, now: float) -> int:
        return self.link.send(6, 11, True, encode_wafer_report(r), now)

    def alarm(self, set_: bool, category: int, alarm_id: int, text: str, now: float) -> int:
        return self.link.send(5, 1, True, encode_alarm(set_, category, alarm_id, text), now)

    def answer(self, primary: hsms.Header, ack: int) -> None:
        self.link.reply(primary, encode_command_ack(ack))

    def _complain(self, function: int, about: hsms.Header, now: float) -> None:
        """Stream 9: 3 and 5 an unknown stream or function, 7 a bad body, 9 a reply that didn't come."""
        self._try(lambda: self.link.send(9, function, False, encode_mhead(about), now))

    def _on_closed(self, *_) -> None:
        self._control("host isn't there")

    _on_deselected = _on_closed

    def _on_reply_timeout(self, h: hsms.Header, body: bytes, now: float) -> None:
        if h.system == self.attempt:
            self._control("host isn't there")
        else:
            super()._on_reply_timeout(h, body, now)
        self._complain(9, h, now)

    def _on_reply(self, h: hsms.Header, body: bytes, now: float) -> None:
        if h.system == self.attempt:
            self._control("host is there" if h.function == 2 else "host isn't there")
        else:
            super()._on_reply(h, body, now)

    def _on_primary(self, h: hsms.Header, body: bytes, now: float) -> None:
        handler = self.PRIMARIES.get((h.stream, h.function))
        if handler is Equipment._online_wanted or self.online and handler:
            handler(self, h, body, now)
        elif not self.online:
            self._refuse(h)
        else:
            self._complain(5 if any(s == h.stream for s, _ in self.PRIMARIES) else 3, h, now)

    def _online_wanted(self, h: hsms.Header, body: bytes, now: float) -> None:
        self._reply(h, encode_ack(ONLACK.get(self._at, 0)))
        self._control("host wants it online")

    def _offline_wanted(self, h: hsms.Header, body: bytes, now: float) -> None:
        self._reply(h, encode_ack(0))
        self._control("host wants it offline")

    def _greeted(self, h: hsms.Header, body: bytes, now: float) -> None:
        self._reply(h, encode_identity(*(self.identity or ("", ""))))

    def _commanded(self, h: hsms.Header, body: bytes, now: float) -> None:
        try:
            command, parameters = decode_host_command(body)
        except GemError:
            self._complain(7, h, now)
            self._report("malformed", h)
            return
        lot = parameters.get(LOTID)
        wrong_type = lot is not None and lot.format not in ("A", "J")
        checks = (
            (command not in (HOLD, RELEASE), "invalid_command", ()),
            (lot is None, "parameter_invalid", ()),
            (wrong_type, "parameter_invalid", ((LOTID, CPACK["illegal_format"]),)),
            (self.control != "online_remote", "cannot_do_now", ()),
        )
        failed = next((c for c in checks if c[0]), None)
        if failed:
            self._reply(h, encode_command_ack(HCACK[failed[1]], failed[2]))
        else:
            self._report("command", command, lot.text(), h)

    PRIMARIES: ClassVar[dict] = {(1, 1): _greeted, (1, 15): _offline_wanted, (1, 17): _online_wanted, (2, 41): _commanded}
