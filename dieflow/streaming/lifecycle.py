"""What needs a clock: holds that wait for answers, and batches that close at a deadline.

Both are stateful operators with timers of processing time (they need the
RocksDB state store; see STORE), one state a tool.  Their rules are plain
classes without Spark, over whatever keeps the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from dieflow.operators import messages
from dieflow.protocol.gem import HOLD, GemError, decode_command_ack, encode_lot_command
from dieflow.streaming.capture import tool_of

#: The session's setting that timers and map states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

WAITING, SENT, ACKED, FAILED, UNRECORDED = "waiting", "sent", "acked", "failed", "unrecorded"
#: Answers (HCACK) after which a lot counts as held: done, will be done, was so already.
HELD = (0, 4, 5)

TRANSITIONS = "tool string, lot string, at_us bigint, seq bigint, pattern string, state string, hcack int, tries int, system bigint, on_ms bigint, body binary"


# --- holds ---


@dataclass(frozen=True)
class Link:
    """How holds are sent to a tool: commands open at a time, milliseconds an answer may take, how often a command is sent, holds remembered at a time, and milliseconds a finished one is known."""

    window: int = 64
    reply_ms: int = 45_000
    tries: int = 1
    capacity: int = 4096
    keep_ms: int = 86_400_000

    def __post_init__(self) -> None:
        if min(self.window, self.reply_ms, self.tries, self.capacity, self.keep_ms) < 1:
            raise ValueError(f"not a link: {self}")


@dataclass(frozen=True)
class Entry:
    """An unfinished hold."""

    at_us: int
    seq: int
    lot: str
    pattern: str
    state: str = WAITING
    tries: int = 0
    system: int = 0
    sent_ms: int = 0

    @property
    def key(self) -> tuple[int, int, str]:
        return self.at_us, self.seq, self.lot


@dataclass
class Desk:
    """A tool's unfinished holds.  Each method gives the transitions it makes, as (entry, state, hcack); entries that change are in `touched`, finished ones in `over`."""

    link: Link
    open: dict[tuple, Entry] = field(default_factory=dict)
    system: int = 0
    touched: set[tuple] = field(default_factory=set)
    over: set[tuple] = field(default_factory=set)

    def _put(self, e: Entry) -> Entry:
        self.open[e.key] = e
        self.touched.add(e.key)
        return e

    def _end(self, e: Entry, state: str, hcack: int | None = None) -> tuple[Entry, str, int | None]:
        del self.open[e.key]
        self.touched.add(e.key)
        self.over.add(e.key)
        return replace(e, state=state), state, hcack

    def _command(self, e: Entry, now: int) -> Entry:
        self.system = self.system % 0xFFFFFFFF + 1
        return replace(e, state=SENT, tries=e.tries + 1, system=self.system, sent_ms=now)

    def hold(self, e: Entry, now: int) -> list[tuple]:
        """A new hold waits; beyond the capacity it is sent once and forgotten."""
        if e.key in self.open:
            return []
        if len(self.open) >= self.link.capacity:
            self.over.add(e.key)
            return [(self._command(e, now), UNRECORDED, None)]
        return [(self._put(e), WAITING, None)]

    def send(self, now: int) -> list[tuple]:
        """Waiting holds go out, oldest first, while commands may be opened."""
        room = self.link.window - sum(e.state == SENT for e in self.open.values())
        due = sorted(k for k, e in self.open.items() if e.state == WAITING)[: max(0, room)]
        return [(self._put(self._command(self.open[k], now)), SENT, None) for k in due]

    def answer(self, system: int, hcack: int) -> list[tuple]:
        """The answer to a command; one to a command that isn't open changes nothing."""
        found = [e for e in self.open.values() if e.state == SENT and e.system == system]
        return [self._end(e, ACKED if hcack in HELD else FAILED, hcack) for e in found]

    def expire(self, now: int) -> list[tuple]:
        """Commands without an answer in time are sent again, under a new number, or fail."""
        late = sorted(k for k, e in self.open.items() if e.state == SENT and e.sent_ms + self.link.reply_ms <= now)
        out = []
        for k in late:
            e = self.open[k]
            out.append(self._end(e, FAILED) if e.tries >= self.link.tries else (self._put(self._command(e, now)), SENT, None))
        return out

    def alarm(self) -> int | None:
        """When the next command is late."""
        return min((e.sent_ms + self.link.reply_ms for e in self.open.values() if e.state == SENT), default=None)


class HoldProcessor(StatefulProcessor):
    """Desk over Spark's state: open holds by key, finished ones with a time to live, and the last command's number."""

    def __init__(self, link: Link) -> None:
        self.link = link

    def init(self, handle) -> None:
        self.handle = handle
        key = "at_us bigint, seq bigint, lot string"
        self.open = handle.getMapState("open", key, "pattern string, state string, tries int, system bigint, sent_ms bigint")
        self.done = handle.getMapState("done", key, "state string", ttlDurationMs=self.link.keep_ms)
        self.last = handle.getValueState("system", "n bigint")

    def close(self) -> None: ...

    def _desk(self) -> Desk:
        held = [Entry(*k, v[0], v[1], int(v[2]), int(v[3]), int(v[4])) for k, v in self.open.iterator()]
        return Desk(self.link, {e.key: e for e in held}, int(self.last.get()[0]) if self.last.exists() else 0)

    def _finish(self, tool: str, desk: Desk, changes: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        for k in desk.touched:
            if e := desk.open.get(k):
                self.open.updateValue(k, (e.pattern, e.state, e.tries, e.system, e.sent_ms))
            elif self.open.containsKey(k):
                self.open.removeKey(k)
        for k in desk.over:
            self.done.updateValue(k, ("over",))
        self.last.update((desk.system,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (alarm := desk.alarm()) is not None:
            self.handle.registerTimer(max(alarm, now + 1))
        rows = [(tool, e.lot, e.at_us, e.seq, e.pattern, state, hcack, e.tries, e.system, now, encode_lot_command(HOLD, e.lot) if state in (SENT, UNRECORDED) else None) for e, state, hcack in changes]
        yield pd.DataFrame(rows, columns=["tool", "lot", "at_us", "seq", "pattern", "state", "hcack", "tries", "system", "on_ms", "body"]).astype({"hcack": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, desk, changes, new = timerValues.getCurrentProcessingTimeInMs(), self._desk(), [], []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.kind == "answer":
                    changes += desk.answer(int(r.system), int(r.hcack))
                else:
                    new.append(Entry(int(r.at_us), int(r.seq), r.lot, r.pattern))
        for e in sorted(new, key=lambda e: e.key):
            if not self.done.containsKey(e.key):
                changes += desk.hold(e, now)
        yield from self._finish(key[0], desk, [*changes, *desk.send(now)], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, desk = timerValues.getCurrentProcessingTimeInMs(), self._desk()
        changes = desk.expire(now)
        yield from self._finish(key[0], desk, [*changes, *desk.send(now)], now)


def answers_of(frames: DataFrame) -> DataFrame:
    """(tool, system, hcack) of the frames that answer a remote command; malformed ones are none."""

    @F.pandas_udf("int")
    def hcack(bodies: pd.Series) -> pd.Series:
        def one(b) -> int | None:
            try:
                return decode_command_ack(bytes(b))[0]
            except (GemError, TypeError):
                return None

        return bodies.map(one).astype("Int32")

    each = frames.select(tool_of().alias("tool"), *messages.header_fields(F.col("header")), "body")
    found = each.where((F.col("stype") == 0) & (F.col("stream") == 2) & (F.col("function") == 42)).select("tool", "system", hcack("body").alias("hcack"))
    return found.where("hcack is not null")


def track_holds(holds: DataFrame, answers: DataFrame, link: Link | None = None) -> DataFrame:
    """A stream of every hold's transitions (TRANSITIONS), from streams of holds (tool, lot, at_us, seq, pattern) and answers (tool, system, hcack).

    A transition with a body is a command to send, numbered `system`.  A hold
    that comes twice counts once, as long as it is open or known.
    """
    none = lambda t: F.lit(None).cast(t)
    tool = F.coalesce(F.col("tool").cast("string"), F.lit("")).alias("tool")
    a = holds.select(tool, F.lit("hold").alias("kind"), "lot", F.col("at_us").cast("bigint").alias("at_us"), F.col("seq").cast("bigint").alias("seq"), "pattern", none("bigint").alias("system"), none("int").alias("hcack"))
    b = answers.select(tool, F.lit("answer").alias("kind"), none("string").alias("lot"), none("bigint").alias("at_us"), none("bigint").alias("seq"), none("string").alias("pattern"), F.col("system").cast("bigint").alias("system"), F.col("hcack").cast("int").alias("hcack"))
    return a.unionAll(b).groupBy("tool").transformWithStateInPandas(HoldProcessor(link or Link()), TRANSITIONS, "Append", "ProcessingTime")


class Record:
    """Transitions in a folder that outlives the query, a file a batch, and every hold's latest state; compact() makes the batches so far one file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return []
        whole = lambda s: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(s.getPath().getName() for s in fs.listStatus(target) if whole(s))

    def write(self, batch: int, transitions: DataFrame) -> None:
        """A batch that runs again replaces what it wrote."""
        transitions.drop("body").withColumn("batch", F.lit(batch).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{batch:012d}")

    def _parts(self) -> tuple[int, list[str]]:
        """The last batch that a compacted file holds, and what to read: that file and all later batches."""
        names = self._names()
        base = max((n for n in names if n.startswith("base-")), default=None)
        upto = int(base[5:]) if base else -1
        return upto, [*([base] if base else []), *(n for n in names if n.startswith("batch-") and int(n[6:]) > upto)]

    def states(self) -> DataFrame:
        """(tool, lot, at_us, seq, pattern, state, hcack, tries, system, on_ms, batch) of each hold, its latest."""
        schema = ", ".join(x for x in TRANSITIONS.split(", ") if not x.startswith("body")) + ", batch bigint"
        parts = self._parts()[1]
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in parts)) if parts else self.spark.createDataFrame([], schema)
        key = ("tool", "lot", "at_us", "seq")
        order = F.array(*(F.lit(s) for s in (WAITING, SENT, UNRECORDED, FAILED, ACKED)))
        last = rows.groupBy(*key).agg(F.max(F.struct("batch", "tries", F.array_position(order, F.col("state")).alias("rank"), "pattern", "state", "hcack", "system", "on_ms")).alias("x"))
        return last.select(*key, "x.pattern", "x.state", "x.hcack", "x.tries", "x.system", "x.on_ms", "x.batch")

    def compact(self) -> None:
        """One file of latest states for all there is.

        What it stands for goes with the next compaction, not with this one, so
        a reader that has just listed the files still finds them.
        """
        upto, parts = self._parts()
        batches = [int(n[6:]) for n in parts if n.startswith("batch-")]
        if not batches:
            return
        self.states().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{max(batches):012d}")
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for n in self._names():
            kind, number = n.split("-")
            if int(number) < upto or kind == "batch" and int(number) == upto:
                fs.delete(fs_path(f"{self.path}/{n}"), True)


def deliver(transitions: DataFrame, send: Callable[[str, int, bytes], None], checkpoint: str, record: str, compact_every: int = 100, every: str = "1 second") -> StreamingQuery:
    """Send every command of a stream of transitions, in order, and keep the record.

    Commands are few, a hold each, and go out from the driver, where the links
    are.  A batch that runs again after a failure sends its commands again,
    under the same numbers; a lot that is held already answers so, which counts.
    """
    ledger = Record(transitions.sparkSession, record)

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            for r in df.where("body is not null").orderBy("tool", "system").toLocalIterator():
                send(r.tool, r.system, bytes(r.body))
            ledger.write(n, df)
        finally:
            df.unpersist()
        if n and n % compact_every == 0:
            ledger.compact()

    return transitions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


# --- batches ---


@dataclass
class Cutter:
    """Rows of one key in order of arrival, cut into batches of `size`; what is left is due `deadline_ms` after its oldest came."""

    size: int
    deadline_ms: int

    def close(self, times: list[int], now: int) -> list[tuple[int, str]]:
        """(rows, why) of the batches to close of rows that came at these times, in order."""
        full, rest = divmod(len(times), self.size)
        out = [(self.size, "size")] * full
        if rest and times[-rest] + self.deadline_ms <= now:
            out.append((rest, "deadline"))
        return out


class BatchProcessor(StatefulProcessor):
    """Cutter over Spark's state: rows not in a batch yet, with when they came, and how many batches were closed."""

    def __init__(self, size: int, deadline_ms: int, schema: str, names: list[str]) -> None:
        self.cutter, self.schema, self.names = Cutter(size, deadline_ms), schema, names

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"{self.schema}, came_ms bigint")
        self.count = handle.getValueState("batches", "n bigint")

    def close(self) -> None: ...

    def _cut(self, rows: list[tuple], now: int, changed: bool) -> Iterator[pd.DataFrame]:
        done, at, n = [], 0, int(self.count.get()[0]) if self.count.exists() else 0
        for size, why in self.cutter.close([int(r[-1]) for r in rows], now):
            done += [(*r[:-1], n, why) for r in rows[at : at + size]]
            at, n = at + size, n + 1
        if at or changed:
            if rest := rows[at:]:
                self.held.put(rest)
            else:
                self.held.clear()
            self.count.update((n,))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if rows[at:]:
            self.handle.registerTimer(max(now + 1, int(rows[at][-1]) + self.cutter.deadline_ms))
        yield pd.DataFrame(done, columns=[*self.names, "batch", "closed_by"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        new = [(*r, now) for pdf in rows for r in pdf[self.names].itertuples(index=False, name=None)]
        yield from self._cut([*(tuple(r) for r in self.held.get()), *new], now, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._cut([tuple(r) for r in self.held.get()], timerValues.getCurrentProcessingTimeInMs(), False)


def batched(rows: DataFrame, key: str, size: int = 256, deadline_ms: int = 10) -> DataFrame:
    """A stream's rows as they leave in batches of a key: at `size` rows, or `deadline_ms` after the oldest came, with `batch`, numbered from 0 a key, and `closed_by` (size or deadline).

    The state of a key is under `size` rows between micro-batches.
    """
    if size < 1 or deadline_ms < 1:
        raise ValueError("a batch has a row and a time at least")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    processor = BatchProcessor(size, deadline_ms, schema, rows.columns)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{schema}, batch bigint, closed_by string", "Append", "ProcessingTime")
