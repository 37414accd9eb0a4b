"""The live loop as Structured Streaming: files or frames in, verdicts, holds and counters out.

Detection is stateless.  The hold rule is one order a tool, kept as state by
tool; within a micro-batch verdicts are taken by (at_us, seq).  There is no
watermark, as late verdicts count like any other.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dieflow.operators import messages
from dieflow.operators.hold import HoldConfig, HoldRule, holds_in_order
from dieflow.operators.rules import Classifier
from dieflow.operators.signatures import signals
from dieflow.patterns import MAX_DIES, MAX_LOT_CHARS, PATTERNS, UNKNOWN
from dieflow.streaming.capture import BLOCK, live_frames, read_captures, tool_of

#: A detector turns wafers (with rows, cols and bins) into the same rows with `pattern` and `rule`.
Detector = Callable[[DataFrame], DataFrame]

HOLDS = "tool string, lot string, at_us bigint, seq bigint, pattern string, by_tool boolean, evictions bigint"


def rules_detector(classifier: Classifier | None = None) -> Detector:
    c = classifier or Classifier.fitted()

    def detect(wafers: DataFrame) -> DataFrame:
        keep = tuple(x for x in wafers.columns if x != "bins")
        found = signals(wafers, keep)
        return c.classify(found).select(*keep, F.col("pred").alias("pattern"), "rule")

    return detect


def cnn_detector(model, precision: str = "fp32", scales: list[float] | None = None) -> Detector:
    from dieflow.operators.cnn import logits
    from dieflow.operators.metrics import argmax
    from dieflow.patterns import pattern_name

    def detect(wafers: DataFrame) -> DataFrame:
        keep = tuple(x for x in wafers.columns if x != "bins")
        scored = logits(wafers, model, keep, precision, scales)
        return scored.select(*keep, pattern_name(argmax(F.col("logits"))).alias("pattern"), F.lit(-1).alias("rule"))

    return detect


def detector(name: str, model=None, classifier: Classifier | None = None, scales: list[float] | None = None) -> Detector:
    """rules, cnn, cnn-fp16, cnn-int8, or two of them as A+B: A decides and B's verdict is the column second."""
    if "+" in name:
        first, second = (detector(n, model, classifier, scales) for n in name.split("+", 1))

        def both(wafers: DataFrame) -> DataFrame:
            # The maps stay beside the first verdict for the second detector.
            again = first(wafers.withColumn("map", F.col("bins"))).withColumnsRenamed({"pattern": "__first", "rule": "__rule"}).withColumn("bins", F.col("map")).drop("map")
            return second(again).withColumnRenamed("pattern", "second").drop("rule").withColumnsRenamed({"__first": "pattern", "__rule": "rule"})

        return both
    if name == "rules":
        return rules_detector(classifier)
    if name in ("cnn", "cnn-fp32", "cnn-fp16", "cnn-int8"):
        return cnn_detector(model, name.removeprefix("cnn").removeprefix("-") or "fp32", scales)
    raise ValueError(f"no detector {name}")


def admit(wafers: DataFrame, counters: str | None = None) -> DataFrame:
    """Rows within the limits, with `received`, `oversized` and `bad_lot` counted under a name."""
    big, long_ = F.col("rows") * F.col("cols") > MAX_DIES, F.char_length("lot") > MAX_LOT_CHARS
    if counters:
        counts = (F.count("*").alias("received"), F.count_if(big).alias("oversized"), F.count_if(~big & long_).alias("bad_lot"), F.lit(0).cast("bigint").alias("dropped"))
        wafers = wafers.observe(counters, *counts) if wafers.isStreaming else wafers.observe(Observation(counters), *counts)
    return wafers.where(~big & ~long_)


def file_drop(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Wafers from Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frame_drop(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Wafer reports (tool, lot, wafer_id, seq, at_us, rows, cols, bins) from captured byte streams as they grow; see capture.py, also for its options.

    tool is the file's name up to its first dash; at_us the file's time when its frames were found.
    """
    return wafer_reports_of(live_frames(spark, path, **options))


def capture_reports(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The same from captures that are complete, of any size, read in blocks."""
    return wafer_reports_of(read_captures(spark, path, block))


def wafer_reports_of(frames: DataFrame) -> DataFrame:
    """(tool, at_us, seq, lot, wafer_id, rows, cols, bins) of the frames that are wafer reports."""
    each = frames.select(tool_of().alias("tool"), F.col("modified_us").alias("at_us"), *messages.header_fields(F.col("header")), "body")
    reports = each.where((F.col("stype") == 0) & (F.col("stream") == 6) & (F.col("function") == 11)).select("tool", "at_us", F.col("system").alias("seq"), messages.wafer_reports("body").alias("r"))
    return reports.where(F.col("r.lot").isNotNull()).select("tool", "at_us", "seq", F.col("r.lot").alias("lot"), F.col("r.wafer").cast("int").alias("wafer_id"), F.col("r.rows").alias("rows"), F.col("r.cols").alias("cols"), F.col("r.bins").alias("bins"))


def dump(rule: HoldRule) -> str:
    return json.dumps({"recent": [[k, None if v is None else list(v)] for k, v in rule.recent.items()], "arrivals": {k: list(v) for k, v in rule.arrivals.items()}, "evictions": rule.evictions, "tool_holds": rule.tool_holds})


def restore(config: HoldConfig, text: str | None) -> HoldRule:
    rule = HoldRule(config)
    if text:
        state = json.loads(text)
        for lot, window in state["recent"]:
            rule.recent[lot] = None if window is None else deque(window, maxlen=config.window)
        for p, at in state["arrivals"].items():
            rule.arrivals[p].extend(at)
        rule.evictions, rule.tool_holds = state["evictions"], state["tool_holds"]
    return rule


def decide(verdicts: DataFrame, config: HoldConfig) -> DataFrame:
    """Holds from verdicts (tool, lot, pattern, at_us, seq), streaming or not.

    State is a few lots' windows and a few times for each tool.
    """
    given = verdicts.select(F.coalesce(F.col("tool").cast("string"), F.lit("")).alias("tool"), "lot", "pattern", F.col("at_us").cast("bigint"), F.col("seq").cast("bigint"))
    if not verdicts.isStreaming:
        return holds_in_order(given.withColumnRenamed("seq", "pos"), config, "tool").withColumnRenamed("pos", "seq")

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule = restore(config, state.get[0] if state.exists else None)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["at_us", "seq"], kind="stable")
        out = []
        for v in batch.itertuples(index=False):
            before = rule.tool_holds
            if hit := rule.observe(v.lot, v.pattern, int(v.at_us)):
                out.append((key[0], v.lot, v.at_us, v.seq, hit, rule.tool_holds > before, rule.evictions))
        state.update((dump(rule),))
        yield pd.DataFrame(out, columns=["tool", "lot", "at_us", "seq", "pattern", "by_tool", "evictions"])

    return given.groupBy("tool").applyInPandasWithState(run, HOLDS, "rule string", "append", GroupStateTimeout.NoTimeout)


#: Answers (HCACK) after which a lot counts as held: done, will be done, was so already.
ACKED = (0, 4, 5)
#: What send() gives for a command that is out and will be answered later.
PENDING = -1
RECORD = "tool string, lot string, at_us bigint, seq bigint, pattern string, state string, hcack int, tries int, batch bigint"


def lifecycle(answer: int | None) -> str:
    """waiting until a command is sent, then sent until it is answered, then acked or failed."""
    return {None: "waiting", PENDING: "sent"}.get(answer) or ("acked" if answer in ACKED else "failed")


class HoldRecord:
    """Every hold's state, in a folder that outlives the query: one file a batch, in which a later state replaces an earlier one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, batch: int, rows: list[tuple]) -> None:
        """The states that a batch brought; the batch run again replaces them."""
        self.spark.createDataFrame([(*r, batch) for r in rows], RECORD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch:012d}")

    def states(self, before: int | None = None) -> DataFrame:
        """The latest state of each hold, or the latest of the batches before one."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], RECORD)
        rows = self.spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        key = ("tool", "lot", "at_us", "seq")
        last = rows.groupBy(*key).agg(F.max(F.struct("batch", F.col("state").isin("acked", "failed").alias("over"), "pattern", "state", "hcack", "tries")).alias("x"))
        return last.select(*key, "x.pattern", "x.state", "x.hcack", "x.tries", "x.batch")

    def send(self, holds: DataFrame, batch: int, send: Callable[[str, bytes], int | None]) -> None:
        """Send HOLD for what earlier batches left waiting and for the given holds, in order, and record what came of each.

        send(tool, body) gives an HCACK, PENDING, or None when the tool's window
        is full; that tool's holds then wait for the next batch.  Few lots are held
        in a batch, and their commands go out from the driver, where the links are.
        """
        from dieflow.protocol.gem import HOLD, encode_lot_command

        waiting = self.states(batch).where("state = 'waiting'").select("tool", "lot", "at_us", "seq", "pattern", "tries")
        due = waiting.unionByName(holds.select("tool", "lot", "at_us", "seq", "pattern", F.lit(0).alias("tries"))).orderBy("at_us", "seq")
        full, rows = set(), []
        for r in due.collect():
            answer = None if r.tool in full else send(r.tool, encode_lot_command(HOLD, r.lot))
            tried = r.tries + (r.tool not in full)
            if answer is None:
                full.add(r.tool)
            rows.append((r.tool, r.lot, r.at_us, r.seq, r.pattern, lifecycle(answer), None if answer == PENDING else answer, tried))
        if rows:
            self.write(batch, rows)

    def answered(self, batch: int, answers: dict[tuple[str, str], int]) -> None:
        """Record answers, by tool and lot, to commands that were sent; batch is the number of the last one that was."""
        open_ = self.states().where("state = 'sent'").collect()
        rows = [(r.tool, r.lot, r.at_us, r.seq, r.pattern, lifecycle(answers[r.tool, r.lot]), answers[r.tool, r.lot], r.tries, batch) for r in open_ if (r.tool, r.lot) in answers]
        if rows:
            self.spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(f"{self.path}/answers")


def send_holds(holds: DataFrame, send: Callable[[str, bytes], int | None], checkpoint: str, record: str) -> StreamingQuery:
    """Send a HOLD command for every hold and keep its state in the folder `record`; see HoldRecord.

    A hold that finds no free window stays waiting and goes out with a later
    batch, before that batch's own.  A batch that runs again after a failure
    sends its commands again; a lot held already answers so, which counts.
    """
    ledger = HoldRecord(holds.sparkSession, record)
    return holds.writeStream.foreachBatch(lambda df, batch: ledger.send(df, batch, send)).option("checkpointLocation", checkpoint).start()


def paced(writer: DataStreamWriter, deadline_ms: int) -> DataStreamWriter:
    """A writer whose batches close after a time, full or not; file_drop and frame_drop bound their size."""
    return writer.trigger(processingTime=f"{deadline_ms} milliseconds")


def tally(verdicts: DataFrame, counters: str) -> DataFrame:
    """verdicts, with `verdicts` and one counter a pattern observed under a name."""
    counts = [F.count("*").alias("verdicts"), *(F.count_if(F.col("pattern") == p).alias(p) for p in PATTERNS)]
    return verdicts.observe(counters, *counts) if verdicts.isStreaming else verdicts.observe(Observation(counters), *counts)


class Counters(StreamingQueryListener):
    """Adds up the observed counters of a query's batches."""

    def __init__(self) -> None:
        self.total: dict[str, int] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            for k, v in row.asDict().items():
                self.total[k] = self.total.get(k, 0) + int(v or 0)


def latency(verdicts: DataFrame, since: str, until: str) -> DataFrame:
    """verdicts plus latency_ns of two microsecond columns, at least 0."""
    return verdicts.withColumn("latency_ns", F.greatest(F.lit(0).cast("bigint"), (F.col(until) - F.col(since)) * 1000))


#: What passes between the times of a wafer's way: (stage, from, until).
STAGES = (("to_host", "scheduled_us", "received_us"), ("analyse", "received_us", "analysed_us"), ("decide", "analysed_us", "decided_us"), ("total", "scheduled_us", "decided_us"), ("hold", "scheduled_us", "held_us"))


def stages(verdicts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, stage, latency_ns) of every stage whose two times a verdict has, at least 0."""
    each = F.array(*(F.struct(F.lit(n).alias("stage"), F.when(F.col(b) >= F.col(a), F.col(b) - F.col(a)).when(F.col(b) < F.col(a), 0).cast("bigint").alias("us")) for n, a, b in STAGES))
    return verdicts.select(*keep, F.explode(each).alias("s")).where("s.us is not null").select(*keep, "s.stage", (F.col("s.us") * 1000).alias("latency_ns"))


def run_accuracy(verdicts: DataFrame, truths: DataFrame) -> DataFrame:
    """(scored, correct, paired, agree) of a run in one row: verdicts (wafer_id, pattern, second) beside truths (wafer_id, truth).

    Unknown truths aren't scored; verdicts without a known second opinion aren't paired.
    """
    both = verdicts.join(truths, "wafer_id")
    known, paired = F.col("truth") != UNKNOWN, F.col("second") != UNKNOWN
    same = lambda a: F.col("pattern") == F.col(a)
    return both.agg(F.count_if(known).alias("scored"), F.count_if(known & same("truth")).alias("correct"), F.count_if(paired).alias("paired"), F.count_if(paired & same("second")).alias("agree"))
