import time

import pytest
from pyspark.sql import functions as F

from dieflow.operators import hold
from dieflow.operators.hold import HoldConfig
from dieflow.operators.rules import Classifier
from dieflow.patterns import lot_name
from dieflow.plans.derive import verdicts, wafers
from dieflow.protocol import gem, hsms
from dieflow.streaming import pipeline


@pytest.mark.parametrize("config", [HoldConfig(k=3, window=5, lots=8), HoldConfig(k=2, window=4, lots=64, tool_k=3, tool_window_us=600_000_000)])
def test_holds_over_batches_equal_one_batch(spark, tmp_path, config):
    v = verdicts(spark, "/root/testdata/sf0.001").withColumn("tool", F.when(F.col("lot") < "LOT-000007", "a").otherwise("b"))
    rows = v.select("tool", "lot", "pattern", "at_us", F.col("pos").alias("seq")).orderBy("at_us", "seq").collect()
    schema = "tool string, lot string, pattern string, at_us bigint, seq bigint"
    n = -(-len(rows) // 4)
    for k in range(4):
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = pipeline.file_drop(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    q = pipeline.decide(stream, config).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("held").select("tool", "lot", "at_us", "seq", "pattern", "by_tool", "evictions").collect())
    want = hold.holds_in_order(v, config, "tool").select("tool", "lot", "at_us", F.col("pos").alias("seq"), "pattern", "by_tool", "evictions")
    assert got == sorted(tuple(r) for r in want.collect()) and got


def test_frames_to_holds(spark, tmp_path):
    w = wafers(spark, "/root/testdata/sf0.001").where("wafer_id < 60").orderBy("wafer_id").collect()
    captures = tmp_path / "in"
    captures.mkdir()
    for k in range(2):
        data = b"".join(hsms.frame(hsms.data_header(0, 6, 11, True, r.wafer_id), gem.encode_wafer_report(gem.WaferReport(r.wafer_id, f"LOT-{r.lot_id:06d}", r.wafer_id, r.rows, r.cols, bytes(r.bins)))) for r in w[k * 30 : k * 30 + 30])
        (captures / f"toolA-{k}.bin").write_bytes(data + b"\0\0")
    detect = pipeline.detector("rules", classifier=Classifier.fitted())
    seen = pipeline.frame_drop(spark, str(captures), bytesPerBatch="9000")
    listener = pipeline.Counters()
    spark.streams.addListener(listener)
    q = detect(pipeline.admit(seen, "front")).writeStream.format("memory").queryName("verdicts").start()
    q.processAllAvailable()
    q.stop()
    got = {r.wafer_id: (r.tool, r.pattern) for r in spark.table("verdicts").collect()}
    batch = Classifier.fitted().classify(__import__("dieflow.operators.signatures", fromlist=["x"]).signals(wafers(spark, "/root/testdata/sf0.001").where("wafer_id < 60")))
    assert got == {r.wafer_id: ("toolA", r.pred) for r in batch.collect()}
    for _ in range(50):
        if listener.total.get("received") == 60:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.total["received"] == 60 and listener.total["oversized"] == 0


def test_admit(spark):
    w = spark.createDataFrame([("L" * 33, 2, 2), ("ok", 65, 64), ("ok", 64, 64)], "lot string, rows int, cols int")
    assert [tuple(r) for r in pipeline.admit(w, "x").collect()] == [("ok", 64, 64)]


def test_lifecycle_and_latency(spark):
    assert [pipeline.lifecycle(x) for x in (None, pipeline.PENDING, 0, 5, 2)] == ["waiting", "sent", "acked", "acked", "failed"]
    df = spark.createDataFrame([(10, 5), (10, 12)], "a bigint, b bigint")
    assert [r.latency_ns for r in pipeline.latency(df, "a", "b").collect()] == [0, 2000]


def test_lot_names(spark):
    assert spark.range(7, 8).select(lot_name(F.col("id"))).first()[0] == "LOT-000007"


def test_holds_are_sent_and_recorded(spark, tmp_path):
    schema = "tool string, lot string, at_us bigint, seq bigint, pattern string, by_tool boolean, evictions bigint"
    for k in range(3):
        spark.createDataFrame([(t, f"{t}{k}", 10 * k + i, k, "scratch", False, 0) for i, t in enumerate("abc")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    sent, free = [], {"a": 9, "b": 1, "c": 9}

    def send(tool, body):
        command, parameters = gem.decode_host_command(body)
        assert command == "HOLD"
        if not free[tool]:
            return None
        free[tool] -= 1
        sent.append(parameters["LOTID"].text())
        return {"a": 0, "b": pipeline.PENDING, "c": 2}[tool]

    holds = pipeline.file_drop(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    q = pipeline.send_holds(holds, send, str(tmp_path / "cp"), str(tmp_path / "record"))
    q.processAllAvailable()
    q.stop()
    record = pipeline.HoldRecord(spark, str(tmp_path / "record"))
    state = lambda: {r.lot: (r.state, r.hcack, r.tries) for r in record.states().collect()}
    assert state() == {**{f"a{k}": ("acked", 0, 1) for k in range(3)}, **{f"c{k}": ("failed", 2, 1) for k in range(3)}, "b0": ("sent", None, 1), "b1": ("waiting", None, 2), "b2": ("waiting", None, 0)}
    # The window frees: what waited goes first, and nothing is sent twice.
    free["b"] = 5
    last = record.states().agg(F.max("batch")).first()[0]
    record.send(spark.createDataFrame([], schema), last + 1, send)
    assert sent[-2:] == ["b1", "b2"] and len(sent) == len(set(sent)) == 9
    record.answered(last + 1, {("b", "b0"): 5, ("b", "b1"): 3})
    assert [state()[x] for x in ("b0", "b1", "b2")] == [("acked", 5, 1), ("failed", 3, 3), ("sent", None, 1)]


def test_tally_and_pace(spark, tmp_path):
    v = spark.createDataFrame([("center",), ("none",), ("center",)], "pattern string")
    v.write.parquet(str(tmp_path / "in"))
    listener = pipeline.Counters()
    spark.streams.addListener(listener)
    counted = pipeline.tally(pipeline.file_drop(spark, str(tmp_path / "in"), "pattern string"), "patterns")
    q = pipeline.paced(counted.writeStream.format("memory").queryName("tallied"), 50).start()
    q.processAllAvailable()
    for _ in range(100):
        if listener.total.get("verdicts") == 3:
            break
        time.sleep(0.1)
    q.stop()
    spark.streams.removeListener(listener)
    assert (listener.total["verdicts"], listener.total["center"], listener.total["none"], listener.total["donut"]) == (3, 2, 1, 0)


def test_histograms_of_windows_merge(spark, tmp_path):
    from dieflow.operators.metrics import histogram, merge, percentiles
    from dieflow.streaming.measures import latency_windows

    schema = "wafer_id long, scheduled_us long, received_us long, analysed_us long, decided_us long, held_us long"
    rows = [(i, i * 1_000_000, i * 1_000_000 + i % 700, i * 1_000_000 + i % 700 + 3, None if i % 5 == 0 else i * 1_000_000 + 900, None) for i in range(900)]
    for k in range(3):
        spark.createDataFrame(rows[k * 300 : k * 300 + 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    given = pipeline.file_drop(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    q = latency_windows(given, "1 minute", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    windows = spark.read.parquet(str(tmp_path / "out"))
    closed = [r for r in rows if r[1] // 60_000_000 * 60_000_000 + 60_000_000 <= rows[-1][1] - 60_000_000]
    want = histogram(pipeline.stages(spark.createDataFrame(closed, schema)), "latency_ns", ("stage",))
    got = merge(windows.drop("window_us"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and windows.select("window_us").distinct().count() > 5
    assert percentiles(got, by=("stage",)).count() > 0
