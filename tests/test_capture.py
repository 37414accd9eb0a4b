"""Captures read in blocks and as they grow, against one walk over the bytes."""

import random

import pytest
from pyspark.sql import functions as F

from dieflow.protocol import hsms
from dieflow.streaming import capture


def stream(seed, n=400, nested=True):
    """Frames of all sizes; some bodies are captures themselves, which no guess from inside can tell from the real thing."""
    rng, out = random.Random(seed), []
    inner = b"".join(hsms.frame(hsms.data_header(1, 6, 11, True, 10_000 + i), rng.randbytes(rng.randrange(40))) for i in range(60))
    for i in range(n):
        body = inner if nested and i % 50 == 7 else rng.randbytes(rng.choice([0, 5, 80, 700]))
        out.append(hsms.frame(hsms.Header(stype=rng.choice([1, 2, 5, 6]), session=0xFFFF, system=i) if rng.random() < 0.1 else hsms.data_header(0, 6, 11, True, i), body))
    return b"".join(out)


def walk(data):
    f, at, out = hsms.Frames(), 0, []
    f.feed(data)
    try:
        while (x := f.next()) is not None:
            out.append((at, x[0].pack(), x[1]))
            at += 14 + len(x[1])
    except hsms.FrameError:
        pass
    return out


FILES = {
    "a-1.bin": stream(1),
    "b-1.bin": stream(2, nested=False) + b"\0\0\0",
    "b-2.bin": stream(3, 40) + b"\0\0\0\3" + stream(4, 40),
    "c.bin": hsms.frame(hsms.data_header(0, 6, 11, True, 1), bytes(40_000)) + stream(5, 30),
    "d.bin": b"",
    "e.bin": b"\xff" * 5000,
    "f.bin": stream(6, 30)[:-1],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("captures")
    for name, data in FILES.items():
        (at / name).write_bytes(data)
    (at / "_hidden").write_bytes(stream(9, 3))
    return str(at)


@pytest.mark.parametrize("block", [97, 1000, 7777, 1 << 20])
def test_blocks_give_the_frames_of_one_walk(spark, folder, block):
    got = {}
    for r in capture.read_captures(spark, folder, block).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.offset, bytes(r.header), bytes(r.body)))
    assert {n: sorted(x) for n, x in got.items()} == {n: walk(d) for n, d in FILES.items() if walk(d)}


def test_work_is_spread_and_wrong_guesses_are_few(spark, folder):
    spans = capture.block_spans(spark, folder, 4096).collect()
    plain = [s for s in spans if s.path.endswith("b-1.bin")]
    assert len(plain) > 15 and plain[0].again <= 1  # hardly a block is walked twice where no body is a capture
    assert any(s.again for s in spans if s.path.endswith("a-1.bin"))
    read = capture.read_captures(spark, folder, 4096)
    assert read.select(F.spark_partition_id()).distinct().count() > 8


def test_missing_folder(spark, tmp_path):
    assert capture.read_captures(spark, f"{tmp_path}/none").count() == 0


def test_guess_needs_a_chain(tmp_path):
    data = bytes(50) + stream(7, 20, nested=False)
    (tmp_path / "x").write_bytes(data)
    source = capture.Bytes(str(tmp_path / "x"), str(tmp_path / "x"), len(data))
    assert capture.guess(source, 1, len(data)) == 50
    assert capture.guess(source, 51, len(data)) in {50 + at for at, *_ in walk(data[50:])}


def run(spark, folder, tmp_path, **options):
    q = capture.live_frames(spark, str(folder), **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    batches = q.lastProgress and q.lastProgress["batchId"]
    q.stop()
    return batches


@pytest.mark.parametrize("hints", [True, False])
def test_growing_files_are_read_once_across_restarts(spark, tmp_path, hints):
    folder, rng = tmp_path / "in", random.Random(3)
    folder.mkdir()
    whole = {"a-1.bin": stream(1, 200), "b.bin": stream(2, 120)}
    options = {"bytesPerBatch": "3000", "bytesPerTask": "1000"} | ({"hints": f"{tmp_path}/hints.json"} if hints else {})
    written = dict.fromkeys(whole, 0)
    while any(written[n] < len(d) for n, d in whole.items()):
        for n, d in whole.items():  # cut anywhere, also inside a length
            to = min(len(d), written[n] + rng.randrange(1, 60_000))
            with open(folder / n, "ab") as f:
                f.write(d[written[n] : to])
            written[n] = to
        run(spark, folder, tmp_path, **options)
    run(spark, folder, tmp_path, **options)  # nothing new
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.offset, bytes(r.header), bytes(r.body)))
    assert {n: sorted(x) for n, x in got.items()} == {n: walk(d) for n, d in whole.items()}


def test_file_that_shrinks_is_an_error(tmp_path):
    (tmp_path / "x").write_bytes(stream(1, 5))
    reader = capture.CaptureStream({"path": str(tmp_path)})
    reader.initialOffset()
    end = reader.latestOffset()
    (tmp_path / "x").write_bytes(b"")
    with pytest.raises(ValueError, match="lost bytes"):
        reader.partitions({}, end)
