"""Captured byte streams: frames of any number of files of any size, in bulk and as the files grow.

A frame is four bytes of length, a header of ten and a body, and nothing marks
where one starts.  read_captures() cuts files into blocks nevertheless.  Each
block guesses its first frame from headers that make sense one after another,
and walks from there to its end.  A walk from the file's start is then put
together from what blocks found: a block whose guess isn't where the one
before it ended is walked again from there.  So the frames are those of one
walk, whatever a body looks like, and a wrong guess costs one block.

The stream source follows files that are still written.  Its offsets are bytes
of whole frames: what has come of a frame so far stays until the rest is
there, and a query that starts again goes on where its checkpoint says.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from dieflow.protocol.hsms import DATA, DESELECT_REQ, DESELECT_RSP, HEADER_SIZE, LENGTH_SIZE, LINKTEST_REQ, LINKTEST_RSP, REJECT_REQ, SELECT_REQ, SELECT_RSP, SEPARATE_REQ

FRAMES = "path string, offset long, modified_us long, header binary, body binary"
BLOCK, LARGEST = 64 << 20, HEADER_SIZE + (16 << 20)
#: Headers in a row that must make sense before a guess counts.
CHAIN = 4
_PIECE = 4 << 20
_TYPES = (DATA, SELECT_REQ, SELECT_RSP, DESELECT_REQ, DESELECT_RSP, LINKTEST_REQ, LINKTEST_RSP, REJECT_REQ, SEPARATE_REQ)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def captures(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in microseconds) of every file in a folder, or of one file; names that start with a dot or underscore are left out."""
    fs, at = _store(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((i.path, i.size, (i.mtime_ns or 0) // 1000) for i in found if i.type == pafs.FileType.File and i.base_name[:1] not in "._")


class Bytes:
    """A file read by pieces; any range can be asked for, in rising order at little cost."""

    def __init__(self, root: str, path: str, size: int) -> None:
        self.file, self.size, self.at, self.held = _store(root)[0].open_input_file(path), size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to n bytes from start; fewer where the file, as long as it was said to be, ends."""
        n = max(0, min(n, self.size - start))
        if start < self.at or start + n > self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(min(max(n, _PIECE), self.size - start), start) if n else b""
        return self.held[start - self.at : start - self.at + n]

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Walk:
    """Where a walk over frames ended: at a frame that starts at or after the limit, one not whole yet, or a length that no frame has."""

    stop: int
    bad: bool = False
    short: bool = False


def steps(source: Bytes, start: int, limit: int, largest: int = LARGEST) -> Iterator[tuple[int, int] | Walk]:
    """(offset, length) of each whole frame that starts in [start, limit), and a Walk at last."""
    at = start
    while at < limit:
        head = source.get(at, LENGTH_SIZE)
        if len(head) < LENGTH_SIZE:
            yield Walk(at, short=True)
            return
        (n,) = struct.unpack(">I", head)
        if not HEADER_SIZE <= n <= largest:
            yield Walk(at, bad=True)
            return
        if at + LENGTH_SIZE + n > source.size:
            yield Walk(at, short=True)
            return
        yield at, n
        at += LENGTH_SIZE + n
    yield Walk(at)


def walked(source: Bytes, start: int, limit: int, largest: int = LARGEST) -> Walk:
    for x in steps(source, start, limit, largest):
        if isinstance(x, Walk):
            return x
    raise AssertionError("a walk ends")


def makes_sense(source: Bytes, at: int, chain: int = CHAIN, largest: int = LARGEST) -> bool:
    """Whether headers make sense there and after, so many times or up to the file's end; one that leads beyond it doesn't."""
    for _ in range(chain):
        head = source.get(at, LENGTH_SIZE + HEADER_SIZE)
        if len(head) < LENGTH_SIZE + HEADER_SIZE:
            return at <= source.size
        (n,) = struct.unpack_from(">I", head)
        if not (HEADER_SIZE <= n <= largest and head[8] == 0 and head[9] in _TYPES):
            return False
        at += LENGTH_SIZE + n
    return True


def guess(source: Bytes, start: int, limit: int, chain: int = CHAIN, largest: int = LARGEST) -> int | None:
    """The first place in [start, limit) where frames seem to start."""
    for at in range(start, limit, _PIECE // 4):
        n = min(_PIECE // 4, limit - at)
        data = np.frombuffer(source.get(at, n + LENGTH_SIZE + HEADER_SIZE - 1), np.uint8)
        n = min(n, len(data) - LENGTH_SIZE - HEADER_SIZE + 1)
        if n <= 0:
            return None
        length = sum(data[k : n + k].astype(np.int64) << (24 - 8 * k) for k in range(4))
        likely = (length >= HEADER_SIZE) & (length <= largest) & (data[8 : n + 8] == 0) & np.isin(data[9 : n + 9], _TYPES)
        for k in np.flatnonzero(likely):
            if makes_sense(source, at + int(k), chain, largest):
                return at + int(k)
    return None


def put_together(blocks: list[dict], source, largest: int = LARGEST) -> tuple[list[tuple[int, int, int]], int]:
    """(block, start, stop) of one file's blocks that frames start in, from guesses in order; and how many blocks were walked again.

    source() opens the file, if it must be read again.
    """
    out, again, at, opened = [], 0, 0, None
    for b in blocks:
        if at >= b["until"]:
            continue  # one frame covers the block
        if b["start"] == at:
            walk = Walk(b["stop"], b["bad"], b["short"])
        else:
            opened = opened or source()
            walk, again = walked(opened, at, b["until"], largest), again + 1
        if walk.stop > at:
            out.append((b["block"], at, walk.stop))
        if walk.bad or walk.short:
            break
        at = walk.stop
    if opened:
        opened.close()
    return out, again


_BLOCKS = "path string, size long, modified_us long, block long, begin long, until long"


def _batches(path: str, modified: int, source: Bytes, start: int, stop: int, hold: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "offset", "modified_us", "header", "body"])

    for x in steps(source, start, stop):
        if isinstance(x, Walk):
            break
        at, n = x
        whole = source.get(at + LENGTH_SIZE, n)
        rows.append((path, at, modified, whole[:HEADER_SIZE], whole[HEADER_SIZE:]))
        held += n
        if held > hold or len(rows) >= 4096:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def block_spans(spark: SparkSession, path: str, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """(path, size, modified_us, block, start, stop, again): from where to where each block's frames go, and how many of its file's blocks were walked twice.

    A row a block moves, and no more than a row a block of one file meets in a task.
    """
    rows = [(p, size, t, k, at, min(size, at + block)) for p, size, t in captures(path) for k, at in enumerate(range(0, size, block))]
    if not rows:
        return spark.createDataFrame([], "path string, size long, modified_us long, block long, start long, stop long, again long")
    given = spark.createDataFrame(rows, _BLOCKS).repartition(min(len(rows), 10_000), "path", "block")

    def guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                source = Bytes(path, r["path"], r["size"])
                start = 0 if not r["begin"] else guess(source, r["begin"], r["until"], largest=largest)
                walk = None if start is None else walked(source, start, r["until"], largest)
                out.append((start, walk and walk.stop, walk and walk.bad, walk and walk.short))
                source.close()
            more = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "start", "stop", "bad", "short"])

    def chain(table: pa.Table) -> pa.Table:
        blocks = table.sort_by("block").to_pylist()
        first = blocks[0]
        spans, again = put_together(blocks, lambda: Bytes(path, first["path"], first["size"]), largest)
        columns = [[first["path"]] * len(spans), [first["size"]] * len(spans), [first["modified_us"]] * len(spans), *([s[i] for s in spans] for i in range(3)), [again] * len(spans)]
        kinds = (pa.string(), *(pa.int64(),) * 6)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "size", "modified_us", "block", "start", "stop", "again"])

    found = given.mapInArrow(guesses, f"{_BLOCKS}, start long, stop long, bad boolean, short boolean")
    return found.groupBy("path").applyInArrow(chain, "path string, size long, modified_us long, block long, start long, stop long, again long")


def read_captures(spark: SparkSession, path: str, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """(path, offset, modified_us, header, body) of every whole frame of the captures under a path, as one walk from each file's start finds them.

    A length that no frame has ends a file; what is left at its end is no frame.
    A task reads a block by pieces and holds a batch of frames.
    """
    spans = block_spans(spark, path, block, largest)
    n = sum(-(-size // block) for _, size, _ in captures(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                source = Bytes(path, r["path"], r["size"])
                yield from _batches(r["path"], r["modified_us"], source, r["start"], r["stop"])
                source.close()

    return spans.repartition(max(1, min(n, 10_000)), "path", "block").mapInArrow(run, FRAMES)


@dataclass
class Span(InputPartition):
    path: str
    modified: int
    size: int
    start: int
    stop: int


class CaptureStream(DataSourceStreamReader):
    """Whole frames of files as they grow.  Options: path, bytesPerBatch (a file), bytesPerTask, and hints, a file for what is known of the offsets.

    Offsets are by file, at the ends of whole frames.  They are found on the
    driver by walking over lengths, from the last one known.  After a restart
    that is what the hints hold; without them files are walked from their start,
    once, and none of their frames is read again.
    """

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.most, self.task = int(options.get("bytesPerBatch", 256 << 20)), int(options.get("bytesPerTask", 32 << 20))
        self.hints = options.get("hints")
        self.known: dict[str, int] = {}
        self.fresh = False
        if self.hints and os.path.exists(self.hints):
            with open(self.hints) as f:
                self.known = json.load(f)

    def initialOffset(self) -> dict:
        self.fresh = True  # nothing was read before: batches may be bounded from the start
        return {}

    def latestOffset(self) -> dict:
        for path, size, _ in captures(self.path):
            at = self.known.get(path)
            bounded = self.fresh or at is not None
            if size > (at or 0):
                source = Bytes(self.path, path, size)
                # A batch takes a frame more than its bound rather than none.
                self.known[path] = walked(source, at or 0, min(size, (at or 0) + self.most) if bounded else size).stop
                source.close()
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.known |= {p: max(at, self.known.get(p, 0)) for p, at in end.items()}
        self.fresh = True
        out, times = [], {p: (size, t) for p, size, t in captures(self.path)}
        for path, stop in end.items():
            at = start.get(path, 0)
            if at >= stop:
                continue
            if path not in times or times[path][0] < stop:
                raise ValueError(f"{path} has lost bytes that were announced")
            source = Bytes(self.path, path, stop)
            while at < stop:
                to = walked(source, at, min(stop, at + self.task)).stop
                out.append(Span(path, times[path][1], stop, at, to))
                at = to
            source.close()
        return out

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        source = Bytes(self.path, part.path, part.size)
        yield from _batches(part.path, part.modified, source, part.start, part.stop)
        source.close()

    def commit(self, end: dict) -> None:
        if self.hints:
            with open(f"{self.hints}.tmp", "w") as f:
                json.dump(end, f)
            os.replace(f"{self.hints}.tmp", self.hints)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)


def live_frames(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (path, offset, modified_us, header, body): the whole frames of files under a path, each once, as they grow."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").options(path=path, **options).load()


def tool_of(path: str = "path"):
    """The tool that a capture is of: its file's name up to the first dash."""
    return F.regexp_extract(path, r"([^/]*?)(-[^/]*)?$", 1)
