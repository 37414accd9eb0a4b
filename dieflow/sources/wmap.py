"""Wafer-map files: 32-byte header, 32-byte records, bins back to back, all little-endian.

`read_wmap` reads whole files through Spark's own reader, so any store will do,
one task a file.  The data source "wmap" splits large local or mounted files by
record range, pushes filters on split, lot_id and wafer_id into the reader, and
writes one file a partition.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from dieflow.patterns import PATTERNS, SPLITS, UNKNOWN, UNKNOWN_CODE, WAFERS

MAGIC, VERSION, HEADER, RECORD = b"WAFERMAP", 1, 32, 32
RECORDS = np.dtype([("wafer_id", "<i4"), ("lot_id", "<i4"), ("tested_at_us", "<i8"), ("offset", "<u8"), ("rows", "<u2"), ("cols", "<u2"), ("truth", "u1"), ("split", "u1"), ("reserved", "<u2")])
COLUMNS = ("wafer_id", "lot_id", "tested_at_us", "truth", "split", "rows", "cols", "bins")


class WmapError(ValueError):
    pass


def check_header(head: bytes, size: int) -> tuple[int, int]:
    """Record count and bytes of bins of a file of that size."""
    if len(head) < HEADER:
        raise WmapError(f"{size} bytes, but the header alone has {HEADER}")
    magic, version, record, count, bins = struct.unpack_from("<8sIIQQ", head)
    wanted = HEADER + count * RECORD + bins
    for right, why in (
        (magic == MAGIC, f"begins with {magic!r} and not with {MAGIC!r}"),
        (version == VERSION, f"has format version {version}; only {VERSION} can be read"),
        (record == RECORD, f"has records of {record} bytes in place of {RECORD}"),
        (wanted == size, f"{count} records and {bins} bytes of bins make {wanted} bytes, the file has {size}"),
    ):
        if not right:
            raise WmapError(why)
    return count, bins


def check_records(records: np.ndarray, bin_bytes: int, first: int = 0) -> None:
    """The first record that points past the bins, or has a code without a name, is an error."""
    dies = records["rows"].astype(np.uint64) * records["cols"].astype(np.uint64)
    room = np.uint64(bin_bytes) - np.minimum(records["offset"], np.uint64(bin_bytes))
    past = (records["offset"] > bin_bytes) | (dies > room)
    unnamed = (records["truth"] >= len(PATTERNS)) & (records["truth"] != UNKNOWN_CODE) | (records["split"] >= len(SPLITS))
    if (past | unnamed).any():
        i = int(np.argmax(past | unnamed))
        r = records[i]
        why = f"bins at {r['offset']} + {dies[i]} of {bin_bytes}" if past[i] else f"truth {r['truth']} or split {r['split']} has no name"
        raise WmapError(f"record {first + i}: {why}")


def name_of(code: int) -> str:
    return PATTERNS[code] if code < len(PATTERNS) else UNKNOWN


def parse(image: bytes) -> list[tuple]:
    """Rows in the order of COLUMNS."""
    count, bins = check_header(image[:HEADER], len(image))
    records = np.frombuffer(image, dtype=RECORDS, count=count, offset=HEADER)
    check_records(records, bins)
    at = HEADER + count * RECORD
    return [_row(r, image[at + int(r["offset"]) : at + int(r["offset"]) + int(r["rows"]) * int(r["cols"])]) for r in records]


def _row(r, bins: bytes) -> tuple:
    return (int(r["wafer_id"]), int(r["lot_id"]), int(r["tested_at_us"]), name_of(int(r["truth"])), SPLITS[r["split"]], int(r["rows"]), int(r["cols"]), bins)


def serialize(rows: Iterable[tuple]) -> bytes:
    codes = {p: i for i, p in enumerate(PATTERNS)} | {UNKNOWN: UNKNOWN_CODE}
    records, bins, at = [], [], 0
    for wafer, lot, tested, truth, split, r, c, b in rows:
        if len(b) != r * c:
            raise WmapError(f"wafer {wafer}: {len(b)} bins for {r} x {c} dies")
        records.append((wafer, lot, tested, at, r, c, codes[truth], SPLITS.index(split), 0))
        bins.append(bytes(b))
        at += len(b)
    return MAGIC + struct.pack("<IIQQ", VERSION, RECORD, len(records), at) + np.array(records, dtype=RECORDS).tobytes() + b"".join(bins)


def read_wmap(spark: SparkSession, path: str) -> DataFrame:
    """The wafers of every .wmap file under path, from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmap").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = parse(content.as_py())
                for at in range(0, len(rows), 1024):
                    part = list(zip(*rows[at : at + 1024]))
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(part, kinds)], names=list(COLUMNS))

    return files.mapInArrow(run, WAFERS)


def _files(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.wmap"))) if os.path.isdir(path) else [path]


@dataclass
class Span(InputPartition):
    file: str
    first: int
    last: int


class WmapReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.records = int(options.get("recordsPerPartition", 50_000))
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("split",), ("lot_id",), ("wafer_id",)):
                values = f.value if isinstance(f, In) else (f.value,)
                self.tests.append((f.attribute[0], frozenset(values)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        out = []
        for f in _files(self.path):
            with open(f, "rb") as file:
                count, _ = check_header(file.read(HEADER), os.path.getsize(f))
            out += [Span(f, at, min(count, at + self.records)) for at in range(0, count, self.records)]
        return out or [Span("", 0, 0)]

    def read(self, part: Span) -> Iterator[tuple]:
        if not part.file:
            return
        with open(part.file, "rb") as f:
            count, bins = check_header(f.read(HEADER), os.path.getsize(part.file))
            f.seek(HEADER + part.first * RECORD)
            records = np.frombuffer(f.read((part.last - part.first) * RECORD), dtype=RECORDS)
            check_records(records, bins, part.first)
            for r in records:
                named = {"wafer_id": int(r["wafer_id"]), "lot_id": int(r["lot_id"]), "split": SPLITS[r["split"]]}
                if all(named[k] in v for k, v in self.tests):
                    f.seek(HEADER + count * RECORD + int(r["offset"]))
                    yield _row(r, f.read(int(r["rows"]) * int(r["cols"])))


@dataclass
class Written(WriterCommitMessage):
    file: str


class WmapWriter(DataSourceWriter):
    """One file a partition, named when the job commits; coalesce(1) first for a single file."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        at = os.path.join(self.path, f".part-{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}.tmp")
        with open(at, "wb") as f:
            f.write(serialize(tuple(r[c] for c in COLUMNS) for r in rows))
        return Written(at)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m.file for m in messages if m]
        if self.overwrite:
            for f in _files(self.path):
                os.remove(f)
        for f in done:
            head, name = os.path.split(f)
            os.replace(f, os.path.join(head, name[1:].rsplit("-", 1)[0] + ".wmap"))

    def abort(self, messages: list[Written | None]) -> None:
        for f in glob.glob(os.path.join(self.path, f".part-{self.run}-*.tmp")):
            os.remove(f)


class WmapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wmap"

    def schema(self) -> str:
        return WAFERS

    def reader(self, schema) -> WmapReader:
        return WmapReader(self.options)

    def writer(self, schema, overwrite: bool) -> WmapWriter:
        return WmapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WmapDataSource)
