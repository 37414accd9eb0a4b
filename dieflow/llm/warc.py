"""Web archives: legacy ARC files are read and written anew as WARC files.

An ARC file says in its first record which version it is; that decides what a
record's header line holds (five fields in version 1, ten in version 2).  A
record is its header line and as many bytes as the line declares, whatever
they look like.  What a WARC record has beyond that is made up from it: an
identifier from the file's name and the record's place, a timestamp from the
14 digits, a type from what the bytes are, and digests of block and payload.
Of records with equal payloads one is stored; the others are revisits of it.

Spark's own text writer and reader move the bytes, by lines, through any store
and with its commit protocol.  Files are gzip, one task each, and streamed:
a task holds a record, and the lines of a batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS, hot_join
from dieflow.llm.common import cut, scratch, small_batches, utf8

#: Payloads from this size on are stored once.
LEAST_BYTES = 1000
#: Seconds, in ARC's form, that pages without a date are said to be of.
CAPTURED = "19970401000000"
_SPACE_NAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs

# The field lists of both ARC versions, and WARC's profile of a revisit.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Blanks may stand in a URL and in a type, hence both are what the fields of known form leave.
_LINE = {
    1: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,14}) (?P<type>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,14}) (?P<type>.*) (?P<status>\d{3}|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>\d+) (?P<name>\S+) (?P<length>\d+)"),
}


# --- bytes of one record ---


def arc_line(version: int, url: bytes, ip: str, date: str, kind: str, status: int | None, offset: int, name: str, length: int, digest: str = "-") -> bytes:
    """A record's header line, without its end."""
    more = f" {status or '-'} {digest} - {offset} {name}" if version == 2 else ""
    return url + f" {ip} {date} {kind}{more} {length}".encode()


def arc_head(version: int, name: str, date: str, origin: str = "dieflow") -> bytes:
    """The record an ARC file starts with, without the newline that separates records."""
    block = f"{version} 0 {origin}\n{FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}".encode(), "0.0.0.0", date, "text/plain", 200, 0, name, len(block)) + b"\n" + block


def safe_url(url: bytes | None) -> bytes:
    """A URL as a field of a header line: blanks and control characters by their codes; none is a dash."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url) if url else b"-"


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP response; other blocks are payload alone."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    at, n = min(ends, default=(len(block), 0))
    return block[: at + n], block[at + n :]


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a head, names in lower case; the first of equal names counts."""
    out: dict[str, str] = {}
    for line in head.splitlines():
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def warc_date(date: str) -> str:
    """14 digits, or 12 without seconds, as WARC's timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    """The same for the same place in the same file, however often it is converted."""
    return f"urn:uuid:{uuid.uuid5(_SPACE_NAME, f'{name}#{offset}')}"


def labelled_digest(sha1_hex: str) -> str:
    return f"sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}"


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.partition(":")[2]).hex()


def warc_record(named: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends that separate records; fields without a value are left out."""
    head = "".join(f"{n}: {v}\r\n" for n, v in [*named, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


# --- streams of records ---


class Records:
    """Records of one file, from its bytes in pieces; holds the bytes of one record."""

    def __init__(self, name: str) -> None:
        self.name, self.held, self.size, self.at, self.need = name, [], 0, 0, 1

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.held.append(piece)
        self.size += len(piece)
        while self.size >= self.need:
            data = b"".join(self.held)
            self.held, start = [data], 0
            while (found := self.first(data, start)) is not None:
                end, record = found
                if record is not None:
                    yield record
                start = end
            self.held, self.size, self.at = [data[start:]], len(data) - start, self.at + start
            if not self.need or self.need <= self.size:
                self.need = self.size + 1

    def end(self) -> None:
        if b"".join(self.held).strip():
            raise ValueError(f"{self.name}: ends inside the record at byte {self.at}")

    def first(self, data: bytes, start: int) -> tuple[int, tuple | None] | None:
        """(end, record) of what starts there, or None, with need set to how many bytes it takes, if more must come."""
        raise NotImplementedError


class ArcRecords(Records):
    """(offset, version, url, ip, date, type, status, block) of every record but the first of an ARC file."""

    version = 0

    def first(self, data: bytes, start: int) -> tuple[int, tuple | None] | None:
        while data[start : start + 1] == b"\n":
            start += 1
        stop = data.find(b"\n", start)
        if stop < 0:
            self.need = 0
            return None
        line = data[start:stop].rstrip(b"\r")
        for version in (self.version,) if self.version else (2, 1):
            if m := _LINE[version].fullmatch(line):
                break
        else:
            raise ValueError(f"{self.name}: no header of version {self.version or '1 or 2'} at byte {self.at + start}")
        end = stop + 1 + int(m["length"])
        if len(data) < end:
            self.need = end - start
            return None
        block = data[stop + 1 : end]
        if not self.version:
            self.version = int(block[:1]) if block[:2] in (b"1 ", b"2 ") else 0
            if not self.version or not line.startswith(b"filedesc:"):
                raise ValueError(f"{self.name}: doesn't start as an ARC file of version 1 or 2")
            return end, None
        status = m["status"] if self.version == 2 else block[9:12] if block.startswith(b"HTTP/") else b""
        return end, (self.at + start, self.version, *(m[n].decode("utf-8", "replace") for n in ("url", "ip", "date", "type")), int(status) if status.isdigit() else None, block)


class WarcRecords(Records):
    """(fields, block) of every record of a WARC file."""

    def first(self, data: bytes, start: int) -> tuple[int, tuple | None] | None:
        while data[start : start + 2] == b"\r\n":
            start += 2
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            self.need = 0
            return None
        if not data.startswith(b"WARC/", start):
            raise ValueError(f"{self.name}: no record at byte {self.at + start}")
        named = fields(data[start:stop])
        end = stop + 4 + int(named["content-length"])
        if len(data) < end:
            self.need = end - start
            return None
        return end, (named, data[stop + 4 : end])


# --- files ---


def _stored(rows: DataFrame, path: str, separator: str) -> str:
    """Write rows' bytes, one file a task."""
    options = {"lineSep": separator, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    rows.select(F.col("value").cast("string")).write.options(**options).text(path)
    return path


def _read(spark: SparkSession, path: str, records: type[Records], row: Callable[[str, tuple], tuple | None], schema: str, arrow: pa.Schema, hold: int = 8 << 20) -> DataFrame:
    """Rows made of the records of all files under a path."""
    lines = spark.read.option("lineSep", "\n").text(path)
    # The file's name travels with every line, as a number.
    named = lines.select(F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now, out, size = None, None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            files, values = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            if any(batch.column(1).to_pylist()):
                raise ValueError("an archive was split: it must be gzip")
            start = 0
            while start < len(files):
                stop = start
                while stop < len(files) and files[stop] == files[start]:
                    stop += 1
                if files[start] != file or now is None:
                    if now is not None:
                        now.end()
                    file, now = files[start], records(f"{files[start] & (1 << 64) - 1:016x}")
                for found in now.feed(b"\n".join(values[start:stop]) + b"\n"):
                    if (made := row(now.name, found)) is not None:
                        out.append(made)
                        size += len(found[-1])
                    if size > hold or len(out) >= 256:
                        yield flush()
                        out, size = [], 0
                start = stop
        if now is not None:
            now.end()
        if out:
            yield flush()

    return small_batches(named).mapInArrow(run, schema)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = CAPTURED) -> str:
    """Pages as gzip ARC files, a file a task, of version 1 and 2 in turn: the legacy archive that convert() reads.

    A page is an HTTP response whose head names the page; a null html is an
    empty payload, a null or empty url a dash.
    """
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, at = 1 + part % 2, f"pages-{part:06d}.arc", 0
        for batch in batches:
            out = []
            for i, u, h in zip(*(utf8(c) for c in batch.columns)):
                if not at:
                    out.append(arc_head(version, name, date))
                    at = len(out[0]) + 1
                payload = h or b""
                named = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *([b"X-Page-Id: " + i] if i is not None else []), b"Content-Length: %d" % len(payload)]
                block = b"\r\n".join(named) + b"\r\n\r\n" + payload
                out.append(arc_line(version, safe_url(u), "0.0.0.0", date, "text/html", 200, at, name, len(block)) + b"\n" + block)
                at += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return _stored(small_batches(rows).mapInArrow(run, "value binary"), path, "\n")


_ARC = "id string, version int, url string, ip string, date string, type string, status int, page_id long, payload_bytes long, sha1 string"
_ARC_ARROW = [("id", pa.string()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("type", pa.string()), ("status", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("sha1", pa.string())]


def read_arc(spark: SparkSession, path: str, block: bool = True) -> DataFrame:
    """A row a record of the ARC files under path: identifier to be, header fields, size and SHA-1 of the payload, and the block unless it isn't wanted.

    page_id is what the HTTP head calls X-Page-Id, null without.
    """

    def row(name: str, record: tuple) -> tuple:
        offset, version, url, ip, date, kind, status, body = record
        head, payload = http_split(body)
        page = fields(head).get("x-page-id")
        narrow = (record_id(name, offset), version, url, ip, date, kind, status, None if page is None else int(page), len(payload), hashlib.sha1(payload).hexdigest())
        return (*narrow, body) if block else narrow

    more = [("block", pa.binary())] if block else []
    return _read(spark, path, ArcRecords, row, _ARC + (", block binary" if block else ""), pa.schema([*_ARC_ARROW, *more]))


def originals(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(sha1, payload_bytes, count, original) of payloads of at least `least` bytes that several records have: the record with the largest page_id stands for all.

    Of several with that id, or without any id, it is the one with the largest identifier.
    """
    best = F.max(F.struct("page_id", "id", "url", "date")).alias("original")
    return records.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes").agg(F.count("*").alias("count"), best).where("count > 1")


def convert(spark: SparkSession, arcs: str, path: str, least: int = LEAST_BYTES, slots: int | None = None, hot: int = LEAST_ROWS) -> str:
    """Write the ARC files under `arcs` as WARC files under path, and return it.

    Files are read twice: for digests, by which one record of each repeated
    payload is chosen, and for the bytes.  Choices are broadcast by Catalyst
    where they are small; else records are dealt out by payload once, those of
    a payload with many copies over many tasks.
    """
    chosen = cut(originals(read_arc(spark, arcs, block=False), least), "originals")
    key = ["sha1", "payload_bytes"]
    met = hot_join(read_arc(spark, arcs), chosen.drop("count"), key, "left", counted=chosen.select(*key, "count"), slots=slots, least=hot, by=["id"])
    narrow = met.select("id", "url", "ip", "date", "type", "page_id", "payload_bytes", "sha1", "original", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started:
                    info = b"software: dieflow\r\nformat: WARC File Format 1.1\r\n"
                    own = f"urn:uuid:{uuid.uuid5(_SPACE_NAME, 'info of ' + r['id'])}"
                    out.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", warc_date(r["date"])), ("Content-Type", "application/warc-fields")], info))
                    started = True
                out.append(_converted(r))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return _stored(small_batches(narrow).mapInArrow(run, "value binary"), path, "\r\n\r\n")


def _converted(r: dict) -> bytes:
    """The WARC record of a row that read_arc() made and that met its payload's original, if there is one."""
    block, first = r["block"], r["original"]
    http = block.startswith(b"HTTP/")
    repeats = first is not None and first["id"] != r["id"]
    if repeats:
        block = http_split(block)[0]
    uri = None if r["url"] == "-" else r["url"]
    kind = "revisit" if repeats else "response" if http or r["url"].startswith("dns:") else "resource"
    of = {} if not repeats else {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{first['id']}>", "WARC-Refers-To-Target-URI": None if first["url"] == "-" else first["url"], "WARC-Refers-To-Date": warc_date(first["date"]), "X-Refers-To-Page-Id": None if first["page_id"] is None else str(first["page_id"])}
    named = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{r['id']}>",
        "WARC-Date": warc_date(r["date"]),
        "WARC-Target-URI": uri,
        "WARC-IP-Address": None if r["ip"] == "0.0.0.0" else r["ip"],
        "WARC-Payload-Digest": labelled_digest(r["sha1"]),
        "WARC-Block-Digest": labelled_digest(hashlib.sha1(block).hexdigest()),
        **of,
        "X-Page-Id": None if r["page_id"] is None else str(r["page_id"]),
        "X-Payload-Length": str(r["payload_bytes"]),
        "Content-Type": "application/http; msgtype=response" if http else r["type"],
    }
    return warc_record(list(named.items()), block)


_WARC = "record_id string, record_type string, date string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to_record string, refers_to long, intact boolean"
_WARC_ARROW = [("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row a record of the WARC files under path, warcinfo left out.

    Digest and size are those of the bytes read, for a revisit those that its
    head declares; intact says whether both digests declared are those of the bytes.
    """

    def row(name: str, record: tuple) -> tuple | None:
        named, block = record
        kind = named["warc-type"]
        if kind == "warcinfo":
            return None
        head, body = http_split(block)
        whole = kind != "revisit"
        sha1 = hashlib.sha1(body).hexdigest() if whole else hex_digest(named["warc-payload-digest"])
        intact = sha1 == hex_digest(named["warc-payload-digest"]) and hashlib.sha1(block).hexdigest() == hex_digest(named["warc-block-digest"])
        page, of = named.get("x-page-id"), named.get("x-refers-to-page-id")
        ref = named.get("warc-refers-to")
        out = (named["warc-record-id"].strip("<>"), kind, named["warc-date"], named.get("warc-target-uri"), None if page is None else int(page), len(body) if whole else int(named["x-payload-length"]), sha1, ref and ref.strip("<>"), None if of is None else int(of), intact)
        return (*out, body if whole else None) if payload else out

    more = [("payload", pa.binary())] if payload else []
    return _read(spark, path, WarcRecords, row, _WARC + (", payload binary" if payload else ""), pa.schema([*_WARC_ARROW, *more]))


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type and refers_to of every page.

    A null html is an empty payload.  Pages with equal payloads from `least`
    bytes on are revisits of the one with the largest id; of repeated rows
    with that id one is the response.  A null id is smaller than all others.
    No rows give no rows.
    """
    spark = pages.sparkSession
    arcs = write_arc(pages, scratch(spark, "arc"), page_id, url, html)
    back = read_warc(spark, convert(spark, arcs, scratch(spark, "warc"), least))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
