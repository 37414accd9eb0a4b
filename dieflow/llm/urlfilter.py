"""URL rules in a sorted digest array.

A rule is a host and a path prefix; it fits its host and all subdomains.  The
rules' 64-bit xxhash keys lie sorted in a file, followed by the full strings.
Each executor gets the file once, its Python workers memory-map it together,
probe it with a vectorised binary search, and compare the stored string, so a
hash collision can neither add nor hide a match.  A list over the size bound
goes through a join instead.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.llm.common import fresh, map_batches

MAX_INDEX_BYTES = 512 << 20
RESULTS = ("host", "path", "rule", "verdict")
UPPER, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER_LETTERS), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class Index:
    """n, then n sorted digests, n + 1 string offsets, n verdicts, n lengths of hosts and n of paths, and the strings."""

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """From (verdict, host, path) rules; the last of equal rules holds."""
        rules = {f"{host}{path}": (verdict, len(host), len(path)) for verdict, host, path in rules}
        rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v == "allow", h, n) for k, (v, h, n) in rules.items())
        ends = np.cumsum([0, *(len(r[1]) for r in rows)])
        words = ([len(rows)], [r[0] for r in rows], ends, *([r[i] for r in rows] for i in (2, 3, 4)))
        return b"".join([*(np.array(w, dtype="<u8").tobytes() for w in words), *(r[1] for r in rows)])

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<u8")[0])
        words = raw[8 : 8 * (5 * n + 2)].view("<u8")
        self.digests, self.ends, self.allow = words[:n], words[n : 2 * n + 1], words[2 * n + 1 : 3 * n + 1]
        self.strings = raw[8 * (5 * n + 2) :]
        shapes = np.unique(np.stack([words[3 * n + 1 : 4 * n + 1], words[4 * n + 1 :]]), axis=1).T.tolist() if n else []
        #: (length of host, lengths of paths) that rules have, longest first.
        self.shapes = [(h, sorted((p for x, p in shapes if x == h), reverse=True)) for h in sorted({h for h, _ in shapes}, reverse=True)]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each key, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not keys or not len(self.digests):
            return found
        probe = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        left, right = np.searchsorted(self.digests, probe, "left"), np.searchsorted(self.digests, probe, "right")
        for i in np.flatnonzero(left < right):
            for r in range(left[i], right[i]):
                if self.strings[int(self.ends[r]) : int(self.ends[r + 1])].tobytes() == keys[i]:
                    found[i] = r
        return found


@lru_cache(maxsize=4)
def _open(name: str) -> Index:
    return Index(SparkFiles.get(name))


_served: dict[str, tempfile.TemporaryDirectory] = {}


def _publish(spark: SparkSession, name: str, data: bytes) -> None:
    """Have the driver serve the file to executors, also to late ones, for as long as it runs."""
    key = f"{spark.sparkContext.applicationId}/{name}"
    if key not in _served:
        _served[key] = tempfile.TemporaryDirectory(prefix="dieflow-urls-")
        at = os.path.join(os.path.realpath(_served[key].name), name)
        with open(at, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(at)


def _candidates(host: str, path: str, shapes: list[tuple[int, list[int]]]) -> list[bytes]:
    """Every string that a fitting rule of these lengths can have, the longest host and then the longest path first: as many as rules have lengths, however long a url is."""
    out = []
    for h, lengths in shapes:
        if host and (h == len(host) or h < len(host) and host[len(host) - h - 1] == "."):
            out += [f"{host[len(host) - h :]}{path[:n]}".encode() for n in lengths if n <= len(path)]
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The kept columns, host, path, rule (host and path of the rule that holds, else null) and verdict.

    rules are (verdict, host, path) with verdict allow or block; the longest
    fitting host and then the longest path wins, and `default` holds where none
    fits.  Null urls and urls without :// have an empty host and path, which no
    rule fits.  Repeated rows stay repeated.  A kept column that is called like
    a result is replaced by it.
    """
    keep = tuple(k for k in keep if k.lower() not in RESULTS)
    given = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    data = Index.build(rules)
    if len(data) > MAX_INDEX_BYTES:
        spark = pages.sparkSession
        return judge_by_join(given, spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place bigint"), keep, default)
    name = f"urls-{xxhash.xxh64_hexdigest(data)}.idx"
    _publish(pages.sparkSession, name, data)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = _open(name)
        hosts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        keys, rows = [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            more = _candidates(h, p, index.shapes)
            keys += more
            rows += [i] * len(more)
        found = index.find(keys)
        rule, verdict = [None] * len(hosts), [default] * len(hosts)
        for k in np.flatnonzero(found >= 0)[::-1]:  # the first candidate comes last and stays
            rule[rows[k]], verdict[rows[k]] = keys[k].decode(), "allow" if index.allow[found[k]] else "block"
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema), "rule string", "verdict string"])
    return map_batches(given, run, schema, rows=4096)


def judge_by_join(given: DataFrame, rules: DataFrame, keep: tuple[str, ...], default: str = "allow") -> DataFrame:
    """judge() for rule tables (verdict, host, path, place) of any size: candidates are listed by page and joined on the full string.

    Of equal rules the one with the highest place holds.  Null rules, hosts or
    paths fit nothing; repeated pages stay repeated.  Kept columns may have any
    name but those of the results.  A page has at most as many candidates as
    rules have pairs of lengths.
    """
    row, cut, short = fresh(given, "row", "cut", "short")
    # Lengths of hosts and paths: a few hundred at most, as long as hosts and paths are.
    shapes = [tuple(r) for r in rules.select(F.length("host").alias("h"), F.length("path").alias("n")).dropna().distinct().collect()]
    rows = given.withColumn(row, F.monotonically_increasing_id())
    size = F.length("host")
    fits = lambda h: (h == size) | ((h < size) & (F.substring("host", size - h, F.lit(1)) == "."))
    cuts = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(n).alias("n")) for h, n in shapes)) if shapes else F.expr("cast(array() as array<struct<h:int,n:int>>)")
    keys = rows.where("host <> ''").select(row, "host", "path", F.explode(F.filter(cuts, lambda c: fits(c["h"]) & (c["n"] <= F.length("path")))).alias(cut))
    keyed = keys.select(row, F.concat(F.right("host", F.col(f"{cut}.h")), F.left("path", F.col(f"{cut}.n"))).alias(short), F.col(cut))
    table = rules.groupBy(F.concat("host", "path").alias(short)).agg(F.max_by("verdict", "place").alias("verdict"))
    best = keyed.join(table, short).groupBy(row).agg(F.max_by(F.struct(F.col(short).alias("rule"), "verdict"), F.col(cut)).alias(cut))
    out = rows.join(best, row, "left")
    return out.select(*keep, "host", "path", F.col(f"{cut}.rule").alias("rule"), F.coalesce(f"{cut}.verdict", F.lit(default)).alias("verdict"))
