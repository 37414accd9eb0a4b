"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes of word shingles.  For radius r every bit
position gets a nonzero vector of r + 1 bits; each nonzero vector v of r + 1
bits gives one table whose mask keeps the positions p with odd <v, vector(p)>.
Any r positions span at most r dimensions, so some v is orthogonal to all of
them: in that table the mask covers none of the differing bits, and every pair
within the radius meets in at least one of the 2^(r+1) - 1 tables.

Equal fingerprints are grouped first, so tables hold distinct fingerprints
only.  A bucket of at most `bucket` fingerprints is linked in memory by
union-find and leaves a spanning forest, never all its pairs.  Larger buckets
take an exact other way: every fingerprint is listed under each key made by
clearing up to r of the positions the mask leaves free.  Fingerprints within
the radius share such a key, fingerprints that share one are within the
radius, and a key has at most 2^r of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS, count_keys, heavy_hitters
from dieflow.llm.common import cut, fresh, map_batches, utf8, word_blocks
from dieflow.llm.components import connected_components

SEED = 42


def _counts(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the shingles of at least `size` words, and how many those are."""
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(h)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, `size`-word shingles with repeats, a bit set where over half the hashes set it.

    Fewer words than `size` make one shingle; no words (or null) give 0.  A
    very long text is read a stretch at a time.
    """
    ones, total, held = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(text or b""):
        held += words
        if len(held) >= size:
            more, n = _counts(held, size)
            ones, total = ones + more, total + n
            held = held[len(held) - size + 1 :]
    if not total:
        if not held:
            return 0
        ones, total = _counts([b" ".join(held)], 1)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `fp`, the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in utf8(batch.column(batch.num_columns - 1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*keep, "fp"])

    given = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return map_batches(given, run, schema)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of the covering family, in the order of their vectors."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << p for p in range(bits) if ((p % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values at up to `radius` bits."""
    parent = list(range(len(values)))
    bits = values.view(np.uint64)  # counted as unsigned: a signed count takes absolute values

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(1, len(values)):
        for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= radius):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(values[i]), int(values[j])))
    return edges


def links(fps: DataFrame, radius: int = 2, bucket: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links of up to `radius` bits connect.

    fps has the distinct fingerprints as signed longs in `fp`.
    """
    masks = covering_masks(radius)
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))
    rows = cut(fps.select("fp", tables.alias("t")).select("t.k", "t.key", "fp"), "tables")
    sizes = rows.groupBy("k", "key").count().where("count > 1")
    small = rows.join(sizes.where(F.col("count") <= bucket).select("k", "key"), ["k", "key"], "left_semi")
    large = rows.join(sizes.where(F.col("count") > bucket).select("k", "key"), ["k", "key"], "left_semi")

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for x in batch.column(0).to_pylist() for e in _forest(np.array(sorted(x), dtype=np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    near = small.groupBy("k", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(in_buckets, "a long, b long")
    free = [[p for p in range(64) if not m >> p & 1] for m in masks]
    cleared = [[_signed(sum(1 << p for p in c)) for c in combinations(x, min(radius, len(x)))] for x in free]
    # The cleared positions come from a small literal array by table; listing them keeps the rows narrow.
    picks = F.element_at(F.array(*(F.array(*(F.lit(c) for c in x)) for x in cleared)), F.col("k") + 1)
    keyed = large.select("fp", F.explode(picks).alias("c")).select("fp", "c", F.col("fp").bitwiseAND(F.bitwise_not("c")).alias("rest"))
    star = keyed.groupBy("c", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    far = star.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return near.unionAll(far).distinct()


def placed(rows: DataFrame, roots: DataFrame, of: str) -> DataFrame:
    """rows, which have doc_id and a vertex, with the vertex's root (itself if roots has none) and component_id, the smallest doc_id at that root."""
    distinct = rows.groupBy(of).agg(F.min("doc_id").alias("least"))
    rooted = distinct.join(roots, of, "left").select(of, "least", F.coalesce("root", of).alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select(of, "root", "component_id"), of).select(*rows.columns, "root", "component_id")


def firsts(rows: DataFrame, roots: DataFrame, of: str) -> DataFrame:
    """(root, at) for every root: at is the smallest struct of the other columns of rows, doc_id before all.

    Rows are aggregated by vertex before roots are joined, so many copies of one
    vertex never meet in a task.
    """
    own = rows.groupBy(of).agg(F.min(F.struct("doc_id", *(c for c in rows.columns if c not in ("doc_id", of)))).alias("at"))
    return own.join(roots, of, "left").groupBy(F.coalesce("root", of).alias("root")).agg(F.min("at").alias("at"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), size: int = 3, radius: int = 2, bucket: int = 256, place: Callable[..., DataFrame] = placed) -> DataFrame:
    """One row for each row of docs: doc_id, the kept columns, fp (signed long), root (one for each component) and component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts and texts without words have fingerprint 0 and link like any other.
    Null doc_ids are kept; they count as larger than all others, so a component of nulls alone has a null id.
    Repeated rows stay repeated.  Other columns of docs are ignored, so their names cannot clash.
    A very long text is read a stretch at a time, at a cost in proportion to its length.
    With place=firsts the result is one row a group instead.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text"))
    printed = cut(fingerprints(given, size=size, keep=("doc_id", *keep)), "fps")
    roots = connected_components(links(printed.select("fp").distinct(), radius, bucket))
    return place(printed, roots.withColumnRenamed("node", "fp"), "fp")


def hex_digits(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", grouped: Callable[..., DataFrame] = groups, hot_rows: int = LEAST_ROWS, **settings) -> DataFrame:
    """One row of docs for each group, as `grouped` finds them: the one with the group's smallest id.

    A row is known by its id and a hash of all its columns, so of several rows
    with that id the same one stays whatever their order, rows of one id with
    different texts stand or fall with their own groups, and equal rows are one.
    Rows without an id can't stand for a group and all stay; null and empty
    texts are one group.  Texts are dealt out once, by id, and met by a hash of
    the chosen rows, so they aren't sorted for the join.  Rows that are there
    so often that they would fill a task are counted beforehand, without their
    texts, and made one where they lie.
    """
    mark = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), mark.alias("mark"))
    least = grouped(given, keep=("mark",), place=firsts, **settings)
    own, hashed = fresh(docs, "kept", "mark")
    chosen = least.select(F.col("at.doc_id").alias(own), F.col("at.mark").alias(hashed))
    marked = docs.where(F.col(doc_id).isNotNull()).withColumn(hashed, mark)
    hot = [k for k, _ in heavy_hitters(count_keys(marked, [doc_id, hashed]), [doc_id, hashed], least=hot_rows)]
    often = reduce(Column.__or__, ((F.col(doc_id) == F.lit(i)) & (F.col(hashed) == F.lit(h)) for i, h in hot), F.lit(False))
    # Partial aggregation leaves one of them a task before any exchange.
    rows = marked.where(~often).unionAll(marked.where(often).dropDuplicates([doc_id, hashed])) if hot else marked
    kept = rows.join(chosen.hint("shuffle_hash").withColumnRenamed(hashed, f"{hashed}_"), (F.col(doc_id) == F.col(own)) & (F.col(hashed) == F.col(f"{hashed}_")), "left_semi")
    return kept.dropDuplicates([doc_id, hashed]).drop(hashed).unionAll(docs.where(F.col(doc_id).isNull()))
