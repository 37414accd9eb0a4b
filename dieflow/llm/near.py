"""Near-duplicate groups by the Jaccard similarity of five-word shingles.

SimHash comes first: every set has a fingerprint, and fingerprints that the
covering family links at RADIUS or fewer differing bits propose their sets.
It can't find all: at a similarity of 0.8 two 64-bit fingerprints differ in
about ten bits, for which a covering family has over a thousand masks.  So
minimum hashes propose the pairs that lie further apart, and whole sets decide
about the proposals of both.

Every text becomes its set of shingles, each by 32 bits of hash; texts with
equal sets are one vertex.  BANDS keys of ROWS minimum hashes each propose
pairs, and a pair is linked only if the similarity of the two whole sets is at
least SIMILARITY: no sketch decides.  Two sets of similarity s meet under some
key with probability 1 - (1 - s^ROWS)^BANDS, which is 0.9998 at 0.8.

A key that at most BUCKET sets share proposes all their pairs.  Under a key
with more, each set is first paired with its WAYS successors in the order of
ids and with the first of the key.  That joins most large groups, and the
members that are then still apart from the key's first are compared with all
others of the key, exactly, slice by slice.  So every link under every key is
found or follows from found ones, while proposals grow with the sets and not
with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.llm.common import cut, discard, map_batches, utf8, word_blocks
from dieflow.llm.components import connected_components
from dieflow.llm import simhash
from dieflow.llm.simhash import placed

SIZE, SIMILARITY = 5, 0.8
RADIUS = 2
BANDS, ROWS = 16, 4
BUCKET, WAYS, SLICE = 16, 2, 512
SEED = 42
#: Shingles whose minimum hashes are taken at once.
STRETCH = 1 << 15

_rng = np.random.default_rng(SEED)
#: Multipliers of the words of a shingle, of the minimum hashes, and of those of a key.
_PLACES = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lower-cased; fewer words than SIZE make one, no words none."""
    parts = [np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words)) for words in word_blocks(text or b"")]
    h = parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, dtype=np.uint64)])
    if not len(h):
        return np.zeros(0, dtype=np.uint32)
    n = max(len(h) - SIZE + 1, 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(SIZE, len(h))):
        total += h[k : k + n] * _PLACES[k]
    return np.unique((_mix(total) >> np.uint64(32)).astype(np.uint32))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of sets of shingles, none of them empty: a row a set, a column a band."""
    least = np.full((len(sets), len(_TIMES)), np.iinfo(np.uint64).max)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(flat), STRETCH):
        part, of = flat[at : at + STRETCH], owner[at : at + STRETCH]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        here = of[first]
        for k in range(len(_TIMES)):
            x = part * _TIMES[k] + _PLUS[k]
            x ^= x >> np.uint64(32)
            least[here, k] = np.minimum(least[here, k], np.minimum.reduceat(x, first))
    return _mix((least.reshape(len(sets), BANDS, ROWS) * _FOLD).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is set where over half the hashes set it; the empty set gives 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), STRETCH):
        h = _mix(_mix((shingles[at : at + STRETCH].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all shingles of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1)


def _read(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, id (equal for equal sets), fp (its SimHash), keys and set of every row; texts without words have no keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in utf8(batch.column(batch.num_columns - 1))]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        fps = np.array([fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
        full = [s for s in sets if len(s)]
        keys = bands(full).view(np.int64).ravel() if full else np.zeros(0, dtype=np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(BANDS * (len(s) > 0) for s in sets)]), pa.int32()), pa.array(keys))
        data = pa.array([s.astype("<u4").tobytes() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids), pa.array(fps), listed, data], names=[*keep, "id", "fp", "keys", "set"])

    given = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1])
    return map_batches(given, run, f"{kinds}, id long, fp long, keys array<bigint>, `set` binary", rows=64)


def shared_keys(sets: DataFrame) -> DataFrame:
    """(k, key, id, n, least) of every key that n sets share, n over 1, from distinct ids and their keys."""
    rows = cut(sets.select("id", F.posexplode("keys").alias("k", "key")), "keys")
    sizes = rows.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    met = cut(rows.join(sizes, ["k", "key"]), "met")
    discard(rows)
    return met


def pairs(met: DataFrame, bucket: int = BUCKET, ways: int = WAYS) -> DataFrame:
    """Distinct proposals (a, b), a < b, from keys shared."""
    small = met.where(F.col("n") <= bucket).groupBy("k", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    every = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + F.lit(2), F.size("ids")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    near = small.select(F.explode(every).alias("p")).select("p.a", "p.b")
    large = met.where(F.col("n") > bucket)
    # The order within a large key is cut into slices of about SLICE ids, so that no key is one task; neighbours across a cut share a slice of the other deal.
    deals = []
    for shift in (0.0, 0.5):
        part = F.floor(F.col("id") / F.lit(2.0**64) * F.ceil(F.col("n") / SLICE) + F.lit(shift) * (F.col("n") > SLICE).cast("int"))
        w = W.partitionBy("k", "key", part).orderBy("id")
        ahead = F.array(*(F.lead("id", j).over(w) for j in range(1, ways + 1)))
        deals.append(large.select("id", ahead.alias("ahead")).select(F.col("id").alias("a"), F.explode("ahead").alias("b")).where("b is not null"))
    first = large.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return near.unionAll(deals[0]).unionAll(deals[1]).unionAll(first).distinct()


def by_fingerprints(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Proposals (a, b), a < b, of distinct ids whose fingerprints SimHash links at up to `radius` bits; one id stands for each fingerprint and is paired with its others."""
    least = cut(sets.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    linked = simhash.links(least.select("fp"), radius)
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"id_{c}")) for c in "ab")
    between = linked.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    equal = sets.join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return between.unionAll(equal)


def links(read: DataFrame, met: DataFrame, bucket: int = BUCKET, ways: int = WAYS, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between ids of sets, proposed by keys or by `more`, whose similarity is at least SIMILARITY."""
    proposed = pairs(met, bucket, ways)
    proposed = cut(proposed if more is None else proposed.unionAll(more).distinct(), "proposed")
    sets = _sets(read, proposed.select(F.explode(F.array("a", "b")).alias("id")))
    both = proposed.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(*(np.frombuffer(s, "<u4") for s in p)) >= SIMILARITY for p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(proposed, sets)
    return found


def _sets(read: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the given ids, from one row each: rows of equal sets don't meet."""
    # An inner join: a semi join would be pushed below the aggregate, where all copies of a set meet.
    rows = read.groupBy("id").agg(F.min("row").alias("row")).join(ids.distinct(), "id").select("row")
    return cut(read.select("row", "id", "set").join(rows, "row", "left_semi").select("id", "set"), "sets")


def _linked_to(rows: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(i, j) of all rows[i], others[j] whose similarity is at least SIMILARITY."""
    sizes = np.array([len(x) for x in others])
    flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, x in enumerate(rows):
        start, end = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = end - start
        at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(others))
        for j in np.flatnonzero(shared >= SIMILARITY * (len(x) + sizes - shared)):
            yield i, int(j)


def rest(read: DataFrame, met: DataFrame, roots: DataFrame, bucket: int = BUCKET, part: int = SLICE) -> DataFrame:
    """Edges (a, b) under large keys from members that aren't in the component of the key's first.

    Those members and all members are dealt into slices of about `part`, and
    every slice of the former meets every slice of the latter in a group of its own.
    """
    at = roots.select(F.col("node").alias("id"), "root")
    large = met.where(F.col("n") > bucket).join(at, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = roots.select(F.col("node").alias("least"), F.col("root").alias("first"))
    large = cut(large.join(first, "least", "left").withColumn("away", F.col("root") != F.coalesce("first", "least")), "large")
    apart = large.where("away").groupBy("k", "key").agg(F.count("*").alias("m"))
    dealt = large.join(apart, ["k", "key"]).withColumns({"rows": F.ceil(F.col("n") / part), "columns": F.ceil(F.col("m") / part)})
    slot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = dealt.select("k", "key", "id", "root", F.lit(False).alias("away"), slot("rows", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    some = dealt.where("away").select("k", "key", "id", "root", "away", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), slot("columns", 2).alias("j"))
    sets = _sets(read, dealt.select("id"))

    def run(group: pa.Table) -> pa.Table:
        ids, root, away, data = (group.column(c).to_pylist() for c in ("id", "root", "away", "set"))
        x, y = ([k for k, a in enumerate(away) if a == kind] for kind in (True, False))
        found = {}
        if x and y:
            for i, j in _linked_to(*([np.frombuffer(data[k], "<u4") for k in of] for of in (x, y))):
                if root[x[i]] != root[y[j]]:
                    found[root[x[i]], root[y[j]]] = ids[x[i]], ids[y[j]]  # one link for each two components
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.int64()), "b": pa.array([b for _, b in found.values()], pa.int64())})

    return every.unionAll(some).join(sets, "id").groupBy("k", "key", "i", "j").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), bucket: int = BUCKET, ways: int = WAYS, place: Callable[..., DataFrame] = placed) -> DataFrame:
    """One row for each row of docs: doc_id, the kept columns, id of its set (signed long), root (one for each group) and component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts and texts without words have the empty set and are
    equal.  Null doc_ids are kept; they count as larger than all others.
    Repeated rows stay repeated.  A very long text is read by stretches and
    held as 4 bytes a shingle.  With place=firsts the result is one row a group
    instead.
    """
    given = _read(docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text")), ("doc_id", *keep))
    read = cut(given.withColumn("row", F.monotonically_increasing_id()), "shingles")
    each = cut(read.where(F.size("keys") > 0).select("id", "fp", "keys").dropDuplicates(["id"]), "each")
    met = shared_keys(each.select("id", "keys"))
    found = links(read, met, bucket, ways, by_fingerprints(each.select("id", "fp")))
    discard(each)
    roots = cut(connected_components(found), "roots")
    if not met.where(F.col("n") > bucket).isEmpty():
        found = cut(found.unionAll(rest(read, met, roots, bucket)), "links")
        roots = connected_components(found)
    return place(read.select("doc_id", *keep, "id"), roots.withColumnRenamed("node", "id"), "id")
