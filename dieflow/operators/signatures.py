"""Signatures of wafer maps: one Arrow pass for all of them, and each as plain relational algebra.

`signals` is the operator to use: a narrow map, no shuffle, batched by shape.
The relational forms below give the same integers from exploded dies; they are
what SQL can check, and they take geometries of the caller's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.functions import kernels
from dieflow.functions.geometry import FRACTION_BITS, RINGS, SECTORS, ZONES, _div, hough_table, with_buckets
from dieflow.patterns import SIGNALS

CLUSTER_FIELDS = ("first", "size", "sum_r", "sum_c", "sum_rr", "sum_cc", "sum_rc", "min_r", "max_r", "min_c", "max_c")
COUNTS = ("dies", "fails", "joins", "join_pairs", "fail_joins", "angle", "rho", "votes", "line_dies", "clusters", *CLUSTER_FIELDS)
ARRAYS = ("zone_dies", "zone_fails", "sector_dies", "sector_fails", "ring_dies", "ring_fails")


def _shapes(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The maps of each shape as one array, and their places in the batch; rows, cols and bins are columns from `at` on."""
    rows, cols, bins = (batch.column(at + k).to_pylist() for k in range(3))
    groups: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(rows, cols)):
        groups.setdefault(key, []).append(i)
    for (r, c), members in groups.items():
        yield np.array(members), np.frombuffer(b"".join(bins[i] for i in members), dtype=np.uint8).reshape(len(members), r, c)


def _by_shape(batch: pa.RecordBatch, at: int, fn) -> dict[str, list]:
    """fn over the maps of each shape, put back in the batch's order."""
    out: dict[str, np.ndarray] = {}
    for members, maps in _shapes(batch, at):
        for name, values in fn(maps).items():
            if name not in out:
                out[name] = np.zeros((batch.num_rows, *values.shape[1:]), dtype=values.dtype)
            out[name][members] = values
    return out


def _given(wafers: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return wafers.select(*keep, F.col("rows").cast("int").alias("__rows"), F.col("cols").cast("int").alias("__cols"), F.col("bins").alias("__bins"))


def map_signatures(wafers: DataFrame, fn, names: dict[str, str], keep: tuple[str, ...], rows: int = 512) -> DataFrame:
    """The kept columns and columns of fn, which takes an array of equal-shaped maps; names give Spark types."""
    given = _given(wafers, keep)
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                found = _by_shape(batch, len(keep), fn)
                arrays = [pa.array([*found[n]] if kind.startswith("array") else found[n], kinds[kind]) for n, kind in names.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[: len(keep)]]
    return given.mapInArrow(run, ", ".join([*schema, *(f"`{n}` {k}" for n, k in names.items())]))


def signals(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",), detail: bool = False) -> DataFrame:
    """The kept columns and the 13 signals; with detail, also every count they rest on."""
    names = {s: "double" for s in SIGNALS}
    if detail:
        names = {n: "bigint" for n in COUNTS} | {n: "array<bigint>" for n in ARRAYS} | names
    return map_signatures(wafers, kernels.signals, names, keep)


def features(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",)) -> DataFrame:
    names = {"dies": "bigint", "fails": "bigint"} | {n: "array<bigint>" for n in ARRAYS}
    return map_signatures(wafers, kernels.features, names, keep)


def hough_lines(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",)) -> DataFrame:
    return map_signatures(wafers, kernels.hough, {n: "bigint" for n in ("angle", "rho", "votes", "line_dies")}, keep)


def cluster_rows(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",), rows: int = 512) -> DataFrame:
    """One row a cluster: the kept columns, its place in its map and its moments."""
    given = _given(wafers, keep)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                of, found = [], []
                for members, maps in _shapes(batch, len(keep)):
                    c = kernels.clusters(maps)
                    first = np.searchsorted(c["map"], c["map"], side="left")
                    of.append(members[c["map"]])
                    found.append([np.arange(len(first)) - first, *(c[n] for n in CLUSTER_FIELDS)])
                if of:
                    kept = batch.take(pa.array(np.concatenate(of))).columns[: len(keep)]
                    more = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays([*kept, *more], names=[*keep, "place", *CLUSTER_FIELDS])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[: len(keep)]]
    return given.mapInArrow(run, ", ".join([*kinds, "place bigint", *(f"`{n}` bigint" for n in CLUSTER_FIELDS)]))


# --- the same from exploded dies ---


#: Maps whose dies are in one task at once.
TASK_MAPS = 2048


def bin_arrays(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",)) -> DataFrame:
    """The kept columns, rows and cols (bigint) and codes, the bins of the map as an array."""
    given = _given(wafers, keep)

    def run(batches):
        for batch in batches:
            maps = batch.column(len(keep) + 2)
            data = [b or b"" for b in maps.to_pylist()]
            codes = pa.array(np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int16))
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, data)]), pa.int32()), codes)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(batch.column(len(keep) + k).cast(pa.int64()) for k in range(2)), listed], names=[*keep, "rows", "cols", "codes"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema[: len(keep)])
    return given.mapInArrow(run, f"{kinds}rows bigint, cols bigint, codes array<smallint>")


def dies(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",), maps: int | None = None) -> DataFrame:
    """One row a grid position: the kept columns, rows, cols, r, c and bin, all bigint.

    Maps are dealt out by the first kept column, TASK_MAPS of them to a task,
    while they are bytes: what groups or joins dies by it moves none of them.
    Who knows how many maps there are gives `maps`; else they are counted, which
    makes each once more.
    """
    maps = wafers.count() if maps is None else maps
    tasks = max(wafers.sparkSession.sparkContext.defaultParallelism, -(-maps // TASK_MAPS))
    dealt = bin_arrays(wafers, keep).repartition(tasks, keep[0])
    each = dealt.select(*keep, "rows", "cols", F.posexplode("codes").alias("i", "bin"))
    return each.select(*keep, "rows", "cols", _div(F.col("i").cast("bigint"), F.col("cols")).alias("r"), F.pmod(F.col("i").cast("bigint"), F.col("cols")).alias("c"), F.col("bin").cast("bigint").alias("bin"))


def on_wafer(bin_: Column) -> Column:
    return bin_ != 0


def is_fail(bin_: Column) -> Column:
    return bin_ >= 2


def count_features(die: DataFrame, key: str = "wafer_id", geometry: DataFrame | None = None) -> DataFrame:
    """dies, fails and the counts by bucket (zone_dies_0 and so on).

    With a geometry table (rows, cols, r, c, zone, sector, ring) its buckets
    count; without one they are computed in place and nothing is joined.  The
    table goes to every task, as it has a few shapes however many maps there are.
    Dies are counted by all three buckets first: 48 conditions for each die take
    longer than all else.
    """
    given = die.join(F.broadcast(geometry), ["rows", "cols", "r", "c"]) if geometry is not None else with_buckets(die)
    cell = given.groupBy(key, "zone", "sector", "ring").agg(F.count_if(on_wafer(F.col("bin"))).alias("dies"), F.count_if(is_fail(F.col("bin"))).alias("fails"))
    out = [F.sum(what).alias(what) for what in ("dies", "fails")]
    for name, n in (("zone", ZONES), ("sector", SECTORS), ("ring", RINGS)):
        out += [F.sum(F.when(F.col(name) == k, F.col(what)).otherwise(0)).alias(f"{name}_{what}_{k}") for what in ("dies", "fails") for k in range(n)]
    return cell.groupBy(key).agg(*out)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def densities(f: DataFrame) -> DataFrame:
    """Yield, fail density, densities by bucket and their ratios to the whole, from count_features."""
    n, bad = F.col("dies"), F.col("fails")
    whole = ratio(bad, n)
    each = {f"{name}_density_{k}": ratio(F.col(f"{name}_fails_{k}"), F.col(f"{name}_dies_{k}")) for name, m in (("zone", ZONES), ("sector", SECTORS), ("ring", RINGS)) for k in range(m)}
    out = f.withColumns({"yield": ratio(n - bad, n), "fail_density": whole} | each)
    d = F.col("fail_density")
    more = {f"zone_ratio_{k}": ratio(F.col(f"zone_density_{k}"), d) for k in range(ZONES)}
    more["max_sector_ratio"] = ratio(F.greatest(*(F.col(f"sector_density_{k}") for k in range(SECTORS))), d)
    return out.withColumns(more).withColumns({"center_ratio": F.col("zone_ratio_0"), "edge_ratio": F.col(f"zone_ratio_{ZONES - 1}")})


#: Columns in a word of dies.
WORD = 32


def words(die: DataFrame, key: str = "wafer_id", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, more, r, w, on, bad): a map's rows by words of WORD columns; bit c - WORD * w is the die at c, if on the wafer and if failing.

    A die costs one update of an aggregate here; what follows has some thirty
    rows a map, not hundreds.
    """
    bit = F.expr(f"shiftleft(1L, cast(c & {WORD - 1} as int))")
    on = die.where(on_wafer(F.col("bin")))
    return on.groupBy(key, *more, "r", F.shiftright("c", WORD.bit_length() - 1).alias("w")).agg(F.bit_or(bit).alias("on"), F.bit_or(F.when(is_fail(F.col("bin")), bit).otherwise(0)).alias("bad"))


def _offsets(of: dict[str, np.ndarray], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Doubled offsets x and y of the dies set in a map's words."""
    word, at = np.divmod(np.flatnonzero(np.unpackbits(of[name].astype("<u4").view(np.uint8), bitorder="little")), WORD)
    return 2 * (of["w"][word] * WORD + at) - (of["cols"][word] - 1), (of["rows"][word] - 1) - 2 * of["r"][word]


def _accumulated(die: DataFrame, key: str, peaks: bool) -> DataFrame:
    """(key, angle, rho, votes) of every bin that has fails, or of each map's peak, with line_dies.

    A map's words come together as one row, and its votes are counted in place:
    180 rows for each fail are never made, and dies are read once.
    """
    fields = ("rows", "cols", "r", "w", "on", "bad")
    given = words(die, key, ("rows", "cols")).groupBy(key).agg(F.collect_list(F.struct(*(F.col(f).cast("bigint").alias(f) for f in fields))).alias("at"))
    cos, sin = (t.astype(np.int32) for t in hough_table())
    kinds = {"angle": pa.int16(), "rho": pa.int32(), "votes": pa.int32()} | ({"line_dies": pa.int64()} if peaks else {})

    def run(batches):
        for batch in batches:
            keys, listed = batch.column(0), batch.column(1)
            every = dict(zip(fields, (f.to_numpy() for f in listed.flatten().flatten())))
            ends = np.cumsum(listed.value_lengths().to_numpy())
            of, found = [], []
            for k, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                own = {f: v[start:end] for f, v in every.items()}
                x, y = _offsets(own, "bad")
                if not len(x):
                    continue
                # Sizes are 16 bits in wafer files and cosines have 15: a product of a larger map may not fit 32 bits.
                kind = np.int32 if max(np.abs(x).max(), np.abs(y).max()) < 1 << 15 else np.int64
                place = np.multiply.outer(cos.astype(kind), x.astype(kind))
                place += np.multiply.outer(sin.astype(kind), y.astype(kind))
                place >>= FRACTION_BITS + 1
                low = int(place.min())
                wide = int(place.max()) - low + 1
                place += (np.arange(len(cos), dtype=kind) * wide - low)[:, None]
                n = np.bincount(place.ravel())
                at = n.argmax(keepdims=True) if peaks else np.flatnonzero(n)
                values = [at // wide, at % wide + low, n[at]]
                if peaks:
                    x, y = _offsets(own, "on")
                    line = (x * int(cos[values[0][0]]) + y * int(sin[values[0][0]])) >> (FRACTION_BITS + 1)
                    values.append(np.count_nonzero(line == values[1], keepdims=True))
                of.append(np.full(len(at), k, dtype=np.int32))
                found.append(values)
            step = max(1, len(of)) if peaks else 16  # some maps a batch: a map has thousands of bins
            for first in range(0, len(of), step):
                part = slice(first, first + step)
                mine = keys.take(pa.array(np.concatenate(of[part])))
                yield pa.RecordBatch.from_arrays([mine, *(pa.array(np.concatenate(v), kind) for v, kind in zip(zip(*found[part]), kinds.values()))], names=[key, *kinds])

    more = ", line_dies bigint" if peaks else ""
    each = given.mapInArrow(run, f"`{key}` {given.schema[key].dataType.simpleString()}, angle smallint, rho int, votes int{more}")
    return each.select(key, *(F.col(c).cast("bigint").alias(c) for c in kinds))


def hough_votes(die: DataFrame, key: str = "wafer_id") -> DataFrame:
    """The accumulator: (key, angle, rho, votes) of every bin that has fails."""
    return _accumulated(die, key, peaks=False)


def hough_peaks(die: DataFrame, key: str = "wafer_id") -> DataFrame:
    """(key, angle, rho, votes, line_dies) of the peak: most votes, then the lower angle, then the lower rho."""
    return _accumulated(die, key, peaks=True)


def join_counts(die: DataFrame, key: str = "wafer_id") -> DataFrame:
    """(key, dies, fails, joins, join_pairs, fail_joins), by listing each word of dies under its neighbours' places.

    One aggregate brings a word and its neighbours together, so there is no
    self-join: a word sends itself to the places west, north, east and south.
    """
    sides = (("own", 0, 0), ("from_n", 1, 0), ("from_w", 0, 1), ("from_s", -1, 0), ("from_e", 0, -1))
    places = F.array(*(F.struct(F.lit(d).alias("d"), (F.col("r") + dr).alias("r"), (F.col("w") + dw).alias("w")) for d, dr, dw in sides))
    sent = words(die, key).select(key, "on", "bad", F.explode(places).alias("p")).select(key, "on", "bad", "p.*")
    of = lambda d, what: F.max(F.when(F.col("d") == d, F.col(what)))
    zero = F.lit(0).cast("bigint")
    met = sent.groupBy(key, "r", "w").agg(
        of("own", "on").alias("on"), of("own", "bad").alias("bad"),
        *(F.coalesce(of(f"from_{d}", what), zero).alias(f"{d}_{what}") for d, what in (("n", "on"), ("n", "bad"), ("w", "on"), ("w", "bad"), ("s", "on"), ("e", "on"))),
    ).where("`on` is not null")
    # Within a word the neighbour west is a bit lower, and bit 0 has its own in the word west.
    west = lambda what: F.shiftleft(what, 1).bitwiseAND((1 << WORD) - 1).bitwiseOR(F.shiftright(f"w_{what}", WORD - 1))
    east = F.shiftright("on", 1).bitwiseOR(F.shiftleft(F.col("e_on").bitwiseAND(1), WORD - 1))
    met = met.select(key, "on", "bad", *(c.bitwiseAND(F.col("on")).alias(d) for d, c in (("n", F.col("n_on")), ("w", west("on")), ("s", F.col("s_on")), ("e", east))), F.col("n_bad").bitwiseAND(F.col("bad")).alias("bad_n"), west("bad").bitwiseAND(F.col("bad")).alias("bad_w"))
    bits = lambda *names: sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0]))
    pairs = bits(*(F.col(a).bitwiseAND(F.col(b)) for a, b in ("nw", "ns", "ne", "ws", "we", "se")))
    return met.groupBy(key).agg(F.sum(bits("on")).alias("dies"), F.sum(bits("bad")).alias("fails"), F.sum(bits("n", "w")).alias("joins"), F.sum(pairs).alias("join_pairs"), F.sum(bits("bad_n", "bad_w")).alias("fail_joins"))


def join_counts_of_maps(wafers: DataFrame, keep: tuple[str, ...] = ("wafer_id",)) -> DataFrame:
    """The same in the Arrow pass: narrow, without exploding or shuffling."""
    return map_signatures(wafers, kernels.join_counts, {n: "bigint" for n in ("dies", "fails", "joins", "join_pairs", "fail_joins")}, keep)


def drawn(n: Column, f: Column, count: int) -> Column:
    """The chance that `count` given dies are all among f failing ones of n."""
    p = F.lit(1.0)
    for i in range(count):
        p = F.when(n - i <= 0, F.lit(0.0)).otherwise(p * ((f - i) / (n - i)))
    return F.greatest(p, F.lit(0.0))


def join_z(j: DataFrame) -> DataFrame:
    """join_counts plus expected, variance and z."""
    n, f, jn, k = (F.col(c).cast("double") for c in ("dies", "fails", "joins", "join_pairs"))
    out = j.withColumns({"p2": drawn(n, f, 2), "p3": drawn(n, f, 3), "p4": drawn(n, f, 4)})
    mean = jn * F.col("p2")
    var = jn * F.col("p2") + 2.0 * k * F.col("p3") + (jn * (jn - 1.0) - 2.0 * k) * F.col("p4") - mean * mean
    out = out.withColumns({"expected": mean, "variance": var}).drop("p2", "p3", "p4")
    z = F.when((F.col("fails") >= 2) & (F.col("variance") > 1e-9), (F.col("fail_joins") - F.col("expected")) / F.sqrt("variance"))
    return out.withColumn("z", F.coalesce(z, F.lit(0.0)))


def cluster_moments(labelled: DataFrame, key: str = "wafer_id") -> DataFrame:
    """Moments and boxes from labelled dies (key, label, r, c)."""
    r, c = F.col("r"), F.col("c")
    return labelled.groupBy(key, "label").agg(
        F.count("*").alias("size"), F.sum(r).alias("sum_r"), F.sum(c).alias("sum_c"), F.sum(r * r).alias("sum_rr"), F.sum(c * c).alias("sum_cc"), F.sum(r * c).alias("sum_rc"),
        F.min(r).alias("min_r"), F.max(r).alias("max_r"), F.min(c).alias("min_c"), F.max(c).alias("max_c"),
    )


def cluster_shapes(c: DataFrame) -> DataFrame:
    """Cluster rows plus row, col, major_var, minor_var, elongation and angle_deg."""
    n, die = F.col("size"), F.lit(kernels.DIE)
    c = c.withColumns({"row": F.col("sum_r") / n, "col": F.col("sum_c") / n})
    row, col = F.col("row"), F.col("col")
    c = c.withColumns({"vrr": F.col("sum_rr") / n - row * row + die, "vcc": F.col("sum_cc") / n - col * col + die, "vrc": F.col("sum_rc") / n - row * col})
    vrr, vcc, vrc = F.col("vrr"), F.col("vcc"), F.col("vrc")
    mean, gap = 0.5 * (vrr + vcc), F.sqrt(0.25 * (vcc - vrr) * (vcc - vrr) + vrc * vrc)
    c = c.withColumns({"major_var": mean + gap, "minor_var": F.greatest(mean - gap, die), "turn": 0.5 * F.atan2(-2.0 * vrc, vcc - vrr) * 180.0 / F.pi()})
    turn = F.when(F.col("turn") < 0, F.col("turn") + 180.0).otherwise(F.col("turn"))
    return c.withColumns({"elongation": F.sqrt(F.col("major_var") / F.col("minor_var")), "angle_deg": F.when(turn >= 180.0, 0.0).otherwise(turn)}).drop("vrr", "vcc", "vrc", "turn")
