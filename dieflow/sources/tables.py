"""Fab tables, excursion and alarm files, logits files."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.functions.ranks import with_ranks
from dieflow.patterns import PATTERNS, SPLITS, UNKNOWN

LOGITS_MAGIC = b"WCNNLOGT"


class TableError(ValueError):
    pass


def label_wafers(maps: DataFrame, lots: DataFrame, excursions: DataFrame, wafer_excursion: DataFrame) -> DataFrame:
    """maps plus lot_id, excursion_id and truth: the pattern of the wafer's excursion, none without one.

    A wafer of excursions with different patterns is an error; check_conflicts says so.
    """
    of = wafer_excursion.join(excursions.select("excursion_id", "spatial_pattern"), "excursion_id")
    one = of.groupBy("wafer_id").agg(F.min("excursion_id").alias("excursion_id"), F.min("spatial_pattern").alias("truth"))
    return maps.join(lots, "wafer_id", "left").join(one, "wafer_id", "left").withColumn("truth", F.coalesce("truth", F.lit("none")))


def conflicts(excursions: DataFrame, wafer_excursion: DataFrame) -> DataFrame:
    """Wafers that excursions give different patterns."""
    of = wafer_excursion.join(excursions.select("excursion_id", "spatial_pattern"), "excursion_id")
    return of.groupBy("wafer_id").agg(F.countDistinct("spatial_pattern").alias("patterns")).where("patterns > 1")


def check_conflicts(excursions: DataFrame, wafer_excursion: DataFrame) -> None:
    if row := conflicts(excursions, wafer_excursion).orderBy("wafer_id").first():
        raise TableError(f"wafer {row.wafer_id}: excursions of {row.patterns} patterns")


def bins_of_lists(bin_map: Column) -> tuple[Column, Column, Column]:
    """rows, cols and bins of a list of lists of small integers."""
    flat = F.transform(F.flatten(bin_map), lambda x: F.lpad(F.hex(x.cast("int")), 2, "0"))
    return F.size(bin_map), F.size(F.get(bin_map, 0)), F.unhex(F.array_join(flat, ""))


def import_fab(maps: DataFrame, lots: DataFrame, excursions: DataFrame, wafer_excursion: DataFrame) -> DataFrame:
    """Fab tables as wafers: maps (wafer_id, tested_at, bin_map) with their bins, lots and truths.

    tested_at is a time or microseconds; the split is unsplit.
    """
    rows, cols, bins = bins_of_lists(F.col("bin_map"))
    at = F.unix_micros(F.col("tested_at").cast("timestamp")) if dict(maps.dtypes)["tested_at"].startswith(("timestamp", "date")) else F.col("tested_at").cast("bigint")
    flat = maps.select("wafer_id", at.alias("tested_at_us"), rows.alias("rows"), cols.alias("cols"), bins.alias("bins"))
    labelled = label_wafers(flat, lots, excursions, wafer_excursion)
    return labelled.select("wafer_id", "lot_id", "tested_at_us", "truth", F.lit("unsplit").alias("split"), "rows", "cols", "bins")


def dense_lots(maps: DataFrame, name: str = "lot_name") -> DataFrame:
    """maps plus lot_id, 0 up in the order of lot names.

    Lots are numbered as a table of distinct names, in slices by the six bytes
    after what all names begin with; names that agree in these share a slice.
    """
    names = maps.where(F.col(name).isNotNull()).select(name).distinct()
    ends = names.agg(F.min(name), F.max(name)).first()
    same = len(os.path.commonprefix([(x or "").encode() for x in ends]))
    bytes_ = F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), same + 1, 6)), 12, "0")
    ranked = with_ranks(names.select(name, F.conv(bytes_, 16, 10).cast("bigint").alias("at"), F.lit(1).alias("n")), [], "at", (name,))
    return maps.join(ranked.select(name, F.col("before").alias("lot_id")), name)


def named_splits(maps: DataFrame, split: str = "split") -> DataFrame:
    """maps with the names of split numbers; a number without a name is an error when its row is read."""
    names = F.get(F.array(*map(F.lit, SPLITS)), F.col(split))
    return maps.withColumn(split, F.coalesce(names, F.raise_error(F.format_string("no split %d", F.col(split).cast("int"))).cast("string")))


def first_in_order(wafers: DataFrame, n: int, order: tuple[str, ...] = ("tested_at_us", "wafer_id")) -> DataFrame:
    """The first n rows of all; each task passes on its own first n."""
    return wafers.orderBy(*order).limit(n)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(wafer_id, pred) of a signals file with a header; a name that is no pattern is an error.  The last of equal wafers holds."""
    rows = spark.read.csv(path, header=True).select(F.col("wafer_id").cast("int").alias("wafer_id"), F.col("pred"), F.monotonically_increasing_id().alias("line"))
    named = F.when(F.col("pred").isin(*PATTERNS), F.col("pred")).otherwise(F.raise_error(F.concat(F.lit("no pattern "), F.coalesce("pred", F.lit("")))).cast("string"))
    return rows.select("wafer_id", named.alias("pred"), "line").groupBy("wafer_id").agg(F.max_by("pred", "line").alias("pred"))


def join_predictions(wafers: DataFrame, predictions: DataFrame, strict: bool = True) -> DataFrame:
    """wafers with their predicted pattern; strict makes a wafer without one an error when the row is read."""
    if not strict:
        return wafers.join(predictions, "wafer_id")
    missing = F.raise_error(F.format_string("wafer %d: no prediction", "wafer_id")).cast("string")
    return wafers.join(predictions, "wafer_id", "left").withColumn("pred", F.coalesce("pred", missing))


def first_of_each(wafers: DataFrame, n: int, by: str = "truth", order: str = "pos") -> DataFrame:
    """The first n rows of each class.  Each task keeps its own first n before any meet."""
    return wafers.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def write_excursions(excursions: DataFrame, wafer_excursion: DataFrame, path: str) -> None:
    """Tagged lines: excursions by id, then wafers by id, in one text file."""
    e = excursions.select(F.lit(0).alias("k"), F.col("id").alias("o"), F.concat_ws(",", F.lit("excursion"), "id", "pattern", "start_us", "end_us").alias("value"))
    w = wafer_excursion.select(F.lit(1).alias("k"), F.col("wafer_id").alias("o"), F.concat_ws(",", F.lit("wafer"), "wafer_id", "excursion_id").alias("value"))
    e.unionAll(w).orderBy("k", "o").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_excursions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(excursions, wafer_excursion); a bad line, or no excursion at all, is an error.  The last of equal wafers holds."""
    lines = _lines(spark, path)
    integer = r"[+-]?\d+"
    shape = rf"^(excursion,{integer},({'|'.join(PATTERNS)}),{integer},{integer}|wafer,{integer},{integer})$"
    _no_bad(lines, path, ~F.col("value").rlike(shape))
    f = F.split("value", ",")
    excursions = lines.where(F.get(f, 0) == "excursion").select(F.get(f, 1).cast("int").alias("id"), F.get(f, 2).alias("pattern"), F.get(f, 3).cast("bigint").alias("start_us"), F.get(f, 4).cast("bigint").alias("end_us"))
    if excursions.isEmpty():
        raise TableError(f"{path}: no excursions")
    wafers = lines.where(F.get(f, 0) == "wafer").select(F.get(f, 1).cast("int").alias("wafer_id"), F.get(f, 2).cast("int").alias("excursion_id"), "line")
    return excursions, wafers.groupBy("wafer_id").agg(F.max_by("excursion_id", "line").alias("excursion_id"))


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    """(excursion_id, pattern, pattern_wafers, first_sorted_h, alarm_h) after a header line."""
    lines = _lines(spark, path)
    first = lines.agg(F.min("line")).first()[0]
    rows = lines.where(F.col("line") > F.lit(first if first is not None else 0))
    number = r"[+-]?\d+(\.\d+)?"
    _no_bad(rows, path, ~F.col("value").rlike(rf"^\d+,({'|'.join(PATTERNS)}),\d+,{number},{number}$"))
    f = F.split("value", ",")
    return rows.select(F.get(f, 0).cast("int").alias("excursion_id"), F.get(f, 1).alias("pattern"), F.get(f, 2).cast("int").alias("pattern_wafers"), F.get(f, 3).cast("double").alias("first_sorted_h"), F.get(f, 4).cast("double").alias("alarm_h"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line) without comments and empty lines; whole small files are read at once, for their line numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return whole.select(F.regexp_replace("value", "\r$", "").alias("value"), (F.col("line") + 1).alias("line")).where("value <> '' and value not like '#%'")


def _no_bad(lines: DataFrame, path: str, bad: Column) -> None:
    if row := lines.where(bad).orderBy("line").first():
        raise TableError(f"{path}:{row.line}: bad line '{row.value}'")


def parse_logits(data: bytes) -> list[tuple[int, list[float]]]:
    """(wafer_id, nine logits) rows of a logits file."""
    if data[:8] != LOGITS_MAGIC or len(data) < 12:
        raise TableError("not a logits file")
    (count,) = struct.unpack_from("<I", data, 8)
    rows = np.dtype([("id", "<i4"), ("x", "<f4", len(PATTERNS))])
    if len(data) != 12 + count * rows.itemsize:
        raise TableError("record count doesn't match the file size")
    return [(int(r["id"]), r["x"].tolist()) for r in np.frombuffer(data, dtype=rows, offset=12)]


def serialize_logits(rows: list[tuple[int, list[float]]]) -> bytes:
    kind = np.dtype([("id", "<i4"), ("x", "<f4", len(PATTERNS))])
    return LOGITS_MAGIC + struct.pack("<I", len(rows)) + np.array([(i, tuple(x)) for i, x in rows], dtype=kind).tobytes()


def read_logits(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = parse_logits(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["wafer_id", "logits"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "wafer_id int, logits array<float>")


def join_logits(wafers: DataFrame, logits: DataFrame, strict: bool = True) -> DataFrame:
    """wafers with their logits; strict makes a wafer without any an error when the row is read."""
    both = wafers.join(logits, "wafer_id", "left")
    if not strict:
        return both
    missing = F.raise_error(F.format_string("wafer %d: no logits", "wafer_id")).cast("array<float>")
    return both.withColumn("logits", F.coalesce("logits", missing))


def truth_by_split(wafers: DataFrame) -> DataFrame:
    """(truth, train, val, test, unsplit): counts."""
    return wafers.groupBy("truth").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test", "unsplit")))


def commonest_shapes(wafers: DataFrame, n: int = 5) -> DataFrame:
    """(rows, cols, n) of the n commonest shapes; ties go to the smaller shape."""
    return wafers.groupBy("rows", "cols").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rows", "cols").limit(n)


def known(wafers: DataFrame) -> DataFrame:
    return wafers.where(F.col("truth") != UNKNOWN)
