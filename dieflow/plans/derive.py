"""Inputs derived from the test tables, as DataFrames and as DuckDB SQL of the same meaning.

Parts become wafers: an id gives a lot, a shape, a painted pattern and noise.
Events become verdicts: a user is a lot, a type a pattern.  Embeddings become
logits, labels a pair of classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.functions.geometry import tables
from dieflow.patterns import PATTERNS, SPLITS, WAFERS

SHAPES = ((24, 24), (25, 27), (30, 30))
BASE_US, STEP_US = 1_600_000_000_000_000, 60_000_000
LOT = 25
#: Painted pattern by the id's last digit.
KINDS = ("none", "center", "donut", "edge_loc", "edge_ring", "loc", "near_full", "random", "scratch", "none")
VERDICT_OF = {"error": "scratch", "signup": "center", "view": "unknown"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, a_core: int = 1) -> DataFrame:
    """A scan dealt out anew if it has fewer partitions than the session has cores, or some a core."""
    parts = scan.sparkSession.sparkContext.defaultParallelism * a_core
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan


def hash_of(wafer: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (wafer[:, None] * 1000003 + r * 4099 + c * 131) % 2147483647 * 2654435761 % 4294967296
    return ((h >> 7) * 40503 >> 9) % 1000


def paint(ids: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bins of equal-shaped wafers, flattened."""
    t = tables(rows, cols)
    r, c = t["r"], t["c"]
    x, y = 2 * c - (cols - 1), (rows - 1) - 2 * r
    num, den = x * x * rows * rows + y * y * cols * cols, rows * rows * cols * cols
    h = hash_of(ids, r, c)
    zero = np.zeros(rows * cols, dtype=bool)
    where = [zero, num * 8 <= den, (t["ring"] >= 3) & (t["ring"] <= 5), (t["zone"] == 4) & (t["sector"] >= 1) & (t["sector"] <= 2), t["zone"] == 4, (r - 6) ** 2 + (c - 8) ** 2 <= 9, ~zero, ~zero, r == c, zero]
    level = np.array([30, 600, 550, 650, 550, 800, 850, 400, 850, 30])
    kind = ids % 10
    limit = np.where(np.stack(where)[kind], level[kind][:, None], 30)
    return np.where(num > den, 0, np.where(h < limit, 2 + h % 4, 1)).astype(np.uint8)


def wafers(spark: SparkSession, sf_dir: str, a_core: int = 1) -> DataFrame:
    """One wafer a part, in the schema of wafer files; in at least some partitions a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, (rows, cols) in enumerate(SHAPES):
                ids = every[every % len(SHAPES) == k]
                for at in range(0, len(ids), 1024):
                    part = ids[at : at + 1024]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part.astype(np.int32)),
                            pa.array((part // LOT).astype(np.int32)),
                            pa.array(BASE_US + part * STEP_US),
                            pa.array([KINDS[i % 10] for i in part]),
                            pa.array([SPLITS[i % 4] for i in part]),
                            pa.array(np.full(n, rows, dtype=np.int32)),
                            pa.array(np.full(n, cols, dtype=np.int32)),
                            pa.array([b.tobytes() for b in paint(part, rows, cols)], pa.binary()),
                        ],
                        names=["wafer_id", "lot_id", "tested_at_us", "truth", "split", "rows", "cols", "bins"],
                    )

    # Ids are a few bytes and become maps of hundreds: they are spread before, if the scan gives few tasks.
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), a_core)
    return parts.mapInArrow(run, WAFERS)


def _cases(of: str, names: tuple[str, ...], every: int) -> str:
    return f"CASE {of} % {every} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


WAFERS_SQL = f"""w AS (SELECT p_partkey AS wafer_id, p_partkey // {LOT} AS lot_id, {BASE_US} + p_partkey * {STEP_US} AS tested_at_us,
  {_cases("p_partkey", KINDS, 10)} AS truth, {_cases("p_partkey", SPLITS, 4)} AS split,
  (CASE p_partkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 25 ELSE 30 END)::BIGINT AS "rows", (CASE p_partkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 27 ELSE 30 END)::BIGINT AS cols FROM part)"""

DIE_SQL = (
    WAFERS_SQL
    + """,
d0 AS (SELECT w.*, i // cols AS r, i % cols AS c FROM (SELECT w.*, unnest(range("rows" * cols)) AS i FROM w) AS w),
d1 AS (SELECT *, 2 * c - (cols - 1) AS x, ("rows" - 1) - 2 * r AS y FROM d0),
d2 AS (SELECT *, x * x * "rows" * "rows" + y * y * cols * cols AS num, "rows" * "rows" * cols * cols AS den, x * "rows" AS u, y * cols AS v,
  ((((((wafer_id * 1000003 + r * 4099 + c * 131) % 2147483647) * 2654435761) % 4294967296) >> 7) * 40503 >> 9) % 1000 AS h FROM d1),
d3 AS (SELECT *, least(4, 5 * num // den) AS zone, """
    + " + ".join(f"({k * k} * den <= 100 * num)::BIGINT" for k in range(1, 10))
    + """ AS ring,
  CASE WHEN u = 0 AND v = 0 THEN 0 WHEN u > 0 AND v >= 0 THEN (v >= u)::BIGINT WHEN u <= 0 AND v > 0 THEN 2 + (-u >= v)::BIGINT
       WHEN u < 0 AND v <= 0 THEN 4 + (-v >= -u)::BIGINT ELSE 6 + (u >= -v)::BIGINT END AS sector FROM d2),
d4 AS (SELECT *, CASE wafer_id % 10 WHEN 1 THEN CASE WHEN num * 8 <= den THEN 600 ELSE 30 END WHEN 2 THEN CASE WHEN ring BETWEEN 3 AND 5 THEN 550 ELSE 30 END
  WHEN 3 THEN CASE WHEN zone = 4 AND sector BETWEEN 1 AND 2 THEN 650 ELSE 30 END WHEN 4 THEN CASE WHEN zone = 4 THEN 550 ELSE 30 END
  WHEN 5 THEN CASE WHEN (r - 6) * (r - 6) + (c - 8) * (c - 8) <= 9 THEN 800 ELSE 30 END WHEN 6 THEN 850 WHEN 7 THEN 400
  WHEN 8 THEN CASE WHEN r = c THEN 850 ELSE 30 END ELSE 30 END AS lim FROM d3),
die AS (SELECT *, CASE WHEN num > den THEN 0 WHEN h < lim THEN 2 + h % 4 ELSE 1 END AS bin FROM d4)"""
)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_of(table(spark, sf_dir, "events"))


def verdicts_of(e: DataFrame) -> DataFrame:
    """(pos, lot, wafer_id, pattern, at_us) of events; types without a pattern of their own are none."""
    pattern = F.lit("none")
    for t, p in VERDICT_OF.items():
        pattern = F.when(F.col("event_type") == t, p).otherwise(pattern)
    at = micros("ts", e)
    return e.select(F.col("event_id").alias("pos"), F.format_string("LOT-%06d", "user_id").alias("lot"), F.col("event_id").alias("wafer_id"), pattern.alias("pattern"), at.alias("at_us"))


VERDICTS_SQL = f"""v AS (SELECT event_id AS pos, printf('LOT-%06d', user_id) AS lot, event_id AS wafer_id,
  CASE event_type {" ".join(f"WHEN '{t}' THEN '{p}'" for t, p in VERDICT_OF.items())} ELSE 'none' END AS pattern, epoch_us(ts) AS at_us FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, logits, truth_code) of embeddings: the first nine numbers; labels past the classes are unknown."""
    e = table(spark, sf_dir, "embeddings")
    known = F.col("label").between(0, len(PATTERNS) - 1)
    return e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, len(PATTERNS)).alias("logits"), F.when(known, F.col("label")).otherwise(255).alias("truth_code"))


SCORED_SQL = """s AS (SELECT vec_id AS id, list_transform(embedding[1:9], lambda x: x::DOUBLE) AS l, CASE WHEN label BETWEEN 0 AND 8 THEN label ELSE 255 END AS truth_code FROM embeddings),
p AS (SELECT *, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p FROM s)"""


def micros(name: str, of: DataFrame) -> Column:
    """Microseconds since 1970 of a time; one without a zone is in UTC, whatever the session's zone."""
    ts = F.col(name)
    if dict(of.dtypes)[name] == "timestamp_ntz":
        ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts)
    return F.unix_micros(ts.cast("timestamp"))
