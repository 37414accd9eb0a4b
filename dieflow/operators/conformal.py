"""Conformal calibration, and how two ways to compute a model differ.

A class's threshold is the finite-sample quantile of its calibration scores
1 - p(truth): the ceil((n + 1) (1 - miss))-th smallest of n, or 1 where there
are too few.  Scores are counted and ranked by slices, so no task sorts a class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.functions.ranks import holds_place, with_ranks
from dieflow.operators import cnn, metrics
from dieflow.patterns import PATTERNS


def class_thresholds(scored: DataFrame, miss: float) -> DataFrame:
    """(truth_code, n, threshold) of each class that scored (p, truth_code) has; other codes are left out."""
    known = scored.where(F.col("truth_code").between(0, len(PATTERNS) - 1)).select(F.col("truth_code").cast("int").alias("truth_code"), (1.0 - F.get("p", F.col("truth_code"))).alias("s"))
    ranked = with_ranks(known.groupBy("truth_code", "s").agg(F.count("*").alias("n")), ["truth_code"], "s")
    place = F.ceil((F.col("total") + 1) * F.lit(1.0 - miss)) - 1
    found = ranked.groupBy("truth_code").agg(F.max("total").alias("n"), F.min(F.when(holds_place(place), F.col("s"))).alias("threshold"))
    return found.select("truth_code", "n", F.coalesce("threshold", F.lit(1.0)).alias("threshold"))


def accept_confidence(scored: DataFrame, error: float) -> float:
    """The least confidence, of a thousand steps, from which on at most a share `error` of the predictions are wrong; 1 if there is none.

    One aggregate: predictions and mistakes by step, a thousand rows.
    """
    known = scored.where(F.col("truth_code").between(0, len(PATTERNS) - 1))
    step = F.least(F.floor(F.array_max("p") * 1000), F.lit(1000)).cast("int")
    rows = sorted(tuple(r) for r in known.groupBy(step.alias("step")).agg(F.count("*"), F.count_if(metrics.argmax(F.col("p")) != F.col("truth_code"))).collect())
    best, n, wrong = 1.0, 0, 0
    for at, some, bad in reversed(rows):
        n, wrong = n + some, wrong + bad
        if wrong <= error * n:
            best = at / 1000
    return best


def calibrate(scored: DataFrame, model_sha256: str, error: float = 0.01) -> cnn.Conformal:
    """Thresholds for misses of 10 and 5 %, the confidence to accept, and what the calibration rows themselves say of them; scored is read five times, so persist it."""

    def thresholds(miss: float) -> tuple[float, ...]:
        found = {r.truth_code: r.threshold for r in class_thresholds(scored, miss).collect()}  # nine rows
        return tuple(found.get(k, 1.0) for k in range(len(PATTERNS)))

    ten, five, accept = thresholds(0.1), thresholds(0.05), accept_confidence(scored, error)
    reported = []
    for name, q in (("0.1", ten), ("0.05", five)):
        m = metrics.conformal_metrics(scored.withColumn("set", metrics.prediction_set(F.col("p"), list(q))), accept).first()
        reported.append((f"reported_coverage {name}", (m.coverage or 0.0, m.worst_class_coverage or 0.0)))
    reported.append(("reported_accept", (m.accept_rate or 0.0, m.error_among_accepted or 0.0)))
    return cnn.Conformal(model_sha256, ten, five, accept, tuple(reported))


def to_text(c: cnn.Conformal) -> str:
    """The text that Conformal.parse reads."""
    numbers = lambda v: " ".join(repr(float(x)) for x in v)
    lines = ["# conformal calibration: thresholds of 1 - p by class", f"model_sha256 {c.model_sha256}", f"thresholds 0.1 {numbers(c.thresholds_10)}", f"thresholds 0.05 {numbers(c.thresholds_05)}", f"accept_confidence {float(c.accept_confidence)!r}"]
    return "\n".join([*lines, *(f"{name} {numbers(v)}" for name, v in c.reported), ""])


def probabilities(wafers: DataFrame, model: cnn.Model, precision: str = "fp32", scales: list[float] | None = None) -> DataFrame:
    """(wafer_id, truth_code, p) of maps with a truth."""
    truth = F.array_position(F.array(*(F.lit(x) for x in PATTERNS)), F.col("truth")) - 1
    scored = cnn.logits(wafers, model, ("wafer_id", "truth"), precision, scales)
    return scored.select("wafer_id", truth.alias("truth_code"), metrics.softmax(F.col("logits")).alias("p"))


def verify(wafers: DataFrame, model: cnn.Model, reference: DataFrame, precision: str = "fp32", scales: list[float] | None = None) -> DataFrame:
    """(n, missing, same_class, max_diff, mean_diff) in one row: the model's logits beside given ones (wafer_id, logits); missing are those without a map."""
    mine = cnn.logits(wafers, model, ("wafer_id",), precision, scales).select("wafer_id", F.col("logits").alias("mine"))
    both = reference.select("wafer_id", "logits").join(mine, "wafer_id", "left")
    gaps = F.zip_with("logits", "mine", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    each = both.select(F.col("mine").isNull().alias("none"), (metrics.argmax(F.col("logits")) == metrics.argmax(F.col("mine"))).alias("same"), F.array_max(gaps).alias("most"), (F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / len(PATTERNS)).alias("mean"))
    return each.agg(F.count("*").alias("n"), F.count_if("none").alias("missing"), F.count_if("same").alias("same_class"), F.max("most").alias("max_diff"), F.avg("mean").alias("mean_diff"))


def layer_differences(wafers: DataFrame, model: cnn.Model, precision: str, scales: list[float] | None = None) -> DataFrame:
    """(layer, largest, max_diff) over all maps: each convolution's largest activation in fp32, and how far that of another precision is from it at most."""

    def both(m: cnn.Model, x: np.ndarray) -> np.ndarray:
        return np.concatenate([*cnn.activations_compared(m, x, precision, scales)], axis=1)

    seen = cnn._scored(wafers, model, both, "x", ("wafer_id",), 16)
    layers = len(model.convs)
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("layer"), F.get("x", F.lit(k)).alias("largest"), F.get("x", F.lit(layers + k)).alias("diff")) for k in range(layers))))
    return seen.select(rows.alias("r")).groupBy("r.layer").agg(F.max("r.largest").alias("largest"), F.max("r.diff").alias("max_diff"))
