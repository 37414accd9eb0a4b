"""Fitting rule thresholds by coordinate ascent on weighted macro-F1.

The rows stay in Spark.  Moving one threshold changes a row's prediction at
most once along the candidates, between what the rule says and what follows
without it; so one aggregate over (truth, place among the candidates, both
predictions) scores all candidates of a condition, and its result is a few
thousand rows however many maps there are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.functions.ranks import holds_place, with_ranks
from dieflow.operators.rules import Classifier
from dieflow.patterns import PATTERNS, SIGNALS, UNKNOWN


@dataclass(frozen=True)
class FitOptions:
    candidates: int = 200
    sweeps: int = 8
    none_weight: float = 1.0

    def __post_init__(self) -> None:
        if self.candidates < 2 or self.sweeps < 0 or not self.none_weight > 0:
            raise ValueError("candidates must be 2 or more, sweeps 0 or more, none_weight positive")


def candidates(signals: DataFrame, count: int, names: tuple[str, ...] = SIGNALS) -> dict[str, list[float]]:
    """For each signal the values at places q (n - 1) div (count - 1) of its sorted order, each once.

    Equal values are counted first and ranked by slices, so no task orders a signal's values.
    """
    n = signals.count()
    if not n:
        return {s: [] for s in names}
    long = signals.select(F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in names))).alias("x")).select("x.*")
    run = with_ranks(long.groupBy("signal", "v").agg(F.count("*").alias("n")), ["signal"], "v")
    wanted = sorted({q * (n - 1) // (count - 1) for q in range(count)})
    places = F.array(*(F.lit(w).cast("bigint") for w in wanted))
    hit = run.where(F.exists(places, holds_place))
    out: dict[str, list[float]] = {s: [] for s in names}
    for r in hit.select("signal", "v").collect():  # at most `count` a signal
        out[r.signal].append(r.v)
    return {s: sorted(v) for s, v in out.items()}


def weighted_macro_f1(counts: dict[tuple[str, str], float]) -> float:
    support, predicted, hits = defaultdict(float), defaultdict(float), defaultdict(float)
    for (truth, pred), w in counts.items():
        support[truth] += w
        predicted[pred] += w
        if truth == pred:
            hits[truth] += w
    scores = []
    for p in PATTERNS:
        if support[p] > 0:
            precision = hits[p] / predicted[p] if predicted[p] else 0.0
            recall = hits[p] / support[p]
            scores.append(2 * precision * recall / (precision + recall) if precision + recall else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def weight(options: FitOptions, truth: str = "truth") -> Column:
    return F.when(F.col(truth) == "none", F.lit(float(options.none_weight))).otherwise(F.lit(1.0))


def score(rows: DataFrame, classifier: Classifier, options: FitOptions) -> float:
    counts = rows.select("truth", classifier.pattern().alias("pred"), weight(options).alias("w")).groupBy("truth", "pred").agg(F.sum("w").alias("w"))
    return weighted_macro_f1({(r.truth, r.pred): r.w for r in counts.collect()})


def scores(rows: DataFrame, classifier: Classifier, rule: int, place: int, values: list[float], options: FitOptions) -> list[float]:
    """The score for each candidate threshold of one condition."""
    r = classifier.rules[rule]
    cond = r.conditions[place]
    rest = F.lit(True)
    for k, c in enumerate(r.conditions):
        if k != place:
            rest = rest & c.holds()
    earlier, later = Classifier(classifier.rules[:rule]), Classifier(classifier.rules[rule + 1 :])
    fixed = earlier.rule_index() >= 0
    without = F.when(fixed, earlier.pattern()).otherwise(later.pattern())
    with_rule = F.when(fixed | ~rest, without).otherwise(F.lit(r.pattern))
    cut = F.array(*(F.lit(float(v)) for v in values))
    s = F.col(cond.signal)
    # How many candidates let the row through: the lowest ones for >=, the highest for <=.
    passed = F.size(F.filter(cut, lambda v: v <= s if cond.op == ">=" else v >= s))
    table = rows.select("truth", passed.alias("passed"), with_rule.alias("yes"), without.alias("no"), weight(options).alias("w")).groupBy("truth", "passed", "yes", "no").agg(F.sum("w").alias("w")).collect()
    out = []
    for i in range(len(values)):
        counts: dict[tuple[str, str], float] = defaultdict(float)
        for t in table:
            through = i < t.passed if cond.op == ">=" else i >= len(values) - t.passed
            counts[t.truth, t.yes if through else t.no] += t.w
        out.append(weighted_macro_f1(counts))
    return out


def fit(rows: DataFrame, start: Classifier | None = None, options: FitOptions | None = None) -> tuple[Classifier, list[str]]:
    """The fitted classifier and a log; rows have truth and the 13 signals, and unknown truths are left out.

    Every condition in turn takes the first candidate that beats the best
    score so far by over 1e-12, and the next that beats that, until a whole
    sweep changes nothing.
    """
    options, now = options or FitOptions(), start or Classifier.defaults()
    rows = rows.where(F.col("truth") != UNKNOWN).select("truth", *SIGNALS)
    given = candidates(rows, options.candidates)
    best = score(rows, now, options)
    log = [f"start: weighted macro-F1 {best:.4f}"]
    for sweep in range(1, options.sweeps + 1):
        improved, at = False, 0
        for i, r in enumerate(now.rules):
            for k, c in enumerate(r.conditions):
                values = given[c.signal]
                chosen = c.threshold
                for v, s in zip(values, scores(rows, now, i, k, values, options) if values else []):
                    if s > best + 1e-12:
                        best, chosen, improved = s, v, True
                thresholds = now.thresholds()
                thresholds[at] = chosen
                now = now.with_thresholds(thresholds)
                at += 1
        log.append(f"sweep {sweep}: weighted macro-F1 {best:.4f}")
        if not improved:
            break
    return now, log


def percentiles(rows: DataFrame, column: str, count: int) -> list[float]:
    """`count` exact percentiles at even distances from the least to the greatest value, between two values in proportion.

    Equal values are counted first and ranked by slices, so no buffer holds the column.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    n = counted.agg(F.sum("n")).first()[0] or 0
    if not n:
        return []
    at = [(n - 1) * (q / (count - 1)) for q in range(count)]
    wanted = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    places = F.array(*(F.lit(w).cast("bigint") for w in wanted))
    hit = with_ranks(counted, [], "v").where(F.exists(places, holds_place)).select("before", "n", "v").collect()  # at most two a percentile
    value = {w: r.v for r in hit for w in wanted if r.before <= w < r.before + r.n}
    return [value[math.floor(x)] if x == int(x) else (math.ceil(x) - x) * value[math.floor(x)] + (x - math.floor(x)) * value[math.ceil(x)] for x in at]


def density_baseline(rows: DataFrame, thresholds: int = 201) -> tuple[float, str, float]:
    """The trivial classifier: density at or over a threshold means the commonest defect.  (threshold, pattern, macro-F1)."""
    rows = rows.where(F.col("truth") != UNKNOWN)
    common = rows.where("truth <> 'none'").groupBy("truth").count().orderBy(F.desc("count"), "truth").first()
    if common is None:
        return 0.0, "none", 0.0
    cuts = percentiles(rows, "density", thresholds)
    passed = F.size(F.filter(F.array(*(F.lit(float(v)) for v in cuts)), lambda v: v <= F.col("density")))
    table = rows.groupBy("truth", passed.alias("passed")).count().collect()
    best = (0.0, common.truth, -1.0)
    for i, v in enumerate(cuts):
        counts: dict[tuple[str, str], float] = defaultdict(float)
        for t in table:
            counts[t.truth, common.truth if i < t.passed else "none"] += t["count"]
        if (s := weighted_macro_f1(counts)) > best[2]:
            best = (float(v), common.truth, s)
    return best
