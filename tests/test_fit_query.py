"""The registered fit against brute force."""

import numpy as np

from dieflow.operators import fit
from dieflow.operators.rules import Classifier
from dieflow.patterns import SIGNALS, UNKNOWN
from dieflow.plans import queries as Q

SF = "/root/testdata/sf0.001"


def fitted_by_hand(rows, count=200, sweeps=8):
    truth = np.array([r["truth"] for r in rows])
    values = {s: np.array([r[s] for r in rows], dtype=float) for s in SIGNALS}
    given = {s: sorted({np.sort(v)[q * (len(v) - 1) // (count - 1)] for q in range(count)}) for s, v in values.items()}
    rules = Classifier.defaults().rules
    cuts = Classifier.defaults().thresholds()

    def score():
        pred, at = np.full(len(rows), "none", dtype=object), 0
        free = np.ones(len(rows), dtype=bool)
        for r in rules:
            held = free.copy()
            for c in r.conditions:
                held &= values[c.signal] >= cuts[at] if c.op == ">=" else values[c.signal] <= cuts[at]
                at += 1
            pred[held] = r.pattern
            free &= ~held
        f1 = [2 * ((truth == p) & (pred == p)).sum() / ((truth == p).sum() + (pred == p).sum()) for p in sorted(set(truth))]
        return sum(f1) / len(f1)

    best = score()
    for _ in range(sweeps):
        before, at = best, 0
        for r in rules:
            for c in r.conditions:
                chosen = cuts[at]
                for v in given[c.signal]:
                    cuts[at] = v
                    if (s := score()) > best + 1e-12:
                        best, chosen = s, v
                cuts[at] = chosen
                at += 1
        if best == before:
            break
    return cuts


def test_query_fits_until_nothing_improves(spark):
    rows = [r.asDict() for r in Q._signals(spark, SF).where(f"split = 'train' and truth <> '{UNKNOWN}'").select("truth", *SIGNALS).collect()]
    got = Q.QUERIES["fit_thresholds"](spark, SF).collect()
    assert np.allclose([r.threshold for r in got], fitted_by_hand(rows), rtol=0, atol=1e-12)
    assert (fit.FitOptions().candidates, fit.FitOptions().sweeps) == (200, 8)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 57, 400):
        v = rng.choice(rng.random(30), n) if n > 50 else rng.random(n)
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        assert np.allclose(fit.percentiles(df, "v", 21), np.percentile(v, np.linspace(0, 100, 21)), rtol=0, atol=1e-12)
    assert fit.percentiles(df.limit(0), "v", 5) == []
