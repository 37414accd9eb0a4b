import numpy as np
import pytest

from dieflow.operators import fit, metrics
from dieflow.operators.rules import Classifier, Condition, Rule, RuleError
from dieflow.patterns import SIGNALS


def test_text_round_trip():
    for c in (Classifier.defaults(), Classifier.fitted()):
        assert Classifier.parse(c.to_text()) == c
    assert "random z <= 5\n" in Classifier.defaults().to_text()


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda t: t + "near_full density >= 0.7\n", "has a threshold already"),
        (lambda t: t + "near_full z >= 1\n", "no condition near_full z >="),
        (lambda t: t + "near_full density\n", "a condition has a rule, a signal"),
        (lambda t: t + " \n", "a condition has"),
        (lambda t: t.replace("0.35", "inf"), "'inf' isn't a finite number"),
        (lambda t: t.replace("loc z >= 4\n", "", 1).replace("edge_ring z >= 4\n", ""), "has no threshold"),
    ],
)
def test_bad_texts(change, message):
    with pytest.raises(RuleError, match="(?s).*" + message.replace("|", r"\|")):
        Classifier.parse(change(Classifier.defaults().to_text()))


def test_trailing_fields_are_ignored():
    assert Classifier.parse(Classifier.defaults().to_text().replace("density >= 0.7", "density >= 0.7 extra")) == Classifier.defaults()


def test_classify_and_explain(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(x) for x in rng.gamma(1.0, 2.0, len(SIGNALS))) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"`{s}` double" for s in SIGNALS))
    c = Classifier.fitted()
    for r in c.explain(c.classify(df)).collect():
        assert (r.pred, r.rule) == c.classify_row(r.asDict()) and r.why == c.explain_row(r.asDict())
    zero = dict.fromkeys(SIGNALS, 0.0)
    assert c.explain_row(zero) == "no rule held -> none"
    assert c.explain_row(zero | {"density": 0.81234}) == "near_full -> near_full: density 0.812 >= 0.7"


def test_fit_recovers_a_separator(spark):
    rows = [tuple(["near_full" if i / 200 >= 0.5 else "none", *[i / 200 if s == "density" else 0.0 for s in SIGNALS]]) for i in range(200)]
    df = spark.createDataFrame(rows, "truth string, " + ", ".join(f"`{s}` double" for s in SIGNALS))
    start = Classifier((Rule("near_full", "near_full", (Condition("density", ">=", 0.95),)),))
    fitted, log = fit.fit(df, start, fit.FitOptions(candidates=200))
    assert fit.score(df, fitted, fit.FitOptions()) == 1.0 and len(log) >= 2
    for place, got in zip([0.1, 0.5, 0.9], fit.scores(df, start, 0, 0, [0.1, 0.5, 0.9], fit.FitOptions())):
        assert got == pytest.approx(fit.score(df, start.with_thresholds([place]), fit.FitOptions()))
    with pytest.raises(ValueError):
        fit.FitOptions(candidates=1)
    t, pattern, f1 = fit.density_baseline(df)
    assert pattern == "near_full" and f1 == 1.0 and 0.49 < t <= 0.5


def test_metrics_by_hand(spark):
    truth = ["none", "none", "none", "center", "center", "unknown"]
    pred = ["none", "none", "center", "center", "none", "scratch"]
    df = spark.createDataFrame(list(zip(truth, pred)), "truth string, pred string")
    m = metrics.summary(metrics.confusion(df)).first()
    assert m.n == 5 and m.accuracy == pytest.approx(3 / 5) and m.macro_f1 == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert metrics.summary(metrics.confusion(df.limit(0))).first().macro_f1 == 0


def test_histogram(spark):
    a, b = spark.range(1, 51).withColumnRenamed("id", "v"), spark.range(51, 101).withColumnRenamed("id", "v")
    h = metrics.merge(metrics.histogram(a, "v"), metrics.histogram(b, "v"))
    got = {r.p: r.value for r in metrics.percentiles(h, (0.5, 0.99, 1.0)).collect()}
    assert got == {0.5: 50, 0.99: 99, 1.0: 100}
    one = metrics.histogram(spark.createDataFrame([(1_000_001,), (-5,)], "v bigint"), "v")
    assert {r.p: r.value for r in metrics.percentiles(one, (0.9,)).collect()} == {0.9: 1_000_001}
    values = spark.createDataFrame([(int(x),) for x in np.random.default_rng(0).lognormal(12, 3, 2000)], "v bigint")
    from pyspark.sql import functions as F

    edges = values.select("v", metrics.bucket(F.col("v")).alias("b")).withColumn("u", metrics.bucket_upper(F.col("b"))).withColumn("again", metrics.bucket(F.col("u")))
    assert edges.where("u < v or again <> b or (v > 255 and u > v * (1 + 1.0 / 128))").count() == 0
