"""Commands over map files.

    python -m dieflow maps FILE                         counts by truth and split, commonest shapes, medians
    python -m dieflow fit FILE RULES [--none-weight W]  fit thresholds on the train split and write them
    python -m dieflow eval FILE RULES [--split S]       evaluation report; --signals DIR writes the signals table
    python -m dieflow explain FILE RULES WAFER          why a wafer got its pattern
    python -m dieflow cnn FILE MODEL [--precision P]    evaluation of a CNN
    python -m dieflow verify FILE MODEL LOGITS          the model's logits beside those of a file; ends with 1 if a class differs
    python -m dieflow layers FILE MODEL                 how far a precision is from fp32, layer by layer
    python -m dieflow calibrate FILE MODEL OUT          int8 scales of the val split
    python -m dieflow conformal FILE MODEL TEXT         coverage of a calibration; --write calibrates on the split and writes it
    python -m dieflow closedloop FILE EXCURSIONS [--detector truth|rules] [--rules RULES] [--alarms CSV] ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.operators import cnn, conformal, fit, metrics, replay, signatures
from dieflow.operators.hold import HoldConfig
from dieflow.operators.rules import Classifier, signals_csv
from dieflow.patterns import SPLITS, lot_name, pattern_name
from dieflow.session import session, ship
from dieflow.sources import tables
from dieflow.sources.wmap import read_wmap

KEEP = ("wafer_id", "lot_id", "truth", "split")


def show(title: str, df: DataFrame) -> None:
    print(title)
    df.show(100, truncate=False)


def report(classified: DataFrame) -> None:
    counts = metrics.confusion(classified).persist()
    show("evaluation", metrics.summary(counts))
    show("by class", metrics.per_class(counts))
    counts.unpersist()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="dieflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in ("maps", "fit", "eval", "explain", "cnn", "verify", "layers", "calibrate", "conformal", "closedloop")}
    for c in commands.values():
        c.add_argument("file")
        c.add_argument("--master", default=None)
    for name in ("fit", "eval", "explain"):
        commands[name].add_argument("rules")
    commands["fit"].add_argument("--none-weight", type=float, default=1.0)
    commands["fit"].add_argument("--candidates", type=int, default=200)
    commands["eval"].add_argument("--split", choices=(*SPLITS, "all"), default="test")
    commands["eval"].add_argument("--signals")
    commands["explain"].add_argument("wafer", type=int)
    for name in ("cnn", "verify", "layers", "calibrate", "conformal"):
        commands[name].add_argument("model")
        commands[name].add_argument("--precision", choices=("fp32", "fp16", "int8"), default="fp16" if name == "layers" else "fp32")
    for name, more in (("verify", "logits"), ("calibrate", "out"), ("conformal", "text")):
        commands[name].add_argument(more)
    commands["conformal"].add_argument("--split", choices=(*SPLITS, "all"), default="val")
    commands["conformal"].add_argument("--write", action="store_true")
    loop = commands["closedloop"]
    loop.add_argument("excursions")
    loop.add_argument("--detector", choices=("truth", "rules"), default="rules")
    loop.add_argument("--rules")
    loop.add_argument("--alarms")
    for name, kind, default in (("k", int, 3), ("window", int, 5), ("lots", int, 64), ("tool-k", int, 0), ("tool-window-h", float, 24.0), ("latency-ms", float, 5.0)):
        loop.add_argument(f"--{name}", type=kind, default=default)
    loop.add_argument("--sweep", action="store_true")
    a = parser.parse_args(argv)

    spark = ship(session(a.master))
    wafers = read_wmap(spark, a.file)
    if a.command == "maps":
        show("wafers by truth and split", tables.truth_by_split(wafers).orderBy("truth"))
        show("commonest shapes", tables.commonest_shapes(wafers))
        sizes = signatures.features(wafers, ("truth",)).withColumn("density", signatures.ratio(F.col("fails"), F.col("dies")))
        for c in ("dies", "fails", "density"):
            show(f"median {c} by truth", metrics.medians(sizes, "truth", c).select("truth", "median_upper").orderBy("truth"))
    elif a.command == "fit":
        rows = signatures.signals(wafers.where("split = 'train'"), KEEP).persist()
        fitted, log = fit.fit(rows, options=fit.FitOptions(candidates=a.candidates, none_weight=a.none_weight))
        print("\n".join(log))
        with open(a.rules, "w", encoding="utf-8") as f:
            f.write(fitted.to_text())
    elif a.command == "eval":
        given = wafers if a.split == "all" else wafers.where(F.col("split") == a.split)
        classified = Classifier.load(a.rules).classify(signatures.signals(given, KEEP)).persist()
        report(classified)
        show("rules fired", metrics.rules_fired(classified).orderBy("rule"))
        if a.signals:
            signals_csv(classified).write.mode("overwrite").csv(a.signals, header=True)
    elif a.command == "explain":
        c = Classifier.load(a.rules)
        row = c.explain(signatures.signals(wafers.where(F.col("wafer_id") == a.wafer), KEEP)).first()
        if row is None:
            raise SystemExit(f"no wafer {a.wafer}")
        print(row.why)
    elif a.command in ("cnn", "verify", "layers", "calibrate", "conformal"):
        with open(a.model, "rb") as f:
            neural(spark, wafers, cnn.Model.parse(f.read()), a)
    else:
        closed_loop(spark, wafers, a)


def neural(spark, wafers: DataFrame, model: cnn.Model, a: argparse.Namespace) -> None:
    if a.command == "calibrate":
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(cnn.scales_text(cnn.calibrate(wafers.where("split = 'val'"), model, 1000)))
        return
    scales = cnn.calibrate(wafers.where("split = 'val'"), model, 1000) if a.precision == "int8" else None
    if a.command == "cnn":
        scored = cnn.logits(wafers, model, KEEP, a.precision, scales)
        report(scored.withColumn("pred", pattern_name(metrics.argmax(F.col("logits")))))
    elif a.command == "layers":
        show(f"{a.precision} beside fp32", conformal.layer_differences(wafers, model, a.precision, scales).orderBy("layer"))
    elif a.command == "verify":
        found = conformal.verify(wafers, model, tables.read_logits(spark, a.logits), a.precision, scales).persist()
        show("logits beside the file's", found)
        row = found.first()
        if row.missing or row.same_class < row.n:
            raise SystemExit(1)
    else:
        given = wafers if a.split == "all" else wafers.where(F.col("split") == a.split)
        scored = conformal.probabilities(given, model, a.precision, scales).persist()
        sha = model.sha256.hex()
        if a.write:
            with open(a.text, "w", encoding="utf-8") as f:
                f.write(conformal.to_text(conformal.calibrate(scored, sha)))
        with open(a.text, encoding="utf-8") as f:
            c = cnn.Conformal.parse(f.read())
        if c.model_sha256 != sha:
            raise SystemExit("the calibration is of another model")
        for name, q in (("10", c.thresholds_10), ("5", c.thresholds_05)):
            show(f"misses of {name} %", metrics.conformal_metrics(scored.withColumn("set", metrics.prediction_set(F.col("p"), list(q))), c.accept_confidence))
        for name, values in c.reported:
            print(name, *values)


def closed_loop(spark, wafers: DataFrame, a: argparse.Namespace) -> None:
    excursions, of = tables.read_excursions(spark, a.excursions)
    if a.detector == "truth":
        said = wafers.select("wafer_id", "lot_id", "tested_at_us", F.col("truth").alias("pattern"))
    else:
        c = Classifier.load(a.rules) if a.rules else Classifier.fitted()
        said = c.classify(signatures.signals(wafers, ("wafer_id", "lot_id", "tested_at_us"))).withColumnRenamed("pred", "pattern")
    verdicts = said.select("wafer_id", lot_name(F.col("lot_id")).alias("lot"), F.col("tested_at_us").alias("at_us"), F.col("wafer_id").cast("bigint").alias("pos"), "pattern").persist()
    config = HoldConfig(a.k, a.window, a.lots, a.tool_k, int(a.tool_window_h * replay.HOUR_US) if a.tool_k else 0)
    latency = int(a.latency_ms * 1000)
    done = replay.replay_in_order(verdicts, config, latency).persist()
    outcome = replay.outcomes(done, of, excursions).persist()
    show("totals", replay.totals(done, of))
    show("excursions", outcome.orderBy("id"))
    show("summary", replay.summary(outcome, excursions))
    if a.alarms:
        show("beside the alarms", replay.report(outcome, excursions, tables.read_alarms(spark, a.alarms), verdicts, of).orderBy("id"))
    if a.sweep:
        many = [HoldConfig(k=k, window=w, lots=a.lots) for k, w in ((1, 1), (2, 3), (2, 5), (3, 5), (3, 8), (4, 8), (5, 10))]
        many += [HoldConfig(k=2, window=5, lots=a.lots, tool_k=k, tool_window_us=h * replay.HOUR_US) for k in (2, 3, 4, 5) for h in (6, 24, 72)]
        show("sweep", replay.sweep(verdicts, many, latency))


if __name__ == "__main__":
    main()
