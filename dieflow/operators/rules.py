"""Ordered rules over signals: the first whose conditions all hold names the pattern.

Rules are data; a classifier compiles to one CASE expression, so classifying
is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.patterns import PATTERNS, SIGNALS


@dataclass(frozen=True)
class Condition:
    signal: str
    op: str
    threshold: float

    def holds(self) -> Column:
        return F.col(self.signal) >= self.threshold if self.op == ">=" else F.col(self.signal) <= self.threshold


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    conditions: tuple[Condition, ...]

    def holds(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.holds()
        return out


#: The rules' conditions with hand-set and with fitted thresholds.
TABLE = """
near_full        near_full  density       >= 0.7   0.7
random           random     density       >= 0.35  0.41304347826086957
random           random     z             <= 5.0   8.400273878371642
edge_ring        edge_ring  edge          >= 2.5   2.3825136612021858
edge_ring        edge_ring  sector        <= 1.6   1.5922953451043338
edge_ring        edge_ring  z             >= 4.0   5.806206050007845
edge_loc         edge_loc   edge          >= 1.8   1.854161091784854
edge_loc         edge_loc   sector        >= 1.7   1.556338028169014
edge_loc         edge_loc   z             >= 3.0   5.0128504519631845
scratch_cluster  scratch    elongation    >= 4.0   3.924790723591553
scratch_cluster  scratch    line_length   >= 0.4   0.43247468518977733
scratch_cluster  scratch    cluster_share >= 0.15  0.16390041493775934
scratch_line     scratch    line          >= 6.0   5.151236342725705
scratch_line     scratch    line_length   >= 0.5   0.28830659013871973
scratch_line     scratch    edge          <= 2.0   1.854161091784854
donut            donut      ring          >= 1.8   2.1739094099949856
donut            donut      inner         <= 1.2   1.829268292682927
donut            donut      z             >= 6.0   6.227737271498747
center           center     inner         >= 2.0   2.1922077922077925
center           center     cluster_rho   <= 0.3   0.19086242915607105
center           center     z             >= 3.0   2.1328703966259708
loc              loc        cluster_size  >= 0.02  0.005573248407643312
loc              loc        cluster_rho   <= 0.85  0.8307470472861923
loc              loc        z             >= 4.0   3.5190974135316146
"""


def number_text(v: float) -> str:
    """The shortest text that reads back as v; whole numbers without a fraction."""
    return str(int(v)) if v == int(v) and abs(v) < 1e16 else repr(float(v))


def short(v: float) -> str:
    """Three significant digits, as C's %.3g writes them."""
    return f"{v:.3g}"


#: Fixed value: what explains a wafer that no rule takes.
NO_RULE = "no rule held -> none"


class RuleError(ValueError):
    """A rules text that can't be read; the message names the line."""


@dataclass(frozen=True)
class Classifier:
    rules: tuple[Rule, ...]

    @staticmethod
    def _from_table(column: int) -> Classifier:
        rules: dict[str, Rule] = {}
        for line in TABLE.split("\n"):
            if f := line.split():
                old = rules.get(f[0], Rule(f[0], f[1], ()))
                rules[f[0]] = replace(old, conditions=(*old.conditions, Condition(f[2], f[3], float(f[column]))))
        return Classifier(tuple(rules.values()))

    @staticmethod
    def defaults() -> Classifier:
        return Classifier._from_table(4)

    @staticmethod
    def fitted() -> Classifier:
        return Classifier._from_table(5)

    def to_text(self) -> str:
        lines = [f"{r.name} {c.signal} {c.op} {number_text(c.threshold)}" for r in self.rules for c in r.conditions]
        return "\n".join(["# rule signal op threshold (first rule that holds wins; order is fixed)", *lines, ""])

    @staticmethod
    def parse(text: str) -> Classifier:
        """Thresholds for every condition of the default rules, each exactly once; # lines and empty lines are skipped."""
        base = Classifier.defaults()
        where = {(r.name, c.signal, c.op): (i, k) for i, r in enumerate(base.rules) for k, c in enumerate(r.conditions)}
        given: dict[tuple[str, str, str], float] = {}
        lines = text.split("\n")
        for n, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):
            if not line or line.startswith("#"):
                continue
            f = line.split()
            if len(f) < 4 or f[2] not in (">=", "<="):
                raise RuleError(f"line {n}: a condition has a rule, a signal, >= or <=, and a number; this has {line!r}")
            try:
                value = float(f[3]) if "_" not in f[3] else math.nan
            except ValueError:
                value = math.nan
            if not math.isfinite(value):
                raise RuleError(f"line {n}: {f[3]!r} isn't a finite number")
            key = (f[0], f[1], f[2])
            if key in given:
                raise RuleError(f"line {n}: {' '.join(key)} has a threshold already")
            if key not in where:
                raise RuleError(f"line {n}: the rules have no condition {' '.join(key)}")
            given[key] = value
        if lacking := where.keys() - given.keys():
            raise RuleError(f"{' '.join(min(lacking, key=where.get))} has no threshold")
        return base.with_thresholds([given[r.name, c.signal, c.op] for r in base.rules for c in r.conditions])

    @staticmethod
    def load(path: str) -> Classifier:
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        except OSError:
            raise RuleError(f"cannot open {path}") from None
        try:
            return Classifier.parse(text)
        except RuleError as e:
            raise RuleError(f"{path}: {e}") from None

    def thresholds(self) -> list[float]:
        return [c.threshold for r in self.rules for c in r.conditions]

    def with_thresholds(self, values: Sequence[float]) -> Classifier:
        left = iter(values)
        return Classifier(tuple(replace(r, conditions=tuple(replace(c, threshold=float(next(left))) for c in r.conditions)) for r in self.rules))

    def rule_index(self) -> Column:
        """The first rule that holds, or -1."""
        out = None
        for i, r in enumerate(self.rules):
            out = F.when(r.holds(), i) if out is None else out.when(r.holds(), i)
        return out.otherwise(-1) if out is not None else F.lit(-1)

    def pattern(self) -> Column:
        out = None
        for r in self.rules:
            out = F.when(r.holds(), r.pattern) if out is None else out.when(r.holds(), r.pattern)
        return out.otherwise("none") if out is not None else F.lit("none")

    def classify(self, signals: DataFrame) -> DataFrame:
        """signals plus pred and rule."""
        return signals.withColumns({"pred": self.pattern(), "rule": self.rule_index()})

    def classify_row(self, s: dict[str, float]) -> tuple[str, int]:
        for i, r in enumerate(self.rules):
            if all(s[c.signal] >= c.threshold if c.op == ">=" else s[c.signal] <= c.threshold for c in r.conditions):
                return r.pattern, i
        return "none", -1

    def explain_row(self, s: dict[str, float], every: bool = False) -> str:
        """One line for the rule that fired; with every, a line for each rule."""
        _, fired = self.classify_row(s)

        def line(r: Rule) -> str:
            return f"{r.name} -> {r.pattern}: " + ", ".join(f"{c.signal} {short(s[c.signal])} {c.op} {short(c.threshold)}" for c in r.conditions)

        if every:
            return "\n".join(map(line, self.rules))
        return line(self.rules[fired]) if fired >= 0 else NO_RULE

    def explain(self, signals: DataFrame, name: str = "why") -> DataFrame:
        """signals plus the line for the rule that fired."""

        @F.pandas_udf("string")
        def why(s: pd.DataFrame) -> pd.Series:
            return pd.Series([self.explain_row(r) for r in s.to_dict("records")], dtype=object)

        return signals.withColumn(name, why(F.struct(*SIGNALS)))


def signals_csv(classified: DataFrame) -> DataFrame:
    """The columns of the signals file, numbers as C's %.6g writes them."""

    @F.pandas_udf("string")
    def six(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.6g}")

    return classified.select("wafer_id", "lot_id", "split", "truth", "pred", "rule", *(six(F.col(s)).alias(s) for s in SIGNALS))


assert all(r.pattern in PATTERNS for r in Classifier.defaults().rules)
