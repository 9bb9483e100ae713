"""A small vocabulary of feature documents that turn into DataFrame operations.

A document is ``{"op": name, "inputs": [documents], "params": {...}}``; leaves
are ``{"op": "source", "field": name}``. Features are ``entity, t, value`` rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import descending_percentile

#: Fixed values of the vocabulary's bounds.
MAX_DEPTH, MAX_NODES, MAX_INTERACTIONS, MAX_WINDOW, MAX_PERIODS = 3, 25, 4, 60, 24
EPS = 1e-12
ARITY = {"lag": 1, "difference": 1, "percentage_change": 1, "rolling_mean": 1, "rolling_median": 1, "rolling_std": 1, "rolling_slope": 1, "zscore": 1, "volatility_scale": 1, "cross_sectional_rank": 1, "winsorize": 1, "sector_neutralize": 1, "interaction": 2, "ratio": 2, "bounded_sum": None, "bounded_weighted_average": None}
LEAKING = ("lead", "forward_return", "future", "target")


def depth(doc: dict) -> int:
    return 0 if doc.get("op") == "source" else 1 + max((depth(d) for d in doc.get("inputs", [])), default=0)


def nodes(doc: dict) -> list[dict]:
    return [doc, *[n for d in doc.get("inputs", []) for n in nodes(d)]]


def violations(doc: dict, fields: set[str], targets: tuple[str, ...] = ("fwd",)) -> list[str]:
    """Why a document isn't allowed; empty if it is."""
    out = []
    found = nodes(doc)
    if depth(doc) > MAX_DEPTH:
        out.append("too_deep")
    if len(found) > MAX_NODES:
        out.append("too_many_nodes")
    if sum(n.get("op") == "interaction" for n in found) > MAX_INTERACTIONS:
        out.append("too_many_interactions")
    for n in found:
        op, params = n.get("op"), n.get("params", {})
        if op == "source":
            if n.get("field") not in fields:
                out.append(f"unknown_field:{n.get('field')}")
            elif str(n["field"]).startswith(targets):
                out.append(f"target_as_source:{n['field']}")
        elif op in LEAKING:
            out.append(f"leaks:{op}")
        elif op not in ARITY:
            out.append(f"unknown_op:{op}")
        else:
            if ARITY[op] is not None and len(n.get("inputs", [])) != ARITY[op] or not n.get("inputs"):
                out.append(f"arity:{op}")
            if not 1 <= params.get("window", 1) <= MAX_WINDOW or not 1 <= params.get("periods", 1) <= MAX_PERIODS:
                out.append(f"bounds:{op}")
    return out


def signature(doc: dict) -> str:
    """The same for equal documents; inputs of symmetric operations in either order."""

    def plain(d: dict):
        inputs = [plain(x) for x in d.get("inputs", [])]
        if d.get("op") in ("interaction", "bounded_sum"):
            inputs = sorted(inputs, key=json.dumps)
        return [d.get("op"), d.get("field"), sorted(d.get("params", {}).items()), inputs]

    return hashlib.sha256(json.dumps(plain(doc)).encode()).hexdigest()


def compile_feature(doc: dict, panel: DataFrame) -> DataFrame:
    """The document's ``entity, t, value`` over a panel of ``entity, t, sector`` and source fields."""
    problems = violations(doc, set(panel.columns) - {"entity", "t"})
    if problems:
        raise ValueError("; ".join(problems))
    months = F.broadcast(panel.select("t").distinct())

    def shifted(x: DataFrame, k: int) -> DataFrame:
        return x.select("entity", (F.col("t") + k).alias("t"), F.col("value").alias("was"))

    def rolled(x: DataFrame, p: dict, f: Callable) -> DataFrame:
        """Each value counts for the months ahead that its window reaches: months in which the entity is absent get a value too."""
        w, least = p["window"], p.get("min_periods", p["window"])
        ahead = x.select("entity", F.col("t").alias("at"), "value", F.explode(F.sequence(F.col("t"), F.col("t") + w - 1)).alias("t")).join(months, "t", "left_semi")
        return ahead.groupBy("entity", "t").agg(F.count("value").alias("_n"), f().alias("value")).where(F.col("_n") >= least).drop("_n")

    def windowed(x: DataFrame, p: dict, f: Callable) -> DataFrame:
        over = Window.partitionBy("entity").orderBy("t").rangeBetween(1 - p["window"], 0)
        sd = F.stddev_samp("value").over(over)
        return x.withColumn("value", F.when((F.count("value").over(over) == p["window"]) & (sd > EPS), f(F.avg("value").over(over), F.nullif(sd, F.lit(0.0)))))

    def sectors(x: DataFrame) -> DataFrame:
        return x.join(panel.select("entity", "t", "sector"), ["entity", "t"], "left")

    def joined(inputs: list[DataFrame]) -> DataFrame:
        out = inputs[0].withColumnRenamed("value", "v0")
        for i, x in enumerate(inputs[1:], 1):
            out = out.join(x.withColumnRenamed("value", f"v{i}"), ["entity", "t"])
        return out

    def build(d: dict) -> DataFrame:
        if d["op"] == "source":
            return panel.select("entity", "t", F.col(d["field"]).cast("double").alias("value")).where("value is not null")
        op, p = d["op"], d.get("params", {})
        inputs = [build(x) for x in d["inputs"]]
        x, k = inputs[0], p.get("periods", 1)
        month = Window.partitionBy("t")
        if op == "lag":
            out = shifted(x, k).withColumnRenamed("was", "value").join(months, "t", "left_semi")
        elif op in ("difference", "percentage_change"):
            out = x.join(shifted(x, k), ["entity", "t"])
            change = F.col("value") - F.col("was")
            out = out.withColumn("value", change if op == "difference" else F.when(F.abs("was") > EPS, change / F.nullif(F.abs("was"), F.lit(0.0))))
        elif op == "rolling_slope":
            out = rolled(x, p, lambda: F.regr_slope(F.col("value"), (F.col("at") - F.col("t")).cast("double")))
        elif op.startswith("rolling_"):
            out = rolled(x, p, {"rolling_mean": lambda: F.avg("value"), "rolling_median": lambda: F.percentile("value", F.lit(0.5)), "rolling_std": lambda: F.stddev_samp("value")}[op])
        elif op == "zscore":
            out = windowed(x, p, lambda m, sd: (F.col("value") - m) / sd)
        elif op == "volatility_scale":
            out = windowed(x, p, lambda m, sd: F.col("value") / sd)
        elif op == "cross_sectional_rank":
            out = x.withColumn("value", descending_percentile("value", "entity", "t"))
        elif op == "winsorize":
            a, b = (F.percentile("value", F.lit(q)).over(month) for q in (p.get("lower", 0.01), p.get("upper", 0.99)))
            out = x.withColumn("value", F.least(F.greatest("value", a), b))
        elif op == "sector_neutralize":
            out = sectors(x).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("t", "sector")))
        else:
            both = joined(inputs)
            values = [F.col(f"v{i}") for i in range(len(inputs))]
            if op == "interaction":
                value = values[0] * values[1]
            elif op == "ratio":
                value = F.when(F.abs(values[1]) > EPS, values[0] / F.nullif(values[1], F.lit(0.0)))
            else:
                weights = p.get("weights", [1.0] * len(values)) if op == "bounded_weighted_average" else [1.0] * len(values)
                value = sum((v * w for v, w in zip(values, weights, strict=True)), F.lit(0.0))
                if op == "bounded_weighted_average":
                    value = value / sum(weights)
                value = F.least(F.greatest(value, F.lit(float(p.get("lower", -1e300)))), F.lit(float(p.get("upper", 1e300))))
            out = both.withColumn("value", value)
        return out.where("value is not null").select("entity", "t", "value")

    return build(doc)


def execute_set(docs: dict[str, dict], panel: DataFrame, targets: tuple[str, ...] = ("fwd",)) -> tuple[DataFrame, dict[str, list[str]]]:
    """The valid documents' features side by side by entity and date, and the violations of those that aren't. Equal documents are computed once."""
    fields = {c for c in panel.columns if c not in ("entity", "t")}
    refused = {name: found for name, doc in docs.items() if (found := violations(doc, fields, targets))}
    made: dict[str, DataFrame] = {}
    out = None
    for name, doc in docs.items():
        if name in refused:
            continue
        key = signature(doc)
        made[key] = made.get(key, compile_feature(doc, panel))
        own = made[key].withColumnRenamed("value", name)
        out = own if out is None else out.join(own, ["entity", "t"], "full")
    return out, refused
