"""Walk-forward calibration: probabilities of a fold from the folds before it, by isotonic fits that are merged range by range."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators.joins import asof_ranged


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """Blocks (from, to, sum of outcomes, rows) whose means rise: neighbours that don't are pooled. Pooling parts first and then their blocks gives the same."""
    out: list[tuple] = []
    for a, b, s, w in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist(), strict=True):
        while out and out[-1][2] * w >= s * out[-1][3]:
            a, _, s0, w0 = out.pop()
            s, w = s + s0, w + w0
        out.append((a, b, s, w))
    return out


def isotonic_blocks(df: DataFrame, score: str, y: str, fold: str = "fold") -> DataFrame:
    """``fold, low, high, total, rows``: for each fold the isotonic fit on all folds before it, as blocks of scores with one mean.

    Rows are summed by fold and score first. Each range of scores is pooled by
    its own task, then a fold's blocks are pooled in order: with outcomes of 0
    and 1 there are at most about the 2/3rd power of its rows. All folds are one
    job; a fold without a fold before it has no blocks.
    """
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    points = known.groupBy(fold, F.col(score).cast("double").alias("low")).agg(F.sum(F.col(y).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("rows"))
    later = df.select(F.col(fold).alias("_for")).distinct()  # a row a fold
    prior = points.join(F.broadcast(later), F.col(fold) < F.col("_for")).groupBy(F.col("_for").alias(fold), "low").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    kind = dict(df.dtypes)[fold]
    schema = f"{fold} {kind}, low double, high double, total double, rows double"

    def one(frame, key):
        found = pooled(frame["low"].to_numpy(), frame["high"].to_numpy(), frame["total"].to_numpy(), frame["rows"].to_numpy())
        out = type(frame)(found, columns=["low", "high", "total", "rows"])
        out.insert(0, fold, key)
        return out

    def ranges(frames):
        for frame in frames:  # sorted: a batch holds neighbours of a fold
            for key, part in frame.assign(high=frame["low"]).groupby(fold, sort=False):
                yield one(part, key)

    def whole(key, frame):
        return one(frame.sort_values("low"), key[0])

    return prior.repartitionByRange(fold, "low").sortWithinPartitions(fold, "low").mapInPandas(ranges, schema).groupBy(fold).applyInPandas(whole, schema)


def interpolated(df: DataFrame, blocks: DataFrame, score: str, fold: str = "fold", rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``fitted``: the mean of the block that holds the score, a straight line between two blocks, and the first or last mean beyond them."""
    order = Window.partitionBy(fold).orderBy("low")
    mean = F.col("total") / F.col("rows")
    steps = blocks.withColumns({"_v": mean, "_next": F.lead("low").over(order), "_nextv": F.lead(mean).over(order), "_first": F.row_number().over(order) == 1})
    steps = steps.select(fold, "low", F.col("high").alias("_high"), "_v", "_next", "_nextv", "_first")
    # Before the first block its own mean holds.
    before = steps.where("_first").withColumns({"low": F.lit(float("-inf")), "_high": F.lit(float("inf"))})
    facts = steps.unionByName(before).select(fold, F.col("low").alias("_low"), "_high", "_v", "_next", "_nextv")
    probes = df.withColumn("_s", F.col(score).cast("double"))
    found = asof_ranged(probes, facts, [fold], "_s", "_low", ["_high", "_v", "_next", "_nextv"], rows)
    line = F.col("_v") + (F.col("_s") - F.col("_high")) / (F.col("_next") - F.col("_high")) * (F.col("_nextv") - F.col("_v"))
    fitted = F.when(F.col("_s").isNotNull(), F.when((F.col("_s") <= F.col("_high")) | F.col("_next").isNull(), F.col("_v")).otherwise(line))
    return found.select(*df.columns, fitted.alias("fitted"))


def logistic_fits(df: DataFrame, score: str, y: str, least: int, fold: str = "fold", steps: int = 50) -> DataFrame:
    """``fold, slope, constant, mean, deviation``: logistic fits on the folds before, for folds with fewer than ``least`` rows before them; each is solved in a map over its rows, of which there are so few."""
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(fold, F.col(score).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sizes = known.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    later = df.select(F.col(fold).alias("_for")).distinct()
    thin = sizes.join(F.broadcast(later), F.col(fold) < F.col("_for")).groupBy("_for").agg(F.sum("n").alias("n")).where(F.col("n") < least)
    rows = known.join(F.broadcast(thin), F.col(fold) < F.col("_for")).select(F.col("_for").alias(fold), "x", "y")
    kind = dict(df.dtypes)[fold]

    def fit(key, frame):
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        mean, deviation = x.mean(), x.std() or 1.0
        z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
        beta = np.zeros(2)
        for _ in range(steps if 0 < y.mean() < 1 else 0):
            p = 1 / (1 + np.exp(-(z @ beta)))
            step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + 1e-6 * np.eye(2), z.T @ (y - p))
            beta = beta + step
        ok = 0 < y.mean() < 1 and np.isfinite(beta).all() and beta[0] >= 0
        return type(frame)([(key[0], beta[0], beta[1], mean, deviation)] if ok else [], columns=[fold, "slope", "constant", "mean", "deviation"])

    return rows.groupBy(fold).applyInPandas(fit, f"{fold} {kind}, slope double, constant double, mean double, deviation double")


def walk_forward(df: DataFrame, score: str, y: str, least: int = 200, fold: str = "fold", entity: str = "entity", rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``p`` and ``kind``: each fold calibrated on the folds before it only.

    ``isotonic`` where those have ``least`` rows with both outcomes;
    ``logistic`` with fewer, if it rises with the score; else their
    ``base_rate``. The first fold has ``rank``: the score's place among its own
    over n + 1, ties by entity. Rows without a score have no probability.
    """
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    sums = known.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    folds = df.select(F.col(fold).alias("_for")).distinct()
    prior = folds.join(sums, F.col(fold) < F.col("_for"), "left").groupBy("_for").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.sum("s").alias("_s1"))
    fits = logistic_fits(df, score, y, least, fold).withColumnRenamed(fold, "_fit")
    within = Window.partitionBy(fold)
    rank = F.row_number().over(within.orderBy(F.col(score).asc_nulls_last(), entity)) / (F.count(score).over(within) + 1)
    first = df.agg(F.min(fold).alias("_first"))
    early = df.join(F.broadcast(first), F.col(fold) == F.col("_first"), "left_semi").withColumn("_rank", F.when(F.col(score).isNotNull(), rank))
    late = df.join(F.broadcast(first), F.col(fold) == F.col("_first"), "left_anti").withColumn("_rank", F.lit(None).cast("double"))
    rows_ = interpolated(early.unionByName(late), isotonic_blocks(df, score, y, fold), score, fold, rows)
    rows_ = rows_.join(F.broadcast(prior), F.col(fold) == F.col("_for")).join(F.broadcast(fits), F.col(fold) == F.col("_fit"), "left").join(F.broadcast(first))
    both = (F.col("_s1") > 0) & (F.col("_s1") < F.col("_n"))
    kind = F.when(F.col(fold) == F.col("_first"), "rank").when((F.col("_n") >= least) & both, "isotonic").when(F.col("_fit").isNotNull(), "logistic").otherwise("base_rate")
    logistic = 1 / (1 + F.exp(-(F.col("slope") * (F.col(score) - F.col("mean")) / F.col("deviation") + F.col("constant"))))
    base = F.coalesce(ratio("_s1", "_n"), F.lit(0.5))
    p = F.when(F.col("kind") == "rank", F.col("_rank")).when(F.col("kind") == "isotonic", F.col("fitted")).when(F.col("kind") == "logistic", logistic).otherwise(base)
    return rows_.withColumn("kind", kind).select(*df.columns, F.when(F.col(score).isNotNull(), p).alias("p"), "kind")
