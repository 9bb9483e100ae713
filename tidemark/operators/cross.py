"""Cross-sectional operators: within a date, or a date and group."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import average_rank, clip, col, ratio


def with_names(df: DataFrame, date: str = "t", least: int = 1) -> DataFrame:
    """Adds ``names``, the rows of the date, and keeps dates with enough."""
    return df.withColumn("names", F.count(F.lit(1)).over(Window.partitionBy(date))).where(F.col("names") >= least)


def zscore(x: Column | str, *by: str, sample: bool = False, flat: float | None = None) -> Column:
    """Standard score within ``by``; ``flat`` where there is no variance."""
    over = Window.partitionBy(*by)
    deviation = (F.stddev_samp if sample else F.stddev_pop)(col(x)).over(over)
    score = ratio(col(x) - F.avg(col(x)).over(over), F.when(deviation > 1e-12, deviation))
    return score if flat is None else F.when(col(x).isNotNull(), F.coalesce(score, F.lit(flat)))


def neutralize(x: Column | str, group: str, *by: str, least: int = 1, keep_small: bool = True) -> Column:
    """x less its group's mean; groups of fewer than ``least`` keep their value, or become null."""
    over = Window.partitionBy(*by, group)
    return F.when(F.count(col(x)).over(over) >= least, col(x) - F.avg(col(x)).over(over)).otherwise(col(x) if keep_small else F.lit(None))


def winsorize(df: DataFrame, x: str, low: float, high: float, *by: str) -> DataFrame:
    """Adds ``<x>_w``: x within its exact quantiles of the group, linear between ranks."""
    over = Window.partitionBy(*by)
    a, b = (F.percentile(F.col(x), F.lit(q)).over(over) for q in (low, high))
    return df.withColumn(f"{x}_w", F.when(F.col(x).isNotNull(), F.least(F.greatest(x, a), b)))


def neutral_clipped(df: DataFrame, x: str, group: str, date: str = "t", limit: float = 3.0) -> DataFrame:
    """Adds ``<x>_n``: neutralised, scored and clipped."""
    return df.withColumn("_n", neutralize(x, group, date)).withColumn(f"{x}_n", clip(zscore("_n", date, flat=0.0), -limit, limit)).drop("_n")


def percent_rank(x: Column | str, *by: str) -> Column:
    """Average rank over count."""
    n = F.count(col(x)).over(Window.partitionBy(*by))
    return F.when(col(x).isNotNull(), average_rank(x, *by, col(x).isNull()) / n)


def rank_target(x: Column | str, *by: str) -> Column:
    """Average rank scaled to [-0.5, 0.5]; 0 if alone."""
    n = F.count(col(x)).over(Window.partitionBy(*by))
    return F.when(col(x).isNotNull(), F.coalesce(F.try_divide(average_rank(x, *by, col(x).isNull()) - 1, (n - 1).cast("double")), F.lit(0.5)) - 0.5)


def bucket(x: Column | str, n: int, *by: str) -> Column:
    """0..n-1 by percent rank of x: floor of rank share, the top one closed."""
    share = percent_rank(x, *by)
    return F.least(F.floor(share * n), F.lit(n - 1)).cast("int")


def bucket_first(x: Column | str, entity: Column | str, n: int, *by: str) -> Column:
    """0..n-1 with equal counts; ties go by entity."""
    over = Window.partitionBy(*by)
    place = F.row_number().over(over.orderBy(col(x), col(entity)))
    return F.floor((place - 1) * n / F.count(F.lit(1)).over(over)).cast("int")


def market_residual(x: Column | str, *by: str, least: int = 1) -> Column:
    """x less the cross-section's median."""
    over = Window.partitionBy(*by)
    return F.when(F.count(col(x)).over(over) >= least, col(x) - F.percentile(col(x), F.lit(0.5)).over(over))


def breadth(df: DataFrame, r: str = "ret", date: str = "t") -> DataFrame:
    """Per date: names, share that gained, dispersion, mean and median."""
    return df.where(F.col(r).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("names"), F.avg((F.col(r) > 0).cast("double")).alias("breadth"), F.stddev_pop(r).alias("dispersion"), F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"))


def gates(df: DataFrame, columns: list[str], date: str = "t") -> DataFrame:
    """Adds ``passes``: at least the date's median in every column."""
    over = Window.partitionBy(date)
    ok = [F.coalesce(F.col(c) >= F.percentile(F.col(c), F.lit(0.5)).over(over), F.lit(False)) for c in columns]
    return df.withColumn("passes", reduce(lambda a, b: a & b, ok))


def rank_composite(df: DataFrame, signs: dict[str, int], date: str = "t") -> DataFrame:
    """Adds ``composite``: mean of signed percent ranks over the columns that aren't null."""
    ranks = [percent_rank(F.col(c) * s, date) for c, s in signs.items()]
    total = reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) for r in ranks])
    n = reduce(lambda a, b: a + b, [r.isNotNull().cast("int") for r in ranks])
    return df.withColumn("composite", ratio(total, n))


def residualize(df: DataFrame, y: str, controls: list[str], date: str = "t", least: int = 5) -> DataFrame:
    """Adds ``residual``: y less its fit on the controls and a constant, date by date.

    Moments are summed by date in Spark; each date's small system is solved in
    a grouped map of one row a date, by least norm where it is singular, and
    the coefficients are joined back. Dates of too few complete rows are
    demeaned.
    """
    names = ["1", *controls]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [y, *controls]])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(value(names[i]) * value(names[j])).alias(f"x{i}_{j}") for i, j in pairs] + [F.sum(value(c) * F.col(y)).alias(f"y{i}") for i, c in enumerate(names)]
    moments = df.where(complete).groupBy(date).agg(F.count(F.lit(1)).alias("m"), *sums)
    kind = dict(df.dtypes)[date]

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                a = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    a[i, j] = a[j, i] = row[f"x{i}_{j}"]
                b = np.array([row[f"y{i}"] for i in range(len(names))])
                beta = np.linalg.lstsq(a, b, rcond=None)[0] if row["m"] >= max(least, len(names) + 1) else np.append(b[0] / row["m"], np.zeros(len(controls)))
                out.append([row[date], *beta])
            yield type(frame)(out, columns=[date, *(f"b{i}" for i in range(len(names)))])

    betas = moments.mapInPandas(solve, f"{date} {kind}, " + ", ".join(f"b{i} double" for i in range(len(names))))
    fit = reduce(lambda a, b: a + b, [F.col(f"b{i}") * value(c) for i, c in enumerate(names)])
    return df.join(betas, date, "left").withColumn("residual", F.when(complete, F.col(y) - fit)).drop(*[f"b{i}" for i in range(len(names))])


def placebo_roll(df: DataFrame, x: str, shift: int, date: str = "t", entity: str = "entity") -> DataFrame:
    """Adds ``placebo``: x of the entity ``shift`` places on within the date, round the end."""
    over = Window.partitionBy(date)
    placed = df.withColumn("_i", F.row_number().over(over.orderBy(entity)) - 1).withColumn("_n", F.count(F.lit(1)).over(over))
    other = placed.select(F.col(date).alias("_d"), F.col("_i").alias("_j"), F.col(x).alias("placebo"))
    return placed.join(other, (F.col(date) == F.col("_d")) & ((F.col("_i") + shift) % F.col("_n") == F.col("_j"))).drop("_i", "_n", "_d", "_j")


def placebo_shuffle(df: DataFrame, x: str, seed: int, date: str = "t", entity: str = "entity") -> DataFrame:
    """Adds ``placebo``: x dealt out anew within the date, in the order of digests of seed, entity and date."""
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(date).orderBy(entity)))
    other = df.select(F.col(date).alias("_d"), F.col(x).alias("placebo"), F.row_number().over(Window.partitionBy(date).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(entity).cast("string"), F.col(date).cast("string")).cast("binary")), entity)).alias("_j"))
    return placed.join(other, (F.col(date) == F.col("_d")) & (F.col("_i") == F.col("_j"))).drop("_i", "_d", "_j")


def model_dispersion(df: DataFrame, scores: list[str], *by: str) -> DataFrame:
    """Adds ``dispersion``: deviation of an entity's percent ranks across models; null with fewer than two."""
    total = lambda f: F.aggregate("_r", F.lit(0.0), lambda a, v: a + f(v))
    out = df.withColumn("_r", F.array_compact(F.array(*[percent_rank(c, *by) for c in scores])))
    out = out.withColumn("_m", F.when(F.size("_r") >= 2, total(lambda v: v) / F.size("_r")))
    return out.withColumn("dispersion", F.sqrt(total(lambda v: (v - F.col("_m")) * (v - F.col("_m"))) / F.size("_r"))).drop("_r", "_m")
