"""Statistical inference on date-level streams; chance comes from hashes, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio


def indexed(stream: DataFrame, x: str, order: str = "t") -> DataFrame:
    """``i, x, n`` of a date-level stream."""
    rows = stream.where(F.col(x).isNotNull())
    return rows.select((F.row_number().over(Window.orderBy(order)) - 1).cast("long").alias("i"), F.col(x).alias("x"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def drawn(*parts) -> Column:
    """A number below 2^32 for each combination of parts: the first eight digits of the md5 of them, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def _row(stream: DataFrame, x: str, order: str) -> DataFrame:
    """One row ``n, xs, sums``: the stream in order, and its sums up to each place from 0 on. The stream has a row a date, so the calendar bounds it."""
    rows = indexed(stream, x, order)
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = F.array_sort(F.collect_list(F.struct("i", "x", "s")))
    held = rows.withColumn("s", F.sum("x").over(upto)).agg(F.count(F.lit(1)).alias("n"), ordered.alias("r"))
    return held.select("n", F.transform("r", lambda r: r["x"]).alias("xs"), F.concat(F.array(F.lit(0.0)), F.transform("r", lambda r: r["s"])).alias("sums"))


def block_bootstrap(stream: DataFrame, x: str, block: int, replicates: int = 1000, alpha: float = 0.05, seed: int = 1, order: str = "t") -> DataFrame:
    """Interval of the mean from moving blocks: each replicate strings blocks together to the stream's length, the last one cut.

    A block's sum is the difference of two sums up to a place, so its length
    costs nothing. Starts come from digests, so another engine can repeat them.
    Without a row there is no interval.
    """
    held = _row(stream, x, order).where("n > 0")
    blocks = stream.sparkSession.range(replicates).select(F.col("id").alias("b")).crossJoin(F.broadcast(held)).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)))
    start = (drawn(F.lit(seed), F.col("b"), F.col("k")) % F.greatest(F.lit(1), F.col("n") - block + 1)).cast("int")
    end = F.least(F.col("s") + F.least(F.lit(block), F.col("n") - F.col("k") * block), F.col("n")).cast("int")
    sums = blocks.withColumn("s", start).select("b", "n", (F.element_at("sums", end + 1) - F.element_at("sums", F.col("s") + 1)).alias("v"))
    means = sums.groupBy("b").agg((F.sum("v") / F.first("n")).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))


def sign_flip(stream: DataFrame, x: str, replicates: int = 1000, seed: int = 1, order: str = "t") -> DataFrame:
    """Share of sign flips whose absolute mean reaches the stream's, one added to both counts; signs are the halves of a digest's 32 digits."""
    held = _row(stream, x, order).where("n > 0")
    draws = stream.sparkSession.range(replicates).select(F.col("id").alias("b")).crossJoin(F.broadcast(held))
    digests = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 32).cast("int")), lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), k.cast("string")).cast("binary")))
    draws = draws.withColumn("d", F.array_join(digests, ""))
    flipped = F.transform("xs", lambda v, i: F.when(F.substring("d", i + 1, F.lit(1)) >= "8", v).otherwise(-v))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    means = draws.select(F.round(F.abs(total(flipped) / F.col("n")), 12).alias("m"), F.round(F.abs(total(F.col("xs")) / F.col("n")), 12).alias("seen"))
    return means.agg(((F.sum((F.col("m") >= F.col("seen")).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.max("seen").alias("mean"))


def leave_one_out(stream: DataFrame, x: str, period: Column) -> DataFrame:
    """``period, mean, same_sign``: the mean without each period, from sums by period and in all."""
    sums = stream.where(F.col(x).isNotNull()).groupBy(period.alias("period")).agg(F.sum(x).alias("s"), F.count(x).alias("c"))
    every = Window.partitionBy()
    mean = ratio(F.sum("s").over(every) - F.col("s"), F.sum("c").over(every) - F.col("c"))
    return sums.select("period", mean.alias("mean"), (F.signum(mean) == F.signum(F.sum("s").over(every))).alias("same_sign"))


def benjamini_hochberg(df: DataFrame, p: str, q: float, key: str) -> DataFrame:
    """Adds ``rejected``: p at most the largest p that lies under its line. A table of hypotheses, not rows."""
    every = Window.partitionBy()
    placed = df.withColumns({"_r": F.row_number().over(Window.orderBy(p, key)), "_m": F.count(F.lit(1)).over(every)})
    bar = F.max(F.when(F.col(p) <= F.col("_r") / F.col("_m") * q, F.col(p))).over(every)
    return placed.withColumn("rejected", F.coalesce(F.col(p) <= bar, F.lit(False))).drop("_r", "_m")


def multiple_testing_bars(n: int) -> dict[str, float]:
    """Bonferroni's level for 5%, the expected largest of n normal draws, and a haircut of log10 n."""
    return {"bonferroni": 0.05 / max(1, n), "max_normal": math.sqrt(2 * math.log(max(2, n))), "log_haircut": math.log10(max(1, n))}


def normal_cdf(c: Column) -> Column:
    """The normal distribution function by a rational fit, within 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    # Fixed values of the formula.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(c) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    tail = poly * F.exp(-z * z) / 2
    return F.when(c >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def expected_max_sharpe(trials: int, variance: float) -> float:
    """The expected best Sharpe ratio among unskilled trials."""
    euler = 0.5772156649015329
    n = max(2, trials)
    return math.sqrt(variance) * ((1 - euler) * normal_quantile(1 - 1 / n) + euler * normal_quantile(1 - 1 / (n * math.e)))


def deflated_sharpe(stream: DataFrame, x: str, trials: int, variance: float) -> DataFrame:
    """Sharpe ratio a period, and the odds that it beats the best of unskilled trials, given skew and kurtosis."""
    bar = expected_max_sharpe(trials, variance)
    m = stream.agg(F.count(x).alias("n"), ratio(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    s = F.col("sharpe")
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s))
    return m.select("n", "sharpe", normal_cdf((s - bar) * F.sqrt(F.col("n") - 1) / spread).alias("odds"))


def regime_split(stream: DataFrame, x: str, state: str, by: str = "median") -> DataFrame:
    """Means of a stream where a state is high and low (against its median, or 0), and whether the sign flips."""
    bar = F.percentile(state, F.lit(0.5)).over(Window.partitionBy()) if by == "median" else F.lit(0.0)
    high = F.col(state) > F.col("_bar")
    rows = stream.where(F.col(x).isNotNull() & F.col(state).isNotNull()).withColumn("_bar", bar)
    out = rows.agg(F.avg(F.when(high, F.col(x))).alias("high"), F.avg(F.when(~high, F.col(x))).alias("low"), F.sum(high.cast("int")).alias("n_high"), F.sum((~high).cast("int")).alias("n_low"))
    return out.withColumn("flips", F.signum("high") != F.signum("low"))


def gated(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``, the gates that fail (a null fails), their number, and a class."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in gates.items()]))
    out = df.withColumn("reasons", F.array_join(failed, ",")).withColumn("failed", F.size(failed))
    return out.withColumn("class", F.when(F.col("failed") == 0, "pass").when(F.col("failed") < len(gates), "partial").otherwise("fail"))
