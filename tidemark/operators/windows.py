"""Trailing features per entity, and forward labels.

``t`` is an integer session or month index. Windows are trailing. A lag over
``t`` is exact in the calendar: a missing session gives null, it doesn't reach
further back; ``row_lag`` counts available rows instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.stats import col, growth_log, ratio, safe_corr


def back(entity: str, t: str, width: int, end: int = 0) -> WindowSpec:
    """The ``width`` sessions up to ``end`` sessions before now."""
    return Window.partitionBy(entity).orderBy(t).rangeBetween(-(width - 1) - end, -end)


def lag_exact(x: Column | str, k: int, entity: str = "entity", t: str = "t") -> Column:
    """The value ``k`` sessions ago (ahead if negative), null if there is none."""
    return F.max(col(x)).over(Window.partitionBy(entity).orderBy(t).rangeBetween(-k, -k))


def row_lag(x: Column | str, k: int, entity: str = "entity", t: str = "t") -> Column:
    return F.lag(col(x), k).over(Window.partitionBy(entity).orderBy(t))


def filled(x: Column | str, entity: str = "entity", t: str = "t") -> Column:
    """The last value that isn't null."""
    return F.last(col(x), ignorenulls=True).over(Window.partitionBy(entity).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))


def trailing_return(x: Column | str, k: int, entity: str = "entity", t: str = "t") -> Column:
    """x / x[-k] - 1; null if the base isn't positive."""
    base = lag_exact(x, k, entity, t)
    return ratio(col(x), F.when(base > 0, base)) - 1


def log_return(x: Column | str, k: int = 1, entity: str = "entity", t: str = "t") -> Column:
    base = lag_exact(x, k, entity, t)
    return F.when((base > 0) & (col(x) > 0), F.log(ratio(col(x), F.when(base > 0, base))))


def skip_momentum(x: Column | str, long: int, skip: int, entity: str = "entity", t: str = "t") -> Column:
    """x[-skip] / x[-long] - 1."""
    base = lag_exact(x, long, entity, t)
    return ratio(lag_exact(x, skip, entity, t), F.when(base > 0, base)) - 1


def forward_return(x: Column | str, k: int, entity: str = "entity", t: str = "t") -> Column:
    """x[+k] / x - 1; null if the base isn't positive."""
    return ratio(lag_exact(x, -k, entity, t), F.when(col(x) > 0, col(x))) - 1


def rolling(f: Callable[[Column], Column], x: Column | str, width: int, least: int | None = None, entity: str = "entity", t: str = "t", end: int = 0) -> Column:
    """An aggregate over the window; null with fewer than ``least`` values (all, if not given)."""
    over = back(entity, t, width, end)
    return F.when(F.count(col(x)).over(over) >= (least or width), f(col(x)).over(over))


def realized_vol(r: Column | str, width: int, least: int | None = None, per_year: int | None = None, **keys) -> Column:
    vol = rolling(F.stddev_samp, r, width, least, **keys)
    return vol * per_year**0.5 if per_year else vol


def downside_vol(r: Column | str, width: int, kind: str = "rms", least: int | None = None, **keys) -> Column:
    """``rms``: root mean square of the negative returns alone; ``clipped``: sample deviation of returns cut off at 0; ``rolling_rms``: root mean square of returns cut off at 0."""
    r = col(r)
    cut = F.when(r.isNotNull(), F.least(r, F.lit(0.0)))
    if kind == "clipped":
        return rolling(F.stddev_samp, cut, width, least, **keys)
    if kind == "rolling_rms":
        return F.sqrt(rolling(F.avg, cut * cut, width, least, **keys))
    enough = rolling(F.count, r, width, least, **keys)
    return F.when(enough.isNotNull(), F.sqrt(rolling(F.avg, F.when(r < 0, r * r), width, 1, **keys)))


def rolling_pair(kind: str, y: Column | str, x: Column | str, width: int, missing: int = 0, entity: str = "entity", t: str = "t") -> Column:
    """``beta``, ``corr`` or ``cov`` of y with x over pairs; null with more than ``missing`` pairs missing."""
    both = col(y).isNotNull() & col(x).isNotNull()
    y, x, over = F.when(both, col(y)), F.when(both, col(x)), back(entity, t, width)
    value = {"corr": lambda: safe_corr(x, y, over), "cov": lambda: F.covar_samp(y, x).over(over), "beta": lambda: F.try_divide(F.covar_samp(y, x).over(over), F.var_samp(x).over(over))}[kind]()
    return F.when(F.count(x).over(over) >= width - missing, value)


def drawdown(x: Column | str, width: int, kind: str = "current", entity: str = "entity", t: str = "t") -> Column:
    """``current``: x over the window's maximum, less 1; ``trough``: the window's minimum over its maximum, less 1; ``path``: the deepest fall from a running maximum within the window."""
    over = back(entity, t, width)
    if kind == "current":
        return ratio(col(x), F.max(col(x)).over(over)) - 1
    if kind == "trough":
        return ratio(F.min(col(x)).over(over), F.max(col(x)).over(over)) - 1
    values = F.array_compact(F.collect_list(col(x)).over(over))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst"))

    def step(a: Column, v: Column) -> Column:
        top = F.greatest(a["top"], v)
        return F.struct(top.alias("top"), F.least(a["worst"], ratio(v, top) - 1).alias("worst"))

    return F.when(F.size(values) > 0, F.aggregate(values, start, step)["worst"])


def extreme_distance(x: Column | str, width: int, high: bool = True, **keys) -> Column:
    """x over the highest (or lowest) value of the window, less 1."""
    return ratio(col(x), rolling(F.max if high else F.min, x, width, 1, **keys)) - 1


def return_zscore(x: Column | str, width: int, entity: str = "entity", t: str = "t") -> Column:
    """The ``width``-session return against the last ``width`` of such returns. The column holds them."""
    return ratio(col(x) - rolling(F.avg, x, width, entity=entity, t=t), F.nullif(rolling(F.stddev_samp, x, width, entity=entity, t=t), F.lit(0.0)))


def surge(v: Column | str, width: int, least: int | None = None, **keys) -> Column:
    """A value over the mean of the ``width`` sessions before it."""
    return ratio(col(v), rolling(F.avg, v, width, least, end=1, **keys))


def volume_zscore(v: Column | str, width: int, least: int | None = None, **keys) -> Column:
    return ratio(col(v) - rolling(F.avg, v, width, least, **keys), F.nullif(rolling(F.stddev_samp, v, width, least, **keys), F.lit(0.0)))


def amihud(r: Column | str, dvol: Column | str, width: int, least: int | None = None, **keys) -> Column:
    """Mean of absolute return per dollar traded."""
    return rolling(F.avg, ratio(F.abs(col(r)), dvol), width, least, **keys)


def moments(x: Column | str, width: int, least: int = 4, entity: str = "entity", t: str = "t") -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis over the window; null without variance."""
    over = back(entity, t, width)
    x = col(x)
    n = F.count(x).over(over).cast("double")
    s1, s2, s3, s4 = (F.sum(F.pow(x, F.lit(float(p)))).over(over) for p in (1, 2, 3, 4))
    m = s1 / n
    m2, m3 = s2 / n - m * m, s3 / n - 3 * m * s2 / n + 2 * m * m * m
    m4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    spread = F.when(m2 > 1e-20, m2)
    skew = F.sqrt(n * (n - 1)) / (n - 2) * m3 / F.pow(spread, F.lit(1.5))
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (spread * spread) - 3 * (n - 1))
    enough = F.count(x).over(over) >= least
    return F.when(enough, skew), F.when(enough, kurt)


def autoregression(r: Column | str, width: int, least: int, entity: str = "entity", t: str = "t") -> Column:
    """Slope of a return on the one before it over the window."""
    previous = lag_exact(r, 1, entity, t)
    return F.when(F.count(F.when(col(r).isNotNull(), previous)).over(back(entity, t, width)) >= least, _slope(r, previous, back(entity, t, width)))


def _slope(y, x, over: WindowSpec) -> Column:
    both = col(y).isNotNull() & col(x).isNotNull()
    return F.try_divide(F.covar_samp(F.when(both, col(y)), F.when(both, col(x))).over(over), F.var_samp(F.when(both, col(x))).over(over))


def bar_shape(bars: DataFrame, entity: str = "entity", t: str = "t", width: int = 3) -> DataFrame:
    """Overnight gap, move within the bar, place of the close, range and its z-score, compression and inside bars. Gap is known at the open, the rest at the close."""
    before = lambda c: lag_exact(c, 1, entity, t)
    out = bars.withColumns({"gap": ratio("open", before("close")) - 1, "intraday": ratio("close", "open") - 1, "place": ratio(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), "range": ratio(F.col("high") - F.col("low"), "close")})
    out = out.withColumn("inside", (F.col("high") <= before("high")) & (F.col("low") >= before("low")))
    return out.withColumns({"range_z": volume_zscore("range", width, entity=entity, t=t), "compression": ratio("range", rolling(F.avg, "range", width, entity=entity, t=t, end=1))})


def execution_returns(bars: DataFrame, entity: str = "entity", t: str = "t", hold: int = 2) -> DataFrame:
    """Forward returns by convention: ``oc`` open to close, ``co`` close to next open, ``noc`` next open to next close, ``oo`` open to open after ``hold``."""
    ahead = lambda c, k: lag_exact(c, -k, entity, t)
    return bars.withColumns({"oc": ratio("close", "open") - 1, "co": ratio(ahead("open", 1), "close") - 1, "noc": ratio(ahead("close", 1), ahead("open", 1)) - 1, "oo": ratio(ahead("open", 1 + hold), ahead("open", 1)) - 1})


def streaks(df: DataFrame, flag: str, entity: str = "entity", t: str = "t") -> DataFrame:
    """Adds ``streak``: gaps and islands, numbered by the breaks before them."""
    order = Window.partitionBy(entity).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.col(flag), F.lit(False))
    island = F.sum(F.when(held, 0).otherwise(1)).over(order)
    out = df.withColumn("_island", island)
    return out.withColumn("streak", F.sum(F.when(held, 1).otherwise(0)).over(Window.partitionBy(entity, "_island").orderBy(t).rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def prior_events(df: DataFrame, value: str, k: int, entity: str = "entity", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Aggregates of the ``k`` events strictly before: mean, share of positive ones, change, value over their deviation (null with fewer than ``k``)."""
    events = Window.partitionBy(entity).orderBy(*order)
    before = events.rowsBetween(-k, -1)
    full = F.count(F.col(value)).over(before) >= k
    mean = F.when(full, F.avg(value).over(before))
    positive = F.when(full, F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).over(before))
    deviation = F.when(full, F.stddev_samp(value).over(before))
    return df.withColumns({"prior_mean": mean, "prior_positive": positive, "change": F.col(value) - F.lag(value).over(events), "standardized": ratio(F.col(value), F.nullif(deviation, F.lit(0.0)))})


def equity_curve(stream: DataFrame, value: str = "ret", order: str = "t", *by: str) -> DataFrame:
    """Compounded ``equity``, its running ``peak`` and ``drawdown`` (at most 0) of a date-level stream."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = stream.withColumn("equity", F.exp(F.sum(growth_log(value)).over(upto)))
    out = out.withColumn("peak", F.max("equity").over(upto))
    return out.withColumn("drawdown", ratio("equity", F.greatest("peak", F.lit(1.0))) - 1)


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Turn of month and quarter, day of week and month of a date."""
    d = F.col(date)
    return df.withColumns({"month_of_year": F.month(d), "day_of_week": F.weekday(d), "is_month_end": d == F.last_day(d), "is_quarter_end": (d == F.last_day(d)) & (F.month(d) % 3 == 0), "days_to_month_end": F.datediff(F.last_day(d), d), "turn_of_month": (F.dayofmonth(d) <= 3) | (F.datediff(F.last_day(d), d) < 1)})


def seasonality(df: DataFrame, r: str = "ret", entity: str = "entity", month: str = "month_idx") -> DataFrame:
    """Mean and share of gains of the same calendar month in the years before."""
    before = Window.partitionBy(entity, F.col(month) % 12).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"season_mean": F.avg(r).over(before), "season_win": F.avg(F.when(F.col(r) > 0, 1.0).when(F.col(r).isNotNull(), 0.0)).over(before)})


def forward_excess(df: DataFrame, horizon: int, entity: str = "entity", t: str = "t", price: str = "close", bench: str = "bench") -> DataFrame:
    """``fwd``, ``fwd_bench``, ``fwd_excess`` and whether it is positive; null where the horizon isn't reached."""
    out = df.withColumns({"fwd": forward_return(price, horizon, entity, t), "fwd_bench": forward_return(bench, horizon, entity, t)})
    return out.withColumn("fwd_excess", F.col("fwd") - F.col("fwd_bench")).withColumn("outperforms", F.col("fwd_excess") > 0)
