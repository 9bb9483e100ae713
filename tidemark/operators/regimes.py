"""Market states known at the time, and what signals do in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio


def market_states(bench: DataFrame, price: str = "bench", t: str = "t", trend: int = 10, vol: int = 6) -> DataFrame:
    """``t, trend, vol_state``: against the moving average, and volatility against the median of all sessions before. A date-level table."""
    dates = Window.orderBy(t)
    df = bench.withColumn("_r", F.col(price) / F.lag(price).over(dates) - 1)
    df = df.withColumn("_v", F.when(F.count("_r").over(dates.rowsBetween(1 - vol, 0)) >= vol, F.stddev_samp("_r").over(dates.rowsBetween(1 - vol, 0))))
    middle = F.percentile("_v", F.lit(0.5)).over(dates.rowsBetween(Window.unboundedPreceding, -1))
    above = F.col(price) >= F.avg(price).over(dates.rowsBetween(1 - trend, 0))
    return df.select(t, F.when(above, "bull").otherwise("bear").alias("trend"), F.when(F.col("_v") > middle, "high_vol").when(F.col("_v").isNotNull() & middle.isNotNull(), "low_vol").otherwise("unknown").alias("vol_state"))


def by_state(stream: DataFrame, states: DataFrame, x: str, state: str, t: str = "t") -> DataFrame:
    """Mean, deviation and count of a stream by state."""
    return stream.join(F.broadcast(states), t).groupBy(state).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def transitions(states: DataFrame, state: str, t: str = "t") -> DataFrame:
    """``before, after, n, share``: how often a state follows another."""
    pairs = states.select(F.lag(state).over(Window.orderBy(t)).alias("before"), F.col(state).alias("after")).where("before is not null")
    return pairs.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("before"))))


def driver_sensitivities(returns: DataFrame, drivers: DataFrame, width: int, least: int, entity: str = "entity", t: str = "t") -> DataFrame:
    """``entity, t, driver, beta, impact``: rolling slope on each driver's change, and times its latest change; all drivers in one windowed pass."""
    rows = returns.select(entity, t, "ret").join(F.broadcast(drivers), t)
    over = Window.partitionBy(entity, "driver").orderBy(t).rangeBetween(1 - width, 0)
    both = F.col("ret").isNotNull() & F.col("change").isNotNull()
    y, x = F.when(both, F.col("ret")), F.when(both, F.col("change"))
    beta = F.when(F.count(x).over(over) >= least, F.try_divide(F.covar_samp(y, x).over(over), F.var_samp(x).over(over)))
    return rows.withColumn("beta", beta).select(entity, t, "driver", "beta", (F.col("beta") * F.col("change")).alias("impact"))


def macro_pack(series: DataFrame, x: str, width: int, least: int, t: str = "t") -> DataFrame:
    """``t, x, change, threshold, above``: a date-level series with its change and its trailing median, from ``least`` dates on."""
    order = Window.orderBy(t)
    back = order.rowsBetween(-(width - 1), 0)
    threshold = F.when(F.count(x).over(back) >= least, F.percentile(F.col(x), F.lit(0.5)).over(back))
    return series.select(t, x, (F.col(x) / F.lag(x).over(order) - 1).alias("change"), threshold.alias("threshold")).withColumn("above", F.col(x) >= F.col("threshold"))


def event_grid(grid: DataFrame, x: str, known: str, d: str, days: int, large: float, entity: str = "entity") -> DataFrame:
    """A grid whose as-of events count for ``days``: ``has_event``, ``large``, and ``ever_large``, which stays from the first large one on."""
    fresh = F.when(F.datediff(d, known) <= days, F.col(x))
    rows = grid.withColumn("_x", fresh).withColumns({"has_event": F.col("_x").isNotNull(), "large": F.coalesce(F.col("_x") > large, F.lit(False))})
    return rows.withColumn("ever_large", F.max("large").over(Window.partitionBy(entity).orderBy(d))).drop("_x")


def price_context(panel: DataFrame, bench: DataFrame, momentum: int, width: int, least: int, stress: float, entity: str = "entity", t: str = "t") -> DataFrame:
    """``entity, t, mom<k>, vol, liquidity, stressed`` of every panel row; joined to events by equality."""
    from tidemark.operators import windows as W

    down = bench.select(t, (F.col("bench") / F.max("bench").over(Window.orderBy(t).rangeBetween(-(width - 1), 0)) - 1).alias("_down"))
    back = lambda k: Window.partitionBy(entity).orderBy(t).rangeBetween(-(k - 1), 0)
    vol = F.when(F.count("ret").over(back(width)) >= least, F.stddev_pop("ret").over(back(width)))
    rows = panel.withColumns({f"mom{momentum}": W.trailing_return("close", momentum), "vol": vol, "liquidity": F.avg("dvol").over(back(6))})
    return rows.join(F.broadcast(down), t).select(entity, t, f"mom{momentum}", "vol", "liquidity", (F.col("_down") <= stress).alias("stressed"))


def _back(x: str, k: int, t: str):
    """The value exactly ``k`` sessions ago, in a date-level table."""
    return F.max(x).over(Window.orderBy(t).rangeBetween(-k, -k))


def regime_axes(series: DataFrame, price: str, macros: dict[str, tuple[str, int, str, str]], t: str = "t", risk_off: float = -0.1, trend: int = 10, vol: int = 6, history: int = 12, change: int = 3) -> DataFrame:
    """``t, axis, label`` of a date-level table: risk, trend and volatility of its ``price``, and the direction of each of ``macros`` (axis: column, lag, name when up, name when not).

    Risk is off below a share of the year's peak; the trend is the average of
    ``trend`` sessions; volatility is high above the median of all sessions up
    to then, of which there must be ``history``; a macro is read ``lag`` sessions
    late, against ``change`` sessions before that. Where a rule has too little
    behind it there is no row. Nothing after a session is read.
    """
    dates = Window.orderBy(t)
    back = lambda k: dates.rowsBetween(1 - k, 0)
    df = series.withColumn("_r", F.col(price) / _back(price, 1, t) - 1)
    df = df.withColumn("_v", F.when(F.count("_r").over(back(vol)) >= vol, F.round(F.stddev_samp("_r").over(back(vol)), 12)))
    upto = dates.rowsBetween(Window.unboundedPreceding, 0)
    middle = F.when(F.count("_v").over(upto) >= history, F.round(F.percentile("_v", F.lit(0.5)).over(upto), 12))
    fall = F.col(price) / F.max(price).over(back(12)) - 1
    axes = {
        "risk": F.when(fall <= risk_off, "risk_off").otherwise("risk_on"),
        "trend": F.when(F.count(price).over(back(trend)) >= trend, F.when(F.col(price) >= F.avg(price).over(back(trend)), "above_trend").otherwise("below_trend")),
        "volatility": F.when(middle.isNotNull() & F.col("_v").isNotNull(), F.when(F.col("_v") > middle, "high_vol").otherwise("low_vol")),
    }
    for axis, (x, lag, up, other) in macros.items():
        now, before = _back(x, lag, t), _back(x, lag + change, t)
        axes[axis] = F.when(now.isNotNull() & before.isNotNull(), F.when(now > before, up).otherwise(other))
    wide = df.select(t, *[c.alias(name) for name, c in axes.items()])
    return wide.unpivot([t], list(axes), "axis", "label").where("label is not null")


def shock_grid(drivers: DataFrame, width: int, least: int, t: str = "t") -> DataFrame:
    """``t, driver, change, shock``: each driver's change, and how many deviations it is from its trailing mean; a row a date and driver."""
    by = Window.partitionBy("driver").orderBy(t)
    back = by.rowsBetween(1 - width, 0)
    df = drivers.withColumn("change", F.col("value") / F.lag("value").over(by) - 1)
    enough = F.count("change").over(back) >= least
    shock = F.when(enough, ratio(F.col("change") - F.avg("change").over(back), F.nullif(F.stddev_samp("change").over(back), F.lit(0.0))))
    return df.withColumn("shock", shock).select(t, "driver", "change", "shock")


def sensitivity_cohorts(betas: DataFrame, y: str, groups: int = 5, t: str = "t", entity: str = "entity") -> DataFrame:
    """``betas`` with ``cohort``, the group (from 1) of a name's sensitivity among those of its date and driver; ties go by entity."""
    by = Window.partitionBy(t, "driver")
    place, n = F.row_number().over(by.orderBy("beta", entity)), F.count("beta").over(by)
    return betas.where(F.col("beta").isNotNull() & F.col(y).isNotNull()).withColumn("cohort", (F.floor((place - 1) * groups / n) + 1).cast("int"))
