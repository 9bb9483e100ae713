"""Per-entity forecasts as windows over every origin at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio


def forecasts(px: DataFrame, width: int, horizons: int, entity: str = "entity", t: str = "t", price: str = "close") -> DataFrame:
    """``entity, t, h, model, forecast``: drift of log returns, naive, drift from the mean price, and linear trend, from the ``width`` rows up to t."""
    order = Window.partitionBy(entity).orderBy(t)
    over = order.rowsBetween(1 - width, 0)
    df = px.withColumns({"_n": F.row_number().over(order), "_r": F.log(F.col(price) / F.lag(price).over(order))})
    df = df.withColumns({"_c": F.count("_r").over(over), "_mu": F.avg("_r").over(over), "_sma": F.avg(price).over(over), "_slope": F.regr_slope(F.col(price), F.col("_n").cast("double")).over(over), "_mid": F.avg("_n").over(over)}).where(F.col("_c") >= width)
    df = df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    models = {"drift": F.col(price) * F.exp(F.col("_mu") * F.col("h")), "naive": F.col(price), "sma": F.col(price) + (F.col("_sma") - F.col(price)) * F.col("h") / horizons, "linear": F.col("_sma") + F.col("_slope") * (F.col("_n") + F.col("h") - F.col("_mid"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("forecast")) for k, v in models.items()]))
    return df.select(entity, t, F.col(price), "h", each.alias("x")).select(entity, t, price, "h", "x.*")


def replay(px: DataFrame, width: int, horizons: int, entity: str = "entity", t: str = "t", price: str = "close") -> DataFrame:
    """The ensemble at every origin: mean, median, agreement in direction, and a recommendation from both."""
    last = forecasts(px, width, horizons, entity, t, price).where(F.col("h") == horizons)
    up = (F.col("forecast") > F.col(price)).cast("double")
    out = last.groupBy(entity, t).agg(F.max(price).alias(price), F.avg("forecast").alias("mean"), F.percentile("forecast", F.lit(0.5)).alias("median"), F.avg(up).alias("up"))
    change = ratio("median", price) - 1
    return out.withColumn("change", change).withColumn("recommendation", F.when((change > 0.01) & (F.col("up") >= 0.5), "BUY").when((change < -0.01) & (F.col("up") <= 0.5), "SELL").otherwise("HOLD"))


def business_days(last: DataFrame, n: int, date: str = "date") -> DataFrame:
    """``date, forecast_date``: the n business days after a date."""
    days = F.sequence(F.date_add(date, 1), F.date_add(date, 2 * n + 5))
    work = F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)
    return last.select(date, F.explode(work).alias("forecast_date"))
