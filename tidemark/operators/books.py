"""Book construction, turnover, costs and performance, as tables of holdings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import growth_log, ordinal_rank, ratio, safe_corr


def legs(df: DataFrame, x: str, q: float | None = None, k: int | None = None, *by: str, date: str = "t", entity: str = "entity") -> DataFrame:
    """The top (``side`` 1) and bottom (-1) rows of each date: ``q`` of the names, or ``k``; ties go by entity."""
    keys = (*by, date)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    size = F.lit(k) if k else F.greatest(F.lit(1), F.floor(n * q))
    placed = df.where(F.col(x).isNotNull()).withColumns({"_i": ordinal_rank(x, entity, *keys), "_k": size, "_n": n})
    side = F.when(F.col("_i") > F.col("_n") - F.col("_k"), 1).when(F.col("_i") <= F.col("_k"), -1)
    return placed.withColumn("side", side).where(F.col("side").isNotNull()).drop("_i", "_k", "_n")


def numbered(book: DataFrame, *by: str, date: str = "t") -> DataFrame:
    """Adds ``i``, the place of the rebalance among those kept."""
    return book.withColumn("i", F.dense_rank().over(Window.partitionBy(*by).orderBy(date))) if by else book.join(F.broadcast(book.select(date).distinct().withColumn("i", F.row_number().over(Window.orderBy(date)))), date)


def churn(book: DataFrame, date: str = "t", entity: str = "entity") -> DataFrame:
    """``date, i, side, new``: the share of a leg that the rebalance before didn't hold."""
    held = numbered(book, date=date).select(date, "i", "side", entity)
    before = F.lag("i").over(Window.partitionBy("side", entity).orderBy("i"))
    new = F.when(before == F.col("i") - 1, 0.0).otherwise(1.0)
    return held.withColumn("_new", new).groupBy(date, "i", "side").agg(F.avg("_new").alias("new"))


def long_short(book: DataFrame, y: str = "fwd", date: str = "t", entity: str = "entity", first: float | None = 1.0) -> DataFrame:
    """``date, i, gross, turnover``: long less short mean, and the mean of both legs' churn; ``first`` at the start."""
    gross = book.groupBy(date).agg((F.avg(F.when(F.col("side") == 1, F.col(y))) - F.avg(F.when(F.col("side") == -1, F.col(y)))).alias("gross"))
    turn = churn(book, date, entity).groupBy(date, "i").agg(F.avg("new").alias("turnover"))
    return gross.join(turn, date).withColumn("turnover", F.when(F.col("i") == 1, F.lit(first).cast("double")).otherwise(F.col("turnover")))


def net_of_costs(stream: DataFrame, bps: list[float], legs_charged: int = 2) -> DataFrame:
    """The stream net of each cost: gross - legs * cost * turnover."""
    return stream.withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in bps]))).withColumn("net", F.col("gross") - legs_charged * F.col("bps") / 1e4 * F.coalesce("turnover", F.lit(0.0)))


def break_even(stream: DataFrame) -> DataFrame:
    """Mean gross and turnover, and the cost in basis points at which nothing is left."""
    return stream.agg(F.avg("gross").alias("gross"), F.avg("turnover").alias("turnover")).withColumn("break_even_bps", ratio("gross", 2 * F.col("turnover")) * 1e4)


def weight_turnover(weights: DataFrame, date: str = "t", entity: str = "entity", half: bool = True) -> DataFrame:
    """``date, turnover``: sum of absolute changes of weights against the rebalance before; all of it at the first."""
    held = numbered(weights, date=date).select(date, "i", entity, "weight")
    dates = held.select(date, "i").distinct()
    before = held.select((F.col("i") + 1).alias("i"), entity, F.col("weight").alias("was")).join(dates.select("i"), "i", "left_semi")
    both = held.select("i", entity, "weight").join(before, ["i", entity], "full")
    moved = both.groupBy("i").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("moved"))
    return dates.join(moved, "i").select(date, (F.col("moved") / (2 if half else 1)).alias("turnover"))


def performance(stream: DataFrame, x: str = "ret", order: str = "t", periods: int = 12, *by: str) -> DataFrame:
    """Annual growth, volatility, Sharpe, Sortino, deepest drawdown (at most 0) and hit rate."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = stream.where(F.col(x).isNotNull()).withColumn("_e", F.exp(F.sum(growth_log(x)).over(upto)))
    e = e.withColumn("_dd", F.col("_e") / F.greatest(F.lit(1.0), F.max("_e").over(upto)) - 1)
    low = F.when(F.col(x) < 0, F.col(x) * F.col(x)).otherwise(0.0)
    out = e.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.sum(growth_log(x)).alias("_g"), F.sqrt(F.avg(low)).alias("_down"), F.min("_dd").alias("max_drawdown"), F.avg((F.col(x) > 0).cast("double")).alias("hit"))
    root = periods**0.5
    return out.select(*by, "n", "max_drawdown", "hit", (F.exp(F.col("_g") * periods / F.col("n")) - 1).alias("cagr"), (F.col("std") * root).alias("vol"), (ratio("mean", F.nullif(F.col("std"), F.lit(0.0))) * root).alias("sharpe"), (ratio("mean", F.nullif(F.col("_down"), F.lit(0.0))) * root).alias("sortino"))


def capped_by_group(df: DataFrame, x: str, n: int, cap: int, group: str, date: str = "t", entity: str = "entity") -> DataFrame:
    """The best ``n`` of each date with at most ``cap`` of a group; a null group isn't capped.

    A name beyond its group's cap never frees a seat, so walking the list is a
    rank within the group, then a rank overall.
    """
    best = [F.col(x).desc(), F.col(entity)]
    inside = F.row_number().over(Window.partitionBy(date, group).orderBy(*best))
    kept = df.where(F.col(x).isNotNull()).withColumn("_g", inside).where((F.col("_g") <= cap) | F.col(group).isNull()).drop("_g")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(date).orderBy(*best))).where(F.col("place") <= n)


def hysteresis(df: DataFrame, x: str, k: int, buffer: float, strategy: str = "strategy", date: str = "t", entity: str = "entity") -> DataFrame:
    """``strategy, date, entity``: books that keep a holding while it stays within the wider band, filled up from the top.

    Today's book depends on yesterday's. Spark ranks, and keeps the band of
    each date only; a strategy's band rows, ``k * (1 + buffer)`` a date, are
    walked in order by one task a strategy.
    """
    band = max(k, int(k * (1 + buffer)))
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(strategy, date).orderBy(F.col(x).desc(), F.col(entity)))).where(F.col("_i") <= band)
    kinds = dict(df.dtypes)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        out = []
        for day, group in rows.sort_values([date, "_i"]).groupby(date, sort=True):
            ranked = list(group[entity])
            stay = [e for e in ranked if e in held][:k]
            held = set(stay) | set([e for e in ranked if e not in held][: k - len(stay)])
            out += [(rows[strategy].iloc[0], day, e) for e in ranked if e in held]
        return pd.DataFrame(out, columns=[strategy, date, entity])

    return placed.select(strategy, date, entity, "_i").groupBy(strategy).applyInPandas(walk, f"{strategy} {kinds[strategy]}, {date} {kinds[date]}, {entity} {kinds[entity]}")


def capped_weights(df: DataFrame, score: str, cap: float, *by: str) -> DataFrame:
    """Adds ``weight``: score shares, cut at ``cap`` with the excess given to the others by score; what can't be placed is cash.

    From the largest score on, a name is cut if its share of what the names
    before it leave reaches the cap, so one ordered pass finds the fixed point
    of cutting and sharing again. Scores are positive.
    """
    over = Window.partitionBy(*by)
    down = over.orderBy(F.desc(score))
    i = F.row_number().over(down) - 1
    rest = F.sum(score).over(down.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumns({"_i": i, "_rest": rest}).withColumn("_full", F.col(score) * (1 - cap * F.col("_i")) >= cap * F.col("_rest"))
    spent = cap * F.sum(F.col("_full").cast("int")).over(over)
    free = F.sum(F.when(~F.col("_full"), F.col(score))).over(over)
    share = F.coalesce(ratio(score, free), F.lit(0.0)) * F.greatest(F.lit(0.0), 1 - spent)
    return out.withColumn("weight", F.when(F.col("_full"), F.lit(cap)).otherwise(share)).drop("_i", "_rest", "_full")


def normalized(df: DataFrame, kind: str, x: str, *by: str, entity: str = "entity") -> DataFrame:
    """Adds ``weight``, summing to one within ``by``: ``equal``, by ``score``, ``inverse`` to x (as for volatility), or ``linear`` by place, the best most."""
    over = Window.partitionBy(*by)
    place = F.row_number().over(over.orderBy(F.col(x).desc(), entity))
    raw = {"equal": F.lit(1.0), "score": F.col(x), "inverse": ratio(F.lit(1.0), F.nullif(F.col(x), F.lit(0.0))), "linear": (F.count(F.lit(1)).over(over) + 1 - place).cast("double")}[kind]
    return df.withColumn("_w", raw).withColumn("weight", ratio("_w", F.sum("_w").over(over))).drop("_w")


def stratified_sample(df: DataFrame, stratum: str, n: int, seed: str, entity: str = "entity") -> DataFrame:
    """``n`` of each stratum by a seeded hash of the entity."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col(entity).cast("string")), 256)
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy(key, entity))).where(F.col("_i") <= n).drop("_i")


def book_risk(book: DataFrame, returns: DataFrame, *by: str, date: str = "t", entity: str = "entity") -> DataFrame:
    """Variance, beta and systematic share of each book's fixed weights; the variance of the weighted sum by date, so no matrix is made. Dates where a name lacks its return are left out."""
    held = book.withColumn("_names", F.count(F.lit(1)).over(Window.partitionBy(*by))).select(*by, entity, "weight", "_names")
    daily = returns.where(F.col("ret").isNotNull() & F.col("bret").isNotNull()).join(held, entity)
    daily = daily.groupBy(*by, date).agg(F.sum(F.col("weight") * F.col("ret")).alias("r"), F.max("bret").alias("b"), F.count(F.lit(1)).alias("c"), F.max("_names").alias("_names")).where("c = _names")
    out = daily.groupBy(*by).agg(F.count(F.lit(1)).alias("dates"), F.var_pop("r").alias("variance"), F.covar_pop("r", "b").alias("_c"), F.var_pop("b").alias("_v"))
    shared = F.when(F.col("dates") > 1, ratio(F.col("_c") * F.col("_c"), F.nullif(F.col("variance") * F.col("_v"), F.lit(0.0))))
    return out.select(*by, "dates", "variance", ratio("_c", F.nullif(F.col("_v"), F.lit(0.0))).alias("beta"), shared.alias("systematic"))


def attribution_of_exits(book: DataFrame, panel: DataFrame, date: str = "t", entity: str = "entity") -> DataFrame:
    """``date, reason, n``: why names left a leg: no row, no member any more, or outranked."""
    held = numbered(book, date=date).select(date, "i", "side", entity)
    dates = held.select("i", F.col(date).alias("now")).distinct()
    gone = held.select((F.col("i") + 1).alias("i"), "side", entity).join(held.drop(date), ["i", "side", entity], "left_anti").join(dates, "i")
    state = panel.select(F.col(date).alias("now"), entity, "member")
    reason = F.when(F.col("member").isNull(), "missing_price").when(~F.col("member"), "left_membership").otherwise("rank_crossing")
    return gone.join(state, ["now", entity], "left").groupBy(F.col("now").alias(date), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def liquidity(book: DataFrame, adv: str, weight: str, capital: float, participation: float) -> DataFrame:
    """Adds ``days`` to liquidate and a bucket of them."""
    days = ratio(F.abs(F.col(weight)) * capital, F.nullif(F.col(adv) * participation, F.lit(0.0)))
    return book.withColumn("days", days).withColumn("bucket", F.when(days.isNull(), "unknown").when(days <= 1, "1d").when(days <= 5, "5d").when(days <= 20, "20d").otherwise("over"))


def metric_battery(stream: DataFrame, ladder: list[int], date: str = "t") -> DataFrame:
    """By cost in basis points a side: months, mean, yearly Sharpe ratio, hit rate, the thirds of the history, and the mean without the best month; ``stream`` has a row a date."""
    rows = stream.withColumns({"_third": F.ntile(3).over(Window.orderBy(date)), "_best": F.max("gross").over(Window.partitionBy())})
    rows = rows.withColumn("bps", F.explode(F.array(*map(F.lit, ladder)))).withColumn("net", F.col("gross") - 2 * F.col("turnover") * F.col("bps") / 10000.0)
    part = lambda c: F.avg(F.when(c, F.col("net")))
    names = ("first_third", "second_third", "last_third")
    return rows.groupBy("bps").agg(
        F.count(F.lit(1)).alias("months"), F.avg("net").alias("mean"), (ratio(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0))) * F.sqrt(F.lit(12.0))).alias("sharpe"), F.avg((F.col("net") > 0).cast("double")).alias("hit"),
        *[part(F.col("_third") == i + 1).alias(c) for i, c in enumerate(names)], part(F.col("gross") < F.col("_best")).alias("without_best"),
    )
