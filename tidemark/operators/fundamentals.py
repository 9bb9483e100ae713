"""Fundamentals as they were known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio


def first_reported(facts: DataFrame, keys: list[str], value: str, available: str) -> DataFrame:
    """``keys, value, available, restated``: the first report of each fact, and whether a later one differs."""
    out = facts.groupBy(*keys).agg(F.min_by(value, available).alias(value), F.min(available).alias(available), F.count_distinct(value).alias("_d"))
    return out.select(*keys, value, available, (F.col("_d") > 1).alias("restated"))


def trailing_year(quarters: DataFrame, value: str, entity: str = "entity", end: str = "period_end", available: str = "available_date") -> DataFrame:
    """Adds ``ttm``: four quarters in a row, known when the last of them was; null over a gap. Also ``ttm_growth`` against the year before."""
    order = Window.partitionBy(entity).orderBy(end)
    four = order.rowsBetween(-3, 0)
    whole = (F.count(value).over(four) == 4) & (F.months_between(F.col(end), F.lag(end, 3).over(order)).cast("int") == 9)
    out = quarters.withColumns({"ttm": F.when(whole, F.sum(value).over(four)), "ttm_available": F.when(whole, F.max(available).over(four))})
    before = F.when(F.months_between(F.col(end), F.lag(end, 4).over(order)).cast("int") == 12, F.lag("ttm", 4).over(order))
    return out.withColumn("ttm_growth", ratio(F.col("ttm") - before, F.nullif(F.abs(before), F.lit(0.0))))


def ratio_features(rows: DataFrame, income: str, revenue: str, assets: str, cash: str) -> DataFrame:
    """Margin, return and accruals, and the reasons why any is missing."""
    why = [(F.col(revenue).isNull() | (F.col(revenue) == 0), "no_revenue"), (F.col(assets).isNull() | (F.col(assets) <= 0), "no_assets"), (F.col(cash).isNull(), "no_cash_flow")]
    positive = F.when(F.col(assets) > 0, F.col(assets))
    return rows.withColumns({"margin": ratio(income, F.nullif(F.col(revenue), F.lit(0.0))), "return_on_assets": ratio(income, positive), "accruals": ratio(F.col(income) - F.col(cash), positive), "log_size": F.when(F.col(assets) > 0, F.log(positive)), "warnings": F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in why])), ",")})


def quarters_from_totals(rows: DataFrame, value: str, entity: str = "entity", year: str = "year", quarter: str = "quarter") -> DataFrame:
    """Adds ``single``: year-to-date values less the quarter before; null where that is missing."""
    before = F.max(F.col(value)).over(Window.partitionBy(entity, year).orderBy(quarter).rangeBetween(-1, -1))
    return rows.withColumn("single", F.when(F.col(quarter) == 1, F.col(value)).otherwise(F.col(value) - before))


def merged_statements(statements: dict[str, tuple[DataFrame, str]], keys: list[str], available: str) -> DataFrame:
    """Items of several statements side by side, known when all of those that are there were."""
    parts = [df.select(*keys, F.lit(k).alias("_k"), F.col(v).alias("_v"), F.col(available).alias("_a")) for k, (df, v) in statements.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.first(F.when(F.col("_k") == k, F.col("_v")), ignorenulls=True).alias(k) for k in statements], F.max("_a").alias(available))



def as_filed_factors(merged: DataFrame, factors: dict[str, tuple[Column, Column]], needed: list[str]) -> DataFrame:
    """Factors (``name: (numerator, denominator)``) of statements that have all items needed; they are known when the last of these was."""
    rows = merged.where(" and ".join(f"`{c}` is not null" for c in needed))
    return rows.withColumns({name: ratio(a, F.nullif(b, F.lit(0.0))) for name, (a, b) in factors.items()})


def single_quarters(filed: DataFrame, entity: str = "entity", year: str = "year", quarter: str = "quarter") -> DataFrame:
    """``entity, year, quarter, single, source`` of filed values by ``kind``: a ``clean`` quarter first, then the first quarter's total, then a total less the one before, then the year less three quarters; others can't be told."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    wide = filed.groupBy(entity, year, quarter).agg(pick("clean").alias("_clean"), F.coalesce(pick("total"), pick("annual")).alias("_total"))
    before = F.max("_total").over(Window.partitionBy(entity, year).orderBy(quarter).rangeBetween(-1, -1))
    rows = wide.withColumn("_before", before)
    ways = [("clean", F.col("_clean")), ("first", F.when(F.col(quarter) == 1, F.col("_total"))), ("difference", F.when(F.col(quarter) < 4, F.col("_total") - F.col("_before"))), ("annual_less", F.when(F.col(quarter) == 4, F.col("_total") - F.col("_before")))]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in ways])
    return rows.select(entity, year, quarter, F.coalesce(*[v for _, v in ways]).alias("single"), source.alias("source")).where("single is not null")


def implied_shares(income: DataFrame, per_share: DataFrame, keys: list[str], value: str, available: str, least: float = 0.01) -> DataFrame:
    """``keys, income, per_share, shares, available``: shares as income over income a share of one period, known when both were; none where that is near 0 or the signs differ."""
    a = income.select(*keys, F.col(value).alias("income"), F.col(available).alias("_a"))
    b = per_share.select(*keys, F.col(value).alias("per_share"), F.col(available).alias("_b"))
    both = a.join(b, keys).withColumn("shares", ratio("income", "per_share"))
    return both.where((F.abs("per_share") > least) & (F.col("shares") > 0)).select(*keys, "income", "per_share", "shares", F.greatest("_a", "_b").alias(available))


def share_yields(rows: DataFrame, price: str) -> DataFrame:
    """``rows`` (``income, per_share, shares``) with ``market_value, earnings_yield, value_yield``; null without a price above 0."""
    px = F.when(F.col(price) > 0, F.col(price))
    rows = rows.withColumn("market_value", F.col("shares") * px)
    return rows.withColumns({"earnings_yield": ratio("per_share", px), "value_yield": ratio("income", "market_value")})


def feature_set(rows: DataFrame, entity: str = "entity", end: str = "period_end", available: str = "available", late: int = 45) -> DataFrame:
    """``rows`` (``revenue, income, cash, liabilities, assets`` by period) with ``margin, leverage, growth, cash_conversion, accruals, log_size, filing_lag, warnings``.

    ``growth`` is against the period that ended a year before, if there is one.
    What a feature lacks stands in ``warnings``; a feature without its parts, or
    over nothing, is null. Cash conversion has no meaning without an income
    above 0.
    """
    before = rows.select(F.col(entity), F.last_day(F.add_months(end, 12)).alias(end), F.col("revenue").alias("_before"))
    df = rows.join(before, [entity, end], "left")
    assets = F.when(F.col("assets") > 0, F.col("assets"))
    df = df.withColumns({
        "margin": ratio("income", F.nullif("revenue", F.lit(0.0))), "leverage": ratio("liabilities", assets), "growth": ratio(F.col("revenue") - F.col("_before"), F.nullif(F.abs("_before"), F.lit(0.0))),
        "cash_conversion": ratio("cash", F.when(F.col("income") > 0, F.col("income"))), "accruals": ratio(F.col("income") - F.col("cash"), assets), "log_size": F.log(assets), "filing_lag": F.datediff(available, end),
    })
    why = {"no_assets": assets.isNull(), "no_year_before": F.col("_before").isNull(), "no_income": F.coalesce(F.col("income") <= 0, F.lit(True)), "late": F.col("filing_lag") > late}
    return df.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in why.items()]))).drop("_before")
