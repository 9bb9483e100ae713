"""Queries of regimes on several axes, driver shocks and cohorts, announcements, blended books and implied shares."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import month_index, ratio
from tidemark.operators import books as B
from tidemark.operators import evaluate as A
from tidemark.operators import events as EV
from tidemark.operators import fundamentals as FU
from tidemark.operators import history as H
from tidemark.operators import joins as J
from tidemark.operators import regimes as R
from tidemark.plans.base import eligible, once, prices, register, signals
from tidemark.plans.data import CUST, cust_months
from tidemark.plans.evaluation import a1
from tidemark.plans.history import SPANS, spans
from tidemark.sources import panels

MARKET = "(SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS t, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS discount, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS tax, CAST(count(*) AS DOUBLE) AS trades FROM lineitem GROUP BY ALL)"


def market(spark, sf):
    """A row a month: the market's price, and three series beside it."""
    mean = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count(F.lit(1))
    rows = panels.table(spark, sf, "lineitem").groupBy(month_index("l_shipdate").alias("t")).agg(mean("l_discount").alias("discount"), mean("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("trades"))
    return panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t").join(rows, "t")


AT = lambda x, k: f"max({x}) OVER (ORDER BY t RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"
TURN = lambda x, lag, up, other: f"CASE WHEN {AT(x, lag)} > {AT(x, lag + 3)} THEN '{up}' WHEN {AT(x, lag)} <= {AT(x, lag + 3)} THEN '{other}' END"
AXES = f"""(SELECT * FROM (SELECT t, unnest(['risk', 'trend', 'volatility', 'inflation', 'rates', 'dollar']) AS axis, unnest([risk, trend, volatility, inflation, rates, dollar]) AS label FROM (
  SELECT t, CASE WHEN bench / max(bench) OVER (ORDER BY t ROWS 11 PRECEDING) - 1 <= -0.1 THEN 'risk_off' ELSE 'risk_on' END AS risk,
    CASE WHEN count(bench) OVER r >= 10 THEN CASE WHEN bench >= avg(bench) OVER r THEN 'above_trend' ELSE 'below_trend' END END AS trend,
    CASE WHEN v IS NOT NULL AND count(v) OVER u >= 12 THEN CASE WHEN v > round(quantile_cont(v, 0.5) OVER u, 12) THEN 'high_vol' ELSE 'low_vol' END END AS volatility,
    {TURN("yoy", 2, "inflation_up", "disinflation")} AS inflation, {TURN("discount", 1, "rates_up", "rates_down")} AS rates, {TURN("tax", 1, "dollar_up", "dollar_down")} AS dollar
  FROM (SELECT *, CASE WHEN count(ret) OVER w >= 6 THEN round(stddev_samp(ret) OVER w, 12) END AS v FROM (SELECT b.*, discount, tax, bench / {AT("bench", 1)} - 1 AS ret, bench / {AT("bench", 12)} - 1 AS yoy FROM bench b JOIN {MARKET} USING (t)) WINDOW w AS (ORDER BY t ROWS 5 PRECEDING))
  WINDOW r AS (ORDER BY t ROWS 9 PRECEDING), u AS (ORDER BY t ROWS UNBOUNDED PRECEDING))) WHERE label IS NOT NULL)"""


def axes(spark, sf):
    year = F.max("bench").over(Window.orderBy("t").rangeBetween(-12, -12))
    series = market(spark, sf).withColumn("yoy", F.col("bench") / year - 1)
    return R.regime_axes(series, "bench", {"inflation": ("yoy", 2, "inflation_up", "disinflation"), "rates": ("discount", 1, "rates_up", "rates_down"), "dollar": ("tax", 1, "dollar_up", "dollar_down")})


@register("e1_six_axes", f"SELECT * FROM {AXES}", "")
def e1_axes(spark, sf):
    """The market's state on six axes, each known at the month."""
    return axes(spark, sf)


@register("e2_ic_by_axis", f"SELECT axis, label, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg((ic > 0)::INT) AS hit FROM ic JOIN {AXES} USING (t) GROUP BY 1, 2", "mean std hit")
def e2_axes(spark, sf):
    ics = a1(spark, sf).join(F.broadcast(axes(spark, sf)), "t")
    return ics.groupBy("axis", "label").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"))


DRIVERS = f"(SELECT t, unnest(['price', 'rates', 'activity']) AS driver, unnest([bench, discount, trades]) AS value FROM bench JOIN {MARKET} USING (t))"
GRID = f"(SELECT t, driver, change, CASE WHEN count(change) OVER w >= 12 THEN (change - avg(change) OVER w) / nullif(stddev_samp(change) OVER w, 0) END AS shock FROM (SELECT *, value / lag(value) OVER (PARTITION BY driver ORDER BY t) - 1 AS change FROM {DRIVERS}) WINDOW w AS (PARTITION BY driver ORDER BY t ROWS 23 PRECEDING))"
BETAS = f"(SELECT s.entity, s.t, driver, change, shock, fwd, CASE WHEN count(x) OVER w >= 8 THEN covar_samp(y, x) OVER w / nullif(var_samp(x) OVER w, 0) END AS beta FROM (SELECT s.entity, s.t, driver, change, shock, fwd, CASE WHEN change IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN change END AS x FROM sig s JOIN {GRID} d USING (t)) s WINDOW w AS (PARTITION BY s.entity, driver ORDER BY s.t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))"


def grid(spark, sf):
    wide = market(spark, sf).select("t", F.col("bench").alias("price"), F.col("discount").alias("rates"), F.col("trades").alias("activity"))
    return R.shock_grid(wide.unpivot(["t"], ["price", "rates", "activity"], "driver", "value"), 24, 12)


@register("e4_shock_grid", f"SELECT * FROM {GRID}", "change shock")
def e4_grid(spark, sf):
    """Changes of three drivers, and their shocks."""
    return grid(spark, sf)


@register("e4_cohorts", f"SELECT driver, cohort, CASE WHEN shock > 1 THEN 'up' WHEN shock < -1 THEN 'down' WHEN shock IS NOT NULL THEN 'calm' END AS state, count(*) AS n, avg(fwd) AS mean, max(round(beta, 6)) AS beta FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY t, driver ORDER BY round(beta, 6), entity) - 1) * 5 / count(beta) OVER (PARTITION BY t, driver)) AS INT) + 1 AS cohort FROM {BETAS} WHERE beta IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1, 2, 3", "mean beta")
def e4_cohorts(spark, sf):
    """Next returns of fifths by sensitivity, in shocks up and down and in calm."""
    shocks = grid(spark, sf)
    betas = R.driver_sensitivities(signals(spark, sf), shocks, 12, 8).withColumn("beta", F.round("beta", 6))
    df = betas.join(signals(spark, sf).select("entity", "t", "fwd"), ["entity", "t"])
    state = F.when(F.col("shock") > 1, "up").when(F.col("shock") < -1, "down").when(F.col("shock").isNotNull(), "calm")
    return R.sensitivity_cohorts(df, "fwd").join(F.broadcast(shocks.drop("change")), ["t", "driver"]).groupBy("driver", "cohort", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean"), F.max("beta").alias("beta"))


#: Quarters as announcements: expected is the quarter of the year before; a customer's prices are those of the supplier with its last digit.
FILED = "(SELECT f.entity, f.period_end, f.available_date, f.value AS actual, p.value AS expected FROM facts f JOIN facts p ON p.entity = f.entity AND p.period_end = last_day(f.period_end - INTERVAL 12 MONTH))"
SCORED = f"""(SELECT *, growth - lag(growth) OVER (PARTITION BY entity ORDER BY period_end) AS acceleration, CAST(sum((surprise > 0)::INT) OVER (PARTITION BY entity, island ORDER BY period_end) AS BIGINT) AS beat_streak FROM (
  SELECT *, 100 * surprise / nullif(abs(expected), 0) AS surprise_pct, surprise / nullif(CASE WHEN count(surprise) OVER p >= 4 THEN stddev_samp(surprise) OVER p END, 0) AS standardized,
    sum((surprise <= 0)::INT) OVER (PARTITION BY entity ORDER BY period_end) AS island, (actual - lag(actual, 4) OVER (PARTITION BY entity ORDER BY period_end)) / nullif(abs(lag(actual, 4) OVER (PARTITION BY entity ORDER BY period_end)), 0) AS growth
  FROM (SELECT *, actual - expected AS surprise FROM {FILED}) WINDOW p AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)))"""
DAILY = "(SELECT entity, date, close, lag(close, 3) OVER w AS past, lead(close, 5) OVER w AS c5, lead(date, 5) OVER w AS d5, lead(close, 20) OVER w AS c20, lead(date, 20) OVER w AS d20 FROM px_d WHERE entity < 10 WINDOW w AS (PARTITION BY entity ORDER BY date))"
LEVEL = "(SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS bench FROM lineitem GROUP BY ALL)"


def level(spark, sf):
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100
    return panels.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((cents / F.sum("l_quantity")).alias("bench"))


TABLE = f"""SELECT s.entity, CAST(s.period_end AS VARCHAR) AS period_end, surprise, surprise_pct, standardized, beat_streak, growth, acceleration,
  CASE WHEN surprise_pct <= -10 THEN 'big_miss' WHEN surprise_pct <= -2 THEN 'miss' WHEN surprise_pct <= 2 THEN 'inline' WHEN surprise_pct <= 10 THEN 'beat' WHEN surprise_pct > 10 THEN 'big_beat' END AS bucket,
  h.code, CAST(d.date AS VARCHAR) AS entry_date, d.close AS entry, d.close / d.past - 1 AS momentum, c5 / d.close - 1 AS return_5, c5 / d.close - 1 - (b5.bench / b.bench - 1) AS excess_5, c20 / d.close - 1 AS return_20, c20 / d.close - 1 - (b20.bench / b.bench - 1) AS excess_20
FROM {SCORED} s LEFT JOIN {SPANS} h ON h.entity = s.entity AND h.valid_from <= s.available_date AND s.available_date < h.valid_to
ASOF LEFT JOIN {DAILY} d ON d.entity = s.entity % 10 AND d.date > s.available_date LEFT JOIN {LEVEL} b ON b.date = d.date LEFT JOIN {LEVEL} b5 ON b5.date = d5 LEFT JOIN {LEVEL} b20 ON b20.date = d20"""


@register("e5_announcement_table", TABLE, "surprise surprise_pct standardized growth acceleration entry momentum return_5 excess_5 return_20 excess_20")
def e5_table(spark, sf):
    """Announcements with surprise, history, the code that held then, and excess returns from the day after on."""
    f = panels.facts(spark, sf)
    year_before = f.select("entity", F.last_day(F.add_months("period_end", 12)).alias("period_end"), F.col("value").alias("expected"))
    filed = f.join(year_before, ["entity", "period_end"]).select("entity", "period_end", "available_date", F.col("value").alias("actual"), "expected")
    scored = once(EV.announcements(filed, "actual", "expected"), "announced")
    coded = H.interval_join(scored, spans(spark, sf), "entity", "available_date", ["code"]).withColumn("px", F.col("entity") % 10)
    px = panels.daily_prices(spark, sf).where("entity < 10")  # the suppliers that stand for the customers
    df = EV.with_returns_after(coded, px, once(level(spark, sf), "level"), [5, 20], "px", "available_date")
    return df.drop("px", "actual", "expected", "available_date").withColumns({"period_end": F.col("period_end").cast("string"), "entry_date": F.col("entry_date").cast("string")})


@register("e5_drift_by_bucket", f"WITH x AS ({TABLE}) SELECT bucket, count(*) AS n, avg(excess_5) AS excess_5, avg(excess_20) AS excess_20, avg((excess_20 > 0)::INT) AS hit FROM x WHERE excess_20 IS NOT NULL GROUP BY bucket", "excess_5 excess_20 hit")
def e5_drift(spark, sf):
    """What follows misses and beats."""
    df = e5_table(spark, sf).where("excess_20 is not null")
    return df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("excess_5").alias("excess_5"), F.avg("excess_20").alias("excess_20"), F.avg((F.col("excess_20") > 0).cast("double")).alias("hit"))


BLEND = "(SELECT *, count(*) OVER (PARTITION BY t) AS common, round(0.7 * (names - row_number() OVER (PARTITION BY t ORDER BY mom DESC, entity)) / (names - 1) + 0.3 * (names - row_number() OVER (PARTITION BY t ORDER BY rev3 DESC, entity)) / (names - 1), 9) AS b FROM el WHERE rev3 IS NOT NULL)"


def blend(spark, sf):
    df = eligible(spark, sf).where("rev3 is not null")
    pct = lambda c: ratio(F.col("names") - F.row_number().over(Window.partitionBy("t").orderBy(F.desc(c), "entity")), F.nullif(F.col("names") - 1, F.lit(0)))
    return df.withColumns({"b": F.round(0.7 * pct("mom") + 0.3 * pct("rev3"), 9), "common": F.count(F.lit(1)).over(Window.partitionBy("t"))})


@register(
    "b8_blended_metrics",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY b, entity DESC) AS low FROM {BLEND}),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY b DESC, entity) AS place FROM (SELECT *, row_number() OVER (PARTITION BY t, sector ORDER BY b DESC, entity) AS g FROM s) WHERE g <= 3) WHERE place <= 8),
n AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM p)), h AS (SELECT p.*, i FROM p JOIN n USING (t)),
w AS (SELECT t, max(c) / sum(c) AS top_sector FROM (SELECT t, sector, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY t),
k AS (SELECT t, round(covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 12) AS ic FROM (SELECT t, common, rank() OVER (PARTITION BY t ORDER BY b) + (count(*) OVER (PARTITION BY t, b) - 1) / 2.0 AS x, rank() OVER (PARTITION BY t ORDER BY fwd) + (count(*) OVER (PARTITION BY t, fwd) - 1) / 2.0 AS y FROM s) WHERE common >= 10 GROUP BY t)
SELECT a.t, a.names, a.common, a.gross, a.gross - l.low AS spread, CASE WHEN a.i = 1 THEN 1.0 ELSE a.new END AS turnover, top_sector, ic
FROM (SELECT h.t, h.i, count(*) AS names, any_value(h.common) AS common, avg(h.fwd) AS gross, avg((o.entity IS NULL)::INT) AS new FROM h LEFT JOIN h o ON o.i = h.i - 1 AND o.entity = h.entity GROUP BY h.t, h.i) a
JOIN (SELECT t, avg(fwd) AS low FROM s WHERE low <= 8 GROUP BY t) l USING (t) JOIN w USING (t) LEFT JOIN k USING (t)""",
    "gross spread turnover top_sector ic",
)
def b8_metrics(spark, sf):
    """The blended book's months: return, spread over the worst by score, turnover, largest sector, and the blend's IC over ten names and more."""
    df = blend(spark, sf)
    book = B.capped_by_group(df, "b", 8, 3, "sector")
    low = df.withColumn("_i", F.row_number().over(Window.partitionBy("t").orderBy("b", F.desc("entity")))).where("_i <= 8").groupBy("t").agg(F.avg("fwd").alias("low"))
    months = book.groupBy("t").agg(F.count(F.lit(1)).alias("names"), F.first("common").alias("common"), F.avg("fwd").alias("gross"))
    sector = book.groupBy("t", "sector").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg((F.max("c") / F.sum("c")).alias("top_sector"))
    turn = B.churn(book.withColumn("side", F.lit(1))).select("t", F.when(F.col("i") == 1, 1.0).otherwise(F.col("new")).alias("turnover"))
    ic = A.rank_ic(df.where("common >= 10"), "b", "fwd").select("t", "ic")
    out = months.join(low, "t").join(sector, "t").join(turn, "t").join(ic, "t", "left")
    return out.select("t", "names", "common", "gross", (F.col("gross") - F.col("low")).alias("spread"), "turnover", "top_sector", "ic")


#: Income a quarter, and income a share as filed fifteen days later; shares are what the two imply.
SHARES = "(SELECT entity, period_end, value AS income, per_share, value / per_share AS shares, period_end + 60 AS available FROM (SELECT f.*, floor(round(f.value * 100) / n) / 100 AS per_share FROM facts f JOIN (SELECT o_custkey AS entity, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end, count(*) AS n FROM orders GROUP BY ALL) USING (entity, period_end)) WHERE abs(per_share) > 0.01 AND value / per_share > 0)"


@register(
    "f6_implied_share_yields",
    f"SELECT p.entity, CAST(p.d AS VARCHAR) AS d, CAST(s.period_end AS VARCHAR) AS period_end, shares, shares * close AS market_value, per_share / close AS earnings_yield, income / (shares * close) AS value_yield FROM {CUST} p LEFT JOIN {SHARES} s ON s.entity = p.entity AND s.available = (SELECT max(x.available) FROM {SHARES} x WHERE x.entity = p.entity AND x.available < p.d) LEFT JOIN px_m m ON m.entity = p.entity % 10 AND m.t = year(p.d) * 12 + month(p.d) - 1",
    "shares market_value earnings_yield value_yield",
)
def f6_yields(spark, sf):
    """Yields a share and in all, of shares implied by income, strictly as known before each probe."""
    f = panels.facts(spark, sf)
    o = panels.table(spark, sf, "orders")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    counts = o.groupBy(F.col("o_custkey").alias("entity"), end.alias("period_end")).agg(F.count(F.lit(1)).alias("n"))
    per_share = f.join(counts, ["entity", "period_end"]).select("entity", "period_end", (F.floor(F.round(F.col("value") * 100) / F.col("n")) / 100).alias("value"), F.date_add("period_end", 60).alias("available_date"))
    shares = FU.implied_shares(f, per_share, ["entity", "period_end"], "value", "available_date")
    df = J.asof(cust_months(spark, sf), shares, "entity", "d", "available_date", ["period_end", "income", "per_share", "shares"], strict=True)
    px = prices(spark, sf).select(F.col("entity").alias("_px"), F.col("t").alias("_t"), "close")
    df = df.join(px, (F.col("entity") % 10 == F.col("_px")) & (month_index("d") == F.col("_t")), "left")
    return FU.share_yields(df, "close").select("entity", F.col("d").cast("string").alias("d"), F.col("period_end").cast("string").alias("period_end"), "shares", "market_value", "earnings_yield", "value_yield")
