"""Queries of file and payload readers: each writes what the tables hold in a vendor's form, with faults, and reads it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import tables as T
from tidemark.plans.base import prices, register, scratch
from tidemark.sources import panels

DAY = "CAST(date AS VARCHAR)"


def vendor_rows(spark, sf):
    """Daily prices under a vendor's names; every second row comes again, older and doubled, and some prices are no numbers or negative."""
    px = panels.daily_prices(spark, sf)
    price = F.when(F.col("n") % 4 == 3, F.lit("n/a")).when(F.col("n") % 4 == 2, (-F.col("close")).cast("string")).otherwise(F.col("close").cast("string"))
    rows = px.select(F.concat(F.lit(" sym"), F.col("entity").cast("string")).alias("Symbol"), F.col("date").cast("string").alias("Date"), price.alias("Adj Close"), F.lit(2).alias("Vol"))
    again = px.where("entity % 2 = 0 and n % 4 < 2").select(F.concat(F.lit("sym"), F.col("entity").cast("string")).alias("Symbol"), F.col("date").cast("string").alias("Date"), (F.col("close") * 2).cast("string").alias("Adj Close"), F.lit(1).alias("Vol"))
    return rows.unionByName(again)


@register("s4_tolerant_prices", f"SELECT 'SYM' || entity AS ticker, {DAY} AS date, close AS adj_close FROM px_d WHERE n % 4 NOT IN (2, 3)", "adj_close")
def s4(spark, sf):
    at = scratch(spark, "prices")
    vendor_rows(spark, sf).write.option("header", True).csv(at)
    return T.read_prices(spark, at).select("ticker", F.col("date").cast("string").alias("date"), "adj_close")


@register("s5_normalized_columns", f"SELECT 'SYM' || entity AS ticker, {DAY} AS date, CASE WHEN n % 3 = 0 THEN NULL ELSE close END AS adj_close, CAST(n AS DOUBLE) AS volume FROM px_d", "adj_close volume")
def s5(spark, sf):
    px = panels.daily_prices(spark, sf)
    raw = px.select(F.concat(F.lit("sym"), F.col("entity").cast("string"), F.lit(" ")).alias("Code"), F.col("date").cast("string").alias("Datetime"), F.when(F.col("n") % 3 == 0, "-").otherwise(F.col("close").cast("string")).alias("Close"), F.col("n").cast("string").alias("Volume"))
    return T.normalized_columns(raw).select("ticker", F.col("date").cast("string").alias("date"), "adj_close", "volume")


@register("s6_import_with_rejects", "SELECT layout, reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN round(close, 4) END) AS total FROM (SELECT CASE WHEN entity % 2 = 0 THEN 'bracketed' ELSE 'day_first' END AS layout, close, CASE WHEN n % 5 = 4 THEN 'bad_date' WHEN n % 5 = 3 THEN 'bad_price' WHEN n % 5 = 2 THEN 'not_positive' END AS reason FROM px_d) GROUP BY 1, 2", "total")
def s6(spark, sf):
    px = panels.daily_prices(spark, sf)
    price = F.when(F.col("n") % 5 == 3, "none").when(F.col("n") % 5 == 2, "-1").otherwise(F.col("close").cast("string"))
    day = lambda pattern: F.when(F.col("n") % 5 == 4, "soon").otherwise(F.date_format("date", pattern))
    a, b = scratch(spark, "bracketed"), scratch(spark, "day-first")
    px.where("entity % 2 = 0").select(F.col("entity").alias("<TICKER>"), day("yyyyMMdd").alias("<DATE>"), price.alias("<CLOSE>")).write.option("header", True).csv(a)
    px.where("entity % 2 = 1").select(F.col("entity").alias("Symbol"), day("dd.MM.yyyy").alias("Date"), price.alias("Price"), F.lit("x").alias("Note")).write.option("header", True).csv(b)
    found = T.import_prices(spark, [a, b])
    return found.groupBy("layout", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("reason").isNull(), F.round("close", 4))).alias("total"))


@register("s7_statements", "SELECT 'C' || entity AS id, CAST(period_end AS VARCHAR) AS period_end, 'Q' || quarter(period_end) AS fiscal_period, value AS revenue FROM facts", "revenue")
def s7(spark, sf):
    at = scratch(spark, "statements")
    f = panels.facts(spark, sf)
    f.select(F.concat(F.lit("C"), F.col("entity").cast("string")).alias("Ticker"), F.col("period_end").cast("string").alias("Report Date"), F.concat(F.lit("Q"), F.quarter("period_end")).alias("Fiscal Period"), F.col("value").alias("Revenue"), F.lit("EUR").alias("Currency")).write.option("header", True).option("sep", ";").csv(at)
    return T.read_statements(spark, at, {"Ticker": "id", "Report Date": "period_end", "Fiscal Period": "fiscal_period", "Revenue": "revenue", "Missing": "missing"})


@register("s8_macro_by_month", "SELECT strftime(date, '%Y-%m') AS month, arg_max(v, date) AS value FROM (SELECT date, CAST(sum(n) AS DOUBLE) AS v FROM px_d GROUP BY date) WHERE v % 5 <> 0 GROUP BY 1", "value")
def s8(spark, sf):
    at = scratch(spark, "macro")
    daily = panels.daily_prices(spark, sf).groupBy("date").agg(F.sum("n").alias("v"))
    daily.select(F.col("date").cast("string").alias("observation_date"), F.when(F.col("v") % 5 == 0, ".").otherwise(F.col("v").cast("string")).alias("DGS10")).write.option("header", True).csv(at)
    return T.read_macro(spark, at, "DGS10")


@register("s9_company_facts", "SELECT 'c' || entity AS ticker, 'Revenues' AS concept, 'USD' AS unit, CAST(period_end AS VARCHAR) AS end, CAST(available_date AS VARCHAR) AS filed, value FROM facts", "value")
def s9(spark, sf):
    """A nested document a company, in which every figure is filed again later and changed."""
    f = panels.facts(spark, sf)
    first = F.struct(F.col("period_end").cast("string").alias("end"), F.col("available_date").cast("string").alias("filed"), F.lit("10-Q").alias("form"), F.col("value").alias("val"))
    later = F.struct(F.col("period_end").cast("string").alias("end"), F.date_add("available_date", 90).cast("string").alias("filed"), F.lit("10-Q/A").alias("form"), (F.col("value") * 1.1).alias("val"))
    obs = F.flatten(F.collect_list(F.array(later, first)))  # a company's filings are few
    docs = f.groupBy("entity").agg(obs.alias("o")).select(F.concat(F.lit("c"), F.col("entity").cast("string")).alias("ticker"), F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("o")).alias("units")))).alias("facts"))).alias("doc"))
    return T.read_company_facts(docs, "doc").select("ticker", "concept", "unit", F.col("end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), "value")


@register("s10_vendor_events", "SELECT 'u' || entity AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS announced, CAST(k AS DOUBLE) AS estimate, value AS actual, value - k AS surprise FROM evt", "estimate actual surprise")
def s10(spark, sf):
    """Events as three vendors' payloads, with numbers as strings."""
    e = panels.user_events(spark, sf)
    day, estimate, actual = F.to_date("ts").cast("string"), F.col("k").cast("string"), F.col("value").cast("string")
    shapes = [("reportedDate", "estimatedEPS", "reportedEPS"), ("period", "estimate", "actual"), ("date", "epsEstimated", "eps")]
    payloads = [F.to_json(F.struct(day.alias(a), estimate.alias(b), actual.alias(c))) for a, b, c in shapes]
    i = F.pmod("event_id", F.lit(3))
    docs = e.select(F.concat(F.lit("u"), F.col("entity").cast("string")).alias("ticker"), F.when(i == 0, payloads[0]).when(i == 1, payloads[1]).otherwise(payloads[2]).alias("doc"))
    return T.read_events(docs, "doc").withColumn("announced", F.col("announced").cast("string"))


@register("s11_news_records", "SELECT 'U' || entity AS ticker, CAST(CAST(ts AS DATE) + 1 AS VARCHAR) AS available_date, value AS feature FROM evt WHERE value IS NOT NULL", "feature")
def s11(spark, sf):
    """A document a user and day, with an item an event."""
    e = panels.user_events(spark, sf)
    item = F.struct(F.date_format(F.to_date("ts"), "yyyyMMdd'T'HHmmss").alias("time_published"), F.array(F.struct(F.concat(F.lit("u"), F.col("entity").cast("string")).alias("ticker"), F.col("value").cast("string").alias("score"))).alias("ticker_sentiment"))
    docs = e.groupBy("entity", F.to_date("ts").alias("d")).agg(F.collect_list(item).alias("feed")).select(F.to_json(F.struct("feed")).alias("doc"))
    return T.read_news(docs, "doc").withColumn("available_date", F.col("available_date").cast("string"))


@register("s13_cached_columns", f"SELECT entity, {DAY} AS date, close FROM px_d", "close")
def s13(spark, sf):
    wide, cache = scratch(spark, "wide"), scratch(spark, "cache")
    panels.daily_prices(spark, sf).withColumns({f"unused_{i}": F.lit(i) for i in range(8)}).write.option("header", True).csv(wide)
    return T.cached_columns(spark, wide, {"entity": "bigint", "date": "date", "close": "double"}, cache).withColumn("date", F.col("date").cast("string"))


@register("s18_published_report", "SELECT t, count(*) AS names, sum(n) AS trades FROM px_m GROUP BY t", "")
def s18(spark, sf):
    report = prices(spark, sf).groupBy("t").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("trades"))
    at = scratch(spark, "report")
    T.publish(report.limit(1), at)
    return T.publish(report, at)


@register("p1_valid_prices", "SELECT entity, t, close FROM px_m WHERE n % 4 < 2", "close")
def p1(spark, sf):
    """Finite, positive prices; a quarter of the rows has none, and another a price below zero."""
    faulty = F.when(F.col("n") % 4 == 2, F.lit(float("nan"))).when(F.col("n") % 4 == 3, -F.col("close")).otherwise(F.col("close"))
    return T.price_series(prices(spark, sf).withColumn("close", faulty), ["entity", "t"], "close", "n").select("entity", "t", "close")


@register("p24_column_classes", "SELECT unnest(['entity', 'period_end', 'value', 'available_date']) AS name, unnest(['key', 'value', 'value', 'known_at']) AS class, unnest([count(entity), count(period_end), count(value), count(available_date)]) AS present, unnest([count(entity), count(period_end), count(value), count(available_date)]) / count(*) AS share FROM facts", "share")
def p24(spark, sf):
    return T.column_classes(panels.facts(spark, sf))


@register("p24_revision_proxy", "SELECT event_id, d AS acceleration, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT event_id, value - k - lag(value - k) OVER (PARTITION BY entity ORDER BY ts, event_id) AS d FROM evt) WHERE d IS NOT NULL", "acceleration")
def p24_proxy(spark, sf):
    events = panels.user_events(spark, sf).withColumn("surprise", F.col("value") - F.col("k"))
    return T.revision_proxy(events, "surprise").select("event_id", "acceleration", "direction")


@register("j20_common_universe", "SELECT a.t, a.entity, a.mom AS champion, b.ret3 AS challenger, count(*) OVER (PARTITION BY a.t) AS names FROM sig a JOIN (SELECT entity, t, -rev3 AS ret3 FROM sig WHERE rev3 IS NOT NULL) b USING (entity, t) WHERE a.mom IS NOT NULL", "champion challenger")
def j20(spark, sf):
    """Two signals' panels on exactly the dates and names that both have."""
    from tidemark.plans.base import signals

    s = signals(spark, sf)
    champion, challenger = s.where("mom is not null").select("entity", "t", F.col("mom").alias("champion")), s.where("rev3 is not null").select("entity", "t", (-F.col("rev3")).alias("challenger"))
    return champion.join(challenger, ["entity", "t"]).withColumn("names", F.count(F.lit(1)).over(Window.partitionBy("t")))
