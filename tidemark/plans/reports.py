"""Reports: a signal by slices and deciles, direction scores with class and confidence, exposures of books, candidates, and repaired factors measured again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import month_index, ratio
from tidemark.operators import books as B
from tidemark.operators import evaluate as A
from tidemark.operators import fundamentals as FU
from tidemark.operators import joins as J
from tidemark.operators import models as M
from tidemark.operators import tables as T
from tidemark.operators import windows as W
from tidemark.plans.analytics import STATE, e1
from tidemark.plans.base import eligible, prices, register, signals
from tidemark.plans.data import CUST, cust_months
from tidemark.plans.models import STATUS, items
from tidemark.sources import panels

RANKED = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
AGED = f"(SELECT e.*, trend, ntile_, age FROM el e JOIN {STATE} USING (t) JOIN (SELECT entity, t, CAST(floor((row_number() OVER (PARTITION BY t ORDER BY dvol, entity) - 1) * 3 / count(*) OVER (PARTITION BY t)) AS INT) AS ntile_ FROM el) USING (entity, t) JOIN (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t) AS age FROM px_m) USING (entity, t))"
SLICED = f"(SELECT t, entity, mom, fwd, unnest(['all', 'year', 'sector', 'state', 'liquidity', 'history']) AS kind, unnest(['all', CAST(t // 12 AS VARCHAR), CAST(sector AS VARCHAR), trend, CAST(ntile_ AS VARCHAR), CASE WHEN age > 24 THEN 'long' ELSE 'short' END]) AS slice FROM {AGED})"


@register(
    "a26_a21_slice_report",
    f"""WITH r AS (SELECT *, {RANKED.format(by="kind, slice, t", x="mom")} AS a, {RANKED.format(by="kind, slice, t", x="fwd")} AS b, row_number() OVER (PARTITION BY kind, slice, t ORDER BY mom, entity) AS i, count(*) OVER (PARTITION BY kind, slice, t) AS n FROM {SLICED}),
d AS (SELECT kind, slice, t, any_value(n) AS n, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic, avg(fwd) FILTER (i > n - greatest(1, n // 5)) - avg(fwd) FILTER (i <= greatest(1, n // 5)) AS spread FROM r GROUP BY 1, 2, 3)
SELECT kind, slice, CAST(sum(n) AS BIGINT) AS rows, count(*) AS dates, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t_stat, avg((ic > 0)::INT) AS hit, avg(spread) AS spread FROM d GROUP BY 1, 2""",
    "mean_ic t_stat hit spread",
)
def a26_slices(spark, sf):
    """A signal in all, by year, sector, market state, liquidity and length of history, in one pass: names are ranked within their slice of a month."""
    by = Window.partitionBy("t")
    third = F.floor((F.row_number().over(by.orderBy("dvol", "entity")) - 1) * 3 / F.count(F.lit(1)).over(by)).cast("int")
    age = prices(spark, sf).select("entity", "t", F.row_number().over(Window.partitionBy("entity").orderBy("t")).alias("age"))
    df = eligible(spark, sf).withColumn("third", third).join(age, ["entity", "t"]).join(F.broadcast(e1(spark, sf)), "t")
    history = F.when(F.col("age") > 24, "long").otherwise("short")
    slices = {"all": F.lit("all"), "year": F.floor(F.col("t") / 12).cast("string"), "sector": F.col("sector").cast("string"), "state": F.col("trend"), "liquidity": F.col("third").cast("string"), "history": history}
    return A.slice_report(df, slices, "mom", "fwd")


@register("a26_deciles", "SELECT decile, count(*) AS rows, avg(fwd) AS mean, median(fwd) AS median, avg(mom) AS score, avg((fwd > 0)::INT) AS hit FROM (SELECT *, CAST(floor((ox - 1) * 10 / names) AS INT) AS decile FROM rk) GROUP BY decile", "mean median score hit")
def a26_deciles(spark, sf):
    """Next returns by tenth of the signal."""
    from tidemark.functions.stats import ordinal_rank

    df = eligible(spark, sf).withColumn("decile", F.floor((ordinal_rank("mom", "entity", "t") - 1) * 10 / F.col("names")).cast("int"))
    return df.groupBy("decile").agg(F.count(F.lit(1)).alias("rows"), F.avg("fwd").alias("mean"), F.median("fwd").alias("median"), F.avg("mom").alias("score"), F.avg((F.col("fwd") > 0).cast("double")).alias("hit"))


FEATS = "(SELECT s.entity, s.t, ret, mom, CASE WHEN count(close) OVER ten >= 6 THEN close / avg(close) OVER ten - 1 END AS gap, CASE WHEN count(ret) OVER six >= 4 THEN stddev_samp(ret) OVER six END AS vol, close / max(close) OVER year_ - 1 AS fall FROM sig s WINDOW ten AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), six AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), year_ AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))"


@register(
    "q10_direction_calls",
    f"""SELECT entity, t, signal, coverage, CASE WHEN signal IS NULL THEN 'INSUFFICIENT_DATA' WHEN signal >= 0.15 THEN 'UP' WHEN signal <= -0.15 THEN 'DOWN' ELSE 'NEUTRAL' END AS class,
  CASE WHEN signal IS NULL THEN 0.05 ELSE least(greatest((0.15 + 0.45 * abs(signal)) * (0.5 + 0.5 * coverage), 0.05), 0.6) END AS confidence,
  CASE WHEN gap IS NULL AND vol IS NULL THEN 'unknown' WHEN gap > 0 AND NOT coalesce(vol > 0.5, false) AND NOT coalesce(fall < -0.3, false) THEN 'risk_on' WHEN gap <= 0 AND (coalesce(vol > 0.5, false) OR coalesce(fall < -0.3, false)) THEN 'risk_off' ELSE 'neutral' END AS regime
FROM (SELECT *, round((coalesce(0.5 * tanh(gap / 0.08), 0) + coalesce(0.3 * tanh(mom / 0.1), 0) + coalesce(0.2 * tanh(ret / 0.06), 0)) / nullif(coverage, 0), 12) AS signal FROM (SELECT *, 0.5 * (gap IS NOT NULL)::INT + 0.3 * (mom IS NOT NULL)::INT + 0.2 * (ret IS NOT NULL)::INT AS coverage FROM {FEATS}))""",
    "signal coverage confidence",
)
def q10_calls(spark, sf):
    """A transparent score with its class, a capped confidence that falls with missing parts, and the name's own regime."""
    back = lambda k: Window.partitionBy("entity").orderBy("t").rangeBetween(1 - k, 0)
    df = signals(spark, sf).withColumns({"gap": ratio("close", W.rolling(F.avg, "close", 10, 6)) - 1, "vol": W.rolling(F.stddev_samp, "ret", 6, 4), "fall": ratio("close", F.max("close").over(back(12))) - 1})
    return M.direction_calls(df, {"trend": ("gap", 0.08, 0.5), "momentum": ("mom", 0.1, 0.3), "last": ("ret", 0.06, 0.2)}, "gap", "vol", "fall").select("entity", "t", "signal", "coverage", "class", "confidence", "regime")


@register("b16_sector_exposure", "SELECT t, side, sector, n / total AS weight, sum(pow(n / total, 2)) OVER (PARTITION BY t, side) AS hhi FROM (SELECT t, side, sector, count(*) AS n, sum(count(*)) OVER (PARTITION BY t, side) AS total FROM book GROUP BY 1, 2, 3)", "weight hhi")
def b16_sectors(spark, sf):
    """Each leg's weights by sector, and their concentration."""
    held = B.legs(eligible(spark, sf), "mom", 0.2).groupBy("t", "side", "sector").agg(F.count(F.lit(1)).alias("n"))
    leg = Window.partitionBy("t", "side")
    weight = F.col("n") / F.sum("n").over(leg)
    return held.withColumn("weight", weight).select("t", "side", "sector", "weight", F.sum(F.col("weight") * F.col("weight")).over(leg).alias("hhi"))


@register("b16_factor_tilt", "SELECT t, factor, avg(z) AS tilt, count(z) / count(*) AS coverage FROM (SELECT b.t, factor, z FROM book b JOIN (SELECT t, entity, factor, (x - avg(x) OVER (PARTITION BY factor, t)) / nullif(stddev_samp(x) OVER (PARTITION BY factor, t), 0) AS z FROM (SELECT t, entity, unnest(['rev3', 'size']) AS factor, unnest([rev3, ln(dvol)]) AS x FROM el)) USING (t, entity) WHERE side = 1) GROUP BY t, factor", "tilt coverage")
def b16_tilt(spark, sf):
    """The long book's mean score on other factors, over the names that they cover."""
    long = eligible(spark, sf).withColumn("size", F.log("dvol")).unpivot(["t", "entity"], ["rev3", "size"], "factor", "x")
    by = Window.partitionBy("factor", "t")
    scored = long.withColumn("z", ratio(F.col("x") - F.avg("x").over(by), F.nullif(F.stddev_samp("x").over(by), F.lit(0.0))))
    book = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1").select("t", "entity")
    return book.join(scored, ["t", "entity"]).groupBy("t", "factor").agg(F.avg("z").alias("tilt"), (F.count("z") / F.count(F.lit(1))).alias("coverage"))


@register("p22_candidates", "SELECT coalesce(why, CASE WHEN i > 1 THEN 'duplicate' ELSE 'candidate' END) AS verdict, count(*) AS n, min(p_partkey) AS first FROM (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY s, why IS NULL ORDER BY p_partkey) END AS i FROM (SELECT p_partkey, s, CASE WHEN NOT regexp_matches(s, '^[A-Z]+$') THEN 'invalid_characters' WHEN regexp_matches(p_name, '(?i)\\bunits?\\b') THEN 'unit' WHEN length(s) = 5 AND substr(s, 5, 1) IN ('W', 'U', 'R') THEN 'suffix' END AS why FROM (SELECT p_partkey, p_name, substr(upper(p_type), 1, 4) || CASE WHEN p_size % 3 = 0 THEN chr(CAST(65 + p_size % 26 AS INT)) WHEN p_size % 7 = 0 THEN '1' ELSE '' END AS s FROM part))) GROUP BY 1", "")
def p22_candidates(spark, sf):
    """A universe's candidates: what isn't a common share is told by the first rule, later rows of a symbol are duplicates."""
    end = F.when(F.col("p_size") % 3 == 0, F.char(65 + F.col("p_size") % 26)).when(F.col("p_size") % 7 == 0, "1").otherwise("")
    df = panels.table(spark, sf, "part").withColumn("s", F.concat(F.substring(F.upper("p_type"), 1, 4), end))
    df = T.candidates(df, "s", "p_name", "p_partkey")
    return df.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


#: The return of a customer's supplier over the quarter after each probe.
AFTER = "(SELECT p.entity, p.d, b.close / a.close - 1 AS fwd FROM {} p JOIN px_m a ON a.entity = p.entity % 10 AND a.t = year(p.d) * 12 + month(p.d) - 1 JOIN px_m b ON b.entity = a.entity AND b.t = a.t + 3)".format(CUST)
FACTOR = f"(SELECT p.entity, p.d, kind, CASE WHEN kind = 'raw' OR date_diff('day', f.period_end, p.d) <= 150 THEN f.value END AS x FROM {CUST} p JOIN (SELECT unnest(['raw', 'repaired']) AS kind) ON true LEFT JOIN facts f ON f.entity = p.entity AND f.available_date = (SELECT max(y.available_date) FROM facts y WHERE y.entity = p.entity AND y.available_date <= p.d))"


@register(
    "f9_factor_measured_again",
    f"SELECT kind, sum(n) / (SELECT count(*) FROM {CUST}) AS coverage, count(ic) AS dates, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t_stat FROM (SELECT kind, d, count(*) AS n, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic FROM (SELECT kind, d, {RANKED.format(by='kind, d', x='x')} AS a, {RANKED.format(by='kind, d', x='fwd')} AS b FROM {FACTOR} JOIN {AFTER} USING (entity, d) WHERE x IS NOT NULL) GROUP BY 1, 2) GROUP BY kind",
    "coverage mean_ic t_stat",
)
def f9_again(spark, sf):
    """A factor before and after its repair (values that are too old go): coverage, and what it tells about the next quarter."""
    probes = cust_months(spark, sf)
    df = J.asof(probes, panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"])
    px = prices(spark, sf).select(F.col("entity").alias("_p"), F.col("t").alias("_t"), (ratio(W.lag_exact("close", -3), "close") - 1).alias("fwd"))
    df = df.join(px, (F.col("entity") % 10 == F.col("_p")) & (month_index("d") == F.col("_t"))).where("fwd is not null")
    fresh = F.when(F.datediff("d", "period_end") <= 150, F.col("value"))
    kinds = df.select("entity", "d", "fwd", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("value").alias("x")), F.struct(F.lit("repaired").alias("kind"), fresh.alias("x")))).alias("k")).select("entity", "d", "fwd", "k.*").where("x is not null")
    ics = A.rank_ic(kinds, "x", "fwd", "kind", date="d")
    total = probes.agg(F.count(F.lit(1)).alias("total"))
    out = ics.groupBy("kind").agg(F.sum("names").alias("n"), F.count("ic").alias("dates"), F.avg("ic").alias("mean_ic"), (ratio(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))) * F.sqrt(F.count("ic"))).alias("t_stat"))
    return out.crossJoin(F.broadcast(total)).select("kind", (F.col("n") / F.col("total")).alias("coverage"), "dates", "mean_ic", "t_stat")


BOOKED = f"(SELECT *, filled - coalesce(open, 0) AS income, CASE WHEN count(*) OVER w = 4 THEN sum(revenue) OVER w END AS assets FROM (SELECT entity, period_end, sum(v) FILTER (status = 'F') AS filled, sum(v) FILTER (status = 'O') AS open, sum(v) AS revenue, max(a) AS available FROM {STATUS} GROUP BY 1, 2) WINDOW w AS (PARTITION BY entity ORDER BY period_end ROWS 3 PRECEDING))"
FEATURED = f"(SELECT b.*, p.revenue AS before FROM {BOOKED} b LEFT JOIN {BOOKED} p ON p.entity = b.entity AND last_day(p.period_end + INTERVAL 12 MONTH) = b.period_end)"


def featured(spark, sf):
    i = items(spark, sf)
    status = lambda s: F.sum(F.when(F.col("status") == s, F.col("v")))
    wide = i.groupBy("entity", "period_end").agg(status("F").alias("cash"), status("O").alias("liabilities"), F.sum("v").alias("revenue"), F.max("a").alias("available"))
    four = Window.partitionBy("entity").orderBy("period_end").rowsBetween(-3, 0)
    wide = wide.withColumns({"income": F.col("cash") - F.coalesce("liabilities", F.lit(0.0)), "assets": F.when(F.count(F.lit(1)).over(four) == 4, F.sum("revenue").over(four))})
    return FU.feature_set(wide, late=30)


@register("f2_feature_set", f"SELECT entity, CAST(period_end AS VARCHAR) AS period_end, income / nullif(revenue, 0) AS margin, open / nullif(assets, 0) AS leverage, (revenue - before) / nullif(abs(before), 0) AS growth, filled / CASE WHEN income > 0 THEN income END AS cash_conversion, (income - filled) / nullif(assets, 0) AS accruals, ln(assets) AS log_size, date_diff('day', period_end, available) AS filing_lag FROM {FEATURED}", "margin leverage growth cash_conversion accruals log_size")
def f2_set(spark, sf):
    """Margins, leverage, growth, cash conversion, accruals, size and lag of every period."""
    return featured(spark, sf).select("entity", F.col("period_end").cast("string").alias("period_end"), "margin", "leverage", "growth", "cash_conversion", "accruals", "log_size", "filing_lag")


@register("f2_warnings", f"SELECT warning, count(*) AS n, count(DISTINCT entity) AS entities FROM (SELECT entity, unnest(list_filter([CASE WHEN assets IS NULL THEN 'no_assets' END, CASE WHEN before IS NULL THEN 'no_year_before' END, CASE WHEN coalesce(income <= 0, true) THEN 'no_income' END, CASE WHEN date_diff('day', period_end, available) > 30 THEN 'late' END], lambda x: x IS NOT NULL)) AS warning FROM {FEATURED}) GROUP BY warning", "")
def f2_warnings(spark, sf):
    """How often a feature lacks what it needs."""
    return featured(spark, sf).select("entity", F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))
