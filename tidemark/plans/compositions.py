"""Queries that put operators together: audits, surfaces, comparisons, marked books, event context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio, weighted_available
from tidemark.operators import books as B
from tidemark.operators import cross as C
from tidemark.operators import evaluate as A
from tidemark.operators import joins as J
from tidemark.operators import tables as T
from tidemark.plans.base import eligible, prices, register, signals
from tidemark.plans.data import CUST, asof_sql, cust_months
from tidemark.sources import panels


@register("s12_wide_to_long", "SELECT entity, t, field, value FROM (SELECT entity, t, unnest(['close', 'dvol']) AS field, unnest([close, dvol]) AS value FROM px_m)", "value")
def s12(spark, sf):
    return prices(spark, sf).unpivot(["entity", "t"], ["close", "dvol"], "field", "value")


@register("s14_file_inventory", "SELECT count(*) AS rows, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows FROM lineitem", "")
def s14(spark, sf):
    files = T.file_inventory(panels.table(spark, sf, "lineitem"), "l_shipdate")
    return files.select("rows", *[F.to_date(c).cast("string").alias(c) for c in ("first", "last")], "distinct_rows")


@register("p4_robustness_masks", "SELECT mask, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN rx > names / 3 THEN 'top_tertiles' END, CASE WHEN rx > names / 10 THEN 'not_illiquid' END, CASE WHEN age >= 12 THEN 'seasoned' END], lambda x: x IS NOT NULL)) AS mask FROM (SELECT e.*, rank() OVER (PARTITION BY e.t ORDER BY e.dvol) AS rx, age FROM el e JOIN (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t) AS age FROM px_m) a ON a.entity = e.entity AND a.t = e.t)) GROUP BY mask", "")
def p4(spark, sf):
    age = prices(spark, sf).select("entity", "t", F.row_number().over(Window.partitionBy("entity").orderBy("t")).alias("age"))
    df = eligible(spark, sf).join(age, ["entity", "t"]).withColumn("r", F.rank().over(Window.partitionBy("t").orderBy("dvol")))
    masks = {"top_tertiles": F.col("r") > F.col("names") / 3, "not_illiquid": F.col("r") > F.col("names") / 10, "seasoned": F.col("age") >= 12}
    return df.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in masks.items()]))).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


@register("p15_pit_audit", f"SELECT count(*) AS rows, sum((period_end IS NOT NULL)::INT) AS matched, sum(coalesce(CAST(period_end AS DATE) + 45 > CAST(d AS DATE), false)::INT) AS from_the_future, max(date_diff('day', CAST(period_end AS DATE), CAST(d AS DATE))) AS oldest FROM ({asof_sql('<=')})", "")
def p15(spark, sf):
    df = J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end"])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("period_end").isNotNull().cast("int")).alias("matched"), F.sum(F.coalesce(F.col("available_date") > F.col("d"), F.lit(False)).cast("int")).alias("from_the_future"), F.max(F.datediff("d", "period_end")).alias("oldest"))


@register("j14_matched_controls", "SELECT t, sector, count(*) AS hits, avg(c) AS control FROM (SELECT r.t, r.sector, c FROM rk r JOIN (SELECT t, sector, avg(fwd) AS c FROM rk WHERE rx / names <= 0.8 GROUP BY t, sector) k ON r.t = k.t AND r.sector = k.sector WHERE rx / names > 0.8) GROUP BY t, sector", "control")
def j14(spark, sf):
    df = eligible(spark, sf).withColumn("trigger", C.percent_rank("mom", "t") > 0.8)
    control = df.where("not trigger").groupBy("t", "sector").agg(F.avg("fwd").alias("c"))
    return df.where("trigger").join(control, ["t", "sector"]).groupBy("t", "sector").agg(F.count(F.lit(1)).alias("hits"), F.avg("c").alias("control"))


@register("j17_identity_by_tokens", "SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type || ' ' || p_brand), ' '))) AS shared FROM part", "")
def j17(spark, sf):
    words = lambda c: F.split(F.lower(c), " ")
    return panels.table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(words(F.col("p_name")), words(F.concat("p_type", F.lit(" "), "p_brand")))).alias("shared"))


@register("a23_sensitivity_surface", "SELECT q, avg(s) AS spread, count(*) AS months FROM (SELECT q, t, avg(fwd) FILTER (ox > names - k) - avg(fwd) FILTER (ox <= k) AS s FROM (SELECT *, greatest(1, CAST(floor(names * q + 1e-9) AS INT)) AS k FROM rk, (SELECT unnest([0.1, 0.2, 0.3]) AS q)) GROUP BY q, t) GROUP BY q", "q spread")
def a23(spark, sf):
    grid = [A.quantile_spread(eligible(spark, sf), "mom", "fwd", q + 1e-11).select(F.lit(q).alias("q"), "spread") for q in (0.1, 0.2, 0.3)]
    return grid[0].unionByName(grid[1]).unionByName(grid[2]).groupBy("q").agg(F.avg("spread").alias("spread"), F.count(F.lit(1)).alias("months"))


#: Trailing returns of one to four months against legs of four widths.
LAGGED = "(SELECT e.t, e.entity, fwd, CAST(t.t - p.t AS DOUBLE) AS param, e.close / p.close - 1 AS x FROM el e JOIN px_m p ON p.entity = e.entity AND p.t BETWEEN e.t - 4 AND e.t - 1 JOIN (SELECT DISTINCT t FROM px_m) t ON t.t = e.t)"
CELLS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY param, t ORDER BY x, entity) AS i, count(*) OVER (PARTITION BY param, t) AS n FROM {LAGGED}),
c AS (SELECT param, share, avg(s) AS spread, count(*) AS months FROM (SELECT param, share, t, avg(fwd) FILTER (i > n - k) - avg(fwd) FILTER (i <= k) AS s FROM (SELECT *, greatest(1, CAST(floor(n * share + 1e-9) AS INT)) AS k FROM r, (SELECT unnest([0.1, 0.2, 0.3, 0.4]) AS share)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT c.param, c.share, any_value(c.spread) AS spread, any_value(c.months) AS months, max(o.spread) AS near_best, avg(o.spread) AS near_mean, count(*) AS near_cells FROM c JOIN c o ON abs(c.param - o.param) <= 1 AND abs(c.share - o.share) <= 0.11 GROUP BY 1, 2)"""


def lagged_surface(spark, sf):
    from tidemark.operators.windows import lag_exact

    back = {f"r{k}": ratio("close", lag_exact("close", k)) - 1 for k in range(1, 5)}
    df = eligible(spark, sf).select("entity", "t", "fwd").join(prices(spark, sf).select("entity", "t", "close").withColumns(back), ["entity", "t"])
    return A.surface(df, {k: f"r{k}" for k in range(1, 5)}, "fwd", [0.1, 0.2, 0.3, 0.4])


@register("a23_surface_of_two", f"WITH {CELLS} SELECT *, spread >= near_best AS peak FROM g", "param share spread near_best near_mean")
def a23_two(spark, sf):
    """The whole surface over lookback and width, with each cell's neighbourhood."""
    return lagged_surface(spark, sf)


@register("a23_plateau", f"WITH {CELLS} SELECT count(*) AS cells, min(spread) AS least, max(spread) AS best, median(spread) AS median, max(spread) - min(spread) AS range, avg((spread >= b - 0.2 * abs(b))::INT) AS plateau_ratio, CAST(sum((spread >= near_best)::INT) AS BIGINT) AS peaks FROM (SELECT *, max(spread) OVER () AS b FROM g)", "least best median range plateau_ratio")
def a23_plateau(spark, sf):
    """How much of the surface is near its best cell."""
    return A.plateau(lagged_surface(spark, sf))


@register("a26_export_summaries", "SELECT sector, t // 12 AS year, count(*) AS n, avg(fwd) AS mean, avg((fwd > 0)::INT) AS hit FROM el GROUP BY 1, 2", "mean hit")
def a26(spark, sf):
    return eligible(spark, sf).groupBy("sector", F.floor(F.col("t") / 12).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean"), F.avg((F.col("fwd") > 0).cast("double")).alias("hit"))


@register("a28_lead_ranking", "SELECT sector, place FROM (SELECT sector, row_number() OVER (ORDER BY round(least(greatest(m * 10, -1), 1) + 0.5 * h, 9) DESC, sector) AS place FROM (SELECT sector, avg(fwd) AS m, avg((fwd > 0)::INT) AS h FROM el GROUP BY sector))", "")
def a28(spark, sf):
    stats = eligible(spark, sf).groupBy("sector").agg(F.avg("fwd").alias("m"), F.avg((F.col("fwd") > 0).cast("double")).alias("h"))
    score = F.round(F.least(F.greatest(F.col("m") * 10, F.lit(-1.0)), F.lit(1.0)) + 0.5 * F.col("h"), 9)
    return stats.select("sector", F.row_number().over(Window.orderBy(score.desc(), "sector")).alias("place"))


@register("a29_fold_diagnostics", "SELECT year, n, mean, CASE WHEN mean < -0.05 THEN 'catastrophic' WHEN mean < 0 THEN 'negative' ELSE 'positive' END AS class FROM (SELECT t // 12 AS year, count(ic) AS n, avg(ic) AS mean FROM ic GROUP BY 1)", "mean")
def a29(spark, sf):
    years = A.decomposed(A.rank_ic(eligible(spark, sf), "mom", "fwd"), F.floor(F.col("t") / 12).cast("int"))
    return years.select(F.col("period").alias("year"), "n", "mean", F.when(F.col("mean") < -0.05, "catastrophic").when(F.col("mean") < 0, "negative").otherwise("positive").alias("class"))


@register("a31_acquisition_coverage", "SELECT sector, count(DISTINCT entity) AS entities, count(*) AS cells, max(t) - min(t) + 1 AS span, count(*) / (count(DISTINCT entity) * (max(t) - min(t) + 1)) AS filled FROM sig GROUP BY sector", "filled")
def a31(spark, sf):
    out = signals(spark, sf).groupBy("sector").agg(F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("cells"), (F.max("t") - F.min("t") + 1).alias("span"))
    return out.withColumn("filled", ratio("cells", F.col("entities") * F.col("span")))


@register("a32_filter_stress", "SELECT f AS filter, count(*) AS n, avg(fwd) AS mean FROM (SELECT fwd, unnest(list_filter(['none', CASE WHEN dvol > 200000 THEN 'liquid' END, CASE WHEN abs(ret) < 0.5 THEN 'calm' END], lambda x: x IS NOT NULL)) AS f FROM book b JOIN (SELECT entity, t, dvol, ret FROM el) e USING (entity, t) WHERE side = 1) GROUP BY f", "mean")
def a32(spark, sf):
    longs = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1")
    return A.sliced(longs, {"none": F.lit(True), "liquid": F.col("dvol") > 200000, "calm": F.abs("ret") < 0.5}, "fwd").select(F.col("slice").alias("filter"), "n", "mean")


@register("a33_packaging_overlap", "SELECT a.t, count(*) AS n, count(b.entity) AS shared FROM (SELECT t, entity FROM book WHERE side = 1) a LEFT JOIN (SELECT t, entity FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mom DESC, entity) AS place FROM (SELECT *, row_number() OVER (PARTITION BY t, sector ORDER BY mom DESC, entity) AS g FROM el) WHERE g <= 2) WHERE place <= 6) b ON a.t = b.t AND a.entity = b.entity GROUP BY a.t", "")
def a33(spark, sf):
    df = eligible(spark, sf)
    plain = B.legs(df, "mom", 0.2).where("side = 1").select("t", "entity")
    capped = B.capped_by_group(df, "mom", 6, 2, "sector").select("t", "entity", F.lit(1).alias("in"))
    return plain.join(capped, ["t", "entity"], "left").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count("in").alias("shared"))


@register("a34_model_comparison", "SELECT avg(b - a) AS gain, avg((b > a)::INT) AS better, count(*) AS months FROM (SELECT t, avg(fwd) FILTER (ox > names - greatest(1, names // 5)) AS a, avg(fwd) FILTER (oz > names - greatest(1, names // 5)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rev, entity) AS oz FROM rk) GROUP BY t)", "gain better")
def a34(spark, sf):
    top = lambda x, name: A.quantile_spread(eligible(spark, sf), x, "fwd", 0.2).select("t", F.col("top").alias(name))
    both = top("mom", "a").join(top("rev", "b"), "t")
    return both.agg(F.avg(F.col("b") - F.col("a")).alias("gain"), F.avg((F.col("b") > F.col("a")).cast("double")).alias("better"), F.count(F.lit(1)).alias("months"))


@register("b12_book_marks", "SELECT b.t AS opened, p.t, count(p.close) AS marked, avg(p.close / entry - 1) AS mean, median(p.close / entry - 1) AS mid, avg((p.close > entry)::INT) AS hit FROM (SELECT book.t, book.entity, close AS entry FROM book JOIN px_m USING (t, entity) WHERE side = 1) b JOIN px_m p ON p.entity = b.entity AND p.t > b.t GROUP BY 1, 2", "mean mid hit")
def b12(spark, sf):
    """Every month's long book, marked in all later months."""
    book = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1").select("entity", F.col("t").alias("opened"), F.col("close").alias("entry"))
    gain = ratio("close", "entry") - 1
    marks = prices(spark, sf).join(book, "entity").where("t > opened")
    return marks.groupBy("opened", "t").agg(F.count("close").alias("marked"), F.avg(gain).alias("mean"), F.percentile(gain, F.lit(0.5)).alias("mid"), F.avg((F.col("close") > F.col("entry")).cast("double")).alias("hit"))


@register("b13_head_to_head", "SELECT sum((a > b)::INT) AS wins, sum((a < b)::INT) AS losses, avg(a - b) AS mean FROM (SELECT t, avg(fwd) FILTER (side = 1) AS a, avg(fwd) FILTER (side = -1) AS b FROM book GROUP BY t)", "mean")
def b13(spark, sf):
    book = B.legs(eligible(spark, sf), "mom", 0.2)
    marks = book.groupBy("t").agg(F.avg(F.when(F.col("side") == 1, F.col("fwd"))).alias("a"), F.avg(F.when(F.col("side") == -1, F.col("fwd"))).alias("b"))
    return marks.agg(F.sum((F.col("a") > F.col("b")).cast("int")).alias("wins"), F.sum((F.col("a") < F.col("b")).cast("int")).alias("losses"), F.avg(F.col("a") - F.col("b")).alias("mean"))


@register("e8_regime_gated_signal", "SELECT trend, avg(spread) AS spread, count(*) AS months FROM (SELECT t, avg(fwd) FILTER (side = 1) - avg(fwd) FILTER (side = -1) AS spread FROM book GROUP BY t) JOIN (SELECT t, CASE WHEN bench >= median(bench) OVER () THEN 'above' ELSE 'below' END AS trend FROM bench) USING (t) GROUP BY trend", "spread")
def e8(spark, sf):
    bench = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")
    state = bench.select("t", F.when(F.col("bench") >= F.percentile("bench", F.lit(0.5)).over(Window.partitionBy()), "above").otherwise("below").alias("trend"))
    spread = A.quantile_spread(eligible(spark, sf), "mom", "fwd", 0.2)
    return spread.join(F.broadcast(state), "t").groupBy("trend").agg(F.avg("spread").alias("spread"), F.count(F.lit(1)).alias("months"))


@register("e6_event_features_at_probe", "SELECT p.entity, CAST(p.d AS VARCHAR) AS d, count(f.value) AS known, arg_max(f.value, f.available_date) AS latest FROM " + CUST + " p LEFT JOIN facts f ON f.entity = p.entity AND f.available_date < p.d GROUP BY 1, 2", "latest")
def e6(spark, sf):
    facts = panels.facts(spark, sf)
    numbered = facts.withColumn("known", F.row_number().over(Window.partitionBy("entity").orderBy("available_date")))
    df = J.asof(cust_months(spark, sf), numbered, "entity", "d", "available_date", ["known", "value"], strict=True)
    return df.select("entity", F.col("d").cast("string").alias("d"), F.coalesce("known", F.lit(0)).alias("known"), F.col("value").alias("latest"))


@register("f6_yield_factor", f"SELECT entity, d, value / (1000 + entity) AS yield FROM ({asof_sql('<')})", "yield")
def f6(spark, sf):
    df = J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"], strict=True)
    return df.select("entity", F.col("d").cast("string").alias("d"), ratio("value", 1000 + F.col("entity")).alias("yield"))


@register("f11_composite_additivity", "SELECT entity, t, top / nullif(w, 0) AS composite, CASE WHEN rev3 IS NOT NULL THEN 0.3 * rev3 / nullif(w, 0) END AS reversal_part, (top - coalesce(0.3 * rev3, 0)) / nullif(w - 0.3 * (rev3 IS NOT NULL)::INT, 0) AS without_reversal FROM (SELECT *, coalesce(0.5 * mom, 0) + coalesce(0.3 * rev3, 0) + coalesce(0.2 * ret, 0) AS top, 0.5 * (mom IS NOT NULL)::INT + 0.3 * (rev3 IS NOT NULL)::INT + 0.2 * (ret IS NOT NULL)::INT AS w FROM sig)", "composite reversal_part without_reversal")
def f11(spark, sf):
    """A weighted composite of what is there, one member's part of it, and the composite reweighted without that member."""
    weights = {"mom": 0.5, "rev3": 0.3, "ret": 0.2}
    there = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    rest = {c: w for c, w in weights.items() if c != "rev3"}
    return signals(spark, sf).select("entity", "t", weighted_available(weights).alias("composite"), ratio(0.3 * F.col("rev3"), there).alias("reversal_part"), weighted_available(rest).alias("without_reversal"))


@register("q9_prediction_outputs", "SELECT entity AS ticker, t AS as_of, round(rx / names, 9) AS prob, CASE WHEN abs(rx / names - 0.5) >= 0.3 THEN 'high' WHEN abs(rx / names - 0.5) >= 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM rk", "prob")
def q9(spark, sf):
    p = C.percent_rank("mom", "t")
    return eligible(spark, sf).select(F.col("entity").alias("ticker"), F.col("t").alias("as_of"), F.round(p, 9).alias("prob"), F.when(F.abs(p - 0.5) >= 0.3, "high").when(F.abs(p - 0.5) >= 0.1, "medium").otherwise("low").alias("confidence"))
