"""Queries of folds, fallbacks, routed and boosted models, diagnostics, factor packs and repaired factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators import evaluate as A
from tidemark.operators import fundamentals as FU
from tidemark.operators import joins as J
from tidemark.operators import models as M
from tidemark.operators import regimes as R
from tidemark.operators import windows as W
from tidemark.plans.analytics import FEATURES, FOLDS, SHOCKS, STATE, e1, folds
from tidemark.plans.base import eligible, once, register, signals
from tidemark.plans.data import CUST, cust_months
from tidemark.plans.evaluation import a1, b1
from tidemark.sources import panels

CALENDAR = "(SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM el))"
ROLES = f"(SELECT e.*, fold, i > train_end AS is_test FROM el e JOIN {CALENDAR} c USING (t) JOIN {FOLDS} f ON i <= train_end OR i BETWEEN test_start AND test_end)"


@register("a4_ic_summary", "SELECT n, mean, std, mean / nullif(std, 0) AS ir, mean / nullif(std, 0) * sqrt(n) AS t_stat, CASE WHEN mean >= 0 THEN positive ELSE 1 - positive END AS hit FROM (SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg((ic > 0)::INT) AS positive FROM ic)", "mean std ir t_stat hit")
def a4(spark, sf):
    return A.ic_summary(a1(spark, sf)).drop("positive")


@register("m2_year_folds", f"SELECT y AS fold, CAST(a - 3 AS INT) AS train_end, CAST(a AS INT) AS test_start, CAST(b AS INT) AS test_end FROM (SELECT t // 12 AS y, min(i) AS a, max(i) AS b, min(t // 12) OVER () AS y0 FROM {CALENDAR} GROUP BY t // 12) WHERE y - y0 >= 2 AND a - 3 >= 0".replace("min(t // 12) OVER ()", "min(min(t // 12)) OVER ()"), "")
def m2(spark, sf):
    return M.year_folds(eligible(spark, sf).select("t"), 2, 2)


@register("m5_imputed", f"SELECT fold, entity, t, coalesce((x - avg(x) FILTER (NOT is_test) OVER (PARTITION BY fold)) / nullif(stddev_pop(x) FILTER (NOT is_test) OVER (PARTITION BY fold), 0), 0) AS rev3 FROM (SELECT fold, entity, t, is_test, coalesce(rev3, m) AS x FROM {ROLES} r JOIN (SELECT fold, quantile_cont(rev3, 0.5) AS m FROM {ROLES} WHERE NOT is_test GROUP BY fold) USING (fold))", "rev3")
def m5(spark, sf):
    rows = once(M.assigned(eligible(spark, sf).select("entity", "t", "rev3"), folds(spark, sf)), "folds")
    return M.imputed(rows, ["rev3"]).select("fold", "entity", "t", "rev3")


@register("m9_fallback_scores", f"SELECT fold, entity, t, CASE WHEN rows >= 0.5 * most THEN y + b * (mom - x) / s ELSE (mom - x) / s END AS score FROM {ROLES} JOIN (SELECT *, max(rows) OVER () AS most FROM (SELECT fold, count(*) AS rows, avg(fwd) AS y, avg(mom) AS x, stddev_pop(mom) AS s, covar_pop(fwd, mom) / stddev_pop(mom) * count(*) / (count(*) + 10) AS b FROM {ROLES} WHERE NOT is_test GROUP BY fold)) USING (fold) WHERE is_test", "score")
def m9(spark, sf):
    """Ridge scores, but the plain standardized feature in folds with less than half of the last fold's training rows."""
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)), "folds"), ["mom"])
    model = M.ridge(rows, ["mom"], "fwd", 10.0)
    most = model.agg(F.max("rows")).first()[0]
    return M.scored(rows, model, ["mom"], least_rows=-(-most // 2)).select("fold", "entity", "t", "score")


@register("m7_chosen_strength")
def m7(spark, sf):
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", *FEATURES), folds(spark, sf)), "folds"), FEATURES)
    return M.chosen_strength(rows, FEATURES, "fwd", [1.0, 100.0, 10_000.0])


ONE = f"(SELECT fold, entity, t, is_test, fwd, (mom - avg(mom) FILTER (NOT is_test) OVER (PARTITION BY fold)) / stddev_pop(mom) FILTER (NOT is_test) OVER (PARTITION BY fold) AS z FROM {ROLES})"
GRID_OF_STRENGTHS = "(SELECT unnest([1.0, 100.0, 10000.0]) AS strength)"


@register("m7_strength_path", f"SELECT fold, strength, count(*) AS rows, avg(fwd) - covar_pop(fwd, z) * count(*) / (var_pop(z) * count(*) + strength) * avg(z) AS intercept, covar_pop(fwd, z) * count(*) / (var_pop(z) * count(*) + strength) AS slope FROM {ONE}, {GRID_OF_STRENGTHS} WHERE NOT is_test GROUP BY fold, strength", "strength intercept slope")
def m7_path(spark, sf):
    """A fold's models of all strengths from one decomposition."""
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)), "folds"), ["mom"])
    return M.ridge_path(rows, ["mom"], "fwd", [1.0, 100.0, 10_000.0]).withColumnRenamed("mom", "slope")


@register("m7_chosen_strength_of_one", f"""WITH r AS (SELECT * FROM {ONE} WHERE NOT is_test), d AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY t) > ceil(count(*) OVER (PARTITION BY fold) * 0.75) AS late FROM (SELECT DISTINCT fold, t FROM r)),
b AS (SELECT fold, sign(covar_pop(fwd, z)) AS s FROM r JOIN d USING (fold, t) WHERE NOT late GROUP BY fold),
i AS (SELECT fold, t, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic FROM (SELECT fold, t, rank() OVER (PARTITION BY fold, t ORDER BY z) + (count(*) OVER (PARTITION BY fold, t, z) - 1) / 2.0 AS a, rank() OVER (PARTITION BY fold, t ORDER BY fwd) + (count(*) OVER (PARTITION BY fold, t, fwd) - 1) / 2.0 AS b FROM r JOIN d USING (fold, t) WHERE late) GROUP BY fold, t)
SELECT fold, strength, round(avg(ic) * any_value(s), 9) AS ic, strength = 1 AS best FROM i JOIN b USING (fold), {GRID_OF_STRENGTHS} GROUP BY fold, strength""", "strength ic")
def m7_one(spark, sf):
    """With one feature a strength doesn't change ranks: all have the slope's sign times the feature's IC, and the least is chosen."""
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)), "folds"), ["mom"])
    return M.chosen_strength(rows, ["mom"], "fwd", [1.0, 100.0, 10_000.0])


@register("m12_scores_of_one", f"SELECT fold, entity, t, y + b * (z - x) AS score FROM {ONE} JOIN (SELECT fold, avg(fwd) AS y, avg(z) AS x, covar_pop(fwd, z) * count(*) / (var_pop(z) * count(*) + 10) AS b FROM {ONE} WHERE NOT is_test GROUP BY fold) USING (fold) WHERE is_test", "score")
def m12_one(spark, sf):
    """Every fold's test rows by the ridge of its training rows."""
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)), "folds"), ["mom"])
    return M.scored(rows, M.ridge(rows, ["mom"], "fwd", 10.0), ["mom"]).select("fold", "entity", "t", "score")


@register("m14_stability_of_one", f"SELECT 'mom' AS feature, avg(b) AS mean, stddev_pop(b) AS std, avg((sign(b) = sign(m))::INT) AS same_sign FROM (SELECT *, avg(b) OVER () AS m FROM (SELECT fold, covar_pop(fwd, z) * count(*) / (var_pop(z) * count(*) + 10) AS b FROM {ONE} WHERE NOT is_test GROUP BY fold))", "mean std same_sign")
def m14_one(spark, sf):
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)), "folds"), ["mom"])
    return M.weight_stability(M.ridge(rows, ["mom"], "fwd", 10.0), ["mom"])


@register("m11_routed_scores", f"SELECT r.fold, r.entity, r.t, CASE WHEN o.n IS NOT NULL THEN o.y + o.b * (mom - o.x) ELSE w.y + w.b * (mom - w.x) END AS score, CASE WHEN o.n IS NOT NULL THEN 'own' ELSE 'whole' END AS model FROM (SELECT * FROM {ROLES} JOIN {STATE} USING (t)) r LEFT JOIN (SELECT fold, trend, count(*) AS n, avg(fwd) AS y, avg(mom) AS x, covar_pop(fwd, mom) * count(*) / (var_pop(mom) * count(*) + 10) AS b FROM {ROLES} JOIN {STATE} USING (t) WHERE NOT is_test GROUP BY 1, 2 HAVING count(*) >= 200) o ON o.fold = r.fold AND o.trend = r.trend LEFT JOIN (SELECT fold, avg(fwd) AS y, avg(mom) AS x, covar_pop(fwd, mom) * count(*) / (var_pop(mom) * count(*) + 10) AS b FROM {ROLES} WHERE NOT is_test GROUP BY 1) w ON w.fold = r.fold WHERE is_test", "score")
def m11(spark, sf):
    rows = M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)).join(F.broadcast(e1(spark, sf)), "t")
    return M.routed(rows, "mom", "fwd", "trend", 200).select("fold", "entity", "t", "score", "model")


def scored_by_fold(spark, sf, df, columns, **kw):
    """Test rows of every fold, scored by the trees of its own training rows; a fold is one fit of Spark ML."""
    rows = once(M.assigned(df.select("entity", "t", "fwd", *columns), folds(spark, sf)), "boosted")
    ids = sorted(r.fold for r in folds(spark, sf).select("fold").collect())  # folds, not rows
    parts = [M.boosted(rows.where(F.col("fold") == f), columns, "fwd", **kw).select("fold", "entity", "t", "score") for f in ids]
    return reduce(lambda x, y: x.unionByName(y), parts)


def judged_by_fold(scores, sf, spark):
    """By fold: rows scored, dates, and whether all scores lie within the training outcomes."""
    bounds = M.assigned(eligible(spark, sf).select("entity", "t", "fwd"), folds(spark, sf)).where("not is_test").groupBy("fold").agg(F.min("fwd").alias("a"), F.max("fwd").alias("b"))
    out = scores.join(F.broadcast(bounds), "fold").groupBy("fold")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("t").alias("dates"), F.min(F.col("score").between(F.col("a") - 1e-9, F.col("b") + 1e-9)).alias("within"))


@register("m10_boosted_stumps")
def m10(spark, sf):
    """Stumps of every fold on three features."""
    return scored_by_fold(spark, sf, eligible(spark, sf), FEATURES)


@register("m10_boosted_folds", f"SELECT fold, count(*) AS rows, count(DISTINCT t) AS dates, true AS within FROM {ROLES} WHERE is_test AND rev3 IS NOT NULL AND rev IS NOT NULL GROUP BY fold", "")
def m10_folds(spark, sf):
    """Every fold's test rows have a score, and none beyond what its training rows have seen."""
    return judged_by_fold(m10(spark, sf), sf, spark)


@register("v3_boosted_lags")
def v3(spark, sf):
    """Pooled trees on lagged returns, volatility and distance to the mean, in place of a model a name; every fold."""
    lags = {f"lag{k}": W.row_lag("ret", k) for k in range(1, 4)}
    df = signals(spark, sf).where("ret is not null").withColumns(lags).withColumns({"vol": W.rolling(F.stddev_samp, "ret", 6, 3), "gap": ratio("close", W.rolling(F.avg, "close", 6, 3)) - 1})
    keep = eligible(spark, sf).select("entity", "t")
    return scored_by_fold(spark, sf, df.join(keep, ["entity", "t"]), [*lags, "vol", "gap"], rounds=20, depth=3)


def by_year(spark, sf):
    """Scores and outcomes with their year as fold, written once: each fold's fit reads them again."""
    return once(eligible(spark, sf).select("entity", "t", "mom", (F.col("fwd") > 0).alias("y"), F.floor(F.col("t") / 12).cast("int").alias("fold")), "by-year")


@register("q2_calibrated", "SELECT t // 12 AS fold, count(*) AS n FROM el GROUP BY 1", "")
def q2(spark, sf):
    df = by_year(spark, sf)
    p = M.calibrated(df, "mom", "y", 30)
    return p.where("p between 0 and 1").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("q2_rank_fallback", "SELECT entity, t, row_number() OVER (ORDER BY mom, entity) / (count(*) OVER () + 1) AS p, 'rank' AS kind FROM (SELECT * FROM el WHERE t // 12 = (SELECT min(t // 12) FROM el))", "p")
def q2_first(spark, sf):
    df = by_year(spark, sf)
    first = F.broadcast(df.agg(F.min("fold").alias("first")))
    return M.calibrated(df, "mom", "y", 30).crossJoin(first).where("fold = first").select("entity", "t", "p", "kind")


HOLD = "(SELECT entity, t, mom AS expected, CASE WHEN n >= 2 THEN 1.0 / n + 0.4 END AS agreement, CASE WHEN n >= 2 THEN least(abs(mom) * 5, 1) END AS confidence FROM sig WHERE mom IS NOT NULL)"


@register("q8_labels_and_reasons", f"SELECT label, CASE WHEN label <> 'Hold' THEN 'actionable' WHEN agreement IS NULL OR confidence IS NULL THEN 'insufficient_eligible_models' WHEN agreement < 0.5 THEN 'low_agreement' WHEN confidence < 0.3 THEN 'low_confidence' WHEN abs(expected) < 0.02 THEN 'below_direction_band' ELSE 'hold_other' END AS reason, count(*) AS n FROM (SELECT *, CASE WHEN coalesce(agreement, 0) >= 0.5 AND coalesce(confidence, 0) >= 0.3 THEN CASE WHEN expected >= 0.1 THEN 'Strong Buy' WHEN expected >= 0.02 THEN 'Buy' WHEN expected <= -0.1 THEN 'Strong Sell' WHEN expected <= -0.02 THEN 'Sell' ELSE 'Hold' END ELSE 'Hold' END AS label FROM {HOLD}) GROUP BY 1, 2", "")
def q8(spark, sf):
    df = signals(spark, sf).where("mom is not null").select(F.col("mom").alias("expected"), F.when(F.col("n") >= 2, 1 / F.col("n") + 0.4).alias("agreement"), F.when(F.col("n") >= 2, F.least(F.abs("mom") * 5, F.lit(1.0))).alias("confidence"))
    label, reason = M.direction_label(F.col("expected"), F.col("agreement"), F.col("confidence"), 0.5, 0.3, 0.1, 0.02)
    return df.groupBy(label.alias("label"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


DIAGNOSED = ["mom", "rev3", "dvol"]
LONG = "(SELECT e.t, e.entity, feature, x, fwd, sector, mom AS base FROM (SELECT *, unnest(['mom', 'rev3', 'dvol']) AS feature, unnest([mom, rev3, dvol]) AS x FROM el) e)"


@register("a15_feature_diagnostics", f"WITH l AS (SELECT * FROM {LONG}), r AS (SELECT *, rank() OVER (PARTITION BY feature, t ORDER BY x) + (count(*) OVER (PARTITION BY feature, t, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, t ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, t, fwd) - 1) / 2.0 AS b, rank() OVER (PARTITION BY feature, t ORDER BY base) + (count(*) OVER (PARTITION BY feature, t, base) - 1) / 2.0 AS c, row_number() OVER (PARTITION BY feature, t ORDER BY x, entity) AS i, count(*) OVER (PARTITION BY feature, t) AS n FROM l WHERE x IS NOT NULL), d AS (SELECT feature, t, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic, round(covar_pop(a, c) / nullif(sqrt(var_pop(a) * var_pop(c)), 0), 12) AS bc, avg(fwd) FILTER (i > n - greatest(1, n // 4)) - avg(fwd) FILTER (i <= greatest(1, n // 4)) AS spread FROM r GROUP BY 1, 2), s AS (SELECT feature, max(c) / sum(c) AS top_sector FROM (SELECT feature, sector, count(*) AS c FROM r WHERE i > n - greatest(1, n // 4) GROUP BY 1, 2) GROUP BY 1) SELECT feature, avg(ic) AS mean_ic, avg(bc) AS baseline_corr, avg(spread) AS spread, any_value(top_sector) AS top_sector, any_value(present) AS coverage FROM d JOIN s USING (feature) JOIN (SELECT feature, avg((x IS NOT NULL)::INT) AS present FROM l GROUP BY 1) USING (feature) GROUP BY feature", "mean_ic baseline_corr spread top_sector coverage")
def a15(spark, sf):
    df = eligible(spark, sf).select("t", "entity", "fwd", "sector", F.col("mom").alias("base"), *DIAGNOSED)
    return A.feature_diagnostics(df, DIAGNOSED, "fwd", "base", "sector", 0.25)


@register("b9_metric_battery", "WITH s AS (SELECT *, ntile(3) OVER (ORDER BY t) AS third, max(gross) OVER () AS best FROM stream), c AS (SELECT unnest([0, 10, 25]) AS bps) SELECT bps, count(*) AS months, avg(net) AS mean, avg(net) / nullif(stddev_samp(net), 0) * sqrt(12) AS sharpe, avg((net > 0)::INT) AS hit, avg(net) FILTER (third = 1) AS first_third, avg(net) FILTER (third = 2) AS second_third, avg(net) FILTER (third = 3) AS last_third, avg(net) FILTER (gross < best) AS without_best FROM (SELECT *, gross - 2 * turnover * bps / 10000.0 AS net FROM s, c) GROUP BY bps", "mean sharpe hit first_third second_third last_third without_best")
def b9(spark, sf):
    from tidemark.operators.books import metric_battery

    return metric_battery(b1(spark, sf), [0, 10, 25])


@register("e3_factor_pack", f"SELECT s.entity, s.t, beta * change AS beta_shock, CASE WHEN bench >= m THEN mom ELSE 0 END AS mom_above FROM (SELECT s.entity, s.t, mom, change, CASE WHEN count(x) OVER w >= 8 THEN covar_samp(y, x) OVER w / nullif(var_samp(x) OVER w, 0) END AS beta FROM (SELECT s.entity, s.t, mom, change, CASE WHEN change IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN change END AS x FROM sig s JOIN {SHOCKS} d USING (t)) s WINDOW w AS (PARTITION BY s.entity ORDER BY s.t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) s JOIN (SELECT t, bench, CASE WHEN count(*) OVER v >= 24 THEN quantile_cont(bench, 0.5) OVER v END AS m FROM bench WINDOW v AS (ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) USING (t) WHERE m IS NOT NULL", "beta_shock mom_above")
def e3(spark, sf):
    bench = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")
    pack = R.macro_pack(bench, "bench", 60, 24)
    drivers = pack.select("t", F.lit("price").alias("driver"), "change")
    betas = R.driver_sensitivities(signals(spark, sf), drivers, 12, 8).select("entity", "t", "beta")
    df = signals(spark, sf).select("entity", "t", "mom").join(betas, ["entity", "t"]).join(F.broadcast(pack), "t").where("threshold is not null")
    return df.select("entity", "t", (F.col("beta") * F.col("change")).alias("beta_shock"), F.when(F.col("above"), F.col("mom")).otherwise(0.0).alias("mom_above"))


GRID = "(SELECT DISTINCT entity, CAST(date_trunc('week', ts) AS DATE) + 7 AS d FROM evt)"


@register("e7_event_grid", f"SELECT entity, CAST(d AS VARCHAR) AS d, x IS NOT NULL AS has_event, coalesce(x > 1, false) AS large, coalesce(max((coalesce(x > 1, false))::INT) OVER (PARTITION BY entity ORDER BY d), 0) = 1 AS ever_large FROM (SELECT g.entity, g.d, arg_max(e.value, {{'a': e.day, 'b': e.event_id}}) AS x FROM {GRID} g LEFT JOIN (SELECT *, CAST(ts AS DATE) AS day FROM evt WHERE type = 'purchase') e ON e.entity = g.entity AND e.day <= g.d AND e.day >= g.d - 7 GROUP BY 1, 2)", "")
def e7(spark, sf):
    """A weekly grid with each user's latest purchase of at most seven days before; a large one stays marked from then on."""
    e = panels.user_events(spark, sf).withColumn("day", F.to_date("ts"))
    grid = e.select("entity", F.date_add(F.date_trunc("week", "ts").cast("date"), 7).alias("d")).distinct()
    last = e.where("type = 'purchase'").groupBy("entity", "day").agg(F.max_by("value", "event_id").alias("x")).withColumn("on", F.col("day"))
    return R.event_grid(J.asof(grid, last, "entity", "d", "day", ["on", "x"]), "x", "on", "d", 7, 1.0).select("entity", F.col("d").cast("string").alias("d"), "has_event", "large", "ever_large")


@register("e9_event_price_context", "SELECT entity, t, close / c3 - 1 AS mom3, CASE WHEN c >= 6 THEN v END AS vol, liq AS liquidity, bd <= -0.02 AS stressed FROM (SELECT p.entity, p.t, close, max(close) OVER (w RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS c3, count(ret) OVER (w RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS c, stddev_pop(ret) OVER (w RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS v, avg(dvol) OVER (w RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS liq, b.bd FROM sig p JOIN (SELECT t, bench / max(bench) OVER (ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) - 1 AS bd FROM bench) b USING (t) WINDOW w AS (PARTITION BY p.entity ORDER BY p.t)) JOIN (SELECT entity, t FROM sig WHERE n >= 8) USING (entity, t)", "mom3 vol liquidity")
def e9(spark, sf):
    """Prices' context at events, here months of many trades: columns of the panel once, then an equality join."""
    bench = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")
    context = R.price_context(signals(spark, sf), bench, 3, 12, 6, -0.02)
    return signals(spark, sf).where("n >= 8").select("entity", "t").join(context, ["entity", "t"]).select("entity", "t", "mom3", "vol", "liquidity", "stressed")


STATUS = "(SELECT o_custkey AS entity, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end, o_orderstatus AS status, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS v, max(CAST(o_orderdate AS DATE)) + 30 AS a FROM orders GROUP BY ALL)"


def items(spark, sf):
    """``entity, period_end, status, v, a``: revenue by order status, known thirty days after its last order."""
    o = panels.table(spark, sf, "orders")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100
    return o.groupBy(F.col("o_custkey").alias("entity"), end.alias("period_end"), F.col("o_orderstatus").alias("status")).agg(cents.alias("v"), F.date_add(F.max(F.to_date("o_orderdate")), 30).alias("a"))


@register("f3_as_filed_factors", f"SELECT entity, CAST(period_end AS VARCHAR) AS period_end, (f.v - o.v) / f.v AS margin, o.v / (f.v + o.v) AS open_share, CAST(greatest(f.a, o.a) AS VARCHAR) AS available FROM (SELECT * FROM {STATUS} WHERE status = 'F') f JOIN (SELECT * FROM {STATUS} WHERE status = 'O') o USING (entity, period_end)", "margin open_share")
def f3(spark, sf):
    merged = FU.merged_statements({k: (items(spark, sf).where(F.col("status") == s), "v") for k, s in (("filled", "F"), ("open", "O"))}, ["entity", "period_end"], "a")
    rows = FU.as_filed_factors(merged, {"margin": (F.col("filled") - F.col("open"), F.col("filled")), "open_share": (F.col("open"), F.col("filled") + F.col("open"))}, ["filled", "open"])
    return rows.select("entity", F.col("period_end").cast("string").alias("period_end"), "margin", "open_share", F.col("a").cast("string").alias("available"))


FLOWS = "(SELECT entity, year(period_end) AS y, quarter(period_end) AS q, value, sum(value) OVER (PARTITION BY entity, year(period_end) ORDER BY period_end) AS ytd, count(*) OVER (PARTITION BY entity, year(period_end)) AS quarters FROM facts)"


@register("f4_single_quarters", f"SELECT entity, y AS year, q AS quarter, value AS single, CASE WHEN entity % 3 = 0 THEN 'clean' WHEN q = 1 THEN 'first' WHEN q < 4 THEN 'difference' ELSE 'annual_less' END AS source FROM (SELECT *, lag(q) OVER (PARTITION BY entity, y ORDER BY q) AS pq FROM {FLOWS}) WHERE entity % 3 = 0 OR q = 1 OR pq = q - 1", "single")
def f4(spark, sf):
    """Some customers file clean quarters; the others year-to-date totals, and a year's total for the fourth quarter."""
    f = panels.facts(spark, sf).select("entity", F.year("period_end").alias("year"), F.quarter("period_end").alias("quarter"), "value")
    total = F.sum("value").over(Window.partitionBy("entity", "year").orderBy("quarter"))
    clean = F.col("entity") % 3 == 0
    filed = f.withColumn("total", total).select("entity", "year", "quarter", F.when(clean, "clean").when(F.col("quarter") == 4, "annual").otherwise("total").alias("kind"), F.when(clean, F.col("value")).otherwise(F.col("total")).alias("value"))
    return FU.single_quarters(filed)


@register("f8_sector_history", f"SELECT p.entity, CAST(p.d AS VARCHAR) AS d, o.code, CASE WHEN o.code IS NULL THEN 'unknown' WHEN o.code < '3' THEN 'urgent' ELSE 'other' END AS sector FROM {CUST} p LEFT JOIN (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, arg_max(substr(o_orderpriority, 1, 1), o_orderkey) AS code FROM orders GROUP BY 1, 2) o ON o.entity = p.entity AND o.day = (SELECT max(CAST(x.o_orderdate AS DATE)) FROM orders x WHERE x.o_custkey = p.entity AND CAST(x.o_orderdate AS DATE) <= p.d)", "")
def f8(spark, sf):
    """The code of each customer's latest header up to the probe, and what it stands for."""
    o = panels.table(spark, sf, "orders")
    headers = o.groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(F.max_by(F.substring("o_orderpriority", 1, 1), "o_orderkey").alias("code"))
    df = J.asof(cust_months(spark, sf), headers, "entity", "d", "day", ["code"])
    sector = F.when(F.col("code").isNull(), "unknown").when(F.col("code") < "3", "urgent").otherwise("other")
    return df.select("entity", F.col("d").cast("string").alias("d"), "code", sector.alias("sector"))


@register("f9_repaired_factor", f"SELECT CAST(d AS VARCHAR) AS d, count(*) AS names, count(value) AS covered, avg(value) AS mean FROM (SELECT p.entity, p.d, CASE WHEN date_diff('day', f.period_end, p.d) <= 200 THEN f.value END AS value FROM {CUST} p LEFT JOIN facts f ON f.entity = p.entity AND f.available_date = (SELECT max(x.available_date) FROM facts x WHERE x.entity = p.entity AND x.available_date <= p.d)) GROUP BY d", "mean")
def f9(spark, sf):
    """A factor's monthly series after repair: the latest known value, if not too old; and its coverage."""
    df = J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"])
    fresh = F.when(F.datediff("d", "period_end") <= 200, F.col("value"))
    return df.withColumn("fresh", fresh).groupBy(F.col("d").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("names"), F.count("fresh").alias("covered"), F.avg("fresh").alias("mean"))


@register("d9_feature_set", "SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.t, b.t) AS t, a.value AS lagged, b.value AS change FROM (SELECT entity, p.t + 2 AS t, close AS value FROM px_m p WHERE p.t + 2 IN (SELECT t FROM px_m)) a FULL JOIN (SELECT x.entity, x.t, (x.close - y.close) / abs(y.close) AS value FROM px_m x JOIN px_m y ON x.entity = y.entity AND y.t = x.t - 3) b ON a.entity = b.entity AND a.t = b.t", "lagged change")
def d9(spark, sf):
    """A set of feature documents, checked, and executed side by side; one that is not valid is left out with its reasons."""
    from tidemark.operators.dsl import execute_set

    source = {"op": "source", "field": "close"}
    docs = {"lagged": {"op": "lag", "inputs": [source], "params": {"periods": 2}}, "change": {"op": "percentage_change", "inputs": [source], "params": {"periods": 3}}, "leaky": {"op": "source", "field": "fwd"}}
    panel = signals(spark, sf).select("entity", "t", "close", "dvol", "sector")
    found, refused = execute_set(docs, panel)
    if list(refused) != ["leaky"]:
        raise ValueError(f"refused: {refused}")
    return found
