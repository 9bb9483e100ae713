"""Queries of inference, models, calibration, regimes, fundamentals, feature documents, forecasts and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import clip, ratio, signed_log
from tidemark.operators import dsl, forecasts
from tidemark.operators import fundamentals as FU
from tidemark.operators import inference as I
from tidemark.operators import models as M
from tidemark.operators import regimes as R
from tidemark.operators import windows as W
from tidemark.plans.base import benched, eligible, once, prices, register, scratch, signals
from tidemark.plans.evaluation import a1, a13, b1
from tidemark.sources import panels
from tidemark.streaming import ingest

FEATURES = ["mom", "rev", "rev3"]


DRAWN = "CAST('0x' || substr(md5({}), 1, 8) AS UBIGINT)"
STREAMED = "x AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, ic AS x, count(*) OVER () AS n FROM ic WHERE ic IS NOT NULL)"


@register("t1_block_bootstrap", f"WITH {STREAMED}, p AS (SELECT i + 1 AS j, sum(x) OVER (ORDER BY i) AS s FROM x UNION ALL SELECT 0, 0), d AS (SELECT b, k, n, CAST({DRAWN.format("'1:' || b || ':' || k")} % greatest(1, n - 5) AS INT) AS a FROM (SELECT DISTINCT n FROM x), (SELECT unnest(range(500)) AS b), (SELECT unnest(range(1000)) AS k) WHERE k * 6 < n), m AS (SELECT b, sum(q.s - p.s) / any_value(n) AS m FROM d JOIN p ON p.j = a JOIN p q ON q.j = a + least(6, n - k * 6) GROUP BY b) SELECT count(*) AS replicates, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m", "low high")
def t1(spark, sf):
    return I.block_bootstrap(a1(spark, sf), "ic", 6, 500)


@register("t2_sign_flip", f"WITH {STREAMED}, m AS (SELECT b, round(abs(avg(CASE WHEN substr(md5('1:' || b || ':' || (i // 32)), CAST(i % 32 + 1 AS INT), 1) >= '8' THEN x ELSE -x END)), 12) AS m FROM x, (SELECT unnest(range(500)) AS b) GROUP BY b) SELECT (sum((m >= s)::INT) + 1) / (count(*) + 1) AS p, any_value(s) AS mean FROM m, (SELECT round(abs(avg(x)), 12) AS s FROM x)", "p mean")
def t2(spark, sf):
    return I.sign_flip(a1(spark, sf), "ic", 500)


@register("t3_leave_one_year_out", "SELECT period, (sum(s) OVER () - s) / (sum(c) OVER () - c) AS mean, sign((sum(s) OVER () - s) / (sum(c) OVER () - c)) = sign(sum(s) OVER ()) AS same_sign FROM (SELECT t // 12 AS period, sum(ic) AS s, count(ic) AS c FROM ic GROUP BY 1)", "mean")
def t3(spark, sf):
    return I.leave_one_out(a1(spark, sf), "ic", F.floor(F.col("t") / 12).cast("int"))


@register("t4_benjamini_hochberg", "SELECT t, p, coalesce(p <= max(CASE WHEN p <= r / m * 0.3 THEN p END) OVER (), false) AS rejected FROM (SELECT *, row_number() OVER (ORDER BY p, t) AS r, count(*) OVER () AS m FROM (SELECT t, round(exp(-abs(ic) * 20), 9) AS p FROM ic))", "p")
def t4(spark, sf):
    return I.benjamini_hochberg(a1(spark, sf).select("t", F.round(F.exp(-F.abs("ic") * 20), 9).alias("p")), "p", 0.3, "t")


@register("t5_multiple_testing_bars", "SELECT t, ic >= sqrt(2 * ln(75)) / sqrt(names - 1) AS beats_max_normal, 2 * exp(-abs(ic) * 9) <= 0.05 / 75 AS bonferroni FROM ic", "")
def t5(spark, sf):
    bars = I.multiple_testing_bars(75)
    return a1(spark, sf).select("t", (F.col("ic") >= bars["max_normal"] / F.sqrt(F.col("names") - 1)).alias("beats_max_normal"), (2 * F.exp(-F.abs("ic") * 9) <= bars["bonferroni"]).alias("bonferroni"))


#: The normal distribution function in SQL, by the formula of ``normal_cdf``.
TAIL = "(0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * k * exp(-z * z / 2) / 2"


@register("t6_deflated_sharpe", f"SELECT n, s AS sharpe, CASE WHEN z >= 0 THEN 1 - {TAIL} ELSE {TAIL} END AS odds FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS k FROM (SELECT n, s, (s - {I.expected_max_sharpe(10, 0.01)!r}) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * s + (kurt - 1) / 4 * s * s)) AS z FROM (SELECT count(*) AS n, any_value(mu) / nullif(any_value(sd), 0) AS s, avg(pow(gross - mu, 3)) / pow(any_value(v), 1.5) AS skew, avg(pow(gross - mu, 4)) / pow(any_value(v), 2) AS kurt FROM (SELECT gross, avg(gross) OVER () AS mu, stddev_samp(gross) OVER () AS sd, var_pop(gross) OVER () AS v FROM stream WHERE gross IS NOT NULL))))", "sharpe odds")
def t6(spark, sf):
    return I.deflated_sharpe(b1(spark, sf), "gross", 10, 0.01)


STATE = "(SELECT t, bench, CASE WHEN bench >= avg(bench) OVER (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) THEN 'bull' ELSE 'bear' END AS trend FROM bench)"


@register("t7_regime_split", "SELECT avg(ic) FILTER (b > m) AS high, avg(ic) FILTER (b <= m) AS low, count(*) FILTER (b > m) AS n_high, count(*) FILTER (b <= m) AS n_low, sign(avg(ic) FILTER (b > m)) <> sign(avg(ic) FILTER (b <= m)) AS flips FROM (SELECT ic, bench AS b, median(bench) OVER () AS m FROM ic JOIN bench USING (t))", "high low")
def t7(spark, sf):
    bench = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")
    return I.regime_split(a1(spark, sf).join(F.broadcast(bench), "t"), "ic", "bench")


@register("t8_gates", "SELECT signal, concat_ws(',', CASE WHEN NOT coalesce(abs(t_stat) >= 1, false) THEN 'weak' END, CASE WHEN NOT coalesce(hit >= 0.55, false) THEN 'unstable' END) AS reasons FROM (SELECT signal, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t_stat, CASE WHEN avg(ic) >= 0 THEN avg((ic > 0)::INT) ELSE 1 - avg((ic > 0)::INT) END AS hit FROM (SELECT signal, t, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic FROM (SELECT signal, t, rank() OVER (PARTITION BY signal, t ORDER BY x) + (count(*) OVER (PARTITION BY signal, t, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY signal, t ORDER BY y) + (count(*) OVER (PARTITION BY signal, t, y) - 1) / 2.0 AS b FROM (SELECT t, unnest(['mom', 'rev', 'rev3']) AS signal, unnest([mom, rev, rev3]) AS x, fwd AS y FROM el) WHERE x IS NOT NULL) GROUP BY signal, t) GROUP BY signal)", "")
def t8(spark, sf):
    return I.gated(a13(spark, sf), {"weak": F.abs("t_stat") >= 1, "unstable": F.col("hit") >= 0.55}).select("signal", "reasons")


FOLDS = "(SELECT f AS fold, f * s + 26 AS test_start, f * s + 23 AS train_end, CASE WHEN f = 3 THEN n - 1 ELSE f * s + 26 + s - 1 END AS test_end FROM (SELECT unnest(range(4)) AS f, (count(DISTINCT t) - 26) // 4 AS s, count(DISTINCT t) AS n FROM el))"


def folds(spark, sf):
    return M.walk_forward_folds(eligible(spark, sf).select("t"), 4, 2, 24)


@register("m1_walk_forward_folds", f"SELECT fold, train_end, test_start, test_end FROM {FOLDS}", "")
def m1(spark, sf):
    return folds(spark, sf).select("fold", "train_end", "test_start", "test_end")


@register("m3_purged_kfold", "SELECT fold, role, count(*) AS rows FROM (SELECT f.fold, CASE WHEN own = f.fold THEN 'test' WHEN i < a AND i + 1 >= a THEN 'purged' WHEN i > b AND i <= b + 2 THEN 'embargo' ELSE 'train' END AS role FROM (SELECT e.t, i, own FROM el e JOIN (SELECT *, CASE WHEN i < x * (s + 1) THEN i // (s + 1) ELSE x + (i - x * (s + 1)) // s END AS own FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () // 5 AS s, count(*) OVER () % 5 AS x FROM (SELECT DISTINCT t FROM el))) d ON e.t = d.t) r, (SELECT own AS fold, min(i) AS a, max(i) AS b FROM (SELECT i, CASE WHEN i < x * (s + 1) THEN i // (s + 1) ELSE x + (i - x * (s + 1)) // s END AS own FROM (SELECT row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () // 5 AS s, count(*) OVER () % 5 AS x FROM (SELECT DISTINCT t FROM el))) GROUP BY own) f) GROUP BY fold, role", "")
def m3(spark, sf):
    return M.purged_kfold(eligible(spark, sf), 5, 2, 1)


@register("m4_rolling_windows", "SELECT CAST(f AS INT) AS fold, f * 6 AS train_start, f * 6 + 23 AS train_end, f * 6 + 24 AS test_start, f * 6 + 29 AS test_end FROM (SELECT unnest(range((count(DISTINCT t) - 30) // 6 + 1)) AS f FROM el)", "")
def m4(spark, sf):
    return M.rolling_folds(spark, eligible(spark, sf).select("t").distinct().count(), 24, 6, 6)


def ridged(spark, sf):
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", *FEATURES), folds(spark, sf)), "folds"), FEATURES)
    model = M.ridge(rows, FEATURES, "fwd", 10.0)
    return rows, model


@register("m6_ridge_by_fold", f"SELECT fold, count(*) AS rows, avg(fwd) - covar_pop(fwd, z) * count(*) / (var_pop(z) * count(*) + 10) * avg(z) AS intercept, covar_pop(fwd, z) * count(*) / (var_pop(z) * count(*) + 10) AS slope FROM (SELECT fold, fwd, (mom - avg(mom) OVER (PARTITION BY fold)) / stddev_pop(mom) OVER (PARTITION BY fold) AS z FROM el JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM el)) USING (t) JOIN {FOLDS} ON i <= train_end) GROUP BY fold", "intercept slope")
def m6(spark, sf):
    rows = M.imputed(once(M.assigned(eligible(spark, sf).select("entity", "t", "fwd", "mom"), folds(spark, sf)), "folds"), ["mom"])
    return M.ridge(rows, ["mom"], "fwd", 10.0).select("fold", "rows", "intercept", F.col("mom").alias("slope"))


@register("m12_out_of_sample_scores")
def m12(spark, sf):
    rows, model = ridged(spark, sf)
    return M.scored(rows, model, FEATURES, least_rows=50).select("fold", "entity", "t", "score", "fwd")


@register("m13_ic_weighted_ensemble", "SELECT fold, signal, m / nullif(sum(abs(m)) OVER (PARTITION BY fold), 0) AS weight FROM (SELECT fold, signal, avg(ic) AS m FROM (SELECT *, dense_rank() OVER (PARTITION BY signal ORDER BY t) - 1 AS i FROM (SELECT signal, t, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic FROM (SELECT signal, t, rank() OVER (PARTITION BY signal, t ORDER BY x) + (count(*) OVER (PARTITION BY signal, t, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY signal, t ORDER BY y) + (count(*) OVER (PARTITION BY signal, t, y) - 1) / 2.0 AS b FROM (SELECT t, unnest(['mom', 'rev', 'rev3']) AS signal, unnest([mom, rev, rev3]) AS x, fwd AS y FROM el) WHERE x IS NOT NULL) GROUP BY signal, t)) JOIN (SELECT CAST(f AS INT) AS fold, f * 6 AS a, f * 6 + 23 AS b FROM (SELECT unnest(range((count(DISTINCT t) - 30) // 6 + 1)) AS f FROM el)) ON i BETWEEN a AND b GROUP BY 1, 2)", "weight")
def m13(spark, sf):
    from tidemark.operators.evaluate import rank_ic

    df = eligible(spark, sf)
    long = df.select("t", "entity", "fwd", F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("x")) for c in FEATURES])).alias("s")).select("t", "entity", "fwd", "s.*")
    ics = rank_ic(long, "x", "fwd", "signal").withColumn("i", F.dense_rank().over(Window.partitionBy("signal").orderBy("t")) - 1)
    return M.ensemble_weights(ics, m4(spark, sf))


@register("m14_weight_stability")
def m14(spark, sf):
    return M.weight_stability(ridged(spark, sf)[1], FEATURES)


@register("m8_logistic")
def m8(spark, sf):
    df = eligible(spark, sf).select((F.col("fwd") > 0).alias("y"), *FEATURES)
    beta = M.logistic(df, FEATURES, "y")
    return spark.createDataFrame([(n, float(b)) for n, b in zip(["intercept", *FEATURES], beta, strict=True)], "name string, beta double")


@register("q1_isotonic")
def q1(spark, sf):
    df = eligible(spark, sf).select(F.col("mom").alias("x"), (F.col("fwd") > 0).alias("y"))
    return M.isotonic(df, "x", "y")


@register("q4_brier", "SELECT sector, count(*) AS n, avg(pow(rx / names - (fwd > 0)::INT, 2)) AS brier, avg(rx / names) AS mean_p, avg((fwd > 0)::INT) AS rate FROM rk GROUP BY sector", "brier mean_p rate")
def q4(spark, sf):
    from tidemark.operators.cross import percent_rank

    df = eligible(spark, sf).select("sector", percent_rank("mom", "t").alias("p"), (F.col("fwd") > 0).alias("y"))
    return M.brier(df, "p", "y", "sector")


YEARS = "(SELECT *, t // 12 AS fold FROM el)"


@register("q3_q5_conformal_intervals", f"SELECT e.entity, e.t, e.mom + a AS low, e.mom + b AS high FROM {YEARS} e LEFT JOIN (SELECT f.fold, quantile_cont(fwd - mom, 0.1) AS a, quantile_cont(fwd - mom, 0.9) AS b FROM {YEARS} p JOIN (SELECT DISTINCT fold FROM {YEARS}) f ON p.fold < f.fold GROUP BY f.fold HAVING count(*) >= 20) q USING (fold)", "low high")
def q5(spark, sf):
    df = eligible(spark, sf).withColumn("fold", F.floor(F.col("t") / 12).cast("int"))
    return M.conformal(df, "mom", "fwd", 0.8, 20).select("entity", "t", "low", "high")


@register("q6_risk_bands", "SELECT entity, t, CASE WHEN dvol <= a THEN 'low' WHEN dvol <= b THEN 'medium' ELSE 'high' END AS band FROM el JOIN (SELECT t, quantile_cont(dvol, 1 / 3) AS a, quantile_cont(dvol, 2 / 3) AS b FROM el GROUP BY t) USING (t)", "")
def q6(spark, sf):
    return M.risk_bands(eligible(spark, sf), "dvol", "t").select("entity", "t", "band")


@register("q7_recommendations", "SELECT rec, count(*) AS n FROM (SELECT CASE WHEN p >= 0.6 AND mom > 0 THEN CASE WHEN high THEN 'BUY' ELSE 'STRONG_BUY' END WHEN p >= 0.53 AND mom > 0 THEN 'BUY' WHEN p <= 0.4 AND mom < 0 THEN CASE WHEN high THEN 'SELL' ELSE 'STRONG_SELL' END WHEN p <= 0.47 AND mom < 0 THEN 'SELL' ELSE 'HOLD' END AS rec FROM (SELECT *, rx / names AS p, ox > 50 AS high FROM rk)) GROUP BY rec", "")
def q7(spark, sf):
    from tidemark.functions.stats import ordinal_rank
    from tidemark.operators.cross import percent_rank

    df = eligible(spark, sf).withColumns({"p": percent_rank("mom", "t"), "band": F.when(ordinal_rank("mom", "entity", "t") > 50, "high").otherwise("low")})
    return df.groupBy(M.recommendation(F.col("p"), F.col("mom"), F.col("band")).alias("rec")).agg(F.count(F.lit(1)).alias("n"))


@register("q10_direction_score", "SELECT entity, t, (coalesce(tanh(mom * 5) * 2, 0) + coalesce(tanh(rev3 * 3), 0)) / nullif(2 * (mom IS NOT NULL)::INT + (rev3 IS NOT NULL)::INT, 0) AS score FROM sig", "score")
def q10(spark, sf):
    return signals(spark, sf).select("entity", "t", M.direction_score({"m": ("mom", 5.0, 2.0), "r": ("rev3", 3.0, 1.0)}).alias("score"))


@register("e1_market_states", f"SELECT t, trend FROM {STATE}", "")
def e1(spark, sf):
    return R.market_states(panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")).select("t", "trend")


@register("e2_ic_by_state", f"SELECT trend, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic JOIN {STATE} USING (t) GROUP BY trend", "mean std")
def e2(spark, sf):
    return R.by_state(a1(spark, sf), e1(spark, sf), "ic", "trend")


@register("e2_state_transitions", f"SELECT before, after, n, n / sum(n) OVER (PARTITION BY before) AS share FROM (SELECT before, after, count(*) AS n FROM (SELECT lag(trend) OVER (ORDER BY t) AS before, trend AS after FROM {STATE}) WHERE before IS NOT NULL GROUP BY 1, 2)", "share")
def e2_transitions(spark, sf):
    return R.transitions(e1(spark, sf), "trend")


SHOCKS = "(SELECT t, 'price' AS driver, bench / lag(bench) OVER (ORDER BY t) - 1 AS change FROM bench)"


@register("e4_driver_sensitivities", f"SELECT s.entity, s.t, driver, CASE WHEN count(x) OVER w >= 8 THEN covar_samp(y, x) OVER w / nullif(var_samp(x) OVER w, 0) END AS beta FROM (SELECT s.entity, s.t, driver, CASE WHEN change IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN change END AS x FROM sig s JOIN {SHOCKS} d USING (t)) s WINDOW w AS (PARTITION BY s.entity, driver ORDER BY s.t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)", "beta")
def e4(spark, sf):
    bench = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")
    drivers = bench.select("t", F.lit("price").alias("driver"), (F.col("bench") / F.lag("bench").over(Window.orderBy("t")) - 1).alias("change"))
    return R.driver_sensitivities(signals(spark, sf), drivers, 12, 8).select("entity", "t", "driver", "beta")


@register("e5_event_table", "SELECT event_id, value / nullif(CASE WHEN count(value) OVER w >= 4 THEN stddev_samp(value) OVER w END, 0) AS standardized, sum((value > 1)::INT) OVER (PARTITION BY entity, island ORDER BY ts, event_id) AS streak FROM (SELECT *, sum((NOT value > 1)::INT) OVER (PARTITION BY entity ORDER BY ts, event_id) AS island FROM evt) WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)", "standardized")
def e5(spark, sf):
    df = W.prior_events(panels.user_events(spark, sf), "value", 4).withColumn("o", F.struct("ts", "event_id")).withColumn("up", F.col("value") > 1)
    return W.streaks(df, "up", t="o").select("event_id", "standardized", "streak")


@register("f1_first_reported", "SELECT o_custkey AS entity, CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS q, arg_min(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS status, count(DISTINCT o_orderstatus) > 1 AS restated FROM orders GROUP BY 1, 2", "")
def f1(spark, sf):
    o = panels.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.date_trunc("quarter", "o_orderdate").cast("date").cast("string").alias("q"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return FU.first_reported(o, ["entity", "q"], "status", "at").drop("at")


@register("f2_ratio_features", "SELECT l_orderkey, sum(l_extendedprice * 1.0) AS revenue, round(sum(l_tax) / sum(l_quantity), 9) AS margin FROM lineitem GROUP BY l_orderkey", "revenue margin")
def f2(spark, sf):
    li = panels.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("tax"))
    return FU.ratio_features(li, "tax", "q", "revenue", "tax").select("l_orderkey", "revenue", "margin")


@register("f5_trailing_year", "SELECT entity, CAST(period_end AS VARCHAR) AS period_end, CASE WHEN lag(period_end, 3) OVER o = last_day(period_end - INTERVAL 9 MONTH) THEN sum(value) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS ttm FROM facts WINDOW o AS (PARTITION BY entity ORDER BY period_end)", "ttm")
def f5(spark, sf):
    return FU.trailing_year(panels.facts(spark, sf), "value").select("entity", F.col("period_end").cast("string").alias("period_end"), "ttm")


@register("f7_merged_statements", "SELECT coalesce(a.entity, b.entity) AS entity, CAST(coalesce(a.period_end, b.period_end) AS VARCHAR) AS period_end, a.value AS big, b.value AS small FROM (SELECT * FROM facts WHERE value > 300000) a FULL JOIN (SELECT entity, period_end, value FROM facts WHERE value < 500000) b ON a.entity = b.entity AND a.period_end = b.period_end", "big small")
def f7(spark, sf):
    f = panels.facts(spark, sf)
    out = FU.merged_statements({"big": (f.where("value > 300000"), "value"), "small": (f.where("value < 500000"), "value")}, ["entity", "period_end"], "available_date")
    return out.select("entity", F.col("period_end").cast("string").alias("period_end"), "big", "small")


@register("f10_factor_transforms", "SELECT entity, t, sign(mom) * ln(1 + abs(mom)) AS logged, rx / names - 0.5 AS centred, mom * rev AS product FROM rk", "logged centred product")
def f10(spark, sf):
    from tidemark.operators.cross import percent_rank

    return eligible(spark, sf).select("entity", "t", signed_log("mom").alias("logged"), (percent_rank("mom", "t") - 0.5).alias("centred"), (F.col("mom") * F.col("rev")).alias("product"))


SRC = {"op": "source", "field": "close"}


def document(name: str, doc: dict, sql: str):
    """A query of a feature document over the monthly panel."""

    @register(name, sql, "value")
    def run(spark, sf):
        panel = signals(spark, sf).select("entity", "t", "close", "dvol", "sector")
        return dsl.compile_feature(doc, panel)

    return run


MONTHS = "(SELECT DISTINCT t FROM px_m)"
ROLL = lambda f, w, least: f"SELECT entity, m.t, {f} AS value FROM px_m p JOIN {MONTHS} m ON m.t BETWEEN p.t AND p.t + {w - 1} GROUP BY entity, m.t HAVING count(*) >= {least}"
document("d1_lag", {"op": "lag", "inputs": [SRC], "params": {"periods": 2}}, f"SELECT entity, p.t + 2 AS t, close AS value FROM px_m p WHERE p.t + 2 IN {MONTHS}")
document("d2_percentage_change", {"op": "percentage_change", "inputs": [SRC], "params": {"periods": 3}}, "SELECT a.entity, a.t, (a.close - b.close) / abs(b.close) AS value FROM px_m a JOIN px_m b ON a.entity = b.entity AND b.t = a.t - 3")
document("d2_difference", {"op": "difference", "inputs": [SRC], "params": {"periods": 1}}, "SELECT a.entity, a.t, a.close - b.close AS value FROM px_m a JOIN px_m b ON a.entity = b.entity AND b.t = a.t - 1")
document("d3_rolling_mean", {"op": "rolling_mean", "inputs": [SRC], "params": {"window": 4, "min_periods": 2}}, ROLL("avg(close)", 4, 2))
document("d3_rolling_median", {"op": "rolling_median", "inputs": [SRC], "params": {"window": 4}}, ROLL("quantile_cont(close, 0.5)", 4, 4))
document("d4_rolling_slope", {"op": "rolling_slope", "inputs": [SRC], "params": {"window": 6, "min_periods": 3}}, ROLL("regr_slope(close, p.t - m.t)", 6, 3))
document("d5_zscore", {"op": "zscore", "inputs": [SRC], "params": {"window": 6}}, "SELECT * FROM (SELECT entity, t, CASE WHEN count(*) OVER w = 6 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS value FROM px_m WINDOW w AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE value IS NOT NULL")
document("d6_cross_sectional_rank", {"op": "cross_sectional_rank", "inputs": [SRC]}, "SELECT entity, t, CASE WHEN n = 1 THEN 1 ELSE (n - i) / (n - 1) END AS value FROM (SELECT entity, t, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY close DESC, entity) AS i FROM px_m)")
document("d7_sector_neutral_of_winsorized", {"op": "sector_neutralize", "inputs": [{"op": "winsorize", "inputs": [SRC]}]}, "SELECT entity, t, v - avg(v) OVER (PARTITION BY t, sector) AS value FROM (SELECT p.entity, p.t, least(greatest(close, a), b) AS v FROM px_m p JOIN (SELECT t, quantile_cont(close, 0.01) AS a, quantile_cont(close, 0.99) AS b FROM px_m GROUP BY t) q ON p.t = q.t) JOIN sec USING (entity)")
document("d8_ratio_and_bounded_sum", {"op": "bounded_sum", "inputs": [{"op": "ratio", "inputs": [{"op": "source", "field": "dvol"}, SRC]}, SRC], "params": {"lower": 0.0, "upper": 1500.0}}, "SELECT entity, t, least(greatest(dvol / close + close, 0), 1500) AS value FROM px_m")


@register("v1_v2_forecasts", "SELECT entity, t, h, model, forecast FROM (SELECT entity, t, h, unnest(['drift', 'naive', 'sma', 'linear']) AS model, unnest([close * exp(mu * h), close, close + (sma - close) * h / 5, sma + slope * (n + h - mid)]) AS forecast FROM (SELECT *, count(r) OVER w AS c, avg(r) OVER w AS mu, avg(close) OVER w AS sma, regr_slope(close, n) OVER w AS slope, avg(n) OVER w AS mid FROM (SELECT entity, t, close, row_number() OVER (PARTITION BY entity ORDER BY t) AS n, ln(close / lag(close) OVER (PARTITION BY entity ORDER BY t)) AS r FROM px_m) WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), (SELECT CAST(unnest(range(1, 6)) AS INT) AS h) WHERE c >= 12)", "forecast")
def v1(spark, sf):
    return forecasts.forecasts(prices(spark, sf), 12, 5).drop("close")


@register("v4_business_days", "SELECT CAST(date AS VARCHAR) AS date, CAST(f AS VARCHAR) AS forecast_date FROM (SELECT date, f, row_number() OVER (PARTITION BY date ORDER BY f) AS i FROM (SELECT DISTINCT date, CAST(date + CAST(k AS INT) AS DATE) AS f FROM px_d, (SELECT unnest(range(1, 12)) AS k)) WHERE isodow(f) < 6) WHERE i <= 5", "")
def v4(spark, sf):
    days = panels.daily_prices(spark, sf).select("date").distinct()
    return forecasts.business_days(days, 5).select(F.col("date").cast("string").alias("date"), F.col("forecast_date").cast("string").alias("forecast_date"))


@register("v5_replay", "SELECT *, CASE WHEN change > 0.01 AND up >= 0.5 THEN 'BUY' WHEN change < -0.01 AND up <= 0.5 THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM (SELECT entity, t, max(close) AS close, avg(forecast) AS mean, quantile_cont(forecast, 0.5) AS median, avg((forecast > close)::INT) AS up, quantile_cont(forecast, 0.5) / max(close) - 1 AS change FROM (SELECT entity, t, close, unnest([close * exp(mu * 5), close, close + (sma - close) * 5 / 5, sma + slope * (n + 5 - mid)]) AS forecast FROM (SELECT *, count(r) OVER w AS c, avg(r) OVER w AS mu, avg(close) OVER w AS sma, regr_slope(close, n) OVER w AS slope, avg(n) OVER w AS mid FROM (SELECT entity, t, close, row_number() OVER (PARTITION BY entity ORDER BY t) AS n, ln(close / lag(close) OVER (PARTITION BY entity ORDER BY t)) AS r FROM px_m) WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE c >= 12) GROUP BY entity, t)", "close mean median up change")
def v5(spark, sf):
    return forecasts.replay(prices(spark, sf), 12, 5)


def streamed_events(spark, sf):
    """The events table as a stream. Its times have no zone; as instants of UTC they don't depend on the session's."""
    instant = F.timestamp_seconds(F.unix_date(F.to_date("ts")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts")))
    schema = panels.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", instant)


@register("x1_deduplicated_ingest", "SELECT event_id, entity, type, value FROM evt", "value")
def x1(spark, sf):
    """Every event twice through a stream that keeps the first of each; batches are appended, and read back."""
    at = scratch(spark, "stream")
    twice = streamed_events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = ingest.deduplicated(twice, ["event_id"], "ts", "40 days").select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("type"), "value")
    ingest.upsert_into(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}"), f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/rows").drop("batch")


@register("x2_streamed_bars", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, type, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close, count(*) AS n FROM evt GROUP BY 1, 2", "open high low close")
def x2(spark, sf):
    """Daily bars of the stream; each batch replaces the bars so far, and the last are read back."""
    at = scratch(spark, "stream")
    daily = ingest.bars(streamed_events(spark, sf).withColumnRenamed("event_type", "type"), "ts", "value", "1 day", None, "type")
    publish = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/bars/batch={number}")
    daily.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{at}/bars")
    last = found.agg(F.max("batch").alias("batch"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string")
    return found.join(F.broadcast(last), "batch").select(day.alias("day"), "type", "open", "high", "low", "close", "n")


@register("x3_refresh_contract", "SELECT max(t) AS last, sum((t > c)::INT) AS after_cutoff, (SELECT count(*) FROM (SELECT DISTINCT entity FROM px_m WHERE t < (SELECT max(t) - 1 FROM px_m) EXCEPT SELECT entity FROM px_m WHERE t < (SELECT max(t) FROM px_m) AND entity % 5 <> 3)) AS lost_entities, CAST(0 AS BIGINT) AS lost_sessions, false AS ok FROM px_m, (SELECT max(t) - 1 AS c FROM px_m) WHERE t <= c AND entity % 5 <> 3", "")
def x3(spark, sf):
    """A refresh up to the last month but one that has lost every fifth name."""
    px = prices(spark, sf)
    cutoff = px.agg(F.max("t")).first()[0] - 1
    return ingest.contract(px.where(F.col("t") < cutoff), px.where((F.col("t") <= cutoff) & (F.col("entity") % 5 != 3)), "entity", "t", cutoff)


@register("scalar_functions", "SELECT entity, t, least(greatest(close, 900), 1100) AS clipped, dvol / nullif(n - 3, 0) AS safe FROM px_m", "clipped safe")
def scalars(spark, sf):
    return prices(spark, sf).select("entity", "t", clip("close", 900.0, 1100.0).alias("clipped"), ratio("dvol", F.col("n") - 3).alias("safe"))


@register("w19_labelled_dataset", "SELECT s.entity, s.t, mom, fwd - (lead_b / bench - 1) AS label FROM sig s JOIN (SELECT t, bench, max(bench) OVER (ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS lead_b FROM bench) b USING (t) WHERE mom IS NOT NULL AND fwd IS NOT NULL", "mom label")
def w19(spark, sf):
    labels = W.forward_excess(benched(spark, sf), 1).select("entity", "t", F.col("fwd_excess").alias("label"))
    return signals(spark, sf).where("mom is not null and fwd is not null").select("entity", "t", "mom").join(labels, ["entity", "t"])


