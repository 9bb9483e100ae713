"""Queries of evaluation, books and statistical inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators import books as B
from tidemark.operators import evaluate as A
from tidemark.operators import tables as T
from tidemark.plans.base import eligible, register, returns_with_bench, signals

SUMMARY = "count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg((ic > 0)::INT) AS positive, avg(ic) / stddev_samp(ic) AS ir, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t_stat, CASE WHEN avg(ic) >= 0 THEN avg((ic > 0)::INT) ELSE 1 - avg((ic > 0)::INT) END AS hit"
SUMMED = "mean std positive ir t_stat hit"
ICS = lambda cte, keys, x="x", y="y": f"SELECT {keys}, t, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic FROM (SELECT *, rank() OVER (PARTITION BY {keys}, t ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, t, {x}) - 1) / 2.0 AS a, rank() OVER (PARTITION BY {keys}, t ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, t, {y}) - 1) / 2.0 AS b FROM {cte} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}, t"


@register("flagship", f"SELECT {SUMMARY} FROM ic", SUMMED)
def flagship(spark, sf):
    """Six-month momentum against the next month's return: rank IC by month, summed up."""
    return A.ic_summary(A.rank_ic(eligible(spark, sf), "mom", "fwd"))


@register("a1_rank_ic", "SELECT * FROM ic", "ic")
def a1(spark, sf):
    return A.rank_ic(eligible(spark, sf), "mom", "fwd")


@register("a2_rank_ic_ordinal", "SELECT t, count(*) AS names, round(covar_pop(ox, oy) / nullif(sqrt(var_pop(ox) * var_pop(oy)), 0), 12) AS ic FROM rk GROUP BY t", "ic")
def a2(spark, sf):
    return A.rank_ic(eligible(spark, sf), "mom", "fwd", ties="ordinal")


@register("a3_pooled_correlations", "SELECT count(*) AS n, corr(a, b) AS spearman, corr(mom, fwd) AS pearson FROM (SELECT mom, fwd, rank() OVER (ORDER BY mom) + (count(*) OVER (PARTITION BY mom) - 1) / 2.0 AS a, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1) / 2.0 AS b FROM el)", "spearman pearson")
def a3(spark, sf):
    return A.pooled_rank_ic(eligible(spark, sf), "mom", "fwd")


@register("a5_newey_west", "SELECT n, m AS mean, m / sqrt((s0 + 2 * (0.75 * s1 + 0.5 * s2 + 0.25 * s3)) / n / n) AS t_stat FROM (SELECT count(*) AS n, any_value(m) AS m, sum(d * d) AS s0, sum(d * l1) AS s1, sum(d * l2) AS s2, sum(d * l3) AS s3 FROM (SELECT m, d, lag(d, 1) OVER (ORDER BY t) AS l1, lag(d, 2) OVER (ORDER BY t) AS l2, lag(d, 3) OVER (ORDER BY t) AS l3 FROM (SELECT t, ic - avg(ic) OVER () AS d, avg(ic) OVER () AS m FROM ic WHERE ic IS NOT NULL)))", "mean t_stat")
def a5(spark, sf):
    return A.newey_west_t(a1(spark, sf), "ic", 3)


@register("a6_ic_by_year", "SELECT t // 12 AS period, count(ic) AS n, avg(ic) AS mean, avg((ic > 0)::INT) AS positive FROM ic GROUP BY 1", "mean positive")
def a6(spark, sf):
    return A.decomposed(a1(spark, sf), F.floor(F.col("t") / 12).cast("int"))


@register("a7_quantile_spread", "SELECT t, count(*) AS names, avg(fwd) FILTER (ox > names - greatest(1, names // 5)) AS top, avg(fwd) FILTER (ox <= greatest(1, names // 5)) AS bottom, avg(fwd) FILTER (ox > names - greatest(1, names // 5)) - avg(fwd) FILTER (ox <= greatest(1, names // 5)) AS spread FROM rk GROUP BY t", "top bottom spread")
def a7(spark, sf):
    return A.quantile_spread(eligible(spark, sf), "mom", "fwd", 0.2)


@register("a8_monotonicity", "SELECT *, mean > lag(mean) OVER (ORDER BY bucket) AS rises FROM (SELECT CAST((ox - 1) * 5 // names AS INT) AS bucket, avg(fwd) AS mean, count(*) AS n FROM rk GROUP BY 1)", "mean")
def a8(spark, sf):
    return A.bucket_means(eligible(spark, sf), "mom", "fwd", 5)


@register("a9_edge_buckets", "SELECT len(list_filter(edges, lambda e: e < mom)) AS bucket, count(*) AS n, avg(mom) AS mean_x, avg(fwd) AS mean_y, avg((fwd > 0)::INT) AS positive FROM el, (SELECT list_distinct(quantile_cont(mom, [0.25, 0.5, 0.75])) AS edges FROM el) GROUP BY 1", "mean_x mean_y positive")
def a9(spark, sf):
    return A.edge_buckets(eligible(spark, sf), "mom", "fwd", 4)


@register("a10_precision_at_k", "SELECT n, count(*) AS dates, avg(mean) AS mean, avg(hit) AS hit, avg(universe) AS universe FROM (SELECT n, t, avg(fwd) FILTER (i <= n) AS mean, avg((fwd > 0)::INT) FILTER (i <= n) AS hit, avg(fwd) AS universe FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mom DESC, entity) AS i FROM el), (SELECT unnest([1, 3, 5]) AS n) s(n) GROUP BY n, t) GROUP BY n".replace("SELECT n, t,", "SELECT s.n AS n, t,").replace("(i <= n)", "(i <= s.n)").replace("GROUP BY n, t", "GROUP BY s.n, t"), "mean hit universe")
def a10(spark, sf):
    return A.precision_at(eligible(spark, sf), "mom", "fwd", [1, 3, 5])


@register("a11_by_recommendation", "SELECT rec, count(*) AS rows, avg(fwd) AS mean, stddev_samp(fwd) AS std, sum((fwd > 0)::INT) AS gains FROM (SELECT *, CASE WHEN rx / names > 0.8 THEN 'buy' WHEN rx / names <= 0.2 THEN 'sell' ELSE 'hold' END AS rec FROM rk) GROUP BY rec", "mean std")
def a11(spark, sf):
    from tidemark.operators.cross import percent_rank

    share = percent_rank("mom", "t")
    df = eligible(spark, sf).withColumn("rec", F.when(share > 0.8, "buy").when(share <= 0.2, "sell").otherwise("hold"))
    return df.groupBy("rec").agg(F.count(F.lit(1)).alias("rows"), F.avg("fwd").alias("mean"), F.stddev_samp("fwd").alias("std"), F.sum((F.col("fwd") > 0).cast("int")).alias("gains"))


@register("a12_hit_rate_and_error", "SELECT p AS hit, sqrt(p * (1 - p) / n) AS standard_error, losses, worst FROM (SELECT avg((fwd > 0)::INT) AS p, count(*) AS n, sum((fwd < -0.1)::INT) AS losses, min(fwd) AS worst FROM el)", "hit standard_error worst")
def a12(spark, sf):
    df = eligible(spark, sf).agg(F.avg((F.col("fwd") > 0).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n"), F.sum((F.col("fwd") < -0.1).cast("int")).alias("losses"), F.min("fwd").alias("worst"))
    return df.select("hit", F.sqrt(F.col("hit") * (1 - F.col("hit")) / F.col("n")).alias("standard_error"), "losses", "worst")


@register("a13_signal_battery", f"SELECT signal, {SUMMARY} FROM ({ICS('u', 'signal')}) GROUP BY signal".replace("FROM u", "FROM (SELECT t, entity, unnest(['mom', 'rev', 'rev3']) AS signal, unnest([mom, rev, rev3]) AS x, fwd AS y FROM el)"), SUMMED)
def a13(spark, sf):
    return A.sweep(eligible(spark, sf), ["mom", "rev", "rev3"], ["fwd"]).withColumnRenamed("feature", "signal").drop("horizon")


@register("a14_slices", "SELECT slice, count(gross) AS n, avg(gross) AS mean, stddev_samp(gross) AS std FROM (SELECT *, unnest(list_filter(['full', CASE WHEN i <= 30 THEN 'dev' END, CASE WHEN i BETWEEN 31 AND 50 THEN 'val' END, CASE WHEN i > 50 THEN 'holdout' END, CASE WHEN i > 30 THEN 'post' END], lambda x: x IS NOT NULL)) AS slice FROM stream) GROUP BY slice", "mean std")
def a14(spark, sf):
    i = F.col("i")
    return A.sliced(b1(spark, sf), {"full": F.lit(True), "dev": i <= 30, "val": i.between(31, 50), "holdout": i > 50, "post": i > 30}, "gross")


@register("a16_signal_correlation", f"SELECT a, b, avg(ic) AS corr FROM ({ICS('u', 'a_, b_')}) GROUP BY a, b".replace("a_, b_", "k").replace("SELECT a, b, avg(ic)", "SELECT k[1] AS a, k[2] AS b, avg(ic)").replace("GROUP BY a, b", "GROUP BY k").replace("FROM u", "FROM (SELECT t, unnest([['mom', 'rev'], ['mom', 'rev3'], ['rev', 'rev3']]) AS k, unnest([mom, mom, rev]) AS x, unnest([rev, rev3, rev3]) AS y FROM el)"), "corr")
def a16(spark, sf):
    return A.signal_correlation(eligible(spark, sf), ["mom", "rev", "rev3"])


STREAMS = "(SELECT CAST(sector AS VARCHAR) AS k, t, avg(ret) AS ret FROM sig WHERE ret IS NOT NULL GROUP BY 1, 2)"


def sector_streams(spark, sf):
    return signals(spark, sf).where(F.col("ret").isNotNull()).groupBy(F.col("sector").cast("string").alias("k"), "t").agg(F.avg("ret").alias("ret"))


@register("a17_stream_correlation", f"SELECT a.k AS a, b.k AS b, count(*) AS n, corr(a.ret, b.ret) AS corr FROM {STREAMS} a JOIN {STREAMS} b ON a.t = b.t AND a.k < b.k GROUP BY a.k, b.k HAVING count(*) >= 12", "corr")
def a17(spark, sf):
    return A.stream_correlation(sector_streams(spark, sf))


@register("a17_clusters", f"WITH RECURSIVE s AS (SELECT * FROM {STREAMS}), l AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.t = b.t AND a.k < b.k GROUP BY a.k, b.k HAVING count(*) >= 12 AND abs(corr(a.ret, b.ret)) >= 0.1), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(k, c) AS (SELECT DISTINCT k, k FROM s UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.c) SELECT k, min(c) AS cluster FROM r GROUP BY k", "")
def a17_clusters(spark, sf):
    return A.linked_clusters(a17(spark, sf), sector_streams(spark, sf).select("k").distinct(), 0.1)


@register("a18_concentration", "SELECT t, max(s) AS top_share, sum(s * s) AS hhi, 1 / sum(s * s) AS effective_n FROM (SELECT t, w / sum(w) OVER (PARTITION BY t) AS s FROM (SELECT t, sector, CAST(count(*) AS DOUBLE) AS w FROM book WHERE side = 1 GROUP BY t, sector)) GROUP BY t", "top_share hhi effective_n")
def a18(spark, sf):
    longs = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1").withColumn("w", F.lit(1.0))
    return A.concentration(longs, "w", "sector", "t")


@register("a19_coverage", "SELECT sector, field, count(*) AS n, sum(there) AS present, avg(there) AS share FROM (SELECT sector, unnest(['mom', 'fwd', 'ret']) AS field, unnest([(mom IS NOT NULL)::INT, (fwd IS NOT NULL)::INT, (ret IS NOT NULL)::INT]) AS there FROM sig) GROUP BY sector, field", "share")
def a19(spark, sf):
    return A.coverage(signals(spark, sf), ["mom", "fwd", "ret"], "sector")


@register("a20_matched_control_lift", "SELECT count(*) AS n, avg(l) AS lift, avg((l > 0)::INT) AS hit, avg(fwd) FILTER (fwd > 0) / abs(avg(fwd) FILTER (fwd < 0)) AS payoff, quantile_cont(fwd, 0.1) AS worst_decile FROM (SELECT fwd, fwd - c AS l FROM rk r JOIN (SELECT t, sector, avg(fwd) AS c FROM rk WHERE NOT rx / names > 0.8 GROUP BY t, sector) USING (t, sector) WHERE rx / names > 0.8)", "lift hit payoff worst_decile")
def a20(spark, sf):
    from tidemark.operators.cross import percent_rank

    df = eligible(spark, sf).withColumn("trigger", percent_rank("mom", "t") > 0.8)
    return A.lift(df, "trigger", "fwd", "t", "sector")


@register("a21_sector_attribution", f"SELECT slice, {SUMMARY} FROM ({ICS('u', 'slice')}) GROUP BY slice".replace("FROM u", "FROM (SELECT slice, t, mom AS x, fwd AS y FROM el, (SELECT DISTINCT CAST(sector AS VARCHAR) AS slice FROM el UNION ALL SELECT 'all') WHERE slice = 'all' OR slice <> CAST(sector AS VARCHAR))"), SUMMED)
def a21(spark, sf):
    return A.attribution(eligible(spark, sf), "mom", "fwd", "sector")


@register("a22_survivorship", "SELECT count(*) AS entities, sum((last = m)::INT) AS alive, sum((last < m)::INT) AS gone, avg(months) AS months FROM (SELECT entity, max(t) AS last, count(*) AS months FROM px_m GROUP BY entity), (SELECT max(t) AS m FROM px_m)", "months")
def a22(spark, sf):
    from tidemark.plans.base import prices

    px = prices(spark, sf)
    each = px.groupBy("entity").agg(F.max("t").alias("last"), F.count(F.lit(1)).alias("months")).crossJoin(F.broadcast(px.agg(F.max("t").alias("m"))))
    return each.agg(F.count(F.lit(1)).alias("entities"), F.sum((F.col("last") == F.col("m")).cast("int")).alias("alive"), F.sum((F.col("last") < F.col("m")).cast("int")).alias("gone"), F.avg("months").alias("months"))


@register("a24_forecast_ensemble", "SELECT *, greatest(up, 1 - up) AS agreement, 1 / (1 + deviation / nullif(abs(mean), 0)) AS confidence FROM (SELECT entity, t, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS deviation, count(x) AS models, avg((x > 0)::INT) AS up FROM (SELECT entity, t, unnest([mom, rev, rev3]) AS x FROM el) GROUP BY entity, t)", "mean median deviation up agreement confidence")
def a24(spark, sf):
    df = eligible(spark, sf).select("entity", "t", F.explode(F.array("mom", "rev", "rev3")).alias("x")).where("x is not null")
    return A.forecast_ensemble(df, "x", "entity", "t")


@register("a25_error_metrics", "SELECT sector, avg(abs(e)) * 100 AS mae_pct, sqrt(avg(e * e)) * 100 AS rmse_pct FROM (SELECT sector, (close - close * (1 + fwd)) / nullif(close * (1 + fwd), 0) AS e FROM el) GROUP BY sector", "mae_pct rmse_pct")
def a25(spark, sf):
    df = eligible(spark, sf).withColumn("actual", F.col("close") * (1 + F.col("fwd")))
    return A.error_metrics(df, "actual", "close", "sector")


@register("a27_feature_horizon_sweep", f"SELECT feature, horizon, {SUMMARY} FROM ({ICS('u', 'feature, horizon')}) GROUP BY feature, horizon".replace("FROM u", "FROM (SELECT t, unnest(['mom', 'mom', 'rev', 'rev']) AS feature, unnest(['fwd', 'fwd2', 'fwd', 'fwd2']) AS horizon, unnest([mom, mom, rev, rev]) AS x, unnest([fwd, fwd2, fwd, fwd2]) AS y FROM (SELECT *, max(close) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) / close - 1 AS fwd2 FROM sig))"), SUMMED)
def a27(spark, sf):
    from tidemark.operators.windows import forward_return

    df = signals(spark, sf).withColumn("fwd2", forward_return("close", 2))
    return A.sweep(df, ["mom", "rev"], ["fwd", "fwd2"])


@register("a30_top_decile_by_year", "SELECT t // 12 AS year, avg(fwd) AS top_mean, avg((fwd > 0)::INT) AS hit, count(*) AS n FROM rk WHERE ox > names - greatest(1, names // 10) GROUP BY 1", "top_mean hit")
def a30(spark, sf):
    top = B.legs(eligible(spark, sf), "mom", 0.1).where("side = 1")
    return top.groupBy(F.floor(F.col("t") / 12).cast("int").alias("year")).agg(F.avg("fwd").alias("top_mean"), F.avg((F.col("fwd") > 0).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n"))


@register("k1_top_and_bottom", "SELECT t, entity, side FROM book", "")
def k1(spark, sf):
    return B.legs(eligible(spark, sf), "mom", 0.2).select("t", "entity", "side")


@register("k2_sector_capped", "SELECT t, entity, place FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mom DESC, entity) AS place FROM (SELECT *, row_number() OVER (PARTITION BY t, sector ORDER BY mom DESC, entity) AS g FROM el) WHERE g <= 2) WHERE place <= 6", "")
def k2(spark, sf):
    return B.capped_by_group(eligible(spark, sf), "mom", 6, 2, "sector").select("t", "entity", "place")


@register("k3_hysteresis")
def k3(spark, sf):
    df = eligible(spark, sf).withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    df = df.withColumn("score", F.when(F.col("strategy") == "a", F.col("mom")).otherwise(F.col("rev")))
    return B.hysteresis(df, "score", 5, 1.0)


@register("k4_capped_weights", "SELECT t, entity, CASE WHEN full_ THEN 0.3 WHEN free > 0 THEN score / free * greatest(0, 1 - 0.3 * n_full) ELSE 0 END AS weight FROM (SELECT *, count(*) FILTER (full_) OVER (PARTITION BY t) AS n_full, coalesce(sum(score) FILTER (NOT full_) OVER (PARTITION BY t), 0) AS free FROM (SELECT *, score * (1 - 0.3 * (i - 1)) >= 0.3 * rest AS full_ FROM (SELECT *, sum(score) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC) AS i FROM (SELECT t, entity, exp(mom * 5) AS score FROM rk WHERE ox > names - 5)))))", "weight")
def k4(spark, sf):
    df = B.legs(eligible(spark, sf), "mom", None, 5).where("side = 1").withColumn("score", F.exp(F.col("mom") * 5))
    return B.capped_weights(df, "score", 0.3, "t").select("t", "entity", "weight")


@register("k4_capped_equal_weights", "SELECT t, entity, least(1.0 / count(*) OVER (PARTITION BY t), 0.15) AS weight FROM book WHERE side = 1", "weight")
def k4_equal(spark, sf):
    df = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1")
    return df.select("t", "entity", F.least(1 / F.count(F.lit(1)).over(Window.partitionBy("t")), F.lit(0.15)).alias("weight"))


@register("k5_weight_schemes", "SELECT t, entity, (n + 1 - i) / sum(n + 1 - i) OVER (PARTITION BY t) AS linear, (1 / dvol) / sum(1 / dvol) OVER (PARTITION BY t) AS inverse FROM (SELECT b.t, b.entity, e.dvol, count(*) OVER (PARTITION BY b.t) AS n, row_number() OVER (PARTITION BY b.t ORDER BY mom DESC, b.entity) AS i FROM book b JOIN el e ON b.t = e.t AND b.entity = e.entity WHERE side = 1)", "linear inverse")
def k5(spark, sf):
    df = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1")
    linear = B.normalized(df, "linear", "mom", "t").withColumnRenamed("weight", "linear")
    return B.normalized(linear, "inverse", "dvol", "t").select("t", "entity", "linear", F.col("weight").alias("inverse"))


@register("k6_latest_rows", "SELECT entity, t, mom, row_number() OVER (ORDER BY mom DESC NULLS LAST, entity) AS place FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS i FROM sig) WHERE i = 1", "mom")
def k6(spark, sf):
    last = signals(spark, sf).withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("t")))).where("_i = 1")
    return T.placed(last, "mom", "entity").select("entity", "t", "mom", "place")


@register("k7_stratified_sample", "SELECT entity, sector FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY sha256('s:' || CAST(entity AS VARCHAR)), entity) AS i FROM sec) WHERE i <= 5", "")
def k7(spark, sf):
    from tidemark.sources.panels import sectors

    return B.stratified_sample(sectors(spark, sf), "sector", 5, "s")


@register("k8_eligibility_reasons", "SELECT CASE WHEN n < 3 THEN 'few_trades' WHEN mom IS NULL THEN 'no_history' WHEN dvol < 100000 THEN 'illiquid' WHEN fwd IS NULL THEN 'no_label' ELSE 'eligible' END AS reason, count(*) AS n FROM sig GROUP BY 1", "")
def k8(spark, sf):
    reason = F.when(F.col("n") < 3, "few_trades").when(F.col("mom").isNull(), "no_history").when(F.col("dvol") < 100000, "illiquid").when(F.col("fwd").isNull(), "no_label").otherwise("eligible")
    return signals(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("b1_long_short_stream", "SELECT * FROM stream", "gross turnover")
def b1(spark, sf):
    return B.long_short(B.legs(eligible(spark, sf), "mom", 0.2))


@register("b2_name_churn", "SELECT t, i, tl AS long_new, ts AS short_new FROM turn", "long_new short_new")
def b2(spark, sf):
    new = B.churn(B.legs(eligible(spark, sf), "mom", 0.2))
    return new.groupBy("t", "i").agg(F.max(F.when(F.col("side") == 1, F.col("new"))).alias("long_new"), F.max(F.when(F.col("side") == -1, F.col("new"))).alias("short_new"))


W_SQL = "(SELECT t, i, entity, 1.0 / count(*) OVER (PARTITION BY t) AS w FROM held WHERE side = 1)"


@register("b3_weight_turnover", f"SELECT x.t, sum(abs(coalesce(d.w, 0))) / 2 AS turnover FROM (SELECT DISTINCT t, i FROM held) x JOIN (SELECT i, entity, sum(w) AS w FROM (SELECT i, entity, w FROM {W_SQL} UNION ALL SELECT i + 1, entity, -w FROM {W_SQL}) GROUP BY i, entity) d USING (i) GROUP BY x.t", "turnover")
def b3(spark, sf):
    return B.weight_turnover(k4_equal_free(spark, sf))


def k4_equal_free(spark, sf):
    df = B.legs(eligible(spark, sf), "mom", 0.2).where("side = 1")
    return df.select("t", "entity", (1 / F.count(F.lit(1)).over(Window.partitionBy("t"))).alias("weight"))


@register("b4_exit_reasons", "SELECT x.t, CASE WHEN s.member IS NULL THEN 'missing_price' WHEN NOT s.member THEN 'left_membership' ELSE 'rank_crossing' END AS reason, count(*) AS n FROM held p JOIN (SELECT DISTINCT t, i FROM held) x ON x.i = p.i + 1 LEFT JOIN held h ON h.i = x.i AND h.entity = p.entity AND h.side = p.side LEFT JOIN sig s ON s.t = x.t AND s.entity = p.entity WHERE h.entity IS NULL GROUP BY 1, 2", "")
def b4(spark, sf):
    return B.attribution_of_exits(B.legs(eligible(spark, sf), "mom", 0.2), signals(spark, sf))


@register("b5_cost_ladder", "SELECT t, CAST(bps AS DOUBLE) AS bps, gross - 2 * bps / 1e4 * turnover AS net FROM stream, (SELECT unnest([25, 50, 75]) AS bps)", "bps net")
def b5(spark, sf):
    return B.net_of_costs(b1(spark, sf), [25, 50, 75]).select("t", "bps", "net")


@register("b5_break_even", "SELECT avg(gross) AS gross, avg(turnover) AS turnover, avg(gross) / (2 * avg(turnover)) * 1e4 AS break_even_bps FROM stream", "gross turnover break_even_bps")
def b5_break_even(spark, sf):
    return B.break_even(b1(spark, sf))


@register("b6_performance", "SELECT count(*) AS n, min(e / greatest(1, p) - 1) AS max_drawdown, avg((gross > 0)::INT) AS hit, exp(sum(ln(greatest(1 + gross, 1e-9))) * 12 / count(*)) - 1 AS cagr, stddev_samp(gross) * sqrt(12) AS vol, avg(gross) / stddev_samp(gross) * sqrt(12) AS sharpe, avg(gross) / sqrt(avg(CASE WHEN gross < 0 THEN gross * gross ELSE 0 END)) * sqrt(12) AS sortino FROM (SELECT gross, e, max(e) OVER (ORDER BY t) AS p FROM (SELECT t, gross, exp(sum(ln(greatest(1 + gross, 1e-9))) OVER (ORDER BY t)) AS e FROM stream))", "max_drawdown hit cagr vol sharpe sortino")
def b6(spark, sf):
    return B.performance(b1(spark, sf), "gross")


@register("b7_universe_stream", "SELECT t, avg(fwd) AS ew, any_value(f) AS bench FROM el JOIN (SELECT t, lead(bench) OVER (ORDER BY t) / bench - 1 AS f FROM bench) USING (t) GROUP BY t", "ew bench")
def b7(spark, sf):
    from tidemark.sources.panels import benchmark

    bench = benchmark(spark, sf).withColumnRenamed("month_idx", "t").select("t", (F.lead("bench").over(Window.orderBy("t")) / F.col("bench") - 1).alias("bench"))
    return eligible(spark, sf).groupBy("t").agg(F.avg("fwd").alias("ew")).join(bench, "t")


@register("b8_blended_book", "SELECT t, entity, place FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY b DESC, entity) AS place FROM (SELECT *, row_number() OVER (PARTITION BY t, sector ORDER BY b DESC, entity) AS g FROM (SELECT *, round(0.7 * (names - row_number() OVER (PARTITION BY t ORDER BY mom DESC, entity)) / (names - 1) + 0.3 * (names - row_number() OVER (PARTITION BY t ORDER BY rev3 DESC, entity)) / (names - 1), 9) AS b FROM el WHERE rev3 IS NOT NULL)) WHERE g <= 3) WHERE place <= 8", "")
def b8(spark, sf):
    from tidemark.functions.stats import descending_percentile

    df = eligible(spark, sf).where("rev3 is not null")
    pct = lambda c: F.coalesce(ratio(F.col("names") - F.row_number().over(Window.partitionBy("t").orderBy(F.desc(c), "entity")), F.col("names") - 1), descending_percentile(c, "entity", "t"))
    df = df.withColumn("b", F.round(0.7 * pct("mom") + 0.3 * pct("rev3"), 9))
    return B.capped_by_group(df, "b", 8, 3, "sector").select("t", "entity", "place")


@register("b10_quarterly_book", "SELECT q, avg(fwd) FILTER (i > n - greatest(1, n // 5)) - avg(fwd) FILTER (i <= greatest(1, n // 5)) AS spread, count(*) AS names FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY mom, entity) AS i, count(*) OVER (PARTITION BY q) AS n FROM (SELECT t // 3 AS q, entity, arg_max(mom, t) AS mom, arg_max(fwd, t) AS fwd FROM el GROUP BY 1, 2)) GROUP BY q", "spread")
def b10(spark, sf):
    df = eligible(spark, sf).groupBy(F.floor(F.col("t") / 3).cast("int").alias("q"), "entity").agg(F.max_by("mom", "t").alias("mom"), F.max_by("fwd", "t").alias("fwd"))
    return A.quantile_spread(df, "mom", "fwd", 0.2, date="q").select("q", "spread", "names")


@register("b11_regime_scaled", "SELECT s.t, gross * CASE WHEN b >= m THEN 1.0 ELSE 0.5 END AS scaled FROM stream s JOIN (SELECT t, b, avg(b) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m FROM (SELECT t, bench AS b FROM bench)) USING (t)", "scaled")
def b11(spark, sf):
    from tidemark.sources.panels import benchmark

    before = Window.orderBy("t").rowsBetween(-6, -1)
    scale = benchmark(spark, sf).withColumnRenamed("month_idx", "t").select("t", F.when(F.col("bench") >= F.avg("bench").over(before), 1.0).otherwise(0.5).alias("scale"))
    return b1(spark, sf).join(F.broadcast(scale), "t").select("t", (F.col("gross") * F.col("scale")).alias("scaled"))


@register("b14_position_risk", "SELECT entity, stddev_pop(ret) AS vol, covar_pop(ret, bret) / nullif(var_pop(bret), 0) AS beta, avg(dvol) AS adv FROM rb WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY entity".replace("rb", "(SELECT p.entity, p.t, dvol, close / max(close) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS ret, bench / max(bench) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS bret FROM px_m p JOIN bench USING (t) WINDOW w AS (PARTITION BY p.entity ORDER BY p.t))"), "vol beta adv")
def b14(spark, sf):
    df = returns_with_bench(spark, sf).where("ret is not null and bret is not null")
    return df.groupBy("entity").agg(F.stddev_pop("ret").alias("vol"), F.try_divide(F.covar_pop("ret", "bret"), F.var_pop("bret")).alias("beta"), F.avg("dvol").alias("adv"))


@register("b16_liquidity_days", "SELECT entity, CASE WHEN d <= 1 THEN '1d' WHEN d <= 5 THEN '5d' WHEN d <= 20 THEN '20d' ELSE 'over' END AS bucket, d AS days FROM (SELECT entity, 0.05 * 1e7 / (avg(dvol) * 0.1) AS d FROM px_m GROUP BY entity)", "days")
def b16(spark, sf):
    from tidemark.plans.base import prices

    book = prices(spark, sf).groupBy("entity").agg(F.avg("dvol").alias("adv")).withColumn("weight", F.lit(0.05))
    return B.liquidity(book, "adv", "weight", 1e7, 0.1).select("entity", "bucket", "days")


@register("b15_book_risk", "WITH w AS (SELECT t AS opened, entity, 1.0 / count(*) OVER (PARTITION BY t) AS weight, count(*) OVER (PARTITION BY t) AS k FROM book WHERE side = 1), r AS (SELECT w.opened, rb.t, sum(weight * ret) AS r, any_value(bret) AS m, count(*) AS c, any_value(k) AS k FROM w JOIN rb USING (entity) WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY 1, 2) SELECT opened, count(*) AS dates, var_pop(r) AS variance, covar_pop(r, m) / nullif(var_pop(m), 0) AS beta, CASE WHEN count(*) > 1 THEN pow(covar_pop(r, m), 2) / nullif(var_pop(r) * var_pop(m), 0) END AS systematic FROM r WHERE c = k GROUP BY opened".replace("JOIN rb", "JOIN (SELECT p.entity, p.t, close / max(close) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS ret, bench / max(bench) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS bret FROM px_m p JOIN bench USING (t) WINDOW w AS (PARTITION BY p.entity ORDER BY p.t)) rb"), "variance beta systematic")
def b15(spark, sf):
    """Every month's long book, at equal weights, over all months in which its names have returns."""
    long_ = k4_equal_free(spark, sf).withColumnRenamed("t", "opened")
    return B.book_risk(long_, returns_with_bench(spark, sf), "opened")
