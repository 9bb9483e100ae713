"""Queries of the window and cross-sectional operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import average_rank, descending_percentile, ratio, safe_corr
from tidemark.operators import cross as C
from tidemark.operators import windows as W
from tidemark.plans.base import benched, eligible, prices, register, signals
from tidemark.sources import panels

E_T = "WINDOW e AS (PARTITION BY entity ORDER BY t)"


def window(name: str, columns: dict, sql: dict[str, str], source=signals, table: str = "sig"):
    """A query of window columns over a panel, and its SQL."""
    body = ", ".join(f"{x} AS {k}" for k, x in sql.items())
    register(name, f"SELECT entity, t, {body} FROM {table} {E_T}", " ".join(k for k in sql if k != "breakout"))(lambda spark, sf: source(spark, sf).select("entity", "t", *[c().alias(k) for k, c in columns.items()]))


def guard(value: str, x: str, k: int, least: int) -> str:
    frame = f"OVER (e RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least} THEN {value} {frame} END"


at = lambda x, k: f"max({x}) OVER (e RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"
over = lambda k: f"OVER (e RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"

window("w1_trailing_return", {"r3": lambda: W.trailing_return("close", 3)}, {"r3": f"close / nullif({at('close', 3)}, 0) - 1"})
window("w2_simple_and_log_return", {"simple": lambda: W.trailing_return("close", 1), "logged": lambda: W.log_return("close")}, {"simple": f"close / {at('close', 1)} - 1", "logged": f"ln(close / {at('close', 1)})"})
window("w3_skip_momentum", {"m12_1": lambda: W.skip_momentum("close", 12, 1), "m3_1": lambda: W.skip_momentum("close", 3, 1)}, {"m12_1": f"{at('close', 1)} / {at('close', 12)} - 1", "m3_1": f"{at('close', 1)} / {at('close', 3)} - 1"})
window("w4_realized_vol", {"vol": lambda: W.realized_vol("ret", 6, per_year=12), "loose": lambda: W.realized_vol("ret", 6, 3)}, {"vol": guard("sqrt(12) * stddev_samp(ret)", "ret", 6, 6), "loose": guard("stddev_samp(ret)", "ret", 6, 3)})
window(
    "w5_downside_vol",
    {"rms": lambda: W.downside_vol("ret", 6), "clipped": lambda: W.downside_vol("ret", 6, "clipped"), "rolling": lambda: W.downside_vol("ret", 6, "rolling_rms")},
    {"rms": f"CASE WHEN count(ret) {over(6)} >= 6 THEN sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END) {over(6)}) END", "clipped": guard("stddev_samp(least(ret, 0))", "ret", 6, 6), "rolling": f"CASE WHEN count(ret) {over(6)} >= 6 THEN sqrt(avg(least(ret, 0) * least(ret, 0)) {over(6)}) END"},
)
B_RET = "(SELECT p.entity, p.t, p.close, bench, close / max(close) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS ret, bench / max(bench) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS bret FROM px_m p JOIN bench USING (t) WINDOW w AS (PARTITION BY p.entity ORDER BY p.t))"


def returns(spark, sf) -> DataFrame:
    return benched(spark, sf).withColumns({"ret": W.trailing_return("close", 1), "bret": W.trailing_return("bench", 1)})


def pair(f: str) -> str:
    both = "ret IS NOT NULL AND bret IS NOT NULL"
    y, x = f"CASE WHEN {both} THEN ret END", f"CASE WHEN {both} THEN bret END"
    value = {"beta": f"covar_samp({y}, {x}) {over(12)} / nullif(var_samp({x}) {over(12)}, 0)", "corr": f"covar_pop({y}, {x}) {over(12)} / nullif(sqrt(var_pop({y}) {over(12)} * var_pop({x}) {over(12)}), 0)"}[f]
    return f"CASE WHEN count({x}) {over(12)} >= 10 THEN {value} END"


window("w6_rolling_beta_and_corr", {"beta": lambda: W.rolling_pair("beta", "ret", "bret", 12, 2), "corr": lambda: W.rolling_pair("corr", "ret", "bret", 12, 2)}, {"beta": pair("beta"), "corr": pair("corr")}, returns, B_RET)


@register("w7_residual_momentum", f"SELECT entity, t, ret - beta * bret AS residual, CASE WHEN count(ret - beta * bret) {over(6)} >= 6 THEN sum(ret - beta * bret) {over(6)} END AS residual_momentum, CASE WHEN count(ret - beta * bret) {over(6)} >= 6 THEN stddev_samp(ret - beta * bret) {over(6)} END AS idio_vol FROM (SELECT *, {pair('beta')} AS beta FROM {B_RET} {E_T}) {E_T}", "residual residual_momentum idio_vol")
def w7(spark, sf):
    df = returns(spark, sf).withColumn("residual", F.col("ret") - W.rolling_pair("beta", "ret", "bret", 12, 2) * F.col("bret"))
    return df.select("entity", "t", "residual", W.rolling(F.sum, "residual", 6).alias("residual_momentum"), W.rolling(F.stddev_samp, "residual", 6).alias("idio_vol"))


window("w8_moving_averages", {"to_sma": lambda: ratio("close", W.rolling(F.avg, "close", 6)) - 1, "fast_slow": lambda: ratio(W.rolling(F.avg, "close", 3), W.rolling(F.avg, "close", 9, 6)) - 1}, {"to_sma": f"close / ({guard('avg(close)', 'close', 6, 6)}) - 1", "fast_slow": f"({guard('avg(close)', 'close', 3, 3)}) / ({guard('avg(close)', 'close', 9, 6)}) - 1"})
window("w9_drawdowns", {"current": lambda: W.drawdown("close", 6), "trough": lambda: W.drawdown("close", 6, "trough")}, {"current": f"close / max(close) {over(6)} - 1", "trough": f"min(close) {over(6)} / max(close) {over(6)} - 1"})


@register("w9_worst_path_drawdown", "SELECT a.entity, a.t, coalesce(min(b.close / b.top - 1), 0) AS path FROM px_m a, LATERAL (SELECT c.close, max(c.close) OVER (ORDER BY c.t) AS top FROM px_m c WHERE c.entity = a.entity AND c.t BETWEEN a.t - 5 AND a.t) b GROUP BY a.entity, a.t", "path")
def w9_path(spark, sf):
    return prices(spark, sf).select("entity", "t", W.drawdown("close", 6, "path").alias("path"))


window("w10_distance_to_extremes", {"high": lambda: W.extreme_distance("close", 12), "low": lambda: W.extreme_distance("close", 12, False), "breakout": lambda: F.col("close") > W.rolling(F.max, "close", 6, 1, end=1)}, {"high": f"close / max(close) {over(12)} - 1", "low": f"close / min(close) {over(12)} - 1"} | {"breakout": "close > max(close) OVER (e RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)"})


@register("w11_return_zscore", f"SELECT entity, t, (r - {guard('avg(r)', 'r', 6, 6)}) / nullif({guard('stddev_samp(r)', 'r', 6, 6)}, 0) AS z FROM (SELECT entity, t, close / {at('close', 2)} - 1 AS r FROM px_m {E_T}) {E_T}", "z")
def w11(spark, sf):
    return prices(spark, sf).withColumn("r", W.trailing_return("close", 2)).select("entity", "t", W.return_zscore("r", 6).alias("z"))


window("w12_volume_features", {"adv": lambda: W.rolling(F.avg, "dvol", 6, 3), "z": lambda: W.volume_zscore("dvol", 6, 3), "surge": lambda: W.surge("dvol", 6, 3)}, {"adv": guard("avg(dvol)", "dvol", 6, 3), "z": f"(dvol - ({guard('avg(dvol)', 'dvol', 6, 3)})) / nullif({guard('stddev_samp(dvol)', 'dvol', 6, 3)}, 0)", "surge": "dvol / CASE WHEN count(dvol) OVER (e RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) >= 3 THEN avg(dvol) OVER (e RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) END"})
window("w13_amihud", {"illiquidity": lambda: W.amihud("ret", "dvol", 6, 3) * 1e6}, {"illiquidity": f"({guard('avg(abs(ret) / dvol)', 'ret', 6, 3)}) * 1e6"})


@register("w14_rolling_moments", "SELECT a.entity, a.t, CASE WHEN count(b.ret) >= 12 THEN skewness(b.ret) END AS skew, CASE WHEN count(b.ret) >= 12 THEN kurtosis(b.ret) END AS kurt FROM px_m a LEFT JOIN sig b ON a.entity = b.entity AND b.t BETWEEN a.t - 11 AND a.t GROUP BY a.entity, a.t")
def w14(spark, sf):
    skew, kurt = W.moments("ret", 12, 12)
    return signals(spark, sf).select("entity", "t", F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurt"))


from tidemark.plans.base import PRELUDE, SQL  # noqa: E402

SQL["w14_rolling_moments"] = PRELUDE + "SELECT a.entity, a.t, round(CASE WHEN count(b.ret) >= 12 THEN skewness(b.ret) END, 5) + 0.0 AS skew, round(CASE WHEN count(b.ret) >= 12 THEN kurtosis(b.ret) END, 5) + 0.0 AS kurt FROM px_m a LEFT JOIN sig b ON a.entity = b.entity AND b.t BETWEEN a.t - 11 AND a.t GROUP BY a.entity, a.t"


@register("w15_autoregression", f"SELECT entity, t, CASE WHEN count(y) {over(12)} >= 8 THEN covar_samp(y, x) {over(12)} / nullif(var_samp(x) {over(12)}, 0) END AS ar1 FROM (SELECT entity, t, CASE WHEN p IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN p END AS x FROM (SELECT entity, t, ret, {at('ret', 1)} AS p FROM sig {E_T})) {E_T}", "ar1")
def w15(spark, sf):
    return signals(spark, sf).withColumn("p", W.lag_exact("ret", 1)).select("entity", "t", W.rolling_pair("beta", "ret", "p", 12, 4).alias("ar1"))


@register("w16_bar_shape", "SELECT *, (rng - CASE WHEN count(rng) OVER (e RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN avg(rng) OVER (e RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) END) / nullif(stddev_samp(rng) OVER (e RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS range_z FROM (SELECT entity, t, open / max(close) OVER (e RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS gap, close / open - 1 AS intraday, (close - low) / nullif(high - low, 0) AS place, (high - low) / close AS rng, high <= max(high) OVER (e RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AND low >= max(low) OVER (e RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS inside FROM bars WINDOW e AS (PARTITION BY entity ORDER BY t)) WINDOW e AS (PARTITION BY entity ORDER BY t)", "gap intraday place rng range_z")
def w16(spark, sf):
    shaped = W.bar_shape(panels.monthly_bars(spark, sf).withColumnRenamed("month_idx", "t"))
    return shaped.select("entity", "t", "gap", "intraday", "place", F.col("range").alias("rng"), "inside", "range_z")


@register("w17_execution_returns", "SELECT entity, t, close / open - 1 AS oc, max(open) OVER (e RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1 AS co, max(close) OVER (e RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / max(open) OVER (e RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - 1 AS noc, max(open) OVER (e RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING) / max(open) OVER (e RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - 1 AS oo FROM bars WINDOW e AS (PARTITION BY entity ORDER BY t)", "oc co noc oo")
def w17(spark, sf):
    return W.execution_returns(panels.monthly_bars(spark, sf).withColumnRenamed("month_idx", "t")).select("entity", "t", "oc", "co", "noc", "oo")


@register("w18_forward_excess_labels", f"SELECT entity, t, fwd_excess, fwd_excess > 0 AS outperforms, CASE WHEN fwd_excess IS NOT NULL THEN rank() OVER (PARTITION BY t, fwd_excess IS NULL ORDER BY fwd_excess DESC) END AS place FROM (SELECT entity, t, (max(close) OVER (e RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING) / close - 1) - (max(bench) OVER (e RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING) / bench - 1) AS fwd_excess FROM px_m JOIN bench USING (t) {E_T})", "fwd_excess")
def w18(spark, sf):
    df = W.forward_excess(benched(spark, sf), 3)
    place = F.when(F.col("fwd_excess").isNotNull(), F.rank().over(Window.partitionBy("t", F.col("fwd_excess").isNull()).orderBy(F.desc("fwd_excess"))))
    return df.select("entity", "t", "fwd_excess", "outperforms", place.alias("place"))


@register("w20_rolling_ic_stability", "SELECT t, CASE WHEN count(*) OVER (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 12 THEN avg(ic) OVER (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS mean_12, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY t) AS positive FROM ic", "mean_12 positive")
def w20(spark, sf):
    from tidemark.operators.evaluate import rank_ic

    rows = Window.orderBy("t")
    ics = rank_ic(eligible(spark, sf), "mom", "fwd")
    full = F.count(F.lit(1)).over(rows.rowsBetween(-11, 0)) >= 12
    return ics.select("t", F.when(full, F.avg("ic").over(rows.rowsBetween(-11, 0))).alias("mean_12"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("positive"))


@register("w21_expanding_median_and_season", "SELECT s.entity, s.t, (SELECT quantile_cont(x.close, 0.5) FROM px_m x WHERE x.entity = s.entity AND x.t < s.t) AS median_before, avg(ret) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS season_mean FROM sig s WINDOW m AS (PARTITION BY s.entity, s.t % 12 ORDER BY s.t)", "median_before season_mean")
def w21(spark, sf):
    before = Window.partitionBy("entity").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    df = W.seasonality(signals(spark, sf), month="t")
    return df.select("entity", "t", F.percentile("close", F.lit(0.5)).over(before).alias("median_before"), "season_mean")


@register("w22_streaks", "SELECT entity, t, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY entity, island ORDER BY t) AS streak FROM (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY t) AS island FROM (SELECT entity, t, coalesce(ret > 0, false) AS up FROM sig))")
def w22(spark, sf):
    return W.streaks(signals(spark, sf).withColumn("up", F.col("ret") > 0), "up").select("entity", "t", "streak")


@register("w23_prior_event_aggregates", "SELECT event_id, CASE WHEN count(value) OVER w >= 4 THEN avg(value) OVER w END AS prior_mean, CASE WHEN count(value) OVER w >= 4 THEN avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) OVER w END AS prior_positive, value - lag(value) OVER (PARTITION BY entity ORDER BY ts, event_id) AS change, value / nullif(CASE WHEN count(value) OVER w >= 4 THEN stddev_samp(value) OVER w END, 0) AS standardized FROM evt WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)", "prior_mean prior_positive change standardized")
def w23(spark, sf):
    return W.prior_events(panels.user_events(spark, sf), "value", 4).select("event_id", "prior_mean", "prior_positive", "change", "standardized")


@register("w24_shock_zscores", "SELECT t, (d - avg(d) OVER w) / nullif(stddev_samp(d) OVER w, 0) AS z FROM (SELECT t, ln(bench / lag(bench) OVER (ORDER BY t)) AS d FROM bench) WINDOW w AS (ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)", "z")
def w24(spark, sf):
    dates = Window.orderBy("t")  # a date-level table
    before = dates.rowsBetween(-12, -1)
    df = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t").withColumn("d", F.log(F.col("bench") / F.lag("bench").over(dates)))
    return df.select("t", ratio(F.col("d") - F.avg("d").over(before), F.nullif(F.stddev_samp("d").over(before), F.lit(0.0))).alias("z"))


@register("w25_equity_curve", "SELECT t, equity, equity / greatest(max(equity) OVER (ORDER BY t), 1) - 1 AS drawdown FROM (SELECT t, exp(sum(ln(greatest(1 + gross, 1e-9))) OVER (ORDER BY t)) AS equity FROM stream)", "equity drawdown")
def w25(spark, sf):
    from tidemark.operators.books import legs, long_short

    return W.equity_curve(long_short(legs(eligible(spark, sf), "mom", 0.2)), "gross").select("t", "equity", "drawdown")


@register("w26_feature_vector", f"SELECT entity, t, r1, m, list_filter([CASE WHEN r1 IS NULL THEN 'r1' END, CASE WHEN m IS NULL THEN 'm' END], lambda x: x IS NOT NULL)[1] AS first_missing, (r1 IS NULL)::INT + (m IS NULL)::INT AS n_missing FROM (SELECT entity, t, close / {at('close', 1)} - 1 AS r1, {at('close', 1)} / {at('close', 12)} - 1 AS m FROM px_m {E_T})", "r1 m")
def w26(spark, sf):
    df = prices(spark, sf).withColumns({"r1": W.trailing_return("close", 1), "m": W.skip_momentum("close", 12, 1)})
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("r1", "m")]))
    return df.select("entity", "t", "r1", "m", F.get(missing, 0).alias("first_missing"), F.size(missing).alias("n_missing"))


@register("w27_calendar_features", "SELECT DISTINCT CAST(date AS VARCHAR) AS date, month(date) AS month_of_year, isodow(date) - 1 AS day_of_week, date = last_day(date) AS is_month_end, date = last_day(date) AND month(date) % 3 = 0 AS is_quarter_end, day(last_day(date)) - day(date) AS days_to_month_end, day(date) <= 3 OR day(last_day(date)) - day(date) < 1 AS turn_of_month FROM px_d")
def w27(spark, sf):
    return W.calendar_features(panels.daily_prices(spark, sf).select("date").distinct()).withColumn("date", F.col("date").cast("string"))


@register("w28_benchmark_month_metrics", "SELECT t, bench / avg(bench) OVER w - 1 AS to_sma, bench / max(bench) OVER w - 1 AS dd, lead(bench) OVER (ORDER BY t) / bench - 1 AS fwd FROM bench WINDOW w AS (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "to_sma dd fwd")
def w28(spark, sf):
    dates = Window.orderBy("t")
    near = dates.rowsBetween(-9, 0)
    df = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "t")
    return df.select("t", (F.col("bench") / F.avg("bench").over(near) - 1).alias("to_sma"), (F.col("bench") / F.max("bench").over(near) - 1).alias("dd"), (F.lead("bench").over(dates) / F.col("bench") - 1).alias("fwd"))


def section(name: str, sql: str, doubles: str):
    """A query over the eligible cross-sections."""
    return register(name, sql, doubles)


@section("c1_zscore", "SELECT entity, t, (mom - avg(mom) OVER w) / nullif(stddev_pop(mom) OVER w, 0) AS z_pop, (mom - avg(mom) OVER w) / nullif(stddev_samp(mom) OVER w, 0) AS z_samp FROM el WINDOW w AS (PARTITION BY t)", "z_pop z_samp")
def c1(spark, sf):
    return eligible(spark, sf).select("entity", "t", C.zscore("mom", "t").alias("z_pop"), C.zscore("mom", "t", sample=True).alias("z_samp"))


@section("c2_sector_neutral", "SELECT entity, t, CASE WHEN count(mom) OVER w >= 3 THEN mom - avg(mom) OVER w ELSE mom END AS neutral FROM el WINDOW w AS (PARTITION BY t, sector)", "neutral")
def c2(spark, sf):
    return eligible(spark, sf).select("entity", "t", C.neutralize("mom", "sector", "t", least=3).alias("neutral"))


@section("c3_neutral_scored_clipped", "SELECT entity, t, greatest(-1.5, least(1.5, coalesce((d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0), 0))) AS mom_n FROM (SELECT entity, t, mom - avg(mom) OVER (PARTITION BY t, sector) AS d FROM el) WINDOW w AS (PARTITION BY t)", "mom_n")
def c3(spark, sf):
    return C.neutral_clipped(eligible(spark, sf), "mom", "sector", limit=1.5).select("entity", "t", "mom_n")


@section("c4_winsorize", "SELECT entity, t, greatest(lo, least(hi, mom)) AS mom_w FROM el JOIN (SELECT t, quantile_cont(mom, 0.05) AS lo, quantile_cont(mom, 0.95) AS hi FROM el GROUP BY t) USING (t)", "mom_w")
def c4(spark, sf):
    return C.winsorize(eligible(spark, sf), "mom", 0.05, 0.95, "t").select("entity", "t", "mom_w")


@section("c5_rank_targets", "SELECT entity, t, rx / names AS pct, CASE WHEN names = 1 THEN 0 ELSE (rx - 1) / (names - 1) - 0.5 END AS centred FROM rk", "pct centred")
def c5(spark, sf):
    return eligible(spark, sf).select("entity", "t", C.percent_rank("mom", "t").alias("pct"), C.rank_target("mom", "t").alias("centred"))


@section("c6_descending_percentile", "SELECT entity, t, CASE WHEN names = 1 THEN 1 ELSE (names - row_number() OVER (PARTITION BY t ORDER BY mom DESC, entity)) / (names - 1) END AS pct FROM el", "pct")
def c6(spark, sf):
    return eligible(spark, sf).select("entity", "t", descending_percentile("mom", "entity", "t").alias("pct"))


@section("c7_rank_in_universe", "SELECT entity, t, row_number() OVER (PARTITION BY t ORDER BY mom DESC NULLS LAST, entity) AS place FROM sig", "")
def c7(spark, sf):
    return signals(spark, sf).select("entity", "t", F.row_number().over(Window.partitionBy("t").orderBy(F.desc_nulls_last("mom"), "entity")).alias("place"))


@section("c8_composites", "SELECT entity, t, (coalesce(mom, 0) + coalesce(rev3, 0)) / nullif((mom IS NOT NULL)::INT + (rev3 IS NOT NULL)::INT, 0) AS equal, (coalesce(2 * mom, 0) + coalesce(rev3, 0)) / nullif(2 * (mom IS NOT NULL)::INT + (rev3 IS NOT NULL)::INT, 0) AS weighted FROM sig", "equal weighted")
def c8(spark, sf):
    from tidemark.functions.stats import mean_available, weighted_available

    return signals(spark, sf).select("entity", "t", mean_available("mom", "rev3").alias("equal"), weighted_available({"mom": 2.0, "rev3": 1.0}).alias("weighted"))


@section("c9_residualize", "SELECT entity, t, fwd - (CASE WHEN names >= 5 THEN regr_intercept(fwd, mom) OVER w + regr_slope(fwd, mom) OVER w * mom END) AS residual FROM el WINDOW w AS (PARTITION BY t)", "residual")
def c9(spark, sf):
    return C.residualize(eligible(spark, sf), "fwd", ["mom"]).select("entity", "t", "residual")


@section("c10_market_residual", "SELECT entity, t, ret - m AS residual FROM el JOIN (SELECT t, quantile_cont(ret, 0.5) AS m FROM el GROUP BY t) USING (t)", "residual")
def c10(spark, sf):
    return eligible(spark, sf).select("entity", "t", C.market_residual("ret", "t").alias("residual"))


@section("c11_breadth_and_dispersion", "SELECT t, count(*) AS names, avg((ret > 0)::INT) AS breadth, stddev_pop(ret) AS dispersion, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median FROM sig WHERE ret IS NOT NULL GROUP BY t", "breadth dispersion mean median")
def c11(spark, sf):
    return C.breadth(signals(spark, sf))


@section("c12_buckets", "SELECT entity, t, CAST(least(floor(rx / names * 5), 4) AS INT) AS by_share, CAST((ox - 1) * 5 // names AS INT) AS by_count FROM rk", "")
def c12(spark, sf):
    return eligible(spark, sf).select("entity", "t", C.bucket("mom", 5, "t").alias("by_share"), C.bucket_first("mom", "entity", 5, "t").alias("by_count"))


@section("c13_model_dispersion", "SELECT entity, t, sqrt((pow(a - (a + b) / 2, 2) + pow(b - (a + b) / 2, 2)) / 2) AS dispersion FROM (SELECT entity, t, rx / names AS a, (rank() OVER (PARTITION BY t ORDER BY ret) + (count(*) OVER (PARTITION BY t, ret) - 1) / 2.0) / names AS b FROM rk)", "dispersion")
def c13(spark, sf):
    return C.model_dispersion(eligible(spark, sf), ["mom", "ret"], "t").select("entity", "t", "dispersion")


@section("c14_gates", "SELECT entity, t, coalesce(dvol >= a AND mom >= b, false) AS passes FROM el JOIN (SELECT t, quantile_cont(dvol, 0.5) AS a, quantile_cont(mom, 0.5) AS b FROM el GROUP BY t) USING (t)", "")
def c14(spark, sf):
    return C.gates(eligible(spark, sf), ["dvol", "mom"]).select("entity", "t", "passes")


@section("c15_placebo_roll", "SELECT a.entity, a.t, b.mom AS placebo FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY entity) - 1 AS i FROM el) a JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY entity) - 1 AS j FROM el) b ON a.t = b.t AND (a.i + 3) % a.names = b.j", "placebo")
def c15(spark, sf):
    return C.placebo_roll(eligible(spark, sf), "mom", 3).select("entity", "t", "placebo")


@register("c15_placebo_shuffle_ic", "SELECT t, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS ic FROM (SELECT t, rank() OVER (PARTITION BY t ORDER BY x) + (count(*) OVER (PARTITION BY t, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY t ORDER BY fwd) + (count(*) OVER (PARTITION BY t, fwd) - 1) / 2.0 AS b FROM (SELECT p.t, p.fwd, o.mom AS x FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY entity) AS i FROM el) p JOIN (SELECT t, mom, row_number() OVER (PARTITION BY t ORDER BY md5('7:' || entity || ':' || t), entity) AS i FROM el) o ON o.t = p.t AND o.i = p.i)) GROUP BY t", "ic")
def c15_shuffle(spark, sf):
    df = C.placebo_shuffle(eligible(spark, sf), "mom", 7)
    ranked = df.select("t", average_rank("placebo", "t").alias("x"), average_rank("fwd", "t").alias("y"))
    return ranked.groupBy("t").agg(safe_corr("x", "y").alias("ic"))
