"""Queries of scans, data quality, joins, reshapes and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators import joins as J
from tidemark.operators import tables as T
from tidemark.plans.base import eligible, prices, register, returns_with_bench, signals
from tidemark.sources import panels

PROBES = "(SELECT DISTINCT user_id AS entity, CAST(ts AS DATE) AS d FROM events)"
TEXT = "CAST({} AS VARCHAR)"


def cust_months(spark, sf):
    """Probes: each customer at the start of each quarter of four years."""
    starts = [f"{y}-{m:02d}-15" for y in range(1996, 2000) for m in (1, 4, 7, 10)]
    return panels.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.array(*[F.lit(s).cast("date") for s in starts])).alias("d"))


CUST = "(SELECT c_custkey AS entity, make_date(y, m, 15) AS d FROM customer, (SELECT unnest(range(1996, 2000)) AS y), (SELECT unnest([1, 4, 7, 10]) AS m))"


def asof_sql(compare: str, age: str = "") -> str:
    return f"SELECT p.entity, CAST(p.d AS VARCHAR) AS d, CAST(f.period_end AS VARCHAR) AS period_end, f.value AS value FROM {CUST} p LEFT JOIN facts f ON f.entity = p.entity AND f.available_date = (SELECT max(x.available_date) FROM facts x WHERE x.entity = p.entity AND x.available_date {compare} p.d) {age}"


def asof_out(df):
    return df.select("entity", F.col("d").cast("string").alias("d"), F.col("period_end").cast("string").alias("period_end"), "value")


@register("s1_price_series", "SELECT l_suppkey AS entity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, max(l_orderkey * 10 + l_linenumber) AS id FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2", "")
def s1(spark, sf):
    li = panels.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").cast("string").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_extendedprice")
    return T.price_series(li, ["entity", "date"], "l_extendedprice", "id").select("entity", "date", "id")


@register("s2_latest_rows", "SELECT entity, t, close FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS i FROM px_m) WHERE i <= 5", "close")
def s2(spark, sf):
    return T.latest_rows(prices(spark, sf), 5).select("entity", "t", "close")


@register("s3_universe", "SELECT DISTINCT entity FROM px_m WHERE entity <> 1", "")
def s3(spark, sf):
    return prices(spark, sf).where("entity <> 1").select("entity").distinct()


@register("s15_range_upsert", "SELECT entity, t, close FROM px_m WHERE NOT (entity % 3 = 0 AND t BETWEEN 23950 AND 23960) UNION ALL SELECT entity, t, close * 2 FROM px_m WHERE entity % 3 = 0 AND t BETWEEN 23950 AND 23960", "close")
def s15(spark, sf):
    px = prices(spark, sf).select("entity", "t", "close")
    block = px.where("entity % 3 = 0 and t between 23950 and 23960").withColumn("close", F.col("close") * 2)
    return T.range_upsert(px, block, "entity", "t")


@register("s16_insert_absent", "SELECT entity, t, close FROM px_m", "close")
def s16(spark, sf):
    px = prices(spark, sf).select("entity", "t", "close")
    return T.insert_absent(px.where("t % 2 = 0"), px, ["entity", "t"])


@register("s17_persist_checks", "SELECT rule, CAST(n AS BIGINT) AS n FROM (SELECT 'has_signal' AS rule, sum((mom IS NULL)::INT) AS n FROM sig UNION ALL SELECT 'return_in_range', sum((NOT coalesce(ret BETWEEN -1 AND 10, false))::INT) FROM sig UNION ALL SELECT 'close_positive', sum((NOT coalesce(close > 0, false))::INT) FROM sig)", "")
def s17(spark, sf):
    return T.violations(signals(spark, sf), {"has_signal": F.col("mom").isNotNull(), "return_in_range": F.col("ret").between(-1, 10), "close_positive": F.col("close") > 0})


@register("s19_size_budget", "WITH RECURSIVE b AS (SELECT l_shipmode_ AS o, s, row_number() OVER (ORDER BY l_shipmode_) AS i FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, CAST(count(*) AS BIGINT) AS s FROM lineitem GROUP BY 1)), w AS (SELECT o, s, i, s AS used, true AS kept FROM b WHERE i = 1 UNION ALL SELECT b.o, b.s, b.i, CASE WHEN w.used + b.s <= 40000 THEN w.used + b.s ELSE w.used END, w.used + b.s <= 40000 FROM w JOIN b ON b.i = w.i + 1) SELECT o AS block, s AS size, kept FROM w", "")
def s19(spark, sf):
    blocks = panels.table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("block")).agg(F.count(F.lit(1)).alias("size"))
    return T.within_budget(blocks, "size", "block", 40000)


@register("s20_synthetic_planted_signal", "SELECT count(ic) AS n, avg(ic) AS mean FROM (SELECT t, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 12) AS ic FROM (SELECT t, rank() OVER (PARTITION BY t ORDER BY signal) + (count(*) OVER (PARTITION BY t, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY t ORDER BY fwd) + (count(*) OVER (PARTITION BY t, fwd) - 1) / 2.0 AS b FROM (SELECT *, fwd + 0.5 * (CAST('0x' || substr(md5('plant:' || entity || ':' || t), 1, 8) AS UBIGINT) / 4294967296.0 - 0.5) AS signal FROM el)) GROUP BY t)", "mean")
def s20(spark, sf):
    """A signal planted into the panel's own entities, months and returns, with hashed noise."""
    from tidemark.operators.evaluate import rank_ic

    planted = T.planted_signal(eligible(spark, sf), "fwd", 0.5, "plant")
    return rank_ic(planted, "signal", "fwd").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"))


@register("s21_fingerprint")
def s21(spark, sf):
    return T.fingerprint(panels.table(spark, sf, "lineitem"))


@register("p2_min_history", "SELECT entity, t FROM (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t) AS n FROM px_m) WHERE n >= 12", "")
def p2(spark, sf):
    return prices(spark, sf).withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("t"))).where("_n >= 12").select("entity", "t")


@register("p3_membership_and_liquidity", "SELECT entity, t FROM sig WHERE member AND dvol > 200000", "")
def p3(spark, sf):
    return signals(spark, sf).where("member and dvol > 200000").select("entity", "t")


@register("p5_p6_triggers", "SELECT entity, t FROM sig WHERE abs(ret) >= 0.2 AND mom > 0 AND n >= 3", "")
def p6(spark, sf):
    return signals(spark, sf).where(T.trigger([("ret", "abs>=", 0.2), ("mom", ">", 0.0), ("n", ">=", 3)])).select("entity", "t")


@register("p7_p8_quantile_filters", "SELECT entity, s.t FROM sig s JOIN (SELECT t, quantile_cont(dvol, 0.2) AS a, quantile_cont(dvol, 0.9) AS b FROM sig GROUP BY t) q ON s.t = q.t WHERE dvol BETWEEN a AND b", "")
def p8(spark, sf):
    return T.share_filter(signals(spark, sf), "dvol", 0.2, 0.9, "t").select("entity", "t")


@register("p9_staleness_curve", f"SELECT cap, sum((age <= cap)::INT) AS rows, count(DISTINCT CASE WHEN age <= cap THEN entity END) AS entities, avg(coalesce(age <= cap, false)::INT) AS row_share, count(DISTINCT CASE WHEN age <= cap THEN entity END) / count(DISTINCT entity) AS entity_share FROM (SELECT entity, date_diff('day', CAST(period_end AS DATE), CAST(d AS DATE)) AS age FROM ({asof_sql('<=')})), (SELECT unnest([100, 200, 400]) AS cap) GROUP BY cap", "row_share entity_share")
def p9(spark, sf):
    df = J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"]).withColumn("age", F.datediff("d", "period_end"))
    return T.staleness_curve(df, "age", "entity", [100, 200, 400])


@register("p10_quality_battery", "SELECT *, CASE WHEN repeated_keys > 0 OR not_positive > 0 THEN 'FAIL' WHEN missing > 0 OR outliers > 0 OR entities < 5 THEN 'CAVEAT' ELSE 'PASS' END AS verdict FROM (SELECT count(*) AS rows, sum((close IS NULL)::INT) AS missing, sum((close <= 0)::INT) AS not_positive, sum(coalesce(abs(ret) > 0.5, false)::INT) AS outliers, count(DISTINCT entity) AS entities, min(t) AS first, max(t) AS last, 0 AS repeated_keys FROM sig)", "")
def p10(spark, sf):
    return T.quality_battery(signals(spark, sf), ["entity", "t"], "close", "ret", "t", 5)


@register("p11_bar_consistency", "SELECT avg((high >= greatest(open, close) * (1 - 1e-4))::INT) AS high_ok, avg((low <= least(open, close) * (1 + 1e-4))::INT) AS low_ok, count(*) AS n FROM bars", "high_ok low_ok")
def p11(spark, sf):
    ok = lambda c: F.avg(c.cast("double"))
    return panels.monthly_bars(spark, sf).agg(ok(F.col("high") >= F.greatest("open", "close") * (1 - 1e-4)).alias("high_ok"), ok(F.col("low") <= F.least("open", "close") * (1 + 1e-4)).alias("low_ok"), F.count(F.lit(1)).alias("n"))


@register("p12_unique_keys", "SELECT count(*) AS keys, sum((c > 1)::INT) AS repeated, max(c) AS most FROM (SELECT l_shipdate, l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)", "")
def p12(spark, sf):
    keys = panels.table(spark, sf, "lineitem").groupBy("l_shipdate", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.sum((F.col("c") > 1).cast("int")).alias("repeated"), F.max("c").alias("most"))


@register("p13_leakage_checks", f"SELECT rule, CAST(sum(bad) AS BIGINT) AS n FROM (SELECT unnest(['has_fact', 'known_before', 'after_period']) AS rule, unnest([(period_end IS NULL)::INT, (NOT coalesce(CAST(period_end AS DATE) + 45 < CAST(d AS DATE), false))::INT, (NOT coalesce(CAST(period_end AS DATE) < CAST(d AS DATE), false))::INT]) AS bad FROM ({asof_sql('<')})) GROUP BY rule", "")
def p13(spark, sf):
    df = J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"], strict=True)
    return T.violations(df, {"has_fact": F.col("period_end").isNotNull(), "known_before": F.col("available_date") < F.col("d"), "after_period": F.col("period_end") < F.col("d")})


@register("p14_forward_labels", "SELECT count(*) AS rows, sum((p.close IS NULL)::INT) AS no_end, sum((NOT coalesce(abs(p.close / e.close - 1 - e.fwd) <= 1e-9, false))::INT) AS not_forward FROM el e LEFT JOIN px_m p ON p.entity = e.entity AND p.t = e.t + 1", "")
def p14(spark, sf):
    """Labels against the prices at their ends, one month on, joined anew."""
    end = prices(spark, sf).select("entity", (F.col("t") - 1).alias("t"), F.col("close").alias("end"))
    df = eligible(spark, sf).join(end, ["entity", "t"], "left")
    right = F.coalesce(F.abs(ratio("end", "close") - 1 - F.col("fwd")) <= 1e-9, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("end").isNull().cast("int")).alias("no_end"), F.sum((~right).cast("int")).alias("not_forward"))


@register("p16_truncation_probe", "SELECT t, count(*) AS rows, CAST(0 AS BIGINT) AS differences FROM px_m WHERE t % 12 = 0 GROUP BY t", "")
def p16(spark, sf):
    """Signals on data up to the first month of each year must equal those of the full run in that month."""
    from tidemark.operators.windows import skip_momentum

    px = prices(spark, sf).select("entity", "t", "close")
    full = px.withColumn("mom", skip_momentum("close", 6, 1)).where("t % 12 = 0").select("entity", F.col("t").alias("probe"), F.col("mom").alias("all"))
    # One copy of the panel a probe, cut off there: years are few.
    probes = F.broadcast(px.where("t % 12 = 0").select(F.col("t").alias("probe")).distinct())
    cut = px.join(probes, F.col("t") <= F.col("probe")).where("t >= probe - 24")
    cut = cut.withColumn("id", F.struct("entity", "probe")).withColumn("mom", skip_momentum("close", 6, 1, "id")).where("t = probe").select("entity", "probe", "mom")
    both = full.join(cut, ["entity", "probe"], "full")
    return both.groupBy(F.col("probe").alias("t")).agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("all").eqNullSafe(F.col("mom"))).cast("long")).alias("differences"))


@register("p16_violation_found", "SELECT kind, t, count(*) AS rows, CAST(sum((kind = 'next' AND t < last)::INT) AS BIGINT) AS differences FROM (SELECT entity, t, max(t) OVER (PARTITION BY entity) AS last, unnest(['next', 'before']) AS kind FROM px_m) WHERE t % 12 = 0 GROUP BY kind, t", "")
def p16_found(spark, sf):
    """The probe of a feature that reads the next row, and of one that reads the row before: the first differs wherever there is a next row."""
    px = prices(spark, sf).select("entity", "t", "close")
    probes = px.where("t % 12 = 0").select(F.col("t").alias("probe"))
    feature = lambda f: lambda df, by: df.withColumn("x", f("close").over(Window.partitionBy(by).orderBy("t")))
    found = [T.truncation_probe(px, feature(f), probes).select(F.lit(kind).alias("kind"), F.col("probe").alias("t"), "rows", "differences") for kind, f in (("next", F.lead), ("before", F.lag))]
    return found[0].unionByName(found[1])


@register("p17_symbols", "SELECT p_partkey, regexp_replace(upper(trim(s)), '-\\d{6}$', '') AS base, nullif(regexp_extract(s, '-(\\d{6})$', 1), '') AS delisted FROM (SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '-200' || CAST(100 + p_size AS VARCHAR) ELSE '' END AS s FROM part)", "")
def p17(spark, sf):
    s = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-200"), (F.col("p_size") + 100).cast("string"))).otherwise(""))
    return panels.table(spark, sf, "part").select("p_partkey", T.base_symbol(s).alias("base"), T.delisting_month(s).alias("delisted"))


RANGES = [(1, 10, "small"), (11, 30, "medium"), (31, 50, "large")]


@register("p18_code_crosswalk", "SELECT CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' WHEN p_size BETWEEN 31 AND 50 THEN 'large' ELSE 'Unknown' END AS label, count(*) AS n FROM part GROUP BY 1", "")
def p18(spark, sf):
    return panels.table(spark, sf, "part").groupBy(T.crosswalk(F.col("p_size"), RANGES).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("p19_repair_cascade", "SELECT source, label, count(*) AS n FROM (SELECT CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type WHEN p_brand IN ('Brand#1', 'Brand#11') THEN p_brand END AS label, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'type' WHEN p_brand IN ('Brand#1', 'Brand#11') THEN 'brand' END AS source FROM part) GROUP BY 1, 2", "")
def p19(spark, sf):
    label, source = T.first_valid({"type": F.col("p_type"), "brand": F.col("p_brand")}, ["PROMO", "ECONOMY", "Brand#1", "Brand#11"])
    return panels.table(spark, sf, "part").groupBy(source.alias("source"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("p20_tally", "SELECT coalesce(o_orderpriority, 'unknown') AS reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1", "share")
def p20(spark, sf):
    return T.tally(panels.table(spark, sf, "orders"), "o_orderpriority")


@register("p21_sector_map_validation", "SELECT sector, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM sec GROUP BY sector", "share")
def p21(spark, sf):
    return panels.sectors(spark, sf).groupBy("sector").agg(F.count(F.lit(1)).alias("n")).withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy())))


@register("p22_symbol_classes", "SELECT CASE WHEN NOT regexp_matches(s, '^[A-Z]+$') THEN 'invalid_characters' WHEN regexp_matches(p_name, '(?i)\\bpreferred\\b') THEN 'preferred' WHEN length(s) = 5 AND substr(s, 5, 1) IN ('W', 'U', 'R') THEN 'suffix' END AS why, count(*) AS n FROM (SELECT upper(p_type) AS s, p_name FROM part) GROUP BY 1", "")
def p22(spark, sf):
    df = panels.table(spark, sf, "part")
    return df.groupBy(T.symbol_class(F.upper("p_type"), F.col("p_name")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@register("p23_series_quality", "SELECT entity, count(*) AS n, max(t) - min(t) + 1 - count(*) AS gaps, m - max(t) AS stale FROM px_m, (SELECT max(t) AS m FROM px_m) GROUP BY entity, m", "")
def p23(spark, sf):
    px = prices(spark, sf)
    out = px.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).crossJoin(F.broadcast(px.agg(F.max("t").alias("m"))))
    return out.select("entity", "n", (F.col("b") - F.col("a") + 1 - F.col("n")).alias("gaps"), (F.col("m") - F.col("b")).alias("stale"))


@register("j1_features_and_labels", "SELECT f.entity, f.t, f.mom, l.fwd FROM sig f JOIN sig l ON f.entity = l.entity AND f.t = l.t WHERE f.mom IS NOT NULL AND l.fwd IS NOT NULL", "mom fwd")
def j1(spark, sf):
    s = signals(spark, sf)
    return s.select("entity", "t", "mom").where("mom is not null").join(s.select("entity", "t", "fwd").where("fwd is not null"), ["entity", "t"])


@register("j2_left_with_deduplicated_labels", "SELECT s_suppkey AS entity, t, close FROM supplier LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS i FROM px_m) p ON p.entity = s_suppkey AND i = 1", "close")
def j2(spark, sf):
    rows = panels.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"))
    return J.left_with_labels(rows, prices(spark, sf).select("entity", "t", "close"), ["entity"], [F.desc("t")])


@register("j3_benchmark_join", "SELECT entity, t, close / bench AS relative FROM px_m JOIN bench USING (t)", "relative")
def j3(spark, sf):
    from tidemark.plans.base import benched

    return benched(spark, sf).select("entity", "t", ratio("close", "bench").alias("relative"))


@register("j4_dimension_default", "SELECT c_custkey, coalesce(n_name, 'Unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey", "")
def j4(spark, sf):
    nation = panels.table(spark, sf, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    c = panels.table(spark, sf, "customer")
    return c.join(F.broadcast(nation), c["c_nationkey"] == nation["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.lit("Unknown")).alias("nation"))


@register("j5_asof", asof_sql("<="), "value")
def j5(spark, sf):
    return asof_out(J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"]))


@register("j6_asof_strict", asof_sql("<"), "value")
def j6(spark, sf):
    return asof_out(J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"], strict=True))


@register("j7_asof_with_cap", asof_sql("<=", "AND date_diff('day', f.available_date, p.d) <= 120"), "value")
def j7(spark, sf):
    return asof_out(J.asof(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["period_end", "value"], max_age=120))


@register("j8_asof_two_periods", asof_sql("<").replace("f.value AS value", "f.value AS value, f.previous AS previous").replace("LEFT JOIN facts f", "LEFT JOIN (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY period_end) AS previous FROM facts) f"), "value previous")
def j8(spark, sf):
    df = J.asof_two(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", "period_end", "value")
    return df.select("entity", F.col("d").cast("string").alias("d"), F.col("period_end").cast("string").alias("period_end"), "value", "previous")


@register("j10_global_asof", "SELECT DISTINCT CAST(d AS VARCHAR) AS d, (SELECT arg_max(bench, t) FROM bench WHERE t <= year(d) * 12 + month(d) - 2) AS value FROM (SELECT DISTINCT d FROM " + CUST + ")", "value")
def j10(spark, sf):
    from tidemark.functions.stats import month_index

    dates = cust_months(spark, sf).select("d").distinct().withColumn("m", month_index("d") - 1)
    bench = panels.benchmark(spark, sf).withColumnRenamed("month_idx", "bt")
    return J.asof(dates, bench, None, "m", "bt", ["bench"]).select(F.col("d").cast("string").alias("d"), F.col("bench").alias("value"))


@register("j11_next_row", "SELECT p.entity, CAST(p.d AS VARCHAR) AS d, CAST((SELECT min(x.available_date) FROM facts x WHERE x.entity = p.entity AND x.available_date > p.d) AS VARCHAR) AS next FROM " + CUST + " p", "")
def j11(spark, sf):
    df = J.next_after(cust_months(spark, sf), panels.facts(spark, sf), "entity", "d", "available_date", ["value"])
    return df.select("entity", F.col("d").cast("string").alias("d"), F.col("available_date").cast("string").alias("next"))


GRID = "(SELECT s.entity, c.t, close FROM (SELECT entity, min(t) AS a, max(t) AS b FROM px_m GROUP BY entity) s JOIN (SELECT DISTINCT t FROM px_m) c ON c.t BETWEEN a AND b LEFT JOIN px_m p ON p.entity = s.entity AND p.t = c.t)"


@register("j12_limited_fill", f"SELECT g.entity, g.t, (SELECT arg_max(x.close, x.t) FROM px_m x WHERE x.entity = g.entity AND x.t BETWEEN g.t - 2 AND g.t) AS filled FROM {GRID} g", "filled")
def j12(spark, sf):
    grid = J.densified(prices(spark, sf).select("entity", "t", "close"))
    return J.filled_within(grid, "close", 2).select("entity", "t", F.col("close_filled").alias("filled"))


@register("j13_densify", f"SELECT * FROM {GRID}", "close")
def j13(spark, sf):
    return J.densified(prices(spark, sf).select("entity", "t", "close"))


@register("j15_year_over_year", "SELECT a.entity, CAST(a.period_end AS VARCHAR) AS period_end, a.value / b.value - 1 AS growth FROM facts a LEFT JOIN facts b ON a.entity = b.entity AND b.period_end = last_day(a.period_end - INTERVAL 1 YEAR)", "growth")
def j15(spark, sf):
    f = panels.facts(spark, sf)
    before = f.select("entity", F.last_day(F.add_months("period_end", 12)).alias("period_end"), F.col("value").alias("was"))
    return f.join(before, ["entity", "period_end"], "left").select("entity", F.col("period_end").cast("string").alias("period_end"), (ratio("value", "was") - 1).alias("growth"))


@register("j16_closest_period", "SELECT entity, CAST(period_end AS VARCHAR) AS period_end, CAST(m AS VARCHAR) AS match_time FROM (SELECT f.entity, f.period_end, (SELECT arg_min(x.period_end, {'d': abs(date_diff('day', x.period_end, f.period_end - 365)), 'p': x.period_end}) FROM facts x WHERE x.entity = f.entity AND abs(date_diff('day', x.period_end, f.period_end - 365)) <= 100) AS m FROM facts f)", "")
def j16(spark, sf):
    f = panels.facts(spark, sf).select("entity", "period_end", "value")
    out = J.closest(f, f, "entity", F.date_sub("period_end", 365), "period_end", "value", 100, ["entity", "period_end"])
    return out.select("entity", F.col("period_end").cast("string").alias("period_end"), F.col("match_time").cast("string").alias("match_time"))


@register("j18_coverage_gap", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "")
def j18(spark, sf):
    covered = panels.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.coverage_gap(panels.table(spark, sf, "customer"), covered, "c_custkey")


@register("j19_semi_join", "SELECT entity, t FROM px_m WHERE entity IN (SELECT entity FROM sec WHERE sector = 1)", "")
def j19(spark, sf):
    return prices(spark, sf).join(panels.sectors(spark, sf).where("sector = 1"), "entity", "left_semi").select("entity", "t")


@register("j21_reconciliation", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.entity IS NULL THEN 'only_b' WHEN b.entity IS NULL THEN 'only_a' WHEN abs(a.close - b.close) <= 1 THEN 'match' ELSE 'mismatch' END AS status FROM (SELECT * FROM px_m WHERE t % 5 <> 0) a FULL JOIN (SELECT entity, t, close + CASE WHEN entity % 4 = 0 THEN 2 ELSE 0 END AS close FROM px_m WHERE t % 7 <> 0) b ON a.entity = b.entity AND a.t = b.t) GROUP BY status", "")
def j21(spark, sf):
    px = prices(spark, sf)
    other = px.where("t % 7 <> 0").withColumn("close", F.col("close") + F.when(F.col("entity") % 4 == 0, 2).otherwise(0))
    return J.reconciled(px.where("t % 5 <> 0"), other, ["entity", "t"], "close", 1.0)


@register("r1_month_end_rows", "SELECT entity, CAST(date AS VARCHAR) AS date, close FROM (SELECT *, row_number() OVER (PARTITION BY entity, date_trunc('month', date) ORDER BY date DESC) AS i FROM px_d) WHERE i = 1", "close")
def r1(spark, sf):
    return T.month_ends(panels.daily_prices(spark, sf), "date").select("entity", F.col("date").cast("string").alias("date"), "close")


@register("r2_rebalance_dates", "SELECT CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS period, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, count(*) AS n FROM (SELECT DISTINCT date FROM px_d) GROUP BY 1", "")
def r2(spark, sf):
    return T.period_dates(panels.daily_prices(spark, sf), "date", "month").select(*[F.col(c).cast("string").alias(c) for c in ("period", "first", "last")], "n")


@register("r3_week_ends", "SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS period, CAST(max(date) AS VARCHAR) AS last FROM (SELECT DISTINCT date FROM px_d) GROUP BY 1", "")
def r3(spark, sf):
    return T.period_dates(panels.daily_prices(spark, sf), "date", "week").select(*[F.col(c).cast("string").alias(c) for c in ("period", "last")])


@register("r4_every_kth_session", "SELECT entity, p.t FROM px_m p JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM px_m)) USING (t) WHERE i % 3 = 0", "")
def r4(spark, sf):
    return T.every_kth(prices(spark, sf), 3).select("entity", "t")


@register("r5_quarter_latest", "SELECT entity, t // 3 AS q, arg_max(close, t) AS close FROM px_m GROUP BY 1, 2", "close")
def r5(spark, sf):
    return prices(spark, sf).groupBy("entity", F.floor(F.col("t") / 3).cast("int").alias("q")).agg(F.max_by("close", "t").alias("close"))


@register("r6_pivot", "SELECT t, sum(n) FILTER (sector = 0) AS s0, sum(n) FILTER (sector = 1) AS s1, sum(n) FILTER (sector = 2) AS s2, sum(n) FILTER (sector = 3) AS s3, sum(n) FILTER (sector = 4) AS s4, sum(n) FILTER (sector IS NULL) AS none FROM px_m LEFT JOIN sec USING (entity) GROUP BY t", "")
def r6(spark, sf):
    name = F.coalesce(F.concat(F.lit("s"), F.col("sector").cast("string")), F.lit("none"))
    df = prices(spark, sf).join(panels.sectors(spark, sf), "entity", "left").withColumn("sector", name)
    return df.groupBy("t").pivot("sector", ["s0", "s1", "s2", "s3", "s4", "none"]).agg(F.sum("n"))


@register("r7_fact_snapshots", "SELECT o_custkey AS entity, CAST(q AS VARCHAR) AS q, max(v) FILTER (f = 'F') AS \"F\", max(v) FILTER (f = 'O') AS \"O\", CAST(max(a) AS VARCHAR) AS as_of FROM (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, o_orderstatus AS f, max(o_orderkey) AS v, max(CAST(o_orderdate AS DATE)) AS a FROM orders GROUP BY ALL) GROUP BY 1, 2", "")
def r7(spark, sf):
    o = panels.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("q"), F.col("o_orderstatus").alias("field")).agg(F.max("o_orderkey").alias("v"), F.max(F.to_date("o_orderdate")).alias("a"))
    return T.snapshots(o, ["entity", "q"], "field", "v", "a", ["F", "O"]).select("entity", F.col("q").cast("string").alias("q"), "F", "O", F.col("as_of").cast("string").alias("as_of"))


@register("r8_monthly_sums", "SELECT CAST(date_trunc('month', date) AS DATE)::VARCHAR AS month, sum(n) AS n FROM px_d GROUP BY 1", "")
def r8(spark, sf):
    return panels.daily_prices(spark, sf).groupBy(F.date_trunc("month", "date").cast("date").cast("string").alias("month")).agg(F.sum("n").alias("n"))


@register("r9_latest_cross_section", "SELECT entity, close, row_number() OVER (ORDER BY close DESC, entity) AS place FROM px_m WHERE t = (SELECT max(t) FROM px_m)", "close")
def r9(spark, sf):
    px = prices(spark, sf)
    last = px.join(F.broadcast(px.agg(F.max("t").alias("t"))), "t")
    return T.placed(last, "close", "entity").select("entity", "close", "place")


@register("r10_common_calendar", "SELECT DISTINCT t FROM px_m WHERE t <= (SELECT min(last) FROM (SELECT max(t) AS last FROM px_m GROUP BY entity))", "")
def r10(spark, sf):
    return T.common_calendar(prices(spark, sf), "entity", "t")


@register("u1_union_by_priority", "SELECT entity, t, coalesce(a.close, b.close) AS close, CASE WHEN a.close IS NOT NULL THEN 'a' ELSE 'b' END AS source, coalesce(a.close <> b.close, false) AS conflict FROM (SELECT entity, t, close FROM px_m WHERE t % 2 = 0) a FULL JOIN (SELECT entity, t, close * 2 AS close FROM px_m WHERE t % 3 = 0) b USING (entity, t)", "close")
def u1(spark, sf):
    px = prices(spark, sf)
    return J.union_by_priority(px.where("t % 2 = 0"), px.where("t % 3 = 0").withColumn("close", F.col("close") * 2), ["entity", "t"], "close")


@register("u2_union", "SELECT entity, t FROM px_m WHERE t % 2 = 0 UNION ALL SELECT entity, t FROM px_m WHERE t % 3 = 0", "")
def u2(spark, sf):
    px = prices(spark, sf).select("entity", "t")
    return px.where("t % 2 = 0").unionByName(px.where("t % 3 = 0"))


@register("u3_entering_and_leaving", "SELECT a.t, CASE WHEN b.entity IS NULL THEN 'entering' ELSE 'both' END AS kind, a.entity FROM px_m a LEFT JOIN px_m b ON b.entity = a.entity AND b.t = a.t - 1 WHERE a.t > (SELECT min(t) FROM px_m) UNION ALL SELECT a.t + 1, 'leaving', a.entity FROM px_m a LEFT JOIN px_m b ON b.entity = a.entity AND b.t = a.t + 1 WHERE b.entity IS NULL AND a.t < (SELECT max(t) FROM px_m)", "")
def u3(spark, sf):
    """Names of every month against the month before."""
    return J.holdings_changes(prices(spark, sf).select("entity", "t"))


@register("u4_set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "")
def u4(spark, sf):
    o = panels.table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@register("j9_benchmark_interval_return", "SELECT entity, t, CASE WHEN bret IS NOT NULL THEN ret - bret END AS excess FROM (SELECT p.entity, p.t, close / max(close) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS ret, bench / max(bench) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS bret FROM px_m p JOIN bench USING (t) WINDOW w AS (PARTITION BY p.entity ORDER BY p.t))", "excess")
def j9(spark, sf):
    return returns_with_bench(spark, sf).select("entity", "t", (F.col("ret") - F.col("bret")).alias("excess"))
