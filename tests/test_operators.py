"""Hand-made cases for the traps: ties, gaps, least counts, as-of equality, zero variance, order in time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import books, cross, dsl, evaluate, forecasts, joins, models, tables, windows


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_average_and_ordinal_ranks_differ_on_ties(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 1.0), ("d", "c", 2.0)], "t string, entity string, x double")
    assert values(df.select("entity", stats.average_rank("x", "t").alias("r")), "entity", "r") == [("a", 1.5), ("b", 1.5), ("c", 3.0)]
    assert values(df.select("entity", stats.ordinal_rank("x", "entity", "t").alias("r")), "entity", "r") == [("a", 1), ("b", 2), ("c", 3)]


def test_correlation_of_flat_or_single_rows_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (3, 2.0, 2.0)], "g int, x double, y double")
    got = dict(values(df.groupBy("g").agg(stats.safe_corr("x", "y").alias("c")), "g", "c"))
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(1.0)


def test_lag_over_a_gap(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 20.0), ("a", 4, 30.0)], "entity string, t int, x double")
    got = df.select("t", windows.lag_exact("x", 1).alias("exact"), windows.row_lag("x", 1).alias("row"))
    assert values(got, "t", "exact", "row") == [(1, None, None), (3, None, 10.0), (4, 20.0, 20.0)]


def test_windows_need_their_least_count(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(1, 5)], "entity string, t int, x double")
    got = df.select("t", windows.rolling(F.avg, "x", 3).alias("strict"), windows.rolling(F.avg, "x", 3, 2).alias("loose"))
    assert values(got, "t", "strict", "loose") == [(1, None, None), (2, None, 1.5), (3, 2.0, 2.0), (4, 3.0, 3.0)]


@pytest.mark.parametrize("strict, want", [(False, 2.0), (True, 1.0)])
def test_asof_at_equal_times(spark, strict, want):
    left = spark.createDataFrame([("a", dt.date(2020, 1, 2))], "e string, d date")
    right = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 2), 2.0), ("a", dt.date(2020, 1, 3), 3.0)], "e string, at date, v double")
    assert joins.asof(left, right, "e", "d", "at", ["v"], strict).first().v == want


def test_asof_without_facts_and_beyond_the_cap(spark):
    left = spark.createDataFrame([("a", 10), ("b", 10), (None, 10)], "e string, d int")
    right = spark.createDataFrame([("a", 1, 1.0)], "e string, at int, v double")
    assert values(joins.asof(left, right, "e", "d", "at", ["v"]).where("e is not null"), "e", "v") == [("a", 1.0), ("b", None)]
    assert joins.asof(left, right, "e", "d", "at", ["v"], max_age=5).where("v is not null").count() == 0


def test_features_do_not_look_ahead(spark):
    df = spark.createDataFrame([("a", t, 100.0 + t * t) for t in range(20)], "entity string, t int, x double")
    run = lambda d: d.select("t", windows.skip_momentum("x", 6, 1).alias("m"), windows.realized_vol("x", 4).alias("v"))
    assert tables.truncation_differences(run(df).where("t <= 12"), run(df.where("t <= 12"))).isEmpty()


def test_planted_signal_is_found_and_placebo_is_not(spark):
    panel = tables.synthetic_panel(spark, 40, 60, beta=1.0)
    found = evaluate.ic_summary(evaluate.rank_ic(panel, "signal", "fwd")).first()
    placebo = evaluate.ic_summary(evaluate.rank_ic(cross.placebo_shuffle(panel, "signal", 3), "placebo", "fwd")).first()
    assert found["mean"] > 0.5 and found["t_stat"] > 20 and abs(placebo["t_stat"]) < 4


def test_costs_lower_the_stream_and_attribution_holds_all(spark):
    panel = tables.synthetic_panel(spark, 30, 12).withColumn("t", F.col("t"))
    stream = books.long_short(books.legs(panel, "signal", 0.2))
    net = dict(values(books.net_of_costs(stream, [0.0, 50.0]).groupBy("bps").agg(F.avg("net").alias("m")), "bps", "m"))
    assert net[0.0] > net[50.0]
    assert values(books.weight_turnover(panel.where("entity < 2").withColumn("weight", F.lit(0.5))), "t", "turnover") == [(t, 0.5 if t == 0 else 0.0) for t in range(12)]


def test_hysteresis_keeps_holdings_within_the_band(spark):
    rows = [("s", 1, "a", 3.0), ("s", 1, "b", 2.0), ("s", 1, "c", 1.0), ("s", 2, "c", 3.0), ("s", 2, "a", 2.0), ("s", 2, "b", 1.0)]
    df = spark.createDataFrame(rows, "strategy string, t int, entity string, x double")
    held = lambda b: values(books.hysteresis(df, "x", 1, b), "t", "entity")
    assert held(0.0) == [(1, "a"), (2, "c")] and held(1.0) == [(1, "a"), (2, "a")]


def test_capped_weights(spark):
    df = spark.createDataFrame([(1, "a", 6.0), (1, "b", 3.0), (1, "c", 1.0)], "t int, entity string, s double")
    got = dict(values(books.capped_weights(df, "s", 0.5, "t"), "entity", "weight"))
    assert got["a"] == 0.5 and got["b"] == pytest.approx(0.375) and got["c"] == pytest.approx(0.125)


def test_isotonic_pools_equal_scores_first(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 0), (3.0, 1)], "x double, y int")
    got = dict(values(models.isotonic(df, "x", "y"), "x", "fitted"))
    assert got[1.0] == pytest.approx(1 / 3) and got[2.0] == pytest.approx(1 / 3) and got[3.0] == 1.0


def test_folds_are_purged(spark):
    dates = spark.range(50).select(F.col("id").cast("int").alias("t"))
    for r in models.walk_forward_folds(dates, 3, 5, 20).collect():
        assert r.test_start - r.train_end == 6 and r.test_end >= r.test_start
    rows = models.purged_kfold(dates, 5, 2, 3).groupBy("fold").agg(F.sum("rows").alias("n")).collect()
    assert {r.n for r in rows} == {50}


def test_documents_are_checked():
    leaf = {"op": "source", "field": "close"}
    assert dsl.violations({"op": "lead", "inputs": [leaf]}, {"close"}) == ["leaks:lead"]
    assert dsl.violations({"op": "source", "field": "fwd_1"}, {"fwd_1"}) == ["target_as_source:fwd_1"]
    deep = leaf
    for _ in range(4):
        deep = {"op": "lag", "inputs": [deep]}
    assert "too_deep" in dsl.violations(deep, {"close"})
    a, b = {"op": "lag", "inputs": [leaf]}, leaf
    assert dsl.signature({"op": "interaction", "inputs": [a, b]}) == dsl.signature({"op": "interaction", "inputs": [b, a]})


def test_upserts_and_fingerprint(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "e string, t int, v double")
    new = spark.createDataFrame([("a", 2, 9.0), ("a", 3, 9.0), ("c", 1, 9.0)], "e string, t int, v double")
    assert values(tables.range_upsert(old, new, "e", "t"), "e", "t", "v") == [("a", 1, 1.0), ("a", 2, 9.0), ("a", 3, 9.0), ("b", 1, 3.0), ("c", 1, 9.0)]
    assert values(tables.insert_absent(old, new, ["e", "t"]), "e", "t", "v")[1] == ("a", 2, 2.0)
    assert tables.fingerprint(old).first() == tables.fingerprint(old.orderBy(F.desc("v"))).first() != tables.fingerprint(new).first()


def test_tolerant_price_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Symbol,Date,Adjusted_Close,Vol\naa,2020-01-02,10,5\nAA,2020-01-02,11,6\nbb,bad,1,1\ncc,2020-01-02,-1,1\n")
    assert values(tables.read_prices(spark, str(tmp_path / "p.csv")), "ticker", "adj_close") == [("AA", 11.0)]


def test_nested_facts_and_events(spark):
    doc = '{"facts":{"gaap":{"Assets":{"units":{"USD":[{"end":"2020-03-31","filed":"2020-05-01","form":"10-Q","val":1},{"end":"2020-03-31","filed":"2020-06-01","form":"10-Q/A","val":2}]}}}}}'
    df = spark.createDataFrame([("a", doc)], "ticker string, j string")
    assert values(tables.read_company_facts(df, "j"), "concept", "value") == [("Assets", 1.0)]
    event = spark.createDataFrame([("a", '{"date":"2020-05-01","epsActual":"1.5","epsEstimate":"1.0"}')], "ticker string, j string")
    assert values(tables.read_events(event, "j"), "surprise") == [(0.5,)]


def test_forecasts_of_a_straight_line(spark):
    df = spark.createDataFrame([("a", t, 10.0 + t) for t in range(20)], "entity string, t int, close double")
    last = forecasts.forecasts(df, 5, 2).where("t = 19 and model = 'linear'")
    assert values(last, "h", "forecast") == [(1, pytest.approx(30.0)), (2, pytest.approx(31.0))]
