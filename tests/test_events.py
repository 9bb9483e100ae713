"""Announcements, regimes, shocks, shares, calls and slices by hand-made cases; none reads what comes later."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, events, fundamentals, inference, models, regimes, tables

D = dt.date


def test_announcements_use_earlier_periods_only(spark):
    rnd = random.Random(3)
    rows = [("a", i, float(rnd.randint(-5, 9)), 2.0) for i in range(14)] + [("b", 0, 1.0, 0.0), ("b", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "entity string, period_end int, actual double, expected double")
    got = {(r.entity, r.period_end): r for r in events.announcements(df, "actual", "expected").collect()}
    cut = {(r.entity, r.period_end): r for r in events.announcements(df.where("period_end <= 9"), "actual", "expected").collect()}
    assert all(got[k] == r for k, r in cut.items())
    streak = 0
    for i in range(14):
        r, s = got["a", i], rows[i][2] - 2
        streak = streak + 1 if s > 0 else 0
        assert r.surprise == s and r.beat_streak == streak and (r.standardized is None) == (i < 4)
        pct = 50 * s
        assert r.bucket == ("big_miss" if pct <= -10 else "inline" if pct == 0 else "big_beat")
    assert got["b", 0].bucket is None and got["b", 1].surprise is None


def test_returns_start_after_the_announcement(spark):
    px = spark.createDataFrame([("p", D(2020, 1, i), float(10 * i)) for i in range(1, 9)], "entity string, date date, close double")
    bench = spark.createDataFrame([(D(2020, 1, i), 100.0 + i) for i in range(1, 9)], "date date, bench double")
    ev = spark.createDataFrame([("e", "p", D(2020, 1, 4)), ("e", "p", D(2020, 1, 8)), ("e", "q", D(2020, 1, 1))], "entity string, px string, day date")
    got = {(r.px, r.day.day): r for r in events.with_returns_after(ev, px, bench, [2], "px", "day").collect()}
    r = got["p", 4]
    assert r.entry_date == D(2020, 1, 5) and r.entry == 50 and r.return_2 == pytest.approx(0.4) and r.momentum == pytest.approx(1.5)
    assert r.excess_2 == pytest.approx(0.4 - (107 / 105 - 1))
    assert got["p", 8].entry is None and got["q", 1].return_2 is None


def test_regimes_and_shocks_do_not_look_ahead(spark):
    rnd = random.Random(4)
    rows = [(t, 100 + 10 * rnd.random(), rnd.random()) for t in range(50) if t != 20]
    df = spark.createDataFrame(rows, "t int, bench double, m double")
    axes = lambda d: {tuple(r) for r in regimes.regime_axes(d, "bench", {"macro": ("m", 1, "up", "down")}).where("t <= 30").collect()}
    want = axes(df)
    assert axes(df.where("t <= 30")) == want and {a for _, a, _ in want} == {"risk", "trend", "volatility", "macro"}
    assert not any(t in (21, 24) and a == "macro" for t, a, _ in want)  # the month read or compared with is missing
    long = df.unpivot(["t"], ["bench", "m"], "driver", "value")
    shocks = lambda d: {(r.t, r.driver): r.shock for r in regimes.shock_grid(d, 12, 6).where("t <= 30").collect()}
    assert shocks(long.where("t <= 30")) == shocks(long)


def test_implied_shares_and_yields(spark):
    income = spark.createDataFrame([("a", 1, 100.0, D(2020, 2, 1)), ("a", 2, -50.0, D(2020, 5, 1)), ("a", 3, 10.0, D(2020, 8, 1)), ("a", 4, 10.0, D(2020, 8, 1))], "e string, p int, v double, k date")
    each = spark.createDataFrame([("a", 1, 2.0, D(2020, 3, 1)), ("a", 2, 1.0, D(2020, 5, 1)), ("a", 3, 0.001, D(2020, 8, 1))], "e string, p int, v double, k date")
    got = fundamentals.implied_shares(income, each, ["e", "p"], "v", "k").collect()
    assert [(r.p, r.shares, r.k) for r in got] == [(1, 50.0, D(2020, 3, 1))]
    y = fundamentals.share_yields(spark.createDataFrame(got).crossJoin(spark.createDataFrame([(4.0,), (0.0,)], "px double")), "px").collect()
    assert sorted((r.market_value, r.earnings_yield, r.value_yield) for r in y if r.px) == [(200.0, 0.5, 0.5)] and all(r.earnings_yield is None for r in y if not r.px)


def test_calls_and_candidates(spark):
    df = spark.createDataFrame([(1, 0.5, None, 0.1, None), (2, None, None, None, None), (3, -0.5, -0.5, 0.9, -0.5), (4, 0.0, 0.0, None, None)], "i int, a double, b double, v double, f double")
    got = {r.i: r for r in models.direction_calls(df, {"x": ("a", 0.1, 0.6), "y": ("b", 0.1, 0.4)}, "a", "v", "f").collect()}
    assert [(got[i]["class"], got[i].regime) for i in (1, 2, 3, 4)] == [("UP", "risk_on"), ("INSUFFICIENT_DATA", "unknown"), ("DOWN", "risk_off"), ("NEUTRAL", "neutral")]
    assert got[1].coverage == pytest.approx(0.6) and got[2].confidence == 0.05 and got[1].confidence < got[3].confidence
    parts = spark.createDataFrame([(1, "ABC", None), (2, "ABC", ""), (3, "ABCDW", "x"), (4, None, "x"), (5, "A1", "x"), (6, "XYZ", "a warrant"), (7, "XYZ", "x"), (8, " ", "x")], "k int, s string, n string")
    verdicts = {r.k: r.verdict for r in tables.candidates(parts, "s", "n", "k").collect()}
    assert verdicts == {1: "candidate", 2: "duplicate", 3: "suffix", 4: "empty", 5: "invalid_characters", 6: "warrant", 7: "candidate", 8: "empty"}


def test_probe_finds_a_look_ahead(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(e, t, float(t * t)) for e in "ab" for t in range(6)], "entity string, t int, x0 double")
    probes = df.where("t = 3").select(F.col("t").alias("probe"))
    look = lambda f: lambda d, by: d.withColumn("x", f("x0").over(Window.partitionBy(by).orderBy("t")))
    assert tuple(tables.truncation_probe(df, look(F.lead), probes).first()) == (3, 2, 2)
    assert tuple(tables.truncation_probe(df, look(F.lag), probes).first()) == (3, 2, 0)


def test_surface_slices_and_bootstrap_edges(spark):
    df = spark.createDataFrame([(t, e, float(e), float(-e), 0.1 * e) for t in range(3) for e in range(10)], "t int, entity int, a double, b double, y double")
    cells = evaluate.surface(df, {1: "a", 2: "b"}, "y", [0.1, 0.5])
    got = {(r.param, r.share): (round(r.spread, 9), r.months, r.near_cells, r.peak) for r in cells.collect()}
    assert got == {(1.0, 0.1): (0.9, 3, 4, True), (1.0, 0.5): (0.5, 3, 4, False), (2.0, 0.1): (-0.9, 3, 4, False), (2.0, 0.5): (-0.5, 3, 4, False)}
    assert evaluate.plateau(cells).first().plateau_ratio == 0.25
    report = {(r.kind, r.slice): (r.rows, r.dates, r.mean_ic) for r in evaluate.slice_report(df, {"all": F.lit("all"), "half": F.when(F.col("entity") < 5, "low")}, "a", "y").collect()}
    assert report == {("all", "all"): (30, 3, pytest.approx(1.0)), ("half", "low"): (15, 3, pytest.approx(1.0))}
    flat = spark.createDataFrame([(t, 2.0) for t in range(7)], "t int, x double")
    b = inference.block_bootstrap(flat, "x", 3, 20).first()
    assert (b.replicates, b.low, b.high) == (20, pytest.approx(2.0), pytest.approx(2.0))
    assert inference.block_bootstrap(flat.limit(0), "x", 3, 20).first().low is None
