"""Spans of codes and facts with two times, by hand-made cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import history as H

D = dt.date


def test_spans_conflicts_staleness_and_probes(spark):
    seen = [
        ("a", D(2020, 1, 1), "x", 1), ("a", D(2020, 1, 1), "y", 2), ("a", D(2020, 1, 1), "y", 3), ("a", D(2020, 1, 5), "y", 4), ("a", D(2020, 1, 9), "x", 5),
        ("a", D(2020, 3, 1), "x", 6), ("b", D(2020, 1, 2), "z", 7), ("b", None, "z", 8), (None, D(2020, 1, 1), "z", 9), ("b", D(2020, 1, 3), None, 10),
    ]
    obs = spark.createDataFrame(seen, "entity string, day date, code string, o int")
    take = lambda df: sorted((r.entity, r.code, r.valid_from, r.valid_to, r.days, r.conflicts) for r in df.collect())
    spans = H.validity_intervals(obs, "entity", "day", "code", "o", stale=20)
    assert take(spans) == [("a", "x", D(2020, 1, 9), D(2020, 1, 29), 1, 0), ("a", "x", D(2020, 3, 1), D(2020, 3, 21), 1, 0), ("a", "y", D(2020, 1, 1), D(2020, 1, 9), 2, 1), ("b", "z", D(2020, 1, 2), D(2020, 1, 22), 1, 0)]
    open_ = H.validity_intervals(obs, "entity", "day", "code", "o")
    assert [r for r in open_.orderBy("entity", "valid_from").select("entity", "code", "valid_to").collect()][-2:] == [("a", "x", None), ("b", "z", None)]
    for s in (spans, open_):
        f = H.span_faults(s, "entity").first()
        assert (f.empty, f.overlaps, f.open_inside) == (0, 0, 0)
    days = [D(2019, 12, 31), D(2020, 1, 1), D(2020, 1, 8), D(2020, 1, 9), D(2020, 1, 29), D(2020, 3, 5), None]
    probes = spark.createDataFrame([("a", d, i) for i, d in enumerate(days)] + [(None, D(2020, 1, 1), 9)], "entity string, d date, i int")
    for width in (1, 7, 400):
        got = {r.i: r.code for r in H.interval_join(probes, spans, "entity", "d", ["code"], width=width).collect()}
        assert got == {0: None, 1: "y", 2: "y", 3: "x", 4: None, 5: "x", 6: None, 9: None}
        assert {r.i: r.code for r in H.interval_join(probes, open_, "entity", "d", ["code"], width=width).collect()}[4] == "x"
    assert H.validity_intervals(obs.limit(0), "entity", "day", "code", "o").collect() == []
    bad = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 1, 9)), ("a", D(2020, 1, 5), None), ("a", D(2020, 2, 1), D(2020, 2, 1))], "entity string, valid_from date, valid_to date")
    assert tuple(H.span_faults(bad, "entity").first()) == (3, 1, 1, 1)


def test_versions_and_what_was_known(spark):
    q1, q2 = D(2020, 3, 31), D(2020, 6, 30)
    facts = spark.createDataFrame([("a", q1, D(2020, 5, 1), 100.0), ("a", q1, D(2020, 8, 1), 103.0), ("a", q1, D(2020, 9, 1), 103.0), ("a", q1, D(2020, 10, 1), 50.0), ("a", q2, D(2020, 7, 15), 7.0), ("a", q2, None, 9.0), ("b", q1, D(2021, 1, 1), 1.0)], "entity string, p date, k date, v double")
    told = H.versions(facts, ["entity", "p"], "k", "v")
    classes = [(r.version, r["class"], r.lag_days, r.first_value) for r in told.where(F.col("p") == F.lit(q1)).where("entity = 'a'").orderBy("k").collect()]
    assert classes == [(1, "original", 0, 100.0), (2, "minor_up", 92, 100.0), (3, "confirmed", 123, 100.0), (4, "major_down", 153, 100.0)]
    probes = [(D(2020, 12, 31), D(2020, 4, 30)), (D(2020, 12, 31), D(2020, 5, 1)), (D(2020, 12, 31), D(2020, 7, 20)), (D(2020, 4, 1), D(2020, 8, 5)), (D(2020, 4, 1), D(2020, 12, 1)), (D(2020, 3, 30), D(2020, 12, 1))]
    df = spark.createDataFrame([("a", about, at, i) for i, (about, at) in enumerate(probes)] + [("b", D(2020, 12, 31), D(2020, 12, 31), 8), (None, q1, q1, 9)], "entity string, about date, at date, i int")
    for size in (1000, 2):
        got = {r.i: (r.period, r.value, r.version, r.restated) for r in H.known_at(df, told, "entity", "p", "k", "v", "about", "at", size).collect()}
        nothing = (None, None, None, None)
        assert got == {0: nothing, 1: (q1, 100.0, 1, False), 2: (q2, 7.0, 1, False), 3: (q1, 103.0, 2, True), 4: (q1, 50.0, 4, True), 5: nothing, 8: nothing, 9: nothing}
