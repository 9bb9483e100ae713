"""Steps whose cost must grow no faster than their rows: what is read once, cut once, or looked up without pairs."""

import bisect
import re

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tidemark.operators import files as FI
from tidemark.operators import joins as J
from tidemark.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once_by_constant_patterns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticker,Date,Close,Adjusted_Close\n\"a,b\",2020-01-02,1,2\nc,2020-01-02,1,2\n\nc , 2020-01-02 ,1,3\nc,x,1,3\nc,x,1,3\nc,2020-01-02,,\n")
    (tmp_path / "d.csv").write_text("Date,Close,Adj Close\n2020-01-02,1,2\n2020-01-02,1,4\n2020-01-03,1,0\n")
    found = FI.sniffed_prices(spark, str(tmp_path))
    got = [(r.ticker, str(r.date), r.adj_close, r.reason or "") for r in found.collect()]
    day = "2020-01-02"
    key = lambda r: (r[0], r[1], r[2] or -1.0, r[3])
    want = [("A,B", day, 2.0, ""), ("C", day, 2.0, ""), ("C", day, 3.0, "repeated"), ("C", "None", 3.0, "bad_date"), ("C", "None", 3.0, "bad_date"), ("C", day, None, "bad_price"), ("D", day, 2.0, ""), ("D", day, 4.0, "repeated"), ("D", "2020-01-03", 0.0, "not_positive")]
    assert sorted(got, key=key) == sorted(want, key=key)
    plan = plan_of(found)
    assert "Union" not in plan and not re.search(r"gettimestamp\([^,]*, pattern#", plan)


def test_next_row_is_found_in_one_pass(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", None), ("b", 1), (None, 1)], "e string, t int")
    right = spark.createDataFrame([("a", 2, 2.0), ("a", 4, 4.0), ("a", 5, 5.0), ("c", 9, 9.0)], "e string, u int, v double")
    found = J.next_after(left, right, "e", "t", "u", ["v"])
    got = {(r.e, r.t): (r.u, r.v) for r in found.collect() if r.t is not None}
    assert got == {("a", 1): (2, 2.0), ("a", 2): (4, 4.0), ("a", 5): (None, None), ("b", 1): (None, None), (None, 1): (None, None)}
    assert "unboundedfollowing" not in plan_of(found).lower()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 50, 101])
def test_places_within_bounds(spark, n):
    bounds = [3 * i for i in range(n)]
    df = spark.createDataFrame([(i,) for i in range(-2, 3 * n + 3)] + [(None,)], "x int").withColumn("p", J.place_in(bounds, "int", F.col("x")))
    assert all(r.p == bisect.bisect_left(bounds, r.x) for r in df.collect() if r.x is not None)


def test_ranged_joins_size_their_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_ROWS", 10)
    left = spark.createDataFrame([(i % 7, i) for i in range(95)], "e int, t int")
    right = spark.createDataFrame([(i % 7, i, float(i)) for i in range(95)], "e int, u int, v double")
    for rows in (1000, 20):
        found = J.asof_ranged(left, right, ["e"], "t", "u", ["v"], rows)
        assert "RepartitionByExpression [_e" in plan_of(found) and {(r.t, r.u) for r in found.collect()} == {(i, i) for i in range(95)}


def test_slices_are_dealt_apart(spark):
    from tidemark.operators import evaluate

    df = spark.createDataFrame([(t, e, float(e % 4), 0.1 * e) for t in range(3) for e in range(10)], "t int, entity int, a double, y double")
    report = evaluate.slice_report(df.repartition("t"), {"all": F.lit("all"), "half": F.when(F.col("entity") < 5, "low")}, "a", "y")
    assert "RepartitionByExpression [kind" in plan_of(report)
    assert {(r.kind, r.slice, r.rows, r.dates) for r in report.collect()} == {("all", "all", 30, 3), ("half", "low", 15, 3)}


@pytest.mark.parametrize("name", ["q2_calibrated", "q2_rank_fallback", "q1_q2_walk_forward_calibrated", "m10_boosted_stumps", "v3_boosted_lags", "s14_footer_inventory", "s6_sniffed_folder"])
def test_panels_are_built_once(spark, name):
    assert "l_suppkey" not in plan_of(QUERIES[name](spark, f"{DATA}/sf0.001"))
