"""Walk-forward calibration: pooling in parts, all fallbacks, no look-ahead; as-of joins by ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as Q
from tidemark.operators import joins as J

SCHEMA = "fold int, entity string, s double, y int"


def rows(seed, folds=4, n=60):
    rnd = random.Random(seed)
    return [(f, f"e{i}", round(rnd.gauss(0, 1), 2), int(rnd.random() < 0.3 + 0.1 * i / n)) for f in range(folds) for i in range(n)]


def test_pooling_parts_first_gives_the_same():
    rnd = np.random.default_rng(4)
    x, y = np.arange(200.0), rnd.integers(0, 2, 200).astype(float)
    whole = Q.pooled(x, x, y, np.ones(200))
    for cut in (1, 37, 150, 199):
        parts = Q.pooled(x[:cut], x[:cut], y[:cut], np.ones(cut)) + Q.pooled(x[cut:], x[cut:], y[cut:], np.ones(200 - cut))
        assert Q.pooled(*(np.array(c) for c in zip(*parts, strict=True))) == whole
    means = [s / w for _, _, s, w in whole]
    assert means == sorted(set(means))


def test_blocks_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    take = lambda d: sorted(map(tuple, Q.isotonic_blocks(d, "s", "y").collect()))
    want = take(df.coalesce(1))
    assert take(df.repartition(7)) == want and {r[0] for r in want} == {1, 2, 3}


def test_kinds_and_interpolation(spark):
    data = [(0, "a", 1.0, 0), (0, "b", 3.0, 1), (0, "c", None, 1), (0, "d", 2.0, None), (1, "a", 0.0, 1), (1, "b", 2.0, 1), (1, "c", 1.0, 0), (1, "d", 9.0, 0), (1, "e", None, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.fold, r.entity): (r.p, r.kind) for r in Q.walk_forward(df, "s", "y", least=2, rows=2).collect()}
    assert [got[0, e][0] for e in "abdc"] == [0.25, 0.75, 0.5, None]
    # Fold 1 has a step from 0 at 1.0 to 1 at 3.0: beyond its ends the ends, halfway the half.
    assert [got[1, e] for e in "abcd"] == [(0.0, "isotonic"), (0.5, "isotonic"), (0.0, "isotonic"), (1.0, "isotonic")] and got[1, "e"][0] is None
    thin = {(r.fold, r.entity): (r.p, r.kind) for r in Q.walk_forward(df, "s", "y", least=50).collect()}
    assert thin[1, "a"][1] == "logistic" and thin[1, "a"][0] < thin[1, "b"][0] < thin[1, "d"][0]
    falling = df.withColumn("y", 1 - F.col("y"))
    assert {r.kind for r in Q.walk_forward(falling, "s", "y", least=50).where("fold = 1").collect()} == {"base_rate"}
    same = df.withColumn("y", F.lit(1))
    assert {(r.kind, r.p) for r in Q.walk_forward(same, "s", "y", least=2).where("fold = 1 and s is not null").collect()} == {("base_rate", 1.0)}
    assert Q.walk_forward(df.limit(0), "s", "y").collect() == []


def test_logistic_fit_has_no_gradient(spark):
    data = rows(3, folds=2)
    fit = Q.logistic_fits(spark.createDataFrame(data, SCHEMA).withColumn("y", F.when(F.col("s") > 0.2, 1).otherwise(F.col("y"))), "s", "y", 1000).collect()
    x, y = np.array([r[2] for r in data if r[0] == 0]), np.array([1 if r[2] > 0.2 else r[3] for r in data if r[0] == 0])
    f = fit[0]
    p = 1 / (1 + np.exp(-(f.slope * (x - f["mean"]) / f.deviation + f.constant)))
    assert len(fit) == 1 and abs((y - p).sum()) < 1e-3 and abs(((y - p) * x).sum()) < 1e-3


def test_later_folds_change_nothing(spark):
    data = rows(5)
    take = lambda d: {(r.fold, r.entity): (r.p, r.kind) for r in Q.walk_forward(spark.createDataFrame(d, SCHEMA), "s", "y", least=10).where("fold <= 2").collect()}
    later = [(f, e, s, 1 - y) if f >= 2 else (f, e, s, y) for f, e, s, y in data]
    assert take(data) == take(later)


@pytest.mark.parametrize("size", [1000, 7])
def test_asof_by_ranges(spark, size):
    rnd = random.Random(6)
    left = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.randint(0, 50) if i else None, i) for i in range(80)], "e string, t int, i int")
    right = spark.createDataFrame([(rnd.choice(["a", "b"]), rnd.randint(0, 50), float(i)) for i in range(30)], "e string, u int, v double")
    facts = {}
    for r in right.collect():
        facts.setdefault(r.e, {})[r.u] = max(r.v, facts.get(r.e, {}).get(r.u, -1.0))
    got = {r.i: (r.u, r.v) for r in J.asof_ranged(left, right, ["e"], "t", "u", ["v"], size).collect()}
    for r in left.collect():
        u = max((u for u in facts.get(r.e, {}) if r.t is not None and u <= r.t), default=None)
        assert got[r.i] == (u, facts[r.e][u] if u is not None else None)


@pytest.mark.parametrize("size", [1000, 9])
def test_exact_quantiles_of_groups(spark, size):
    from tidemark.operators import evaluate, tables

    rnd = random.Random(8)
    data = [(rnd.choice(["a", "b", None]), round(rnd.gauss(0, 1), 1) if rnd.random() < 0.9 else None) for _ in range(150)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: (r.low, r.mid, r.top) for r in tables.exact_quantiles(df, "x", {"low": 0.1, "mid": 0.5, "top": 1.0}, "g", rows=size).collect()}
    for g in ("a", "b", None, "one"):
        x = [v for k, v in data if k == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.1, 0.5, 1.0])))
    assert "none" not in got
    counts = df.groupBy("g", "x").agg(F.count("*").alias("w"))
    again = {r.g: (r.low, r.mid, r.top) for r in tables.exact_quantiles(counts, "x", {"low": 0.1, "mid": 0.5, "top": 1.0}, "g", weight="w", rows=size).collect()}
    assert again == got
    pairs = df.where("x is not null").withColumn("y", F.abs("x"))
    a, b = (evaluate.pooled_rank_ic(pairs, "x", "y", n).first() for n in (1000, 9))
    assert tuple(a) == pytest.approx(tuple(b))
