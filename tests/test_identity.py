"""Identity joins: rules in order, ties, hot words, and names found only by rare words."""

import random

import pytest

from tidemark.operators import identity as ID

LEFT = "id string, code string, symbol string, name string, removed boolean"
RIGHT = "id int, code string, symbol string, name string"


def found(spark, left, right, **kw):
    out = ID.identity_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "id", "id", **kw)
    return {r.id: (r.match, r.rule, r.confidence, r.ambiguous) for r in out.collect()}


def test_rules_in_order(spark):
    right = [(1, "K1", "AA", "Alpha Widgets Inc"), (2, "K2", "BB", "Beta Corp"), (3, "K2", "CC", "Gamma Steel"), (4, None, "CC", "Delta Rail"), (5, None, "DD", "Delta Rail Co"), (6, None, None, None)]
    left = [
        ("code", "K1", "BB", "Beta", False), ("two codes", "K2", "AA", "Alpha Widgets", False), ("symbol", "K9", "BB", "other", False), ("two symbols", None, "CC", "Gamma Steel", False),
        ("removed alike", None, "AA", "the ALPHA group", True), ("removed unlike", None, "AA", "Omega", True), ("name", None, None, "widgets, alpha", None), ("two names", None, "ZZ", "Delta Rail Holdings", False),
        ("none", None, None, "Epsilon", False), ("empty", None, None, None, None),
    ]
    got = found(spark, left, right)
    assert got == {
        "code": (1, "code", "high", None), "two codes": (None, None, "none", "code of several"), "symbol": (2, "symbol", "medium", None), "two symbols": (None, None, "none", "symbol of several"),
        "removed alike": (1, "symbol and name", "low", None), "removed unlike": (None, None, "none", "symbol may be used again"), "name": (1, "name", "low", None), "two names": (None, None, "none", "name of several"),
        "none": (None, None, "none", None), "empty": (None, None, "none", None),
    }
    assert found(spark, left[:0], right) == {}
    assert found(spark, left, right[:0])["code"] == (None, None, "none", None)


def test_close_runner_up_is_ambiguous(spark):
    right = [(1, None, None, "north river rail one"), (2, None, None, "north river rail two"), (3, None, None, "south")]
    got = found(spark, [("x", None, None, "north river rail", False)], right)
    assert got["x"] == (None, None, "none", "close runner-up")


@pytest.mark.parametrize("cell", [20_000, 2])
def test_names_match_all_pairs_with_hot_words(spark, monkeypatch, cell):
    monkeypatch.setattr(ID, "CELL", cell)
    rnd = random.Random(2)
    words = ["HOT"] * 6 + [f"W{i}" for i in range(12)]
    lists = lambda n: sorted({tuple(sorted({rnd.choice(words) for _ in range(rnd.randint(1, 4))})) for _ in range(n)})
    a, b = lists(60), lists(60)
    left = spark.createDataFrame([(list(x),) for x in a], "tokens array<string>")
    right = spark.createDataFrame([(list(x), i, 1) for i, x in enumerate(b)], "tokens array<string>, match int, copies int")
    import math

    df = {w: max(1, sum(w in x for x in b)) for w in words}
    weigh = lambda ws: sum(round(1000 * math.log(1 + len(b) / df[w])) for w in ws)
    want = {}
    for x in a:
        s = sorted(((-weigh(set(x) & set(y)) / weigh(set(x) | set(y)), y) for y in b))
        s = [(-v, y) for v, y in s if -v >= 0.5]
        if s:
            want[x] = (b.index(s[0][1]), s[0][0], s[1][0] if len(s) > 1 else 0.0)
    got = {tuple(r.tokens): (r.match, r.score, r.runner_up) for r in ID.alike_names(left, right, 0.5).collect()}
    assert got == want and len(want) > 20
