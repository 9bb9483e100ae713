"""Queries of walk-forward calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration as Q
from tidemark.plans.base import eligible, once, register

#: Momentum in thousandths against a rising price, in years as folds. Blocks by the max-min formula: the largest, over starts, of the least mean to any later end.
SCORED = "(SELECT entity, t, CAST(t // 12 AS INT) AS fold, CAST(round(mom * 1000) AS INT) AS s, (fwd > 0)::INT AS y FROM el)"
FITTED = f"""d AS (SELECT * FROM {SCORED}), f AS (SELECT DISTINCT fold FROM d),
p AS (SELECT f.fold, s, sum(y) AS y, count(*) AS w FROM d JOIN f ON d.fold < f.fold GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER o AS i, sum(y) OVER o AS cy, sum(w) OVER o AS cw FROM p WINDOW o AS (PARTITION BY fold ORDER BY s)),
pairs AS (SELECT a.fold, a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON a.fold = b.fold AND b.i >= a.i),
least_ AS (SELECT fold, a, b AS i, min(m) OVER (PARTITION BY fold, a ORDER BY b DESC) AS m FROM pairs),
fit AS (SELECT l.fold, c.s, max(l.m) AS v, any_value(c.y) AS y, any_value(c.w) AS w FROM least_ l JOIN c ON c.fold = l.fold AND c.i = l.i GROUP BY 1, 2)"""


def scored(spark, sf):
    s = F.round(F.col("mom") * 1000).cast("int")
    return once(eligible(spark, sf).select("entity", "t", F.floor(F.col("t") / 12).cast("int").alias("fold"), s.alias("s"), (F.col("fwd") > 0).cast("int").alias("y")), "scored")


@register("q1_isotonic_prior_folds", f"WITH {FITTED} SELECT fold, CAST(min(s) AS DOUBLE) AS low, CAST(max(s) AS DOUBLE) AS high, sum(y) / sum(w) AS mean, CAST(sum(w) AS BIGINT) AS rows FROM (SELECT *, round(v, 12) AS r FROM fit) GROUP BY fold, r", "low high mean")
def q1_blocks(spark, sf):
    """The fit that each year may use, on all years before, as blocks of one mean."""
    blocks = Q.isotonic_blocks(scored(spark, sf), "s", "y")
    return blocks.select("fold", "low", "high", (F.col("total") / F.col("rows")).alias("mean"), F.col("rows").cast("long").alias("rows"))


@register("q1_q2_walk_forward_calibrated", f"""WITH {FITTED}, pr AS (SELECT f.fold, count(d.y) AS n, sum(d.y) AS sy FROM f LEFT JOIN d ON d.fold < f.fold GROUP BY 1),
g AS (SELECT d.*, n, sy, (SELECT max(s) FROM fit x WHERE x.fold = d.fold AND x.s <= d.s) AS a, (SELECT min(s) FROM fit x WHERE x.fold = d.fold AND x.s >= d.s) AS b FROM d JOIN pr USING (fold))
SELECT g.entity, g.t, CASE WHEN g.fold = (SELECT min(fold) FROM f) THEN row_number() OVER (PARTITION BY g.fold ORDER BY g.s, g.entity, g.t) / (count(*) OVER (PARTITION BY g.fold) + 1)
  WHEN a IS NULL THEN fb.v WHEN b IS NULL OR a = b THEN fa.v ELSE fa.v + (g.s - a) / (b - a) * (fb.v - fa.v) END AS p,
  CASE WHEN g.fold = (SELECT min(fold) FROM f) THEN 'rank' ELSE 'isotonic' END AS kind
FROM g LEFT JOIN fit fa ON fa.fold = g.fold AND fa.s = g.a LEFT JOIN fit fb ON fb.fold = g.fold AND fb.s = g.b""", "p")
def q1_walk(spark, sf):
    """Probabilities of each year from the years before it."""
    rows = scored(spark, sf).withColumn("e", F.struct("entity", "t"))
    return Q.walk_forward(rows, "s", "y", least=2, entity="e", rows=2000).select("entity", "t", "p", "kind")
