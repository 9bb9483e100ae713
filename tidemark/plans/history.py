"""Queries of code histories and of facts with two times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.plans.base import register
from tidemark.plans.data import CUST, cust_months
from tidemark.sources import panels

#: Headers are orders; their code is the priority's digit. A code is stale 200 days after its last header.
SEEN = "(SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, substr(o_orderpriority, 1, 1) AS code, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY ALL)"
SPANS = f"""(SELECT entity, any_value(code) AS code, min(day) AS valid_from, arg_max(coalesce(until, DATE '9999-12-31'), day) AS valid_to, count(*) AS days, sum(conflict) AS conflicts FROM (
  SELECT *, sum(CASE WHEN pc = code AND pu = day THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY day) AS island FROM (
  SELECT *, lag(code) OVER o AS pc, lag(until) OVER o AS pu FROM (
  SELECT *, least(lead(day) OVER (PARTITION BY entity ORDER BY day), day + 200) AS until FROM (
  SELECT entity, day, arg_max(code, {{'a': n, 'b': last, 'c': code}}) AS code, (count(*) > 1)::INT AS conflict FROM {SEEN} GROUP BY 1, 2)) WINDOW o AS (PARTITION BY entity ORDER BY day)))
  GROUP BY entity, island)"""


def spans(spark, sf):
    o = panels.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).alias("code"), "o_orderkey")
    return H.validity_intervals(o, "entity", "day", "code", "o_orderkey", stale=200)


@register("f8_code_intervals", f"SELECT entity, code, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, days, CAST(conflicts AS BIGINT) AS conflicts FROM {SPANS}", "")
def f8_intervals(spark, sf):
    """When which code held, as spans that are open at their ends."""
    return spans(spark, sf).select("entity", "code", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), "days", "conflicts")


@register("f8_interval_faults", f"WITH s AS (SELECT *, row_number() OVER () AS i FROM {SPANS}) SELECT count(*) AS spans, count(*) FILTER (valid_to <= valid_from) AS empty, (SELECT count(*) FROM s a JOIN s b ON a.entity = b.entity AND a.i <> b.i AND a.valid_from <= b.valid_from AND b.valid_from < a.valid_to) AS overlaps, CAST(0 AS BIGINT) AS open_inside FROM s", "")
def f8_faults(spark, sf):
    """No span is empty, none overlaps another."""
    return H.span_faults(spans(spark, sf), "entity")


@register("f8_sector_at_probe", f"SELECT p.entity, CAST(p.d AS VARCHAR) AS d, s.code, CASE WHEN s.code IS NULL THEN 'unknown' WHEN s.code < '3' THEN 'urgent' ELSE 'other' END AS sector FROM {CUST} p LEFT JOIN {SPANS} s ON s.entity = p.entity AND s.valid_from <= p.d AND p.d < s.valid_to", "")
def f8_probe(spark, sf):
    """The code that held at each probe, and what it stands for; unknown before the first header and once stale."""
    df = H.interval_join(cust_months(spark, sf), spans(spark, sf), "entity", "d", ["code"])
    sector = F.when(F.col("code").isNull(), "unknown").when(F.col("code") < "3", "urgent").otherwise("other")
    return df.select("entity", F.col("d").cast("string").alias("d"), "code", sector.alias("sector"))


@register("f8_coverage_by_month", f"SELECT strftime(p.d, '%Y-%m') AS period, count(*) AS cells, count(s.code) AS known, count(DISTINCT CASE WHEN s.code IS NOT NULL THEN p.entity END) AS entities, count(DISTINCT s.code) AS values, count(s.code) / count(*) AS share FROM {CUST} p LEFT JOIN {SPANS} s ON s.entity = p.entity AND s.valid_from <= p.d AND p.d < s.valid_to GROUP BY 1", "share")
def f8_coverage(spark, sf):
    df = H.interval_join(cust_months(spark, sf), spans(spark, sf), "entity", "d", ["code"])
    return H.coverage_by(df, F.date_format("d", "yyyy-MM"), "code", "entity")


#: A quarter's revenue is told again with each of its orders, some weeks after the order: so much as is known by then.
TOLD = "(SELECT entity, period_end, known, CAST(sum(cents) OVER (PARTITION BY entity, period_end ORDER BY known) AS DOUBLE) / 100 AS value FROM (SELECT o_custkey AS entity, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end, CAST(o_orderdate AS DATE) + CAST(20 + o_orderkey % 90 AS INT) AS known, CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL))"
VERSIONS = f"(SELECT *, row_number() OVER o AS version, first(known) OVER o AS first_known, first(value) OVER o AS first_value, lag(value) OVER o AS before FROM {TOLD} WINDOW o AS (PARTITION BY entity, period_end ORDER BY known))"
CLASSED = f"(SELECT *, CASE WHEN version = 1 THEN 'original' WHEN value = before THEN 'confirmed' ELSE CASE WHEN abs((value - before) / nullif(abs(before), 0)) <= 0.05 THEN 'minor' ELSE 'major' END || CASE WHEN value > before THEN '_up' ELSE '_down' END END AS class, (value - before) / nullif(abs(before), 0) AS revision FROM {VERSIONS})"


def told(spark, sf):
    o = panels.table(spark, sf, "orders")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    sign = F.when(F.col("o_orderkey") % 7 == 0, 0).when(F.col("o_orderkey") % 11 == 0, -1).otherwise(1)
    known = F.date_add(F.to_date("o_orderdate"), (20 + F.col("o_orderkey") % 90).cast("int"))
    rows = o.groupBy(F.col("o_custkey").alias("entity"), end.alias("period_end"), known.alias("known")).agg(F.sum(sign * F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    total = F.sum("cents").over(Window.partitionBy("entity", "period_end").orderBy("known"))
    return rows.select("entity", "period_end", "known", (total.cast("double") / 100).alias("value"))


def restated(spark, sf):
    return H.versions(told(spark, sf), ["entity", "period_end"], "known", "value")


@register("f1_restatements", f"SELECT entity, CAST(period_end AS VARCHAR) AS period_end, CAST(known AS VARCHAR) AS known, version, value, first_value, date_diff('day', first_known, known) AS lag_days, revision, class FROM {CLASSED}", "value first_value revision")
def f1_restatements(spark, sf):
    """Every version of every quarter, with its class and its lag after the first."""
    return restated(spark, sf).select("entity", F.col("period_end").cast("string").alias("period_end"), F.col("known").cast("string").alias("known"), "version", "value", "first_value", "lag_days", "revision", "class")


@register("f1_restatement_lags", f"SELECT class, count(*) AS n, avg(date_diff('day', first_known, known)) AS mean_lag, max(date_diff('day', first_known, known)) AS longest, avg(abs(revision)) AS mean_revision FROM {CLASSED} GROUP BY class", "mean_lag mean_revision")
def f1_lags(spark, sf):
    return restated(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("lag_days").alias("mean_lag"), F.max("lag_days").alias("longest"), F.avg(F.abs("revision")).alias("mean_revision"))


PROBED = f"(SELECT entity, CAST(d - CAST(entity % 200 AS INT) AS DATE) AS about, d AS at FROM {CUST})"


@register("j5_known_at", f"WITH v AS (SELECT * FROM {VERSIONS}), p AS (SELECT p.*, (SELECT max(v.period_end) FROM v WHERE v.entity = p.entity AND v.period_end <= p.about AND v.known <= p.at) AS period FROM {PROBED} p) SELECT p.entity, CAST(p.about AS VARCHAR) AS about, CAST(p.at AS VARCHAR) AS at, CAST(p.period AS VARCHAR) AS period, v.value, CAST(v.known AS VARCHAR) AS known_on, v.version, v.version > 1 AS restated FROM p LEFT JOIN v ON v.entity = p.entity AND v.period_end = p.period AND v.known = (SELECT max(x.known) FROM v x WHERE x.entity = p.entity AND x.period_end = p.period AND x.known <= p.at)", "value")
def j5_known(spark, sf):
    """What was known at each probe about the last quarter up to another day."""
    probes = cust_months(spark, sf).select("entity", F.date_sub("d", (F.col("entity") % 200).cast("int")).alias("about"), F.col("d").alias("at"))
    df = H.known_at(probes, restated(spark, sf), "entity", "period_end", "known", "value", "about", "at", rows=5000)
    return df.select("entity", *[F.col(c).cast("string").alias(c) for c in ("about", "at", "period")], "value", F.col("known_on").cast("string").alias("known_on"), "version", "restated")
