"""Histories: states with the spans in which they hold, and facts with the day they are about and the day they became known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators.joins import asof_ranged


def validity_intervals(obs: DataFrame, entity: str, day: str, code: str, order: str, stale: int | None = None) -> DataFrame:
    """``<entity>, code, valid_from, valid_to, days, conflicts``: spans, open at their ends, in which an entity's observed code holds.

    Of codes seen on one day the one seen most often counts, of equally frequent
    ones that of the largest ``order``; such days count as ``conflicts``. A span
    ends where another code is seen, or ``stale`` days after the last sight
    (then nothing holds until the next); else it is open (null). A code is
    never carried to before it was first seen. Rows without entity, day or code
    say nothing. Observations are counted by day first, so an entity has at
    most a row a calendar day.
    """
    there = obs.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(code).isNotNull())
    seen = there.groupBy(entity, F.col(day).alias("day"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
    days = seen.groupBy(entity, "day").agg(F.max(F.struct("n", "last", "code")).alias("b"), (F.count(F.lit(1)) > 1).cast("int").alias("conflict")).select(entity, "day", "b.code", "conflict")
    by = Window.partitionBy(entity).orderBy("day")
    ends = F.lead("day").over(by)
    until = ends if stale is None else F.least(ends, F.date_add("day", stale))  # least skips nulls
    steps = days.withColumn("until", until).withColumn("same", F.coalesce((F.lag("code").over(by) == F.col("code")) & (F.lag("until").over(by) == F.col("day")), F.lit(False)))
    steps = steps.withColumn("island", F.sum((~F.col("same")).cast("int")).over(by))
    spans = steps.groupBy(entity, "island").agg(F.first("code").alias("code"), F.min("day").alias("valid_from"), F.max_by("until", "day").alias("valid_to"), F.count(F.lit(1)).alias("days"), F.sum("conflict").alias("conflicts"))
    return spans.drop("island")


def interval_join(probes: DataFrame, spans: DataFrame, entity: str, at: str, values: list[str], start: str = "valid_from", end: str = "valid_to", width: int = 366) -> DataFrame:
    """``probes`` with the ``values`` of the span that holds at their day, null without one.

    Both sides are split by cells of ``width`` days: a span lies in the cells
    that it covers (an open one up to the last probe), a probe in one. So an
    entity with very many probes is as many tasks as cells.
    """
    cell = lambda c: F.floor(F.unix_date(c) / width).cast("int")
    last = probes.agg(F.max(at).alias("_last"))
    ends = F.coalesce(F.date_sub(end, 1), F.greatest(F.col("_last"), F.col(start)))
    held = spans.crossJoin(F.broadcast(last)).where(F.col(start) <= F.col("_last"))
    held = held.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.greatest(F.least(ends, F.col("_last")), F.col(start))))))
    held = held.select(F.col(entity).alias("_e"), "_cell", F.col(start).alias("_from"), F.col(end).alias("_to"), *[F.col(v).alias(f"_v_{v}") for v in values])
    within = (F.col("_from") <= F.col(at)) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    found = probes.withColumn("_c", cell(F.col(at))).join(held, (F.col(entity) == F.col("_e")) & (F.col("_c") == F.col("_cell")) & within, "left")
    return found.select(*probes.columns, *[F.col(f"_v_{v}").alias(v) for v in values])


def span_faults(spans: DataFrame, entity: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """``spans, empty, overlaps, open_inside``: what must be 0 of a table of spans, but for its rows."""
    by = Window.partitionBy(entity).orderBy(start)
    rows = spans.withColumn("_next", F.lead(start).over(by))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("spans"), count(F.col(end) <= F.col(start)).alias("empty"), count(F.col(end) > F.col("_next")).alias("overlaps"),
        count(F.col(end).isNull() & F.col("_next").isNotNull()).alias("open_inside"),
    )


def coverage_by(df: DataFrame, period: Column, value: str, entity: str) -> DataFrame:
    """``period, cells, known, share, entities, values``: how much of a panel has a value."""
    out = df.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("cells"), F.count(value).alias("known"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col(entity))).alias("entities"), F.count_distinct(value).alias("values"))
    return out.withColumn("share", ratio("known", "cells"))


def versions(facts: DataFrame, keys: list[str], known: str, value: str, minor: float = 0.05) -> DataFrame:
    """``facts`` with ``version, first_known, first_value, lag_days, revision, class`` of each version of a fact.

    A fact (``keys``) has a version a day on which it is reported: the largest
    value if a day has several. ``revision`` is against the version before;
    ``class`` is ``original``, ``confirmed`` (no change), ``minor`` (within that
    share) or ``major``, the latter two with the direction.
    """
    daily = facts.where(F.col(known).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, known).agg(F.max(value).alias(value))
    by = Window.partitionBy(*keys).orderBy(known)
    before = F.lag(value).over(by)
    rows = daily.withColumns({"version": F.row_number().over(by), "first_known": F.first(known).over(by), "first_value": F.first(value).over(by), "_before": before})
    revision = ratio(F.col(value) - F.col("_before"), F.abs("_before"))
    size = F.when(F.abs("revision") <= minor, "minor").otherwise("major")
    kind = F.when(F.col("version") == 1, "original").when(F.col(value) == F.col("_before"), "confirmed").otherwise(F.concat(size, F.when(F.col(value) > F.col("_before"), "_up").otherwise("_down")))
    return rows.withColumns({"lag_days": F.datediff(known, "first_known"), "revision": revision}).withColumn("class", kind).drop("_before")


def known_at(probes: DataFrame, told: DataFrame, entity: str, period: str, known: str, value: str, about: str, at: str, rows: int = 1_000_000) -> DataFrame:
    """``probes`` with ``period, value, known_on, version, restated``: what was known on the day ``at`` about the last period up to ``about``.

    Two times: of an entity's periods that end by ``about``, the last of which
    anything was known by ``at``; and of that period's ``versions`` the last one
    known by ``at``. A later report never reaches an earlier probe. An entity's
    periods are an array, which the calendar bounds.
    """
    opened = told.groupBy(entity, period).agg(F.min(known).alias("_since")).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col("_since").alias("k")))).alias("_periods"))
    found = probes.join(opened.withColumnRenamed(entity, "_e"), F.col(entity) == F.col("_e"), "left")
    seen = F.filter("_periods", lambda x: (x["p"] <= F.col(about)) & (x["k"] <= F.col(at)))
    found = found.select(*probes.columns, F.try_element_at(seen, F.lit(-1))["p"].alias("period"))
    facts = told.select(F.col(entity), F.col(period).alias("period"), F.col(known).alias("known_on"), F.col(value).alias("value"), "version")
    out = asof_ranged(found, facts, [entity, "period"], at, "known_on", ["value", "version"], rows)
    there = F.col("period").isNotNull()
    return out.select(*probes.columns, "period", *[F.when(there, F.col(c)).alias(c) for c in ("value", "known_on", "version")], F.when(there, F.col("version") > 1).alias("restated"))
