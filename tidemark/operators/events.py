"""Tables of announcements: surprise, streaks, growth, what was known then, and returns after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators.joins import next_after

#: Edges of surprises in percent, and the names of what lies between them. Fixed values.
EDGES, BUCKETS = [-10.0, -2.0, 2.0, 10.0], ["big_miss", "miss", "inline", "beat", "big_beat"]


def announcements(events: DataFrame, actual: str, expected: str, entity: str = "entity", period: str = "period_end", back: int = 8, least: int = 4, year: int = 4) -> DataFrame:
    """``events`` with ``surprise, surprise_pct, bucket, standardized, beat_streak, growth, acceleration``, each from an entity's periods up to its own.

    ``standardized`` divides by the deviation of the ``back`` surprises before
    (``least`` of them at least), never the event's own. ``growth`` is against
    ``year`` periods before. A surprise in percent of nothing is null, and so is
    its bucket; edges belong to the bucket below.
    """
    by = Window.partitionBy(entity).orderBy(period)
    prior = by.rowsBetween(-back, -1)
    df = events.withColumn("surprise", F.col(actual) - F.col(expected))
    df = df.withColumns({"surprise_pct": 100 * ratio("surprise", F.nullif(F.abs(expected), F.lit(0.0))), "_beat": F.coalesce(F.col("surprise") > 0, F.lit(False))})
    spread = F.when(F.count("surprise").over(prior) >= least, F.stddev_samp("surprise").over(prior))
    island = F.sum((~F.col("_beat")).cast("int")).over(by)
    bucket = F.when(F.col("surprise_pct").isNull(), None)
    for edge, name in zip(EDGES, BUCKETS, strict=False):
        bucket = bucket.when(F.col("surprise_pct") <= edge, name)
    before = F.lag(actual, year).over(by)
    df = df.withColumns({"standardized": ratio("surprise", F.nullif(spread, F.lit(0.0))), "bucket": bucket.otherwise(BUCKETS[-1]), "_island": island, "growth": ratio(F.col(actual) - before, F.nullif(F.abs(before), F.lit(0.0)))})
    streak = F.sum(F.col("_beat").cast("int")).over(Window.partitionBy(entity, "_island").orderBy(period))
    return df.withColumns({"beat_streak": streak, "acceleration": F.col("growth") - F.lag("growth").over(by)}).drop("_beat", "_island")


def with_returns_after(events: DataFrame, prices: DataFrame, bench: DataFrame, horizons: list[int], on: str, announced: str, entity: str = "entity", date: str = "date", close: str = "close", past: int = 3) -> DataFrame:
    """``events`` with ``entry_date, entry, momentum`` and ``return_<k>, excess_<k>``: from the first price strictly after the announcement to the price ``k`` rows later, and that less the benchmark's over the same days.

    ``momentum`` is the return of the ``past`` rows up to the entry. Later
    prices are columns of the price rows, so an event meets one row; the
    benchmark has a row a date.
    """
    by = Window.partitionBy(entity).orderBy(date)
    rows = prices.select(F.col(entity).alias("_p"), date, close, F.lag(close, past).over(by).alias("_past"), *[f(k) for k in horizons for f in (lambda k: F.lead(close, k).over(by).alias(f"_c{k}"), lambda k: F.lead(date, k).over(by).alias(f"_d{k}"))])
    values = [close, "_past", *[f"_{c}{k}" for k in horizons for c in "cd"]]
    df = next_after(events.withColumn("_p", F.col(on)), rows.withColumnRenamed(date, "entry_date"), "_p", announced, "entry_date", values).withColumnRenamed(close, "entry")
    level = lambda name: F.broadcast(bench.select(F.col(date).alias(f"_{name}"), F.col("bench").alias(f"_{name}b")))  # noqa: E731  a row a date
    df = df.join(level("at"), F.col("entry_date") == F.col("_at"), "left").withColumn("momentum", ratio("entry", "_past") - 1)
    for k in horizons:
        df = df.join(level(f"x{k}"), F.col(f"_d{k}") == F.col(f"_x{k}"), "left").withColumn(f"return_{k}", ratio(f"_c{k}", "entry") - 1)
        df = df.withColumn(f"excess_{k}", F.col(f"return_{k}") - (ratio(f"_x{k}b", "_atb") - 1))
    return df.select(*events.columns, "entry_date", "entry", "momentum", *[f"{c}_{k}" for k in horizons for c in ("return", "excess")])
