"""As-of and other joins of panels, without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str | None, left_time: str, right_time: str, values: list[str], strict: bool = False, max_age: int | None = None, tie: str | None = None, parts: int | None = None) -> DataFrame:
    """``left`` with the latest ``right`` row of its entity at or before (``strict``: before) its time.

    Both sides are put in one ordered table, in which each probe takes the last
    fact before it: one shuffle by entity and one sort, no pairs. Facts come
    before probes of an equal time, or after them if strict. ``tie`` orders
    facts of one time. Values older than ``max_age`` days (for dates and times)
    or units (for numbers) are null, and so is ``<right_time>`` then. ``parts``
    is the number of tasks, for callers that know the rows; else Spark's.
    """
    key = [F.col(on)] if on else [F.lit(1)]
    stamp = F.struct(F.col(right_time).alias(right_time), *[F.col(v) for v in values])
    facts = right.where(F.col(right_time).isNotNull()).select(key[0].alias("_e"), F.col(right_time).alias("_t"), F.lit(1 if strict else -1).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), stamp.alias("_fact"), F.lit(None).cast(left.schema).alias("_row"))
    probes = left.select(key[0].alias("_e"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    upto = Window.partitionBy("_e").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    every = facts.unionByName(probes)
    every = every.repartition(parts, "_e") if parts else every
    found = every.withColumn("_last", F.last("_fact", ignorenulls=True).over(upto)).where(F.col("_row").isNotNull())
    if max_age is not None:
        kind = dict(right.dtypes)[right_time]
        age = F.datediff("_t", F.col("_last")[right_time]) if kind in ("date", "timestamp") else F.col("_t") - F.col("_last")[right_time]
        found = found.withColumn("_last", F.when(age <= max_age, F.col("_last")))
    return found.select("_row.*", *[F.col("_last")[c].alias(c) for c in (right_time, *values)])


def next_after(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the first ``right`` row strictly after its time."""
    stamp = F.struct(F.col(right_time), *[F.col(v) for v in values])
    facts = right.select(F.col(on).alias("_e"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), stamp.alias("_fact"), F.lit(None).cast(left.schema).alias("_row"))
    probes = left.select(F.col(on).alias("_e"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    # Read backwards: a frame that starts at the first row grows, one that ends at the last is read anew for each row.
    after = Window.partitionBy("_e").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    found = facts.unionByName(probes).withColumn("_next", F.last("_fact", ignorenulls=True).over(after)).where(F.col("_row").isNotNull())
    return found.select("_row.*", *[F.col("_next")[c].alias(c) for c in (right_time, *values)])


def asof_two(left: DataFrame, facts: DataFrame, on: str, left_time: str, right_time: str, period: str, value: str, strict: bool = True) -> DataFrame:
    """The value of the latest period known, and of the period before it, as ``value`` and ``previous``."""
    order = Window.partitionBy(on).orderBy(period)
    known = facts.withColumn("previous", F.lag(value).over(order))
    return asof(left, known, on, left_time, right_time, [period, value, "previous"], strict=strict)


def deduplicated(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_i = 1").drop("_i")


def left_with_labels(rows: DataFrame, labels: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A left join whose right side is made unique first, so that rows don't multiply."""
    return rows.join(deduplicated(labels, keys, order), keys, "left")


def densified(panel: DataFrame, entity: str = "entity", t: str = "t") -> DataFrame:
    """Every entity at every session of the shared calendar, from an entity's first to its last; values are null in between. Two bounded dimensions, not rows, are crossed."""
    spans = panel.groupBy(entity).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    dates = panel.select(t).distinct()
    grid = spans.join(F.broadcast(dates), F.col(t).between(F.col("_a"), F.col("_b"))).select(entity, t)
    return grid.join(panel, [entity, t], "left")


def filled_within(panel: DataFrame, value: str, limit: int, entity: str = "entity", t: str = "t") -> DataFrame:
    """Adds ``<value>_filled``: the last value, if at most ``limit`` sessions old."""
    upto = Window.partitionBy(entity).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(upto)
    return panel.withColumn("_l", last).withColumn(f"{value}_filled", F.when(F.col(t) - F.col("_l")["t"] <= limit, F.col("_l")["v"])).drop("_l")


def closest(left: DataFrame, right: DataFrame, on: str, target: Column, right_time: str, value: str, tolerance: int, row: list[str]) -> DataFrame:
    """``left`` with the ``right`` row closest to a target date, at most ``tolerance`` days off; the earlier of two as close.

    A band join: dates fall in cells of the tolerance's width, so a probe meets
    the three cells around it.
    """
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / max(1, tolerance))
    probes = left.withColumn("_target", target)
    facts = right.select(F.col(on).alias("_e"), F.col(right_time).alias("_rt"), F.col(value).alias("_v"), F.explode(F.array(*[cell(F.col(right_time)) + d for d in (-1, 0, 1)])).alias("_c"))
    near = probes.join(facts, (F.col(on) == F.col("_e")) & (cell(F.col("_target")) == F.col("_c")) & (F.abs(F.datediff("_rt", "_target")) <= tolerance))
    best = near.groupBy(*row).agg(F.min_by(F.struct("_rt", "_v"), F.struct(F.abs(F.datediff("_rt", "_target")), F.col("_rt"))).alias("_b"))
    return left.join(best, row, "left").withColumn("match_time", F.col("_b")["_rt"]).withColumn("match_value", F.col("_b")["_v"]).drop("_b")


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Counts of matches, mismatches and rows of one side only."""
    left, right = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ina")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    both = left.join(right, keys, "full")
    status = F.when(F.col("_ina").isNull(), "only_b").when(F.col("_inb").isNull(), "only_a").when(F.abs(F.col("_a") - F.col("_b")) <= tolerance, "match").when(F.col("_a").isNull() & F.col("_b").isNull(), "match").otherwise("mismatch")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def union_by_priority(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A's value, else B's; with where it is from, and whether both had one and differ."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.select(*keys, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "a").when(F.col("_b").isNotNull(), "b").alias("source"), F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("conflict"))


def coverage_gap(universe: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return universe.select(key).distinct().join(covered.select(key).distinct(), key, "left_anti")


def holdings_changes(book: DataFrame, entity: str = "entity", t: str = "t") -> DataFrame:
    """``t, kind, entity``: who is in a month and the month before (``both``), only in it (``entering``), or only in the one before (``leaving``)."""
    order = Window.partitionBy(entity).orderBy(t)
    was, stays = F.lag(t).over(order) == F.col(t) - 1, F.lead(t).over(order) == F.col(t) + 1
    ends = F.broadcast(book.agg(F.min(t).alias("_first"), F.max(t).alias("_last")))
    rows = book.withColumns({"_was": F.coalesce(was, F.lit(False)), "_stays": F.coalesce(stays, F.lit(False))}).crossJoin(ends)
    here = F.when(F.col(t) > F.col("_first"), F.struct(F.col(t).alias(t), F.when(F.col("_was"), "both").otherwise("entering").alias("kind")))
    gone = F.when((F.col(t) < F.col("_last")) & ~F.col("_stays"), F.struct((F.col(t) + 1).alias(t), F.lit("leaving").alias("kind")))
    return rows.select(entity, F.explode(F.array_compact(F.array(here, gone))).alias("x")).select("x.*", entity)


#: Rows that a task of an as-of join sorts, about. Spark sizes tasks by compressed bytes, and rows of alike keys grow manifold when they are read.
TASK_ROWS = 100_000


def ranges_of(df: DataFrame, x: str, rows: int, total: int | None = None) -> list:
    """Bounds that cut the values of ``x`` into ranges of about ``rows`` rows: quantiles of a bounded sketch, found once, so they are the same wherever they are used."""
    parts = -(-(df.count() if total is None else total) // rows)
    if parts < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(x, F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(10_000, 10 * parts))).first()[0] or []))


def place_in(bounds: list, kind: str, c: Column) -> Column:
    """How many of the rising ``bounds`` are below ``c``: first among every k-th of them, then among the k after it, so a row meets about twice the root of their number."""
    k = max(1, int(len(bounds) ** 0.5))
    array = lambda x: F.array(*map(F.lit, x)).cast(f"array<{kind}>")
    if k == 1:
        return F.size(F.filter(array(bounds), lambda b: b < c))
    blocks = F.array(*[array(bounds[i : i + k]) for i in range(0, len(bounds), k)])
    whole = F.size(F.filter(array(bounds[::k]), lambda b: b < c)) - 1  # the block whose first bound is the last one below
    within = F.element_at(blocks, F.greatest(whole + 1, F.lit(1)))
    return F.when(c.isNull() | (whole < 0), 0).otherwise(whole * k + F.size(F.filter(within, lambda b: b < c)))


def asof_ranged(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], rows: int = 1_000_000) -> DataFrame:
    """``asof`` for keys with very many rows: time is cut into ranges, so a key's rows are many tasks.

    The last fact before a range is carried into it, from a table with a row a
    key and range. Of facts with one key and time the one with the largest
    ``values`` counts.
    """
    key, fact = F.struct(*[F.col(c) for c in on]), F.struct(*[F.col(c) for c in (right_time, *values)])
    latest = right.where(F.col(right_time).isNotNull()).groupBy(*on, right_time).agg(F.max(F.struct(*values)).alias("_v")).select(*on, right_time, "_v.*")
    total = left.count()
    parts = max(1, -(-total // TASK_ROWS))
    bounds = ranges_of(left, left_time, rows, total)
    if not bounds:
        return asof(left.withColumn("_k", key), latest.withColumn("_k", key), "_k", left_time, right_time, values, parts=parts).drop("_k")
    kind = dict(left.dtypes)[left_time]
    cut = lambda c: place_in(bounds, kind, c)
    probes = left.withColumn("_r", F.when(F.col(left_time).isNull(), -1).otherwise(cut(F.col(left_time))))
    facts = latest.withColumn("_r", cut(F.col(right_time)))
    ends = facts.groupBy(*on, F.col("_r").alias("_at")).agg(F.max(fact).alias("_f")).withColumn("_k", key)
    carried = asof(probes.select(*on, "_r").distinct().withColumn("_k", key), ends, "_k", "_r", "_at", ["_f"], strict=True, parts=parts).where("_f is not null").select(*on, "_r", "_f.*")
    every = facts.select(*on, "_r", right_time, *values).unionByName(carried.select(*on, "_r", right_time, *values))
    key = F.struct(*[F.col(c) for c in on], F.col("_r"))
    return asof(probes.withColumn("_k", key), every.withColumn("_k", key), "_k", left_time, right_time, values, parts=parts).drop("_k", "_r")
