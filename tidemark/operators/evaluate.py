"""Signal evaluation: one grouped job a question, never a loop over dates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import average_rank, ordinal_rank, ratio, safe_corr
from tidemark.operators.joins import ranges_of


def rank_ic(df: DataFrame, x: str, y: str, *by: str, date: str = "t", ties: str = "average", entity: str = "entity", least: int = 1) -> DataFrame:
    """``by, date, names, ic``: rank correlation by date, of complete pairs; null without variance. Rounded to 12 digits, so that none is zero but for the last bits."""
    keys = (*by, date)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = (lambda c: average_rank(c, *keys)) if ties == "average" else (lambda c: ordinal_rank(c, entity, *keys))
    ranked = pairs.select(*keys, rank(x).alias("_x"), rank(y).alias("_y"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"), F.round(safe_corr("_x", "_y"), 12).alias("ic")).where(F.col("names") >= least)


def ic_summary(ics: DataFrame, *by: str, x: str = "ic") -> DataFrame:
    """Mean, deviation, t, information ratio and share of the mean's sign."""
    base = ics.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))
    ir = ratio("mean", F.nullif(F.col("std"), F.lit(0.0)))
    return base.withColumns({"ir": ir, "t_stat": ir * F.sqrt("n"), "hit": F.when(F.col("mean") >= 0, F.col("positive")).otherwise(1 - F.col("positive"))})


def newey_west_t(stream: DataFrame, x: str, lags: int, order: str = "t") -> DataFrame:
    """Mean and its t with Bartlett weights of a date-level stream."""
    dates = Window.orderBy(order)
    d = stream.where(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.avg(x).over(Window.partitionBy()))
    products = [(F.col("_d") * (F.lag("_d", k).over(dates) if k else F.col("_d"))).alias(f"p{k}") for k in range(lags + 1)]
    sums = d.select(x, *products).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(lags + 1)])
    variance = reduce(lambda a, b: a + b, [F.col("s0")] + [2 * (1 - k / (lags + 1)) * F.col(f"s{k}") for k in range(1, lags + 1)]) / F.col("n")
    return sums.select("n", "mean", F.when(variance > 0, F.col("mean") / F.sqrt(F.when(variance > 0, variance) / F.col("n"))).alias("t_stat"))


def decomposed(ics: DataFrame, period: Column, x: str = "ic") -> DataFrame:
    """Mean, count and share positive by a period."""
    return ics.groupBy(period.alias("period")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))


def quantile_spread(df: DataFrame, x: str, y: str, q: float, *by: str, date: str = "t", entity: str = "entity") -> DataFrame:
    """Top less bottom mean of y by date; a leg is ``q`` of the names, one at least; ties go by entity."""
    keys = (*by, date)
    over = Window.partitionBy(*keys)
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_i", ordinal_rank(x, entity, *keys)).withColumn("_n", F.count(F.lit(1)).over(over))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * q))
    top, bottom = F.avg(F.when(F.col("_i") > F.col("_n") - k, F.col(y))), F.avg(F.when(F.col("_i") <= k, F.col(y)))
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"), top.alias("top"), bottom.alias("bottom"), (top - bottom).alias("spread"))


def bucket_means(df: DataFrame, x: str, y: str, n: int, *by: str, entity: str = "entity", date: str = "t") -> DataFrame:
    """Mean of y by bucket of x (equal counts within the date), and whether it is above the bucket before."""
    from tidemark.operators.cross import bucket_first

    means = df.withColumn("bucket", bucket_first(x, entity, n, date)).groupBy(*by, "bucket").agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("rises", F.col("mean") > F.lag("mean").over(Window.partitionBy(*by).orderBy("bucket")))


def quantiles(df: DataFrame, x: str, shares: list[float]) -> list[float]:
    """Exact interpolated quantiles over all rows, from places by ranges of values: no task holds all values."""
    from tidemark.operators.tables import placed

    rows = df.where(F.col(x).isNotNull()).select(x)
    if not (n := rows.count()):
        return []
    at = [q * (n - 1) for q in shares]
    wanted = sorted({int(k) for a in at for k in (np.floor(a), np.ceil(a))})
    found = placed(rows, x, x).withColumn("_i", n - F.col("place")).where(F.col("_i").isin(wanted))
    value = {r["_i"]: r[x] for r in found.collect()}  # two rows a quantile at most
    return [value[int(np.floor(a))] + (a - np.floor(a)) * (value[int(np.ceil(a))] - value[int(np.floor(a))]) for a in at]


def edge_buckets(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Stats of y by bucket of x between exact quantile edges over all rows; equal edges collapse; a bucket is closed on the right."""
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(quantiles(df, x, [i / n for i in range(1, n)])))]).cast("array<double>")
    rows = df.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col(x))))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.avg((F.col(y) > 0).cast("double")).alias("positive"))


def precision_at(df: DataFrame, x: str, y: str, ns: list[int], date: str = "t", entity: str = "entity") -> DataFrame:
    """By n: mean over dates of the top n's mean y and share of gains, beside the universe's."""
    place = F.row_number().over(Window.partitionBy(date).orderBy(F.col(x).desc(), entity))
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_i", place)
    sized = placed.withColumn("n", F.explode(F.array(*map(F.lit, ns))))
    inside = F.col("_i") <= F.col("n")
    dates = sized.groupBy("n", date).agg(F.avg(F.when(inside, F.col(y))).alias("mean"), F.avg(F.when(inside, (F.col(y) > 0).cast("double"))).alias("hit"), F.avg(y).alias("universe"))
    return dates.groupBy("n").agg(F.count(F.lit(1)).alias("dates"), F.avg("mean").alias("mean"), F.avg("hit").alias("hit"), F.avg("universe").alias("universe"))


def signal_correlation(df: DataFrame, names: list[str], date: str = "t", entity: str = "entity") -> DataFrame:
    """``a, b, corr``: mean over dates of the rank correlation of each pair of signals."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = df.select(date, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("p"), entity)
    rows = rows.select(date, entity, "p.*")
    return rank_ic(rows, "x", "y", "a", "b", date=date, entity=entity).groupBy("a", "b").agg(F.avg("ic").alias("corr"))


def stream_correlation(streams: DataFrame, key: str = "k", order: str = "t", x: str = "ret", least: int = 12) -> DataFrame:
    """``a, b, n, corr`` of date-level streams over shared dates."""
    a = streams.select(F.col(key).alias("a"), order, F.col(x).alias("x"))
    b = streams.select(F.col(key).alias("b"), order, F.col(x).alias("y"))
    both = a.join(b, order).where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("corr")).where(F.col("n") >= least)


def linked_clusters(corr: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """``k, cluster``: single linkage of streams whose absolute correlation reaches the threshold; the cluster's least name names it.

    One row a stream: the smallest label spreads along links until nothing
    changes. Each round's labels are held for the next, and then let go.
    """
    links = corr.where(F.abs("corr") >= threshold).select("a", "b")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).cache()
    labels, held = names.select("k", F.col("k").alias("cluster")), None
    while True:
        least = links.join(labels, links["b"] == labels["k"]).groupBy("a").agg(F.min("cluster").alias("m"))
        new = labels.join(least, labels["k"] == least["a"], "left").select("k", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"), (F.coalesce("m", "cluster") < F.col("cluster")).alias("moved")).cache()
        moved = new.where("moved").isEmpty()
        labels = new.select("k", "cluster")
        if held is not None:
            held.unpersist()
        held = new
        if moved:
            links.unpersist()
            return labels


def concentration(book: DataFrame, weight: str, group: str, *by: str) -> DataFrame:
    """Share of the largest group, Herfindahl index and effective number of groups."""
    sums = book.groupBy(*by, group).agg(F.sum(F.abs(weight)).alias("w"))
    share = ratio("w", F.sum("w").over(Window.partitionBy(*by)))
    return sums.withColumn("s", share).groupBy(*by).agg(F.max("s").alias("top_share"), F.sum(F.col("s") * F.col("s")).alias("hhi"), ratio(F.lit(1.0), F.sum(F.col("s") * F.col("s"))).alias("effective_n"))


def coverage(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """``by, field, n, present, share`` of each column."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().cast("int").alias("there")) for c in columns]))
    return df.select(*by, fields.alias("f")).groupBy(*by, "f.field").agg(F.count(F.lit(1)).alias("n"), F.sum("f.there").alias("present"), F.avg("f.there").alias("share"))


def attribution(df: DataFrame, x: str, y: str, group: str, date: str = "t", entity: str = "entity") -> DataFrame:
    """IC summary over all rows, and with each group left out, in one grouped job.

    Ranks differ by slice, so each row goes to all slices but its own group's;
    groups are few, as sectors are, and stand in one array beside the rows.
    """
    rows = df.select(date, entity, x, y, F.col(group).cast("string").alias("_g"))
    groups = rows.agg(F.array_append(F.collect_set("_g"), F.lit("all")).alias("_all"))
    slices = F.filter("_all", lambda s: (s == "all") | (s != F.col("_g")))
    rows = rows.crossJoin(F.broadcast(groups)).where(F.col(x).isNotNull()).withColumn("slice", F.explode(F.when(F.col("_g").isNull(), F.array(F.lit("all"))).otherwise(slices)))
    return ic_summary(rank_ic(rows, x, y, "slice", date=date, entity=entity), "slice")


def sliced(stream: DataFrame, slices: dict[str, Column], x: str) -> DataFrame:
    """Mean, deviation and count of a stream over named, overlapping slices of its dates."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in slices.items()]))
    return stream.withColumn("slice", F.explode(labels)).groupBy("slice").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def sweep(df: DataFrame, features: list[str], labels: list[str], date: str = "t", entity: str = "entity") -> DataFrame:
    """IC summary for every feature and horizon in one job."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).alias("x"), F.col(h).alias("y")) for f in features for h in labels]
    rows = df.select(date, entity, F.explode(F.array(*pairs)).alias("p")).select(date, entity, "p.*")
    return ic_summary(rank_ic(rows, "x", "y", "feature", "horizon", date=date, entity=entity), "feature", "horizon")


def pooled_rank_ic(df: DataFrame, x: str, y: str, rows: int = 1_000_000) -> DataFrame:
    """Rank correlation over all rows, without a window over them all.

    Ranks come from counts by value: each value's rows and the rows below it,
    from sums over ranges of values and then within a range. The ranges' bounds
    are numbers in the plan, so a range is the same wherever it is worked on.
    """

    def ranks(c: str) -> DataFrame:
        there = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        bounds = ranges_of(there, c, rows)
        cut = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col("v"))) if bounds else F.lit(0)
        ranged = there.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("p", cut)
        before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        starts = ranged.groupBy("p").agg(F.sum("c").alias("s")).withColumn("start", F.coalesce(F.sum("s").over(before), F.lit(0)))
        upto = F.sum("c").over(Window.partitionBy("p").orderBy("v"))
        return ranged.join(F.broadcast(starts.select("p", "start")), "p").select("v", (F.col("start") + upto - (F.col("c") - 1) / 2).alias("r"))

    a, b = ranks(x).withColumnsRenamed({"v": "_vx", "r": "_rx"}), ranks(y).withColumnsRenamed({"v": "_vy", "r": "_ry"})
    both = df.join(a, F.col(x) == F.col("_vx")).join(b, F.col(y) == F.col("_vy"))
    return both.agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias("spearman"), safe_corr(x, y).alias("pearson"))


def forecast_ensemble(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Mean, median, share of agreement in sign and confidence 1 / (1 + deviation over mean) of several forecasts."""
    stats = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("deviation"), F.count(x).alias("models"), F.avg((F.col(x) > 0).cast("double")).alias("up"))
    return stats.withColumn("agreement", F.greatest("up", 1 - F.col("up"))).withColumn("confidence", ratio(F.lit(1.0), 1 + ratio("deviation", F.nullif(F.abs("mean"), F.lit(0.0)))))


def error_metrics(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """Mean absolute and root mean square error, in percent of the actual."""
    e = ratio(F.col(predicted) - F.col(actual), F.nullif(F.col(actual), F.lit(0.0)))
    return df.groupBy(*by).agg((F.avg(F.abs(e)) * 100).alias("mae_pct"), (F.sqrt(F.avg(e * e)) * 100).alias("rmse_pct"))


def lift(df: DataFrame, trigger: str, y: str, *controls: str) -> DataFrame:
    """Triggered rows against the mean of untriggered ones of the same date and bucket."""
    control = df.where(~F.col(trigger)).groupBy(*controls).agg(F.avg(y).alias("_c"))
    hit = df.where(F.col(trigger)).join(control, list(controls)).withColumn("_l", F.col(y) - F.col("_c"))
    return hit.agg(F.count(F.lit(1)).alias("n"), F.avg("_l").alias("lift"), F.avg((F.col("_l") > 0).cast("double")).alias("hit"), ratio(F.avg(F.when(F.col(y) > 0, F.col(y))), F.abs(F.avg(F.when(F.col(y) < 0, F.col(y))))).alias("payoff"), F.percentile(y, F.lit(0.1)).alias("worst_decile"))


def feature_diagnostics(df: DataFrame, features: list[str], y: str, base: str, sector: str, q: float, date: str = "t", entity: str = "entity") -> DataFrame:
    """``feature, mean_ic, baseline_corr, spread, top_sector, coverage``: each feature's mean IC, mean rank correlation with a baseline, mean spread of its outer quantiles, the largest sector's share of its top ones, and how much of it is there; one job for all features."""
    rows = df.select(date, entity, y, sector, F.col(base).alias("_base"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_v")) for f in features])).alias("f")).select(date, entity, y, sector, "_base", "f.*")
    there = rows.where("_v is not null")
    ics = rank_ic(there, "_v", y, "feature", date=date, entity=entity).groupBy("feature").agg(F.avg("ic").alias("mean_ic"))
    alike = rank_ic(there, "_v", "_base", "feature", date=date, entity=entity).groupBy("feature").agg(F.avg("ic").alias("baseline_corr"))
    spreads = quantile_spread(there, "_v", y, q, "feature", date=date, entity=entity).groupBy("feature").agg(F.avg("spread").alias("spread"))
    keys = Window.partitionBy("feature", date)
    n = F.count(F.lit(1)).over(keys)
    top = there.withColumn("_top", F.row_number().over(keys.orderBy("_v", entity)) > n - F.greatest(F.lit(1), F.floor(n * q))).where("_top")
    sectors = top.groupBy("feature", sector).agg(F.count(F.lit(1)).alias("c")).groupBy("feature").agg(ratio(F.max("c"), F.sum("c")).alias("top_sector"))
    present = rows.groupBy("feature").agg(F.avg(F.col("_v").isNotNull().cast("double")).alias("coverage"))
    return ics.join(alike, "feature").join(spreads, "feature").join(sectors, "feature").join(present, "feature")


def surface(df: DataFrame, params: dict[float, str], y: str, shares: list[float], date: str = "t", entity: str = "entity") -> DataFrame:
    """``param, share, spread, months, near_best, near_mean, near_cells, peak``: mean spread of the top over the bottom ``share`` for each cell of a grid of signals (``params``: value, column) and shares.

    All shares come from one ranked pass: a leg's mean is the difference of two
    sums by rank. Then each cell is compared with the cells next to it in both
    directions, itself included: ``peak`` where none is better. A signal's null
    rows don't take part; a leg has one name at least.
    """
    long = df.select(date, entity, F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(float(p)).alias("param"), F.col(c).alias("_x")) for p, c in params.items()])).alias("p")).select(date, entity, "_y", "p.*").where("_x is not null and _y is not null")
    by = Window.partitionBy("param", date)
    order = by.orderBy("_x", entity)
    ranked = long.withColumns({"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(by), "_s": F.sum("_y").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    size = lambda q: F.greatest(F.lit(1), F.floor(F.col("_n") * q + 1e-9)).cast("int")
    at = lambda place: F.max(F.when(F.col("_r") == place, F.col("_s")))
    ends = [f for i, q in enumerate(shares) for f in (at(size(q)).alias(f"_low{i}"), F.coalesce(at(F.col("_n") - size(q)), F.lit(0.0)).alias(f"_high{i}"), F.max(size(q)).alias(f"_k{i}"))]
    dates = ranked.groupBy("param", date).agg(F.max_by("_s", "_r").alias("_all"), *ends)
    spread = lambda i: (F.col("_all") - F.col(f"_high{i}") - F.col(f"_low{i}")) / F.col(f"_k{i}")
    cells = dates.select("param", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), spread(i).alias("v")) for i, q in enumerate(shares)])).alias("c")).select("param", "c.*")
    grid = cells.groupBy("param", "share").agg(F.avg("v").alias("spread"), F.count("v").alias("months"))
    place = lambda values, c: F.array_position(F.array(*[F.lit(float(v)) for v in sorted(values)]), F.col(c))
    grid = grid.withColumns({"_i": place(params, "param"), "_j": place(shares, "share")})
    other = grid.select(F.col("_i").alias("_i2"), F.col("_j").alias("_j2"), F.col("spread").alias("_v"))
    near = grid.join(F.broadcast(other), (F.abs(F.col("_i") - F.col("_i2")) <= 1) & (F.abs(F.col("_j") - F.col("_j2")) <= 1))  # cells of a grid
    out = near.groupBy("param", "share", "spread", "months").agg(F.max("_v").alias("near_best"), F.avg("_v").alias("near_mean"), F.count(F.lit(1)).alias("near_cells"))
    return out.withColumn("peak", F.col("spread") >= F.col("near_best"))


def plateau(cells: DataFrame, x: str = "spread", band: float = 0.2) -> DataFrame:
    """``cells, least, best, median, range, plateau_ratio, peaks``: the share of cells within ``band`` of the best one (of its absolute value), and the peaks; no cell is recommended."""
    best = F.max(x).over(Window.partitionBy())
    held = cells.withColumn("_ok", F.col(x) >= best - band * F.abs(best))
    return held.agg(F.count(x).alias("cells"), F.min(x).alias("least"), F.max(x).alias("best"), F.percentile(x, F.lit(0.5)).alias("median"), (F.max(x) - F.min(x)).alias("range"), F.avg(F.col("_ok").cast("double")).alias("plateau_ratio"), F.sum(F.col("peak").cast("int")).alias("peaks"))


#: Tasks over which slices by date are dealt; Spark sizes tasks by compressed bytes, and these rows grow manifold when they are read.
SLICE_TASKS = 200


def slice_report(df: DataFrame, slices: dict[str, Column], x: str, y: str, q: float = 0.2, date: str = "t", entity: str = "entity") -> DataFrame:
    """``kind, slice, rows, dates, mean_ic, t_stat, hit, spread`` of a signal within slices (kind: name of a row's slice), all in one pass.

    Names are ranked within their slice and date. Each row is read once a kind;
    kinds are few. A row whose slice is null isn't in any of that kind.
    """
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("slice")) for k, c in slices.items()])
    long = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(date, entity, F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(parts).alias("s")).select(date, entity, "_x", "_y", "s.*").where("slice is not null")
    keys = ("kind", "slice", date)
    # A slice's month is dealt as such, not with its date's other slices. Places by score and name come first: all that goes by score then needs no sort of its own.
    placed = long.repartition(SLICE_TASKS, *keys).withColumn("_i", ordinal_rank("_x", entity, *keys)).drop(entity)
    ranked = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_a", average_rank("_x", *keys)).drop("_x").withColumn("_b", average_rank("_y", *keys))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * q + 1e-9))
    dates = ranked.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.round(safe_corr("_a", "_b"), 12).alias("ic"),
        (F.avg(F.when(F.col("_i") > F.col("_n") - k, F.col("_y"))) - F.avg(F.when(F.col("_i") <= k, F.col("_y")))).alias("spread"),
    )
    t_stat = ratio(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))) * F.sqrt(F.count("ic"))
    return dates.groupBy("kind", "slice").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), t_stat.alias("t_stat"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"), F.avg("spread").alias("spread"))
