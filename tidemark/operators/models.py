"""Purged walk-forward models from distributed sums; the solver sees a small matrix a fold."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators.tables import exact_quantiles


def walk_forward_folds(dates: DataFrame, folds: int, embargo: int, least: int, t: str = "t", step: int = 1) -> DataFrame:
    """``fold, train_end, test_start, test_end`` (places in the calendar ``i``): training grows, and ends ``embargo`` sessions before the test.

    Sessions after the first ``least + embargo`` are cut into equal tests; the
    last takes what is left over.
    """
    n = F.lit(dates.select(t).distinct().count())
    size = F.floor((n - least - embargo) / folds)
    out = dates.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    start = F.col("fold") * size + least + embargo
    return out.withColumns({"test_start": start.cast("int"), "train_end": (start - embargo - 1).cast("int"), "test_end": F.when(F.col("fold") == folds - 1, n - 1).otherwise(start + size - 1).cast("int")})


def rolling_folds(spark: SparkSession, n: int, train: int, test: int, step: int) -> DataFrame:
    """``fold, train_start, train_end, test_start, test_end`` of fixed windows."""
    count = max(0, (n - train - test) // step + 1)
    i = F.col("id") * step
    return spark.range(count).select(F.col("id").cast("int").alias("fold"), i.alias("train_start"), (i + train - 1).alias("train_end"), (i + train).alias("test_start"), (i + train + test - 1).alias("test_end"))


def purged_kfold(df: DataFrame, folds: int, embargo: int, horizon: int, t: str = "t") -> DataFrame:
    """``fold, role, rows``: k contiguous tests of sessions (the first ones longer by one where they don't divide); training rows whose label overlaps the test, or that follow it within the embargo, are purged."""
    place = F.dense_rank().over(Window.orderBy(t)) - 1
    dates = df.select(t).distinct().withColumn("i", place)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    base, extra = F.floor(n / folds), n % folds
    i = F.col("i")
    dates = dates.withColumn("own", F.when(i < extra * (base + 1), F.floor(i / (base + 1))).otherwise(extra + F.floor((i - extra * (base + 1)) / F.greatest(F.lit(1), base))).cast("int"))
    spans = dates.groupBy(F.col("own").alias("fold")).agg(F.min("i").alias("a"), F.max("i").alias("b"))
    rows = df.join(F.broadcast(dates), t).crossJoin(F.broadcast(spans))
    role = F.when(F.col("own") == F.col("fold"), "test").when((i < F.col("a")) & (i + horizon >= F.col("a")), "purged").when((i > F.col("b")) & (i <= F.col("b") + embargo), "embargo").otherwise("train")
    return rows.groupBy("fold", role.alias("role")).agg(F.count(F.lit(1)).alias("rows"))


def assigned(df: DataFrame, folds: DataFrame, t: str = "t") -> DataFrame:
    """Every row in every fold where it trains or is tested: ``fold, is_test``. Folds are few, dates bounded."""
    dates = df.select(t).distinct().withColumn("_i", F.row_number().over(Window.orderBy(t)) - 1)
    start = F.col("train_start") if "train_start" in folds.columns else F.lit(0)
    roles = dates.join(F.broadcast(folds), (F.col("_i").between(start, F.col("train_end"))) | F.col("_i").between(F.col("test_start"), F.col("test_end")))
    return df.join(F.broadcast(roles.select(t, "fold", (F.col("_i") >= F.col("test_start")).alias("is_test"))), t)


def imputed(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """Columns with the fold's training median for nulls, less its training mean, over its training deviation (ddof 0); dead columns are 0."""
    train = df.where(~F.col("is_test"))
    long = train.select(fold, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(fold, "v.*")
    middle = exact_quantiles(long, "x", {"m": 0.5}, fold, "name")
    medians = train.select(fold).distinct().join(middle.groupBy(fold).agg(*[F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"_m_{c}") for c in columns]), fold, "left")
    filled = df.join(F.broadcast(medians), fold).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns})
    stats = filled.where(~F.col("is_test")).groupBy(fold).agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.avg), ("s", F.stddev_pop))])
    out = filled.join(F.broadcast(stats), fold)
    return out.withColumns({c: F.coalesce(ratio(F.col(c) - F.col(f"_a_{c}"), F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}"))), F.lit(0.0)) for c in columns}).select(*df.columns)


def ridge(df: DataFrame, features: list[str], y: str, strength: float, fold: str = "fold") -> DataFrame:
    """``fold, rows, intercept, <feature>...``: (X'X + sI)^-1 X'y on demeaned training rows.

    The sums of products are one aggregate by fold; each fold is one row, and
    its small system is solved in a map over those rows.
    """
    train = df.where(~F.col("is_test") & F.col(y).isNotNull())
    names = [*features, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = train.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"s_{c}") for c in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for a, b in pairs])

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                n = r["rows"]
                cross = lambda a, b, r=r, n=n: r.get(f"p_{a}__{b}", r.get(f"p_{b}__{a}")) - r[f"s_{a}"] * r[f"s_{b}"] / n
                a = np.array([[cross(i, j) for j in features] for i in features]) + strength * np.eye(len(features))
                beta = np.linalg.solve(a, np.array([cross(i, y) for i in features]))
                out.append([r[fold], n, r[f"s_{y}"] / n - sum(b * r[f"s_{c}"] / n for b, c in zip(beta, features, strict=True)), *beta])
            yield type(frame)(out, columns=[fold, "rows", "intercept", *features])

    return sums.mapInPandas(solve, f"{fold} int, rows bigint, intercept double, " + ", ".join(f"{c} double" for c in features))


def scored(df: DataFrame, model: DataFrame, features: list[str], fold: str = "fold", least_rows: int = 0) -> DataFrame:
    """Test rows with ``score``; folds of too few training rows use the features' mean."""
    coefficients = model.select(F.col(fold).alias("_f"), "rows", F.col("intercept").alias("_c"), *[F.col(c).alias(f"_b_{c}") for c in features])
    rows = df.where("is_test").join(F.broadcast(coefficients), F.col(fold) == F.col("_f"), "left")
    linear = reduce(lambda a, b: a + b, [F.col("_c"), *[F.col(f"_b_{c}") * F.col(c) for c in features]])
    plain = reduce(lambda a, b: a + b, [F.col(c) for c in features]) / len(features)
    return rows.withColumn("score", F.when(F.coalesce("rows", F.lit(0)) >= least_rows, linear).otherwise(plain)).select(*df.columns, "score")


def logistic(df: DataFrame, features: list[str], y: str, steps: int = 50, penalty: float = 1e-6, tolerance: float = 1e-9) -> list[float]:
    """Coefficients, constant first, by Newton steps, each one aggregate of gradient and curvature, until the mean gradient is within the tolerance; ValueError where it doesn't get there."""
    beta = np.zeros(len(features) + 1)
    value = lambda i: F.lit(1.0) if i == 0 else F.col(features[i - 1])
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*features, y)])).select(*features, y).persist()
    for _ in range(steps):
        z = reduce(lambda a, b: a + b, [F.lit(float(b)) * value(i) for i, b in enumerate(beta)])
        p = 1 / (1 + F.exp(-z))
        held = rows.withColumns({"_p": p, "_w": p * (1 - p)})
        pairs = [(i, j) for i in range(len(beta)) for j in range(i, len(beta))]
        r = held.agg(F.count(F.lit(1)).alias("n"), *[F.sum(value(i) * (F.col(y).cast("double") - F.col("_p"))).alias(f"g{i}") for i in range(len(beta))], *[F.sum(value(i) * value(j) * F.col("_w")).alias(f"h{i}_{j}") for i, j in pairs]).first()
        h = np.zeros((len(beta), len(beta)))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
        g = np.array([r[f"g{i}"] or 0.0 for i in range(len(beta))]) - penalty * beta
        if np.abs(g).max() <= tolerance * max(1, r["n"]):
            rows.unpersist()
            return beta.tolist()
        beta = beta + np.linalg.solve(h + penalty * np.eye(len(beta)), g)
    rows.unpersist()
    raise ValueError(f"no fit after {steps} steps")


def ensemble_weights(ics: DataFrame, windows: DataFrame, signal: str = "signal", kind: str = "ic") -> DataFrame:
    """``fold, signal, weight`` from ICs by date in each fold's training window: by mean ``ic``, its ``sign``, or ``equal``; absolute weights sum to one."""
    inside = ics.join(F.broadcast(windows), F.col("i").between(F.col("train_start"), F.col("train_end")))
    mean = inside.groupBy("fold", signal).agg(F.avg("ic").alias("m"))
    raw = {"ic": F.col("m"), "sign": F.signum("m"), "equal": F.lit(1.0)}[kind]
    return mean.withColumn("_w", raw).select("fold", signal, ratio("_w", F.sum(F.abs("_w")).over(Window.partitionBy("fold"))).alias("weight"))


def weight_stability(model: DataFrame, features: list[str]) -> DataFrame:
    """``feature, mean, std, same_sign``: coefficients over folds, and the share with the mean's sign."""
    long = model.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("b")) for c in features])).alias("x")).select("x.*")
    mean = F.avg("b").over(Window.partitionBy("feature"))
    return long.withColumn("_m", mean).groupBy("feature").agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("std"), F.avg((F.signum("b") == F.signum("_m")).cast("double")).alias("same_sign"))


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, fitted`` at each distinct score: Spark ML's isotonic fit of the mean outcome, weighted by how often the score comes."""
    from pyspark.ml.regression import IsotonicRegression

    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(F.col(y).cast("double")).alias("mean"), F.count(F.lit(1)).cast("double").alias("w"))
    fit = IsotonicRegression(featuresCol="x", labelCol="mean", weightCol="w", predictionCol="fitted").fit(points)
    return fit.transform(points).select("x", "fitted")


def prior_folds(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows of every earlier fold, by the fold that may use them: ``for_fold``."""
    later = df.select(F.col(fold).alias("for_fold")).distinct()
    return df.join(F.broadcast(later), F.col(fold) < F.col("for_fold"))


def conformal(df: DataFrame, score: str, y: str, coverage: float, least: int, fold: str = "fold") -> DataFrame:
    """Rows with ``low, high``: the score plus quantiles of earlier folds' residuals; null where they are too few."""
    counts = df.where(F.col(y).isNotNull()).groupBy(fold, (F.col(y) - F.col(score)).alias("_r")).agg(F.count(F.lit(1)).alias("_w"))
    prior = prior_folds(counts, fold)
    sizes = prior.groupBy("for_fold").agg(F.sum("_w").alias("_n")).where(F.col("_n") >= least)
    q = exact_quantiles(prior, "_r", {"_a": (1 - coverage) / 2, "_b": (1 + coverage) / 2}, "for_fold", weight="_w").join(sizes, "for_fold", "left_semi")
    rows = df.join(F.broadcast(q), F.col(fold) == F.col("for_fold"), "left")
    return rows.select(*df.columns, (F.col(score) + F.col("_a")).alias("low"), (F.col(score) + F.col("_b")).alias("high"))


def brier(df: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    d = F.col(p) - F.col(y).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("brier"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def risk_bands(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Adds ``band``: thirds of x by exact quantiles."""
    edges = exact_quantiles(df, x, {"_a": 1 / 3, "_b": 2 / 3}, *by)
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{c}").eqNullSafe(F.col(f"_e.{c}")) for c in by], F.lit(True))
    rows = df.alias("_l").join(edges.alias("_e"), same, "left").select("_l.*", "_e._a", "_e._b")
    return rows.withColumn("band", F.when(F.col(x).isNull(), "unknown").when(F.col(x) <= F.col("_a"), "low").when(F.col(x) <= F.col("_b"), "medium").otherwise("high")).drop("_a", "_b")


def recommendation(p: Column, excess: Column, band: Column, strong: float = 0.6, mild: float = 0.53) -> Column:
    """Five levels by probability and sign of the expected excess; a strong one is one less in the high band."""
    level = F.when((p >= strong) & (excess > 0), 2).when((p >= mild) & (excess > 0), 1).when((p <= 1 - strong) & (excess < 0), -2).when((p <= 1 - mild) & (excess < 0), -1).otherwise(0)
    level = F.when(band == "high", F.signum(level) * F.least(F.abs(level), F.lit(1))).otherwise(level)
    return F.when(level == 2, "STRONG_BUY").when(level == 1, "BUY").when(level == -1, "SELL").when(level == -2, "STRONG_SELL").otherwise("HOLD")


def direction_score(parts: dict[str, tuple[str, float, float]]) -> Column:
    """Weighted mean of tanh(scale * x) over the parts that are there: ``name: (column, scale, weight)``."""
    top = [F.coalesce(F.tanh(F.col(c) * s) * w, F.lit(0.0)) for c, s, w in parts.values()]
    return ratio(reduce(lambda a, b: a + b, top), reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, _, w in parts.values()]))


def year_folds(dates: DataFrame, embargo: int, least_years: int, t: str = "t") -> DataFrame:
    """``fold, train_end, test_start, test_end`` (places in the calendar): each calendar year is tested once, after ``least_years`` and with ``embargo`` sessions before it left out."""
    calendar = dates.select(t).distinct().withColumn("_i", F.row_number().over(Window.orderBy(t)) - 1)  # a row a date
    years = calendar.groupBy(F.floor(F.col(t) / 12).cast("int").alias("fold")).agg(F.min("_i").alias("test_start"), F.max("_i").alias("test_end"))
    first = F.min("fold").over(Window.partitionBy())
    out = years.withColumn("_first", first).withColumn("train_end", F.col("test_start") - embargo - 1)
    return out.where((F.col("fold") - F.col("_first") >= least_years) & (F.col("train_end") >= 0)).select("fold", *[F.col(c).cast("int").alias(c) for c in ("train_end", "test_start", "test_end")])


def ridge_path(df: DataFrame, features: list[str], y: str, strengths: list[float], fold: str = "fold") -> DataFrame:
    """``fold, strength, rows, intercept, <feature>...``: ``ridge`` for all strengths from one pass over the training rows.

    The sums of products are taken once a fold; the symmetric matrix of a fold
    is decomposed once, and each strength only shifts its eigenvalues.
    """
    train = df.where(~F.col("is_test") & F.col(y).isNotNull())
    names = [*features, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = train.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"s_{c}") for c in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for a, b in pairs])

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                n = r["rows"]
                cross = lambda a, b, r=r, n=n: r.get(f"p_{a}__{b}", r.get(f"p_{b}__{a}")) - r[f"s_{a}"] * r[f"s_{b}"] / n
                values, vectors = np.linalg.eigh(np.array([[cross(i, j) for j in features] for i in features]))
                turned = vectors.T @ np.array([cross(i, y) for i in features])
                for s in strengths:
                    beta = vectors @ (turned / (np.maximum(values, 0) + s))
                    out.append([r[fold], float(s), n, r[f"s_{y}"] / n - sum(b * r[f"s_{c}"] / n for b, c in zip(beta, features, strict=True)), *beta])
            yield type(frame)(out, columns=[fold, "strength", "rows", "intercept", *features])

    return sums.mapInPandas(solve, f"{fold} int, strength double, rows bigint, intercept double, " + ", ".join(f"{c} double" for c in features))


def chosen_strength(df: DataFrame, features: list[str], y: str, strengths: list[float], inner: float = 0.75, fold: str = "fold", date: str = "t", entity: str = "entity") -> DataFrame:
    """``fold, strength, ic, best``: each fold's training dates are split again in time; models of the earlier part are measured on the later one by their mean rank IC.

    One pass fits all folds and strengths, one scores them; ties go to the least strength. Strengths are above 0.
    """
    from tidemark.operators.evaluate import rank_ic

    train = df.where(~F.col("is_test"))
    dates = train.select(fold, date).distinct()
    place = F.row_number().over(Window.partitionBy(fold).orderBy(date))
    dates = dates.withColumn("_late", place > F.ceil(F.count(F.lit(1)).over(Window.partitionBy(fold)) * inner))
    rows = train.join(F.broadcast(dates), [fold, date]).withColumn("is_test", F.col("_late"))
    path = ridge_path(rows, features, y, strengths, fold)
    models = path.groupBy(F.col(fold).alias("_f")).agg(F.collect_list(F.struct("strength", "intercept", *features)).alias("_m"))  # as many as strengths
    late = rows.where("is_test").join(F.broadcast(models), F.col(fold) == F.col("_f"))
    linear = lambda m: reduce(lambda a, b: a + b, [m["intercept"], *[m[c] * F.col(c) for c in features]])
    every = late.select(fold, date, entity, y, F.explode(F.transform("_m", lambda m: F.struct(m["strength"].alias("strength"), linear(m).alias("score")))).alias("s")).select(fold, date, entity, y, "s.*")
    ics = rank_ic(every, "score", y, fold, "strength", date=date, entity=entity).groupBy(fold, "strength").agg(F.round(F.avg("ic"), 12).alias("ic"))
    best = F.row_number().over(Window.partitionBy(fold).orderBy(F.desc_nulls_last("ic"), "strength")) == 1
    return ics.withColumn("best", best)


def routed(df: DataFrame, feature: str, y: str, state: str, least: int, strength: float = 10.0, fold: str = "fold") -> DataFrame:
    """Test rows with ``score`` and ``model``: the one-feature ridge of the row's own ``state`` in its fold, or that of the whole fold where the state has fewer than ``least`` training rows."""
    train = df.where(~F.col("is_test") & F.col(y).isNotNull() & F.col(feature).isNotNull())
    n = F.count(F.lit(1))
    slope = ratio(F.covar_pop(y, feature) * n, F.var_pop(feature) * n + strength)
    fit = [n.alias("_n"), slope.alias("_b"), F.avg(y).alias("_y"), F.avg(feature).alias("_x")]
    own = train.groupBy(fold, state).agg(*fit).where(F.col("_n") >= least)
    whole = train.groupBy(fold).agg(*fit)
    rows = df.where("is_test").join(F.broadcast(own), [fold, state], "left")
    whole = whole.select(fold, *[F.col(c).alias(f"{c}w") for c in ("_b", "_y", "_x")])
    rows = rows.join(F.broadcast(whole), fold, "left")
    line = lambda w: F.col(f"_y{w}") + F.col(f"_b{w}") * (F.col(feature) - F.col(f"_x{w}"))
    return rows.select(*df.columns, F.when(F.col("_n").isNotNull(), line("")).otherwise(line("w")).alias("score"), F.when(F.col("_n").isNotNull(), "own").otherwise("whole").alias("model"))


def calibrated(df: DataFrame, score: str, y: str, least: int, fold: str = "fold", entity: str = "entity") -> DataFrame:
    """Rows with ``p`` and ``kind``: a logistic fit on earlier folds' scores; their base rate where that would fall with the score, or is too thin; in the first fold the score's rank over n + 1.

    Folds are few: each has a fit of its own by Spark ML, on standardized scores.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(fold, F.col(score).alias("_s"), F.col(y).cast("double").alias("_y"))
    stats = {r["for_fold"]: r for r in prior_folds(known, fold).groupBy("for_fold").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("base"), F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std")).collect()}
    fits = []
    for f in folds[1:]:
        r = stats.get(f)
        a = b = None
        if r and r.n >= least and 0 < r.base < 1 and r.std > 0:
            z = known.where(F.col(fold) < f).select(((F.col("_s") - r["mean"]) / r["std"]).alias("z"), F.col("_y").alias("label"))
            model = LogisticRegression(standardization=False, tol=1e-10, maxIter=100).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(z))
            a, b = float(model.coefficients[0]), float(model.intercept)
        fits.append((int(f), a, b, float(r.base) if r else None, float(r["mean"]) if r else None, float(r["std"]) if r else None))
    table = F.broadcast(df.sparkSession.createDataFrame(fits, "_fold int, a double, b double, base double, mean double, std double"))
    within = Window.partitionBy(fold)
    rank = F.row_number().over(within.orderBy(score, entity)) / (F.count(F.lit(1)).over(within) + 1)
    rows = df.withColumn("_rank", rank).join(table, F.col(fold) == F.col("_fold"), "left")
    kind = F.when(F.col("_fold").isNull(), "rank").when(F.col("a") >= 0, "logistic").otherwise("base_rate")
    logistic_p = 1 / (1 + F.exp(-(F.col("a") * (F.col(score) - F.col("mean")) / F.col("std") + F.col("b"))))
    return rows.withColumn("kind", kind).select(*df.columns, F.when(F.col("kind") == "rank", F.col("_rank")).when(F.col("kind") == "logistic", logistic_p).otherwise(F.col("base")).alias("p"), "kind")


def boosted(df: DataFrame, features: list[str], y: str, rounds: int = 20, depth: int = 1, rate: float = 0.1, seed: int = 7) -> DataFrame:
    """Test rows of one fold with ``score``: Spark ML's gradient-boosted trees (stumps by default) on its training rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="score", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(rows.where(~F.col("is_test") & F.col(y).isNotNull()))
    return model.transform(rows.where("is_test")).drop("_x")


def direction_label(expected: Column, agreement: Column, confidence: Column, least_agreement: float, least_confidence: float, strong: float, weak: float) -> tuple[Column, Column]:
    """The label of an expected return, gated by agreement and confidence, and why it is a hold."""
    open_ = (F.coalesce(agreement, F.lit(0.0)) >= least_agreement) & (F.coalesce(confidence, F.lit(0.0)) >= least_confidence)
    label = F.when(open_ & (expected >= strong), "Strong Buy").when(open_ & (expected >= weak), "Buy").when(open_ & (expected <= -strong), "Strong Sell").when(open_ & (expected <= -weak), "Sell").otherwise("Hold")
    reason = F.when(label != "Hold", "actionable").when(agreement.isNull() | confidence.isNull(), "insufficient_eligible_models").when(agreement < least_agreement, "low_agreement").when(confidence < least_confidence, "low_confidence").when(F.abs(expected) < weak, "below_direction_band").otherwise("hold_other")
    return label, reason


def direction_calls(df: DataFrame, parts: dict[str, tuple[str, float, float]], trend: str, vol: str, fall: str, up: float = 0.15, floor: float = 0.05, cap: float = 0.6, high_vol: float = 0.5, deep: float = -0.3) -> DataFrame:
    """``df`` with ``signal, coverage, class, confidence, regime`` of parts (name: column, scale, weight; weights sum to one).

    The signal is the weighted mean of tanh(x / scale) over the parts that are
    there, ``coverage`` their weight. Confidence grows with the signal, shrinks
    with what is missing, and stays between its floor and cap. The regime is
    told by the name's own trend, volatility and fall from its peak.
    """
    there = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, _, w in parts.values()])
    top = reduce(lambda a, b: a + b, [F.coalesce(w * F.tanh(F.col(c) / s), F.lit(0.0)) for c, s, w in parts.values()])
    df = df.withColumn("coverage", there).withColumn("signal", F.round(ratio(top, F.nullif(F.col("coverage"), F.lit(0.0))), 12))
    kind = F.when(F.col("signal").isNull(), "INSUFFICIENT_DATA").when(F.col("signal") >= up, "UP").when(F.col("signal") <= -up, "DOWN").otherwise("NEUTRAL")
    raw = (0.15 + 0.45 * F.abs("signal")) * (0.5 + 0.5 * F.col("coverage"))
    rough = F.coalesce(F.col(vol) > high_vol, F.lit(False)) | F.coalesce(F.col(fall) < deep, F.lit(False))
    regime = F.when(F.col(trend).isNull() & F.col(vol).isNull(), "unknown").when((F.col(trend) > 0) & ~rough, "risk_on").when((F.col(trend) <= 0) & rough, "risk_off").otherwise("neutral")
    return df.withColumns({"class": kind, "confidence": F.when(F.col("signal").isNull(), floor).otherwise(F.least(F.greatest(raw, F.lit(floor)), F.lit(cap))), "regime": regime})
