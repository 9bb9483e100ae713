"""Scans, upserts, quality checks and reshapes of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import finite, ratio
from tidemark.operators.joins import ranges_of

#: Header names that mean the same, in order of preference.
ALIASES = {
    "ticker": ["ticker", "symbol", "code"],
    "date": ["date", "datetime", "timestamp"],
    "open": ["open", "adjusted_open"],
    "high": ["high", "adjusted_high"],
    "low": ["low", "adjusted_low"],
    "close": ["close", "last"],
    "adj_close": ["adj_close", "adjusted_close", "adj close", "close"],
    "volume": ["volume", "vol"],
}


def latest_rows(df: DataFrame, n: int, entity: str = "entity", t: str = "t", as_of: Column | None = None) -> DataFrame:
    """The last ``n`` rows of each entity, up to ``as_of``."""
    rows = df if as_of is None else df.where(F.col(t) <= as_of)
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(t)))).where(F.col("_i") <= n).drop("_i")


def price_series(df: DataFrame, keys: list[str], price: str, newest: str) -> DataFrame:
    """Finite, positive prices; of rows with one key the one with the highest ``newest``."""
    ok = df.withColumn(price, finite(price)).where(F.col(price) > 0)
    return ok.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest)))).where("_i = 1").drop("_i")


def normalized_columns(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns by their common names, from whichever alias is there; numbers that can't be read are null."""
    there = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    out = []
    for name, names in (aliases or ALIASES).items():
        found = [F.col(f"`{there[x.replace(' ', '_')]}`") for x in names if x.replace(" ", "_") in there]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        kind = "string" if name == "ticker" else "date" if name == "date" else "double"
        value = F.upper(F.trim(value.cast("string"))) if name == "ticker" else F.try_to_date(value.cast("string")) if name == "date" else finite(value.try_cast("double"))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def read_prices(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Price files with tolerant headers; bad or non-positive rows go, the last of a key wins (by volume for equal rows)."""
    df = normalized_columns(spark.read.option("header", True).option("sep", sep).csv(path)).where(F.col("date").isNotNull() & F.col("ticker").isNotNull())
    return price_series(df, ["ticker", "date"], "adj_close", "volume")


def read_statements(spark: SparkSession, path: str, wanted: dict[str, str], sep: str = ";") -> DataFrame:
    """Selected fields of delimited statements, under their new names."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(n) if n not in ("id", "period_end", "fiscal_period") else F.col(f"`{c}`").alias(n) for c, n in wanted.items() if c in df.columns])


def read_macro(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``month, value``: the last value of each month; blanks and dots are skipped."""
    df = spark.read.option("header", True).csv(path).select(F.try_to_date("observation_date").alias("d"), F.col(value).try_cast("double").alias("v")).where("d is not null and v is not null")
    return df.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.max_by("v", "d").alias("value"))


def read_company_facts(docs: DataFrame, json_col: str) -> DataFrame:
    """``ticker, concept, unit, end, filed, form, value``: observations of nested fact documents, the first reported of each period."""
    schema = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<end:string,filed:string,form:string,val:double>>>>>>>"
    facts = docs.select("ticker", F.from_json(json_col, schema)["facts"].alias("f"))
    for a, b, c in (("f", "taxonomy", "concepts"), ("concepts", "concept", "detail")):
        facts = facts.select(*[x for x in facts.columns if x != a], F.explode(a).alias(b, c))
    units = facts.select("ticker", "concept", F.explode("detail.units").alias("unit", "obs")).select("ticker", "concept", "unit", F.explode("obs").alias("o"))
    rows = units.select("ticker", "concept", "unit", F.try_to_date("o.end").alias("end"), F.try_to_date("o.filed").alias("filed"), "o.form", F.col("o.val").alias("value"))
    first = Window.partitionBy("ticker", "concept", "unit", "end").orderBy("filed", "form")
    return rows.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")


def read_events(docs: DataFrame, json_col: str) -> DataFrame:
    """``ticker, announced, estimate, actual, surprise`` from payloads of several vendors: whichever of their names is there."""
    text = lambda *names: F.coalesce(*[F.get_json_object(json_col, f"$.{n}") for n in names])
    number = lambda *names: text(*names).try_cast("double")
    out = docs.select("ticker", F.try_to_date(text("reportedDate", "reportDate", "date", "period")).alias("announced"), number("estimatedEPS", "epsEstimate", "epsEstimated", "estimate").alias("estimate"), number("reportedEPS", "epsActual", "eps", "actual").alias("actual"))
    return out.withColumn("surprise", F.col("actual") - F.col("estimate"))


def file_inventory(df: DataFrame, date: str) -> DataFrame:
    """Rows, distinct rows and date span of each file of a file-based table."""
    every = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.input_file_name().alias("file"), F.xxhash64(*every).alias("h"), F.col(date).alias("d"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("h").alias("distinct_rows"), F.min("d").alias("first"), F.max("d").alias("last"))


def range_upsert(table: DataFrame, block: DataFrame, entity: str, t: str) -> DataFrame:
    """The table with each entity's rows in the block's span replaced by the block, of whose equal keys one row stays."""
    spans = block.groupBy(entity).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    rest = table.join(spans, entity, "left").where(F.col("_a").isNull() | ~F.col(t).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return rest.unionByName(block.dropDuplicates([entity, t]))


def insert_absent(table: DataFrame, block: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the block's rows of new keys."""
    return table.unionByName(block.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, and a digest of the contents that doesn't depend on their order."""
    parts = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    digits = lambda i: F.conv(F.substring(F.col("h"), i, 8), 16, 10).cast("long")
    return df.select(parts.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(digits(1)).alias("low"), F.bit_xor(digits(9)).alias("mixed"))


def within_budget(blocks: DataFrame, size: str, order: str, budget: int) -> DataFrame:
    """Adds ``kept``: the first block, and every later one that still fits; a block-level table, so one task walks it."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("s"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(blocks.dtypes)[order]}>").alias("kept"))
    step = lambda a, b: F.when((F.size(a["kept"]) == 0) | (a["used"] + b["s"] <= budget), F.struct((a["used"] + b["s"]).cast("long").alias("used"), F.array_append(a["kept"], b["o"]).alias("kept"))).otherwise(a)
    kept = blocks.agg(F.aggregate(rows, start, step)["kept"].alias("k"))
    return blocks.crossJoin(F.broadcast(kept)).withColumn("kept", F.array_contains("k", F.col(order))).drop("k")


def synthetic_panel(spark: SparkSession, names: int, days: int, beta: float = 0.5, seed: int = 1) -> DataFrame:
    """``entity, t, signal, fwd``: noise by hash, and a planted dependence of ``fwd`` on ``signal``."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "entity", "t"), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    noise = lambda k: F.sqrt(-2 * F.log(unit(k))) * F.cos(6.283185307179586 * unit(k + 1))
    grid = spark.range(names * days).select((F.col("id") % names).alias("entity"), F.floor(F.col("id") / names).cast("int").alias("t"))
    return grid.withColumn("signal", noise(1)).withColumn("fwd", beta * F.col("signal") + noise(3))


def planted_signal(panel: DataFrame, y: str, noise: float, seed: str, entity: str = "entity", t: str = "t") -> DataFrame:
    """Adds ``signal``: ``y`` and uniform noise, by a seeded hash of the row's keys, of width ``noise``."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(entity).cast("string"), F.col(t).cast("string")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return panel.withColumn("signal", F.col(y) + noise * (unit - 0.5))


def placed(df: DataFrame, x: str, entity: str, rows: int = 1_000_000) -> DataFrame:
    """Adds ``place``: rows by ``x`` from the largest on, nulls last, ties by entity; no task orders all rows.

    Ranges of about ``rows`` rows have quantiles of a bounded sketch as bounds,
    which stand in the plan as numbers: a row's range doesn't depend on where it
    is worked on. Places are those within the range after the rows of the ranges
    before.
    """
    bounds = ranges_of(df, x, rows)
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b > F.col(x))) if bounds else F.lit(0)
    above = F.when(F.col(x).isNull(), len(bounds) + 1).otherwise(cut)
    rows = df.withColumn("_range", above)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc_nulls_last(x), entity))
    return rows.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + own).drop("_range", "_start")


def trigger(conditions: list[tuple[str, str, float]]) -> Column:
    """All conditions hold; a null is false."""
    ops = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "abs>=": lambda c, v: F.abs(c) >= v}
    return reduce(lambda a, b: a & b, [F.coalesce(ops[o](F.col(c), F.lit(v)), F.lit(False)) for c, o, v in conditions])


def share_filter(df: DataFrame, x: str, low: float, high: float, *by: str) -> DataFrame:
    """Rows whose x lies between its exact quantiles within ``by``; nulls go."""
    over = Window.partitionBy(*by)
    out = df.withColumns({"_a": F.percentile(F.col(x), F.lit(low)).over(over), "_b": F.percentile(F.col(x), F.lit(high)).over(over)})
    return out.where(F.col(x).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def staleness_curve(df: DataFrame, age: str, entity: str, caps: list[int]) -> DataFrame:
    """By cap: rows and entities kept, and their shares."""
    rows = df.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    kept = F.col(age) <= F.col("cap")
    out = rows.groupBy("cap").agg(F.sum(kept.cast("int")).alias("rows"), F.count_distinct(F.when(kept, F.col(entity))).alias("entities"), F.count(F.lit(1)).alias("_n"), F.count_distinct(entity).alias("_e"))
    return out.select("cap", "rows", "entities", ratio("rows", "_n").alias("row_share"), ratio("entities", "_e").alias("entity_share"))


def quality_battery(df: DataFrame, keys: list[str], price: str, r: str, date: str, least_entities: int, outlier: float = 0.5) -> DataFrame:
    """One row of counts and a verdict: FAIL for repeated keys or prices that aren't positive, CAVEAT for gaps, outliers or few entities."""
    repeats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum((F.col("c") > 1).cast("int")), F.lit(0)).alias("repeated_keys"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(price).isNull().cast("int")).alias("missing"), F.sum(F.coalesce(F.col(price) <= 0, F.lit(False)).cast("int")).alias("not_positive"), F.sum(F.coalesce(F.abs(F.col(r)) > outlier, F.lit(False)).cast("int")).alias("outliers"), F.count_distinct(keys[0]).alias("entities"), F.min(date).alias("first"), F.max(date).alias("last"))
    out = sums.crossJoin(repeats)
    return out.withColumn("verdict", F.when((F.col("repeated_keys") > 0) | (F.col("not_positive") > 0), "FAIL").when((F.col("missing") > 0) | (F.col("outliers") > 0) | (F.col("entities") < least_entities), "CAVEAT").otherwise("PASS"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n``: rows that break each rule; a rule that is null is broken."""
    flags = F.array(*[F.struct(F.lit(k).alias("rule"), (~F.coalesce(c, F.lit(False))).cast("int").alias("bad")) for k, c in rules.items()])
    return df.select(F.explode(flags).alias("x")).groupBy("x.rule").agg(F.sum("x.bad").alias("n"))


def tally(df: DataFrame, reason: str) -> DataFrame:
    """Counts and shares by reason; null is unknown."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy())))


def base_symbol(c: Column) -> Column:
    """A symbol without its delisting month (``SYM-YYYYMM``)."""
    return F.regexp_replace(F.upper(F.trim(c)), r"-\d{6}$", "")


def delisting_month(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"-(\d{6})$", 1), F.lit(""))


def symbol_class(symbol: Column, title: Column) -> Column:
    """Why a symbol isn't a common share; null if it is."""
    return (
        F.when(~symbol.rlike(r"^[A-Z]+$"), "invalid_characters")
        .when(title.rlike(r"(?i)\bwarrants?\b"), "warrant")
        .when(title.rlike(r"(?i)\bunits?\b"), "unit")
        .when(title.rlike(r"(?i)\brights?\b"), "right")
        .when(title.rlike(r"(?i)\bpreferred\b"), "preferred")
        .when(title.rlike(r"(?i)\b(etf|fund|trust)\b"), "fund")
        .when((F.length(symbol) == 5) & F.substring(symbol, 5, 1).isin("W", "U", "R"), "suffix")
    )


def crosswalk(code: Column, ranges: list[tuple[int, int, str]], default: str = "Unknown") -> Column:
    """The label of the first range that holds a code."""
    out = F.when(F.lit(False), default)
    for low, high, label in ranges:
        out = out.when(code.between(low, high), label)
    return out.otherwise(default)


def first_valid(sources: dict[str, Column], allowed: list[str]) -> tuple[Column, Column]:
    """The first source's label that is allowed, and the source's name."""
    value, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, c in reversed(list(sources.items())):
        ok = F.coalesce(c.isin(*allowed), F.lit(False))
        value, name = F.when(ok, c).otherwise(value), F.when(ok, F.lit(k)).otherwise(name)
    return value, name


def month_ends(df: DataFrame, date: str, entity: str = "entity") -> DataFrame:
    """Each entity's last row of each month."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(entity, F.date_trunc("month", date)).orderBy(F.desc(date)))).where("_i = 1").drop("_i")


def period_dates(df: DataFrame, date: str, period: str) -> DataFrame:
    """``period, first, last, n`` sessions of the shared calendar by month, week or quarter."""
    dates = df.select(F.col(date).alias("d")).distinct()
    return dates.groupBy(F.date_trunc(period, "d").cast("date").alias("period")).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))


def every_kth(df: DataFrame, k: int, t: str = "t") -> DataFrame:
    """Rows of every k-th session of the shared calendar. The calendar is a date-level table."""
    dates = df.select(t).distinct().withColumn("_i", F.row_number().over(Window.orderBy(t)) - 1).where(F.col("_i") % k == 0).select(t)
    return df.join(F.broadcast(dates), t, "left_semi")


def snapshots(facts: DataFrame, keys: list[str], field: str, value: str, available: str, fields: list[str]) -> DataFrame:
    """Facts of one filing key side by side, known when the last of them was."""
    wide = facts.groupBy(*keys).pivot(field, fields).agg(F.max_by(value, available))
    return wide.join(facts.groupBy(*keys).agg(F.max(available).alias("as_of")), keys)


def common_calendar(panel: DataFrame, entity: str, t: str) -> DataFrame:
    """The dates up to the least of all entities' latest ones."""
    ends = panel.groupBy(entity).agg(F.max(t).alias("_last")).agg(F.min("_last").alias("_end"))
    return panel.select(t).distinct().crossJoin(F.broadcast(ends)).where(F.col(t) <= F.col("_end")).select(t)


def truncation_differences(full: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that a run on truncated data has and the full run hasn't, and the other way."""
    return full.exceptAll(again).withColumn("only_in", F.lit("full")).unionByName(again.exceptAll(full).withColumn("only_in", F.lit("truncated")))


#: Header layouts of price files by vendor: the columns that tell them, what they mean, and the pattern of their dates.
LAYOUTS = {
    "bracketed": ({"<TICKER>": "ticker", "<DATE>": "date", "<CLOSE>": "close"}, "yyyyMMdd"),
    "day_first": ({"Symbol": "ticker", "Date": "date", "Price": "close"}, "dd.MM.yyyy"),
}


def layout_of(columns: list[str]) -> str | None:
    """The name of the layout whose columns are all there."""
    return next((name for name, (names, _) in LAYOUTS.items() if set(names) <= set(columns)), None)


def import_prices(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``layout, ticker, date, close, reason``: rows of price files whose headers tell their layout; ``reason`` says why a row is rejected, null if it isn't."""
    parts = []
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        if (layout := layout_of(raw.columns)) is None:
            raise ValueError(f"no known layout has the columns {raw.columns}")
        names, pattern = LAYOUTS[layout]
        rows = raw.select(F.lit(layout).alias("layout"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        date, close = F.to_date(F.try_to_timestamp("date", F.lit(pattern))), finite(F.col("close").try_cast("double"))
        rows = rows.withColumns({"date": date, "close": close})
        reason = F.when(F.col("ticker").isNull(), "no_ticker").when(F.col("date").isNull(), "bad_date").when(F.col("close").isNull(), "bad_price").when(F.col("close") <= 0, "not_positive")
        parts.append(rows.withColumn("reason", reason))
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_news(docs: DataFrame, json_col: str) -> DataFrame:
    """``ticker, available_date, feature`` of nested news documents: one row for each ticker of an item, known the day after."""
    schema = "struct<feed:array<struct<time_published:string,ticker_sentiment:array<struct<ticker:string,score:string>>>>>"
    items = docs.select(F.explode(F.from_json(json_col, schema)["feed"]).alias("i"))
    rows = items.select(F.to_date(F.try_to_timestamp("i.time_published", F.lit("yyyyMMdd'T'HHmmss"))).alias("d"), F.explode("i.ticker_sentiment").alias("s"))
    found = rows.select(F.upper("s.ticker").alias("ticker"), F.date_add("d", 1).alias("available_date"), finite(F.col("s.score").try_cast("double")).alias("feature"))
    return found.where("ticker is not null and available_date is not null and feature is not null")


def cached_columns(spark: SparkSession, path: str, columns: dict[str, str], cache: str) -> DataFrame:
    """The needed columns (name: type) of a large delimited file, converted once to a columnar copy at ``cache``."""
    wanted = spark.read.option("header", True).csv(path).select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in columns.items()])
    wanted.write.mode("ignore").parquet(cache)
    return spark.read.parquet(cache)


def publish(report: DataFrame, path: str) -> DataFrame:
    """Replaces the report at ``path`` as a whole, by the committer of the file system, and reads it back; for small reports, in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)


#: Endings of column names that tell when a value was known, and prefixes of columns that identify a row.
KNOWN_ENDINGS, KEY_PREFIXES = ("available_date", "filed", "ts", "date"), ("entity", "ticker", "symbol")


def column_classes(df: DataFrame) -> DataFrame:
    """``name, class, present, share``: the class of each column by its name (``key``, ``known_at`` or ``value``), and how much of it is there."""
    kinds = {c: "key" if c.lower().startswith(KEY_PREFIXES) else "known_at" if c.lower().endswith(KNOWN_ENDINGS) else "value" for c in df.columns}
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kinds)])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("class"), F.col(f"c{i}").alias("present"), ratio(f"c{i}", "n").alias("share")) for i, (c, k) in enumerate(kinds.items())])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def revision_proxy(events: DataFrame, surprise: str, entity: str = "entity", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds ``acceleration``, the change of the surprise since the event before, and its ``direction``; events without one before go."""
    before = F.lag(surprise).over(Window.partitionBy(entity).orderBy(*order))
    rows = events.withColumn("acceleration", F.col(surprise) - before).where("acceleration is not null")
    return rows.withColumn("direction", F.when(F.col("acceleration") > 0, "up").when(F.col("acceleration") < 0, "down").otherwise("flat"))


def truncation_probe(panel: DataFrame, feature, probes: DataFrame, entity: str = "entity", t: str = "t") -> DataFrame:
    """``probe, rows, differences``: rows of each probe's date whose feature changes when all rows after the date are cut off.

    ``feature(df, by)`` returns ``df`` with a column ``x`` made within ``by``. A
    feature that reads no later row has no differences. There is a copy of the
    panel up to each probe, so probes should be few.
    """
    times = F.broadcast(probes.select(F.col("probe")).distinct())
    full = feature(panel, entity).join(times, F.col(t) == F.col("probe")).select(entity, "probe", F.col("x").alias("_all"))
    cut = panel.join(times, F.col(t) <= F.col("probe")).withColumn("_id", F.struct(entity, "probe"))
    cut = feature(cut, "_id").where(F.col(t) == F.col("probe")).select(entity, "probe", F.col("x").alias("_cut"))
    both = full.join(cut, [entity, "probe"], "full")
    return both.groupBy("probe").agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("_all").eqNullSafe(F.col("_cut"))).cast("long")).alias("differences"))


def candidates(df: DataFrame, symbol: str, title: str, order: str) -> DataFrame:
    """``df`` with ``verdict``: why a row isn't a common share, else ``candidate`` for the first row of its symbol in ``order`` and ``duplicate`` for later ones; an empty or null symbol is ``empty``."""
    why = F.when(F.coalesce(F.trim(symbol), F.lit("")) == "", "empty").otherwise(symbol_class(F.col(symbol), F.coalesce(F.col(title), F.lit(""))))
    rows = df.withColumn("_why", why)
    again = F.row_number().over(Window.partitionBy(symbol, F.col("_why").isNull()).orderBy(order)) > 1
    return rows.withColumn("verdict", F.coalesce("_why", F.when(again, "duplicate").otherwise("candidate"))).drop("_why")


def exact_quantiles(df: DataFrame, x: str, shares: dict[str, float], *by: str, weight: str | None = None, rows: int = 1_000_000) -> DataFrame:
    """``by, <name>...``: exact quantiles (name: share) within groups of any size, between two values in proportion; nulls don't count.

    Values are counted first, so ties are one row; then ranges of values are
    counted, and only the places asked for are looked up within their range. No
    task holds a group. ``weight`` is a column of counts, where ``df`` has them.
    """
    there = df.where(F.col(x).isNotNull())
    counts = there.groupBy(*by, F.col(x).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    bounds = ranges_of(there, x, rows)
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col("_v"))) if bounds else F.lit(0)
    ranged = counts.withColumn("_r", cut)
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_r").agg(F.sum("_c").alias("_s"))  # a row a group and range
    totals = totals.withColumns({"_start": F.coalesce(F.sum("_s").over(upto), F.lit(0)), "_n": F.sum("_s").over(whole)}).drop("_s")
    same = F.lit(True)
    for c in (*by, "_r"):
        same = same & F.col(f"_l.{c}").eqNullSafe(F.col(f"_t.{c}"))
    held = ranged.alias("_l").join(totals.alias("_t"), same).select(*[F.col(f"_l.{c}") for c in (*by, "_r", "_v", "_c")], "_t._start", "_t._n")
    end = F.col("_start") + F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_v"))
    placed_ = held.withColumn("_end", end)
    at = lambda k: F.max(F.when((F.col("_end") - F.col("_c") <= k) & (k < F.col("_end")), F.col("_v")))
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ends = [f for name, q in shares.items() for f in (at(F.floor(place(q))).alias(f"_a_{name}"), at(F.ceil(place(q))).alias(f"_b_{name}"), F.max(place(q) - F.floor(place(q))).alias(f"_f_{name}"))]
    out = placed_.groupBy(*by).agg(*ends)
    return out.select(*by, *[(F.col(f"_a_{n}") + F.col(f"_f_{n}") * (F.col(f"_b_{n}") - F.col(f"_a_{n}"))).alias(n) for n in shares])
