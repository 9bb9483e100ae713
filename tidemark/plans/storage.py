"""Queries of stored tables, folders of files, and bars kept by a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import files as FI
from tidemark.operators import storage as ST
from tidemark.plans.base import once, prices, register, scratch
from tidemark.sources import panels
from tidemark.streaming import ingest

YEAR = {"year": "cast(floor(t / 12) as int)"}


def upserted(spark, sf):
    """The monthly panel as a table by year, with the block of ``s15_range_upsert`` put in twice; its path and the files before."""
    at = f"{scratch(spark, 'store')}/prices"
    px = prices(spark, sf).select("entity", "t", "close")
    ST.store(px, at, YEAR)
    before = ST.files_of(spark, at).select("file").collect()  # files of a table, not rows
    block = px.where("entity % 3 = 0 and t between 23950 and 23960").withColumn("close", F.col("close") * 2)
    ST.upsert_range(spark, at, block, "entity", "t", YEAR)
    ST.upsert_range(spark, at, block, "entity", "t", YEAR)
    return at, spark.createDataFrame(before, "file string")


@register("s15_stored_range_upsert", "SELECT entity, t, CASE WHEN entity % 3 = 0 AND t BETWEEN 23950 AND 23960 THEN close * 2 ELSE close END AS close, CAST(t // 12 AS INT) AS year FROM px_m", "close")
def s15_stored(spark, sf):
    """A stored table after a range upsert that ran twice."""
    return spark.read.parquet(upserted(spark, sf)[0])


@register("s15_touched_partitions", "SELECT CAST(t // 12 AS INT) AS year, max((entity % 3 = 0 AND t BETWEEN 23950 AND 23960)::INT) = 1 AS rewritten FROM px_m GROUP BY 1", "")
def s15_touched(spark, sf):
    """Which years' files a range upsert has replaced: those with rows of the block, and no other."""
    at, before = upserted(spark, sf)
    now = ST.files_of(spark, at).select("file")
    kept = now.join(before, "file", "left_semi").withColumn("kept", F.lit(1))
    year = F.regexp_extract("file", r"year=(\d+)", 1).cast("int")
    return now.join(kept, "file", "left").groupBy(year.alias("year")).agg((F.count("kept") == 0).alias("rewritten"))


@register("s16_stored_insert", "SELECT entity, t, close, CAST(t // 12 AS INT) AS year FROM px_m", "close")
def s16_stored(spark, sf):
    """A stored table of even months into which all months are inserted, twice; what was there stays."""
    at = f"{scratch(spark, 'store')}/prices"
    px = prices(spark, sf).select("entity", "t", "close")
    ST.store(px.where("t % 2 = 0"), at, YEAR)
    for _ in range(2):
        ST.insert_absent(spark, at, px, ["entity", "t"], YEAR)
    return spark.read.parquet(at)


@register("s14_footer_inventory", "SELECT 'part=' || (entity % 3) AS folder, count(*) AS rows, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, CAST(0 AS BIGINT) AS nulls, CASE WHEN entity % 3 = 0 THEN 2 ELSE 1 END AS copies, 'entity: int64, date: date32[day], close: double, n: int64' AS columns FROM px_d GROUP BY entity % 3 UNION ALL SELECT 'again', count(*), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR), 0, 2, 'entity: int64, date: date32[day], close: double, n: int64' FROM px_d WHERE entity % 3 = 0", "")
def s14_footers(spark, sf):
    """A folder of four files, two of them equal, from their footers alone."""
    at = scratch(spark, "folder")
    # Sorted by ranges and written once, so the one task of a file passes rows on and sorts none; equal files read the same rows in the same order.
    px = once(panels.daily_prices(spark, sf).select("entity", "date", "close", "n").repartitionByRange("entity", "date").sortWithinPartitions("entity", "date"), "daily")
    for folder, part in (("part=0", 0), ("part=1", 1), ("part=2", 2), ("again", 0)):
        px.where(F.col("entity") % 3 == part).coalesce(1).write.parquet(f"{at}/{folder}")
    found = FI.footer_inventory(spark, at, "date")
    return found.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("folder"), "rows", "first", "last", "nulls", F.col("copies").cast("int").alias("copies"), "columns")


#: Daily prices over six files, five of layouts that are known; each with lines that can't be used.
KIND = "CASE entity % 6 WHEN 0 THEN 'symbol_adjusted' WHEN 1 THEN 'title_case' WHEN 2 THEN 'bracketed' WHEN 3 THEN 'day_first' WHEN 4 THEN 'tabbed' END"


@register("s6_sniffed_folder", f"SELECT layout, CASE WHEN entity % 6 IN (1, 5) THEN NULL ELSE 'S' || entity END AS ticker, reason, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN CAST(round(close * 10000) AS BIGINT) END) AS BIGINT) AS total FROM (SELECT entity, close, {KIND} AS layout, CASE WHEN entity % 6 = 5 THEN 'unknown_layout:date' WHEN n % 5 = 4 THEN 'bad_date' WHEN n % 5 = 3 THEN 'bad_price' WHEN n % 5 = 2 THEN 'not_positive' WHEN entity % 6 = 1 AND row_number() OVER (PARTITION BY entity % 6, date, n % 5 < 2 ORDER BY entity) > 1 THEN 'repeated' END AS reason FROM px_d) GROUP BY 1, 2, 3", "")
def s6_sniffed(spark, sf):
    """One read of a folder of files of five layouts and one unknown; a day's rows of a layout are in one file."""
    at = scratch(spark, "mixed")
    px = once(panels.daily_prices(spark, sf).select("entity", "date", "close", "n"), "daily").withColumn("ticker", F.concat(F.lit(" s"), F.col("entity").cast("string")))
    bad = lambda c: F.when(F.col("n") % 5 == 3, "none").when(F.col("n") % 5 == 2, "-1").otherwise(c)
    close = F.col("close").cast("string")
    day = lambda pattern: F.when(F.col("n") % 5 == 4, "soon").otherwise(F.date_format("date", pattern))
    forms = {
        0: (",", {"Ticker": F.col("ticker"), "Date": day("yyyy-MM-dd"), "Close": bad(F.lit("7")), "Adjusted_Close": bad(close), "Volume": F.col("n").cast("string")}),
        1: (",", {"Date": day("yyyy-MM-dd"), "Close": bad(F.lit("7")), "Adj Close": bad(close)}),
        2: (",", {"<TICKER>": F.col("ticker"), "<PER>": F.lit("D"), "<DATE>": day("yyyyMMdd"), "<CLOSE>": bad(close), "<VOL>": F.col("n").cast("string")}),
        3: (";", {"Kurs": bad(F.translate(close, ".", ",")), "Datum": day("dd.MM.yyyy"), "Symbol": F.col("ticker")}),
        4: ("\t", {"Code": F.col("ticker"), "Trade Date": day("MM/dd/yyyy"), "Last": bad(close)}),
        5: (",", {"ticker": F.col("ticker"), "when": day("yyyy-MM-dd"), "Close": bad(close)}),
    }
    for kind, (sep, columns) in forms.items():
        rows = px.where(F.col("entity") % 6 == kind).repartitionByRange("date").sortWithinPartitions("date", "entity").select(*[c.alias(name) for name, c in columns.items()])
        rows.write.option("header", True).option("sep", sep).csv(f"{at}/kind={kind}")
    found = FI.sniffed_prices(spark, at)
    # Two files have no column for tickers; their names, which Spark makes up, stand for it.
    ticker = F.when(F.coalesce("layout", F.lit("")).isin("", "title_case"), None).otherwise(F.col("ticker"))
    return found.withColumn("ticker", ticker).groupBy("layout", "ticker", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("reason").isNull(), F.round(F.col("adj_close") * 10000).cast("long"))).alias("total"))


#: Events come in four files by day; one in 53 comes a file late. The stream stops after two files and is started again.
ARRIVED = "(SELECT event_id, ts, type, value, CAST(least(3, (date_diff('day', min(CAST(ts AS DATE)) OVER (), CAST(ts AS DATE)) * 4) // (date_diff('day', min(CAST(ts AS DATE)) OVER (), max(CAST(ts AS DATE)) OVER ()) + 1) + (event_id % 53 = 0)::INT) AS INT) AS chunk FROM evt)"
MARKED = f"(SELECT a.*, (SELECT max(ts) FROM {ARRIVED} b WHERE b.chunk < a.chunk) AS mark, (SELECT max(ts) FROM evt) AS last FROM {ARRIVED} a)"
LATE = "coalesce(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= mark - INTERVAL 1 DAY, false)"


def streamed(spark, sf):
    at = scratch(spark, "stream")
    e = panels.user_events(spark, sf)
    day = F.datediff(F.to_date("ts"), "first")
    ends = e.agg(F.min(F.to_date("ts")).alias("first"), (F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("days"))
    chunk = F.least(F.lit(3), F.floor(day * 4 / F.col("days")) + (F.col("event_id") % 53 == 0).cast("int")).cast("int")
    instant = F.timestamp_micros((F.unix_date(F.to_date("ts")).cast("long") * 86_400_000_000 + (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1_000_000 + F.extract(F.lit("SECOND"), F.col("ts")) * 1_000_000).cast("long"))
    rows = e.crossJoin(F.broadcast(ends)).select("event_id", instant.alias("ts"), "type", "value", chunk.alias("chunk"))
    for run in ((0, 1), (2, 3)):
        for k in run:
            rows.where(F.col("chunk") == k).drop("chunk").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = ingest.read_events(spark, f"{at}/in", rows.drop("chunk").schema, 1)
        ingest.bars_with_late(stream, f"{at}/out", "ts", "value", 86_400, 86_400, ["type"]).awaitTermination()
    return f"{at}/out"


@register("x2_closed_bars", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, type, arg_min(value, {{'a': ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {{'a': ts, 'b': event_id}}) AS close, count(*) AS n, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= any_value(last) - INTERVAL 1 DAY AS closed FROM {MARKED} WHERE NOT {LATE} GROUP BY CAST(ts AS DATE), type", "open high low close")
def x2_closed(spark, sf):
    """Daily bars of a stream that was stopped and started again; closed ones were appended and never written again."""
    day = F.date_from_unix_date((F.col("start") / 86400).cast("int")).cast("string")
    return ingest.read_bars(spark, streamed(spark, sf), ["type"]).select(day.alias("day"), "type", "open", "high", "low", "close", "n", "closed")


@register("x2_late_rows", f"SELECT event_id, type, value FROM {MARKED} WHERE {LATE}", "value")
def x2_late(spark, sf):
    """The rows that came after their day was closed."""
    return spark.read.parquet(f"{streamed(spark, sf)}/late").select("event_id", "type", "value")
