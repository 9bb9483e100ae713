"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """New files of a folder as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; state is held for the delay only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bars(stream: DataFrame, time: str, value: str, width: str, delay: str | None, *by: str) -> DataFrame:
    """Bars of a window of time by key: first, last, extremes and count; rows later than the delay are dropped, none without."""
    late = stream.withWatermark(time, delay) if delay else stream
    order = F.struct(F.col(time), F.col("event_id"))
    out = late.groupBy(F.window(time, width), *by).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "open", "high", "low", "close", "n")


def upsert_into(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch through ``publish``; what is there at the start is worked off, then it stops."""
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def contract(old: DataFrame, new: DataFrame, entity: str, t: str, cutoff) -> DataFrame:
    """One row of what forbids publishing ``new`` over ``old``: not reaching the cutoff, rows after it, lost entities or sessions."""
    ends = new.agg(F.max(t).alias("last"), F.sum((F.col(t) > cutoff).cast("int")).alias("after_cutoff"))
    lost = old.select(entity).distinct().join(new.select(entity).distinct(), entity, "left_anti").agg(F.count(F.lit(1)).alias("lost_entities"))
    days = old.select(t).distinct().join(new.select(t).distinct(), t, "left_anti").agg(F.count(F.lit(1)).alias("lost_sessions"))
    out = ends.crossJoin(lost).crossJoin(days)
    return out.withColumn("ok", (F.col("last") == cutoff) & (F.col("after_cutoff") == 0) & (F.col("lost_entities") == 0) & (F.col("lost_sessions") == 0))


def bars_with_late(stream: DataFrame, path: str, time: str, value: str, width: int, delay: int, by: list[str], order: str = "event_id", files: int | None = None) -> StreamingQuery:
    """Bars of ``width`` seconds by key, appended once their window has ended ``delay`` seconds before the latest event; late rows go to a table of their own.

    Below ``path`` each batch writes ``late`` (rows whose window was closed
    before the batch came), ``bars`` (``closed=true``: final, never written
    again; ``closed=false``: sums of the windows still open) and its ``mark``
    (the latest event so far), each in a folder of the batch's number. It reads
    the open sums and the mark of the batch before, and nothing else, so what is
    held is bounded by the windows within the delay. A batch that runs again
    writes the same. A query started again goes on from its checkpoint and those
    tables. What is there at the start is worked off, then it stops.
    """
    from tidemark.operators.storage import delete, exists

    start = F.floor(F.unix_micros(time) / (width * 1_000_000)) * width
    at = lambda table, n: f"{path}/{table}/batch={n}"

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(at("mark", n - 1)).first()["mark"] if n and exists(spark, at("mark", n - 1)) else None
        rows = batch.withColumn("start", start)
        closed = lambda mark: F.lit(False) if mark is None else F.col("start") + width <= F.lit(mark / 1e6 - delay)
        rows.where(closed(before)).drop("start").write.mode("overwrite").parquet(at("late", n))
        fresh = rows.where(~closed(before))
        stamp = F.struct(F.col(time).alias("ts"), F.col(order).alias("o"), F.col(value).alias("v"))
        sums = fresh.groupBy("start", *by).agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"), F.max(value).alias("high"), F.min(value).alias("low"), F.count(F.lit(1)).alias("n"))
        if n and exists(spark, f"{at('bars', n - 1)}/closed=false"):
            held = spark.read.parquet(f"{at('bars', n - 1)}/closed=false").select(*sums.columns)
            sums = sums.unionByName(held).groupBy("start", *by).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"))
        latest = batch.agg(F.max(F.unix_micros(time))).first()[0]
        mark = max(x for x in (before, latest) if x is not None) if before is not None or latest is not None else None
        sums.withColumn("closed", closed(mark)).write.mode("overwrite").partitionBy("closed").parquet(at("bars", n))
        spark.createDataFrame([(mark,)], "mark bigint").coalesce(1).write.mode("overwrite").parquet(at("mark", n))
        if n > 1 and exists(spark, f"{at('bars', n - 2)}/closed=false"):
            delete(spark, f"{at('bars', n - 2)}/closed=false")  # the batch before may still run again

    return upsert_into(stream, step, f"{path}/checkpoint")


def read_bars(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """``start, <by>, open, high, low, close, n, closed``: all closed bars, and those still open as the last batch left them."""
    rows = spark.read.option("basePath", f"{path}/bars").parquet(f"{path}/bars").withColumn("closed", F.col("closed").cast("boolean"))
    last = rows.agg(F.max("batch").alias("_last"))
    rows = rows.join(F.broadcast(last), F.col("closed") | (F.col("batch") == F.col("_last")))
    return rows.select("start", *by, F.col("first.v").alias("open"), "high", "low", F.col("last.v").alias("close"), "n", "closed")
