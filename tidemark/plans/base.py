"""Registry of queries with their SQL, and the panels that both read."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.operators import windows as W
from tidemark.sources import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 9

#: The panels in SQL; only those that a query names are computed.
PRELUDE = """
WITH px_m AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS t,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close,
         CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS dvol, count(*) AS n
  FROM lineitem GROUP BY ALL
), px_d AS (
  SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close,
         CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS dvol, count(*) AS n
  FROM lineitem GROUP BY ALL
), bench AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS t,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS bench
  FROM lineitem GROUP BY ALL
), bars AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS t,
         arg_min(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice, 'e': l_quantity}) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice, 'e': l_quantity}) AS close
  FROM lineitem GROUP BY ALL
), sec AS (
  SELECT s_suppkey AS entity, n_regionkey AS sector FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
), facts AS (
  SELECT o_custkey AS entity, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value,
         CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) + 45 AS DATE) AS available_date
  FROM orders GROUP BY ALL
), evt AS (
  SELECT event_id, user_id AS entity, ts, event_type AS type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
), s0 AS (
  SELECT p.entity, p.t, p.close, p.dvol, p.n, sector,
         max(close) OVER (e RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS c1, max(close) OVER (e RANGE BETWEEN 6 PRECEDING AND 6 PRECEDING) AS c6,
         max(close) OVER (e RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS c3,
         max(close) OVER (e RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS f1
  FROM px_m p LEFT JOIN sec USING (entity) WINDOW e AS (PARTITION BY p.entity ORDER BY p.t)
), sig AS (
  SELECT entity, t, close, dvol, n, sector, close / c1 - 1 AS ret, c1 / c6 - 1 AS mom, -(close / c1 - 1) AS rev, -(close / c3 - 1) AS rev3, f1 / close - 1 AS fwd, n >= 3 AS member FROM s0
), ok AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS names FROM sig WHERE member AND mom IS NOT NULL AND fwd IS NOT NULL
), el AS (SELECT * FROM ok WHERE names >= 5),
rk AS (
  SELECT *, rank() OVER (PARTITION BY t ORDER BY mom) + (count(*) OVER (PARTITION BY t, mom) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY t ORDER BY fwd) + (count(*) OVER (PARTITION BY t, fwd) - 1) / 2.0 AS ry,
         row_number() OVER (PARTITION BY t ORDER BY mom, entity) AS ox, row_number() OVER (PARTITION BY t ORDER BY fwd, entity) AS oy FROM el
), ic AS (
  SELECT t, count(*) AS names, round(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0), 12) AS ic FROM rk GROUP BY t
), legs AS (
  SELECT *, CASE WHEN ox > names - greatest(1, names // 5) THEN 1 WHEN ox <= greatest(1, names // 5) THEN -1 END AS side FROM rk
), book AS (SELECT t, entity, side, fwd, sector FROM legs WHERE side IS NOT NULL),
tx AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM book)),
held AS (SELECT b.*, i FROM book b JOIN tx USING (t)),
turn AS (
  SELECT h.t, h.i, count(*) FILTER (h.side = 1 AND p.entity IS NULL) / CAST(count(*) FILTER (h.side = 1) AS DOUBLE) AS tl,
         count(*) FILTER (h.side = -1 AND p.entity IS NULL) / CAST(count(*) FILTER (h.side = -1) AS DOUBLE) AS ts
  FROM held h LEFT JOIN held p ON p.i = h.i - 1 AND p.entity = h.entity AND p.side = h.side GROUP BY h.t, h.i
), stream AS (
  SELECT b.t, i, avg(fwd) FILTER (side = 1) - avg(fwd) FILTER (side = -1) AS gross, CASE WHEN i = 1 THEN 1.0 ELSE (any_value(tl) + any_value(ts)) / 2 END AS turnover
  FROM book b JOIN turn USING (t) GROUP BY b.t, i
)
"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zeros: sums differ in the last bits by the order of rows."""
    return df.select(*[(F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def register(name: str, sql: str | None = None, doubles: str = ""):
    """Registers a query, and the SQL of its rows; ``doubles`` names the columns that are rounded."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            names = doubles.split()
            replaced = f" REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}' for c in names)})" if names else ""
            SQL[name] = f"{PRELUDE}SELECT *{replaced} FROM ({sql})"
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, where several passes follow that would each build it anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.monthly_prices(spark, sf_dir).withColumnRenamed("month_idx", "t")


def benched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with the benchmark of the month: one row a month, so its broadcast is bounded by the calendar."""
    bench = panels.benchmark(spark, sf_dir).withColumnRenamed("month_idx", "t")
    return prices(spark, sf_dir).join(F.broadcast(bench), "t")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, t, close, dvol, n, sector, ret, mom, rev, rev3, fwd, member``."""
    px = prices(spark, sf_dir).join(panels.sectors(spark, sf_dir), "entity", "left")
    back = lambda k: W.lag_exact("close", k)
    return px.withColumns({"ret": ratio("close", back(1)) - 1, "mom": ratio(back(1), back(6)) - 1, "rev": -(ratio("close", back(1)) - 1), "rev3": -(ratio("close", back(3)) - 1), "fwd": ratio(back(-1), "close") - 1, "member": F.col("n") >= 3})


def eligible(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """Members with signal and forward return, in months with enough names."""
    from tidemark.operators.cross import with_names

    ok = signals(spark, sf_dir).where(F.col("member") & F.col("mom").isNotNull() & F.col("fwd").isNotNull())
    return with_names(ok, "t", least)


def returns_with_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, t, close, bench, dvol, ret, bret``."""
    return benched(spark, sf_dir).withColumns({"ret": W.trailing_return("close", 1), "bret": W.trailing_return("bench", 1)})
