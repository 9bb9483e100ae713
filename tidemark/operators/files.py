"""Folders of files: inventories from Parquet footers, and price files whose layout is told by their header lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import finite
from tidemark.operators.storage import files_of

FOOTER = "file string, bytes bigint, rows bigint, row_groups int, columns string, first string, last string, nulls bigint, digest string"


def footers(date: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for frame in frames:
            out = []
            for file, size in zip(frame["file"], frame["bytes"], strict=True):
                uri = file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file
                store, path = fs.FileSystem.from_uri(uri)
                meta = pq.read_metadata(path, filesystem=store)
                schema = meta.schema.to_arrow_schema()
                digest, low, high, nulls = hashlib.sha256(), [], [], 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    digest.update(f"{group.num_rows}".encode())
                    for c in range(group.num_columns):
                        column = group.column(c)
                        stats = column.statistics if column.is_stats_set else None
                        ends = (stats.min, stats.max) if stats and stats.has_min_max else (None, None)
                        digest.update(f"{column.path_in_schema}:{column.num_values}:{column.total_uncompressed_size}:{ends}:{stats and stats.null_count}".encode())
                        if column.path_in_schema == date and stats:
                            nulls += stats.null_count or 0
                            if stats.has_min_max:
                                low.append(stats.min)
                                high.append(stats.max)
                columns = ", ".join(f"{f.name}: {f.type}" for f in schema)
                out.append((file, size, meta.num_rows, meta.num_row_groups, columns, str(min(low)) if low else None, str(max(high)) if high else None, nulls, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["file", "bytes", "rows", "row_groups", "columns", "first", "last", "nulls", "digest"])

    return run


def footer_inventory(spark: SparkSession, path: str, date: str, tasks: int | None = None) -> DataFrame:
    """``file, bytes, rows, row_groups, columns, first, last, nulls, digest, copies``: a row a Parquet file below ``path``.

    Read are footers alone: the file's list has no contents, and each task opens
    the ends of its files (by their addresses, through Arrow's file systems).
    ``first`` and ``last`` are the statistics of ``date``, null where a file has
    none. ``digest`` covers rows, sizes and statistics of all row groups;
    ``copies`` counts the files that have the same.
    """
    found = files_of(spark, path).repartition(tasks or spark.sparkContext.defaultParallelism, "file").mapInPandas(footers(date), FOOTER)
    return found.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("digest")))


#: Layouts of price files. Separator, pattern of dates, mark of decimals, and what the columns are that tell the layout; then columns that it may have.
LAYOUTS: dict[str, tuple[str, str, str, dict[str, str], dict[str, str]]] = {
    "symbol_adjusted": (",", "yyyy-MM-dd", ".", {"ticker": "ticker", "date": "date", "close": "close", "adjusted_close": "adj_close"}, {"volume": "volume", "open": "open", "high": "high", "low": "low"}),
    "title_case": (",", "yyyy-MM-dd", ".", {"date": "date", "close": "close", "adj close": "adj_close"}, {"volume": "volume", "open": "open", "high": "high", "low": "low"}),
    "bracketed": (",", "yyyyMMdd", ".", {"<ticker>": "ticker", "<date>": "date", "<close>": "close"}, {"<vol>": "volume", "<open>": "open", "<high>": "high", "<low>": "low"}),
    "day_first": (";", "dd.MM.yyyy", ",", {"symbol": "ticker", "datum": "date", "kurs": "close"}, {"stueck": "volume"}),
    "tabbed": ("\t", "MM/dd/yyyy", ".", {"code": "ticker", "trade date": "date", "last": "close"}, {"vol": "volume"}),
    "plain": (",", "yyyy-MM-dd", ".", {"date": "date", "close": "close"}, {"volume": "volume"}),
}
FIELDS = ["ticker", "date", "close", "adj_close", "volume"]


def cells(line: Column, separator: Column) -> Column:
    """The fields of a line, without blanks and quotes at their ends; a separator within quotes is part of a field."""
    parts = F.split(line, F.concat(F.lit("["), separator, F.lit('](?=(?:[^"]*"[^"]*")*[^"]*$)')))
    quoted = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', "")))
    plain = F.transform(F.split(line, F.concat(F.lit("["), separator, F.lit("]"))), lambda x: F.trim(x))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def layouts_of(headers: DataFrame, spark: SparkSession, layouts: dict | None = None) -> DataFrame:
    """``file, layout, missing, header, names, separator, pattern, decimal``: of the layouts whose telling columns a header has, the one with the most columns in it; else null, and what the closest one lacks."""
    rows = [(i, name, sep, pattern, mark, list(told), list({**told, **also}), list({**told, **also}.values())) for i, (name, (sep, pattern, mark, told, also)) in enumerate((layouts or LAYOUTS).items())]
    known = spark.createDataFrame(rows, "place int, layout string, separator string, pattern string, decimal string, told array<string>, columns array<string>, meanings array<string>")
    tried = headers.crossJoin(F.broadcast(known)).withColumn("have", cells(F.lower("header"), F.col("separator")))
    tried = tried.withColumns({"lacks": F.array_except("told", "have"), "held": F.size(F.array_intersect("columns", "have"))})
    fits = F.size("lacks") == 0
    best = tried.groupBy("file").agg(F.min(F.struct((~fits).alias("no"), F.when(fits, 0).otherwise(F.size("lacks")).alias("far"), (-F.col("held")).alias("few"), "place", "layout", "header", "have", "columns", "meanings", "lacks", "separator", "pattern", "decimal")).alias("b")).select("file", "b.*")
    names = F.transform("have", lambda h: F.element_at("meanings", F.nullif(F.array_position("columns", h), F.lit(0)).cast("int")))
    ok = ~F.col("no")
    return best.select("file", F.when(ok, F.col("layout")).alias("layout"), F.when(~ok, F.array_join("lacks", ",")).alias("missing"), "header", F.when(ok, names).alias("names"), "separator", "pattern", "decimal")


def sniffed_prices(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``file, layout, ticker, date, close, adj_close, volume, reason``: the lines of all price files below ``path``, whatever their layouts.

    All files are read at once as lines. The first line of each is gathered by
    file, compared with the table of layouts, and joined back. A file without a
    column for tickers has one in its name. ``reason`` says why a line isn't
    used: ``unknown_layout`` (with what the closest layout lacks),
    ``no_ticker``, ``bad_date``, ``bad_price``, ``not_positive`` or ``repeated``
    (a later line of the file with the same ticker and date), else null. Without
    a close the adjusted one holds, and the other way. Empty lines and headers
    are no rows; an empty file has none.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).where(F.trim("value") != "")
    headers = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "i").alias("header"))  # combined where the lines are
    named = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    told = layouts_of(headers, spark).withColumns({"_f": F.monotonically_increasing_id(), "_named": F.when(~F.coalesce(F.array_contains("names", "ticker"), F.lit(False)), named)})
    found = lines.join(F.broadcast(told), "file").where(F.col("value") != F.col("header"))  # a row a file
    # A generated column is built once a line; a projected one would be built anew wherever a later column or filter names it.
    once = lambda c: F.explode(F.array(c))
    parts = once(cells(F.col("value"), F.col("separator")))
    field = lambda name: F.nullif(F.try_element_at("_parts", F.nullif(F.array_position("names", F.lit(name)), F.lit(0)).cast("int")), F.lit(""))
    number = lambda c: finite(F.when(F.col("decimal") == ",", F.translate(F.regexp_replace(c, r"\.", ""), ",", ".")).otherwise(F.col(c)).try_cast("double"))
    # A pattern that is a column would be built anew for each line; no pattern has a date without a digit.
    dated = F.lit(None).cast("timestamp")
    for pattern in sorted({layout[1] for layout in LAYOUTS.values()}):
        dated = F.when((F.col("pattern") == pattern) & F.col("date").rlike("[0-9]"), F.try_to_timestamp("date", F.lit(pattern))).otherwise(dated)
    rows = found.withColumn("_parts", parts).withColumn("_v", once(F.struct(*[field(c).alias(c) for c in FIELDS]))).select("file", "_f", "layout", "missing", "pattern", "decimal", "at", "i", "_named", "_v.*")
    close, adjusted = number("close"), number("adj_close")
    rows = rows.select(
        "file", "_f", "layout", "missing", "at", "i", F.upper(F.coalesce("_named", "ticker")).alias("ticker"),
        F.to_date(dated).alias("date"), F.coalesce(close, adjusted).alias("close"), F.coalesce(adjusted, close).alias("adj_close"), number("volume").alias("volume"),
    )
    bad = (
        F.when(F.col("layout").isNull(), F.concat(F.lit("unknown_layout:"), "missing")).when(F.col("ticker").isNull(), "no_ticker").when(F.col("date").isNull(), "bad_date")
        .when(F.col("adj_close").isNull(), "bad_price").when(F.col("adj_close") <= 0, "not_positive")
    )
    # Lines that can't be used are no one's repetition: each is a group of its own.
    rows = rows.withColumn("_bad", once(bad)).withColumn("_alone", F.when(F.col("_bad").isNotNull(), F.col("i")))
    again = F.row_number().over(Window.partitionBy("_f", "ticker", "date", "_alone").orderBy("at", "i")) > 1
    return rows.withColumn("reason", F.coalesce("_bad", F.when(again, "repeated"))).select("file", "layout", *FIELDS, "reason")
