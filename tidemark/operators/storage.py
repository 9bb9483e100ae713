"""Upserts of stored tables that rewrite only the partitions which they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes`` of a table's data files; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def placed(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """``df`` with its partition columns (name: SQL expression of the row)."""
    return df.withColumns({name: F.expr(e) for name, e in parts.items()})


def store(df: DataFrame, path: str, parts: dict[str, str]) -> None:
    """Writes a new table, a folder a value of ``parts`` (name: SQL expression of the row)."""
    placed(df, parts).repartition(*parts).write.partitionBy(*parts).parquet(path)


def _replace(spark: SparkSession, path: str, journal: str, parts: list[str]) -> None:
    """Puts the journal's partitions in the place of the table's; those that it names without rows are emptied."""
    rows, touched = spark.read.parquet(f"{journal}/rows"), spark.read.parquet(f"{journal}/touched")
    empty = touched.join(rows.select(*parts).distinct(), parts, "left_anti").collect()  # partitions, not rows
    rows.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for r in empty:
        delete(spark, "/".join([path, *[f"{c}={r[c]}" for c in parts]]))
    delete(spark, journal)


def recover(spark: SparkSession, path: str, parts: list[str]) -> bool:
    """Finishes an upsert that was broken off while it replaced partitions; whether there was one. Before that point the table is as it was."""
    journal = f"{path.rstrip('/')}-journal"
    if exists(spark, f"{journal}/ready/_SUCCESS"):
        _replace(spark, path, journal, parts)
        return True
    if exists(spark, journal):
        delete(spark, journal)
    return False


def upsert_range(spark: SparkSession, path: str, block: DataFrame, entity: str, t: str, parts: dict[str, str]) -> DataFrame:
    """Each entity's stored rows in the block's span are replaced by the block; returns the partitions that were touched.

    Only partitions that hold such rows, or get some, are read and written, by
    dynamic overwrite; the files of all others stay. What they will hold is
    written to a journal beside the table first, so a run that is broken off is
    finished by the next, and running again changes nothing. ``parts`` are
    SQL expressions of the row; of a block's rows with one key one counts.
    """
    names, journal = list(parts), f"{path.rstrip('/')}-journal"
    recover(spark, path, names)
    table = spark.read.parquet(path)
    placed(block.dropDuplicates([entity, t]), parts).write.parquet(f"{journal}/block")
    block = spark.read.parquet(f"{journal}/block").select(*table.columns)
    spans = block.groupBy(entity).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    inside = F.col("_a").isNotNull() & F.col(t).between(F.col("_a"), F.col("_b"))
    hit = table.select(*names, entity, t).join(spans, entity).where(inside).select(*names)
    hit.unionByName(block.select(*names)).distinct().write.parquet(f"{journal}/touched")
    touched = spark.read.parquet(f"{journal}/touched").select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in names])
    # The few touched partitions prune the scan; they are as many as folders at most.
    rest = table.join(F.broadcast(touched), names, "left_semi").join(spans, entity, "left").where(~inside).select(*table.columns)
    rest.unionByName(block).write.parquet(f"{journal}/rows")
    out = spark.createDataFrame(touched.collect(), touched.schema)
    touched.limit(0).write.parquet(f"{journal}/ready")
    _replace(spark, path, journal, names)
    return out


def insert_absent(spark: SparkSession, path: str, block: DataFrame, keys: list[str], parts: dict[str, str]) -> None:
    """Appends the block's rows of new keys; no stored file changes, and running again appends nothing. ``parts`` are SQL expressions of the keys, so only the block's partitions are looked into."""
    names = list(parts)
    table = spark.read.parquet(path)
    block = placed(block.dropDuplicates(keys), parts)
    where = block.select(*names).distinct()
    known = table.select(*{*names, *keys}).join(F.broadcast(where), names, "left_semi").select(*keys)
    block.join(known, keys, "left_anti").select(*table.columns).repartition(*names).write.mode("append").partitionBy(*names).parquet(path)
