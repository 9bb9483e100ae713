"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, broadcast_within, materialize, table, text_of

#: Most sources that are broadcast as a table of totals; beyond that Spark picks the join.
BROADCAST_SOURCES = 10_000
#: Hexadecimal digits of the seeded hash that one selection level settles.
DIGITS = 2
LEVELS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: weights repeat over the sources by code point, null last.

    Sources share the total of all sizes by weight. A target stops at
    ``max_epochs`` times its source's size; the excess is shared again by
    weight among the others until none is above. In ascending order of cap per
    weight a source is clamped exactly if its cap is at most its share of what
    the sources before it leave, so one pass over the table of sources finds
    the fixed point of clamping and resharing.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, rising = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table_ = totals.select("*", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("long").alias("weight"))
    table_ = table_.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    table_ = table_.withColumn("total", F.sum("source_size").over(every)).withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table_ = table_.withColumn("left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    table_ = table_.withColumn("clamped", F.col("cap") * F.col("left") <= F.col("weight") * (F.col("total") - F.col("before")))
    spent, free = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every), F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(every)
    table_ = table_.withColumn("spent", spent).withColumn("free", free)
    share = F.try_divide((F.col("weight") * (F.col("total") - F.col("spent"))).cast("double"), F.col("free").cast("double"))
    return table_.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, repeats``.

    ``size`` is the number of words (null text: 0). Every document is taken the
    whole number of epochs its source's target asks for, and once more if it
    ends within the rest of the target when the source's documents are laid out
    by a seeded hash of their id (ties by id, size and a hash of the text).
    What is then still missing is met by the one document left that comes
    nearest to it. So a source's taken words differ from its target by less
    than half of the document in which the rest ends, and mostly by far less.

    The point on that layout is found by selection, two digits of the hash at a
    time: sums by source and digit, then only the documents of the one cell
    that holds the point. No source is ordered whole. Rows that are equal in
    all of these are alike: which of them is taken makes no difference. A very
    long text is read whole, for its size alone. Empty sources have target 0; a
    null source is a source; an empty table gives no rows. Other columns are
    ignored, whatever their names, or travel in a struct column named
    ``carry``: the plan's rows, one a source, are joined to the documents where
    those are read.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    size = F.size(F.regexp_extract_all(text_of(text_col), F.lit(WORD), F.lit(0))).cast("long")
    carried = [] if carry is None else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)]
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), digest.alias("h"), F.xxhash64(text_of(text_col)).alias("x")]
    rows = materialize(docs.select(*columns), "sizes")
    plan = materialize(source_targets(rows, weights, max_epochs), "targets")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("cell", F.lit("")).withColumn("base", F.lit(0).cast("long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    for level in range(1, LEVELS + 1):
        small = broadcast_within(plan, BROADCAST_SOURCES)
        inside = rows.join(small, same(rows, small)).where(F.col("h").startswith(F.col("cell")))
        sums = inside.groupBy(rows["source"], F.substring("h", 1, DIGITS * level).alias("next")).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("next"))
        ends = sums.withColumn("end", upto).withColumn("start", F.col("end") - F.col("s"))
        ends, plan_ = ends.alias("e"), plan.alias("p")
        hit = ends.join(plan_, F.col("e.source").eqNullSafe(F.col("p.source"))).where("p.base + e.start < p.rest and p.rest < p.base + e.end")
        hit = hit.select(F.col("e.source").alias("at"), F.col("e.next").alias("next"), (F.col("p.base") + F.col("e.start")).alias("start"))
        # Where no cell holds the point, it lies at the edge of one: cells before it are in, the rest is out.
        edge = ends.join(plan_, F.col("e.source").eqNullSafe(F.col("p.source"))).where("p.base + e.end <= p.rest").groupBy(F.col("e.source").alias("at")).agg(F.max("e.next").alias("last"))
        plan = plan.join(hit, plan["source"].eqNullSafe(hit["at"]), "left").drop("at").join(edge, plan["source"].eqNullSafe(edge["at"]), "left").drop("at")
        done = F.col("cell").startswith("=")
        found = F.when(done, F.col("cell")).when(F.col("next").isNotNull(), F.col("next")).otherwise(F.concat(F.lit("="), F.coalesce("last", F.col("cell"))))
        plan = plan.select("source", "source_size", "target", "epochs", "rest", found.alias("cell"), F.when(done | F.col("next").isNull(), F.col("base")).otherwise(F.col("start")).alias("base"))
        plan = materialize(plan, f"cells{level}")
    placed = _placed(rows, plan)
    # What the open cell adds before the point; the document that comes nearest to what is then missing.
    added = placed.where("side = 0").groupBy("source").agg(F.sum(F.when(F.col("within"), F.col("size")).otherwise(0)).alias("added"))
    gap = F.col("rest") - F.col("base") - F.coalesce("added", F.lit(0))
    gaps = plan.where(~F.col("cell").startswith("=")).join(added.withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at")), "left")
    gaps = gaps.select(F.col("source").alias("at"), gap.alias("gap")).where("gap > 0")
    left = placed.where(~F.col("within")).select("source", "size", "h", "doc_id", "x")
    left = left.join(broadcast_within(materialize(gaps, "gaps"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("at"))).where("size < 2 * gap and size > 0")
    nearest = left.groupBy("at").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "doc_id", "size", "x")).alias("k"))
    nearest = materialize(nearest.select(F.col("at").alias("n_source"), F.col("k.h").alias("n_h"), F.col("k.doc_id").alias("n_id"), F.col("k.size").alias("n_size"), F.col("k.x").alias("n_x")), "nearest")
    base = rows if carry is None else docs.select(*columns, *carried)
    placed = _placed(base, plan)
    key = F.col("source").eqNullSafe(F.col("n_source")) & (F.col("h") == F.col("n_h")) & F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("size") == F.col("n_size")) & (F.col("x") == F.col("n_x"))
    placed = placed.join(broadcast_within(nearest, BROADCAST_SOURCES), key, "left")
    # Of rows that are equal in all of these one is taken.
    chosen = F.col("n_h").isNotNull() & ~F.col("within")
    first = F.row_number().over(Window.partitionBy("source", "h", "doc_id", "size", "x").orderBy(F.lit(1)))
    extra = placed.where(~chosen).withColumn("extra", F.col("within").cast("int")).unionByName(placed.where(chosen).withColumn("extra", (first == 1).cast("int")))
    return extra.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0)).cast("int").alias("repeats"), *([carry] if carry else []))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan, ``side`` of the open cell, and whether they end within the rest of the target."""
    small = broadcast_within(plan.withColumnRenamed("source", "of"), BROADCAST_SOURCES)
    placed = rows.join(small, rows["source"].eqNullSafe(small["of"])).drop("of")
    exact, cell = F.col("cell").startswith("="), F.regexp_replace("cell", "^=", "")
    head = F.substring(F.col("h"), F.lit(1), F.length(cell))
    placed = placed.withColumn("side", F.when(head < cell, -1).when(head > cell, 1).when(exact & (cell != ""), -1).when(exact, 1).otherwise(0))
    settled = placed.where("side <> 0").withColumn("within", F.col("side") < 0)
    order = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size", "x").rowsBetween(Window.unboundedPreceding, 0)
    return settled.unionByName(placed.where("side = 0").withColumn("within", F.col("base") + F.sum("size").over(order) <= F.col("rest")))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w
  FROM d GROUP BY source
), a AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s
), b AS (SELECT *, cap * open <= w * (total - before) AS clamped FROM a),
c AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (total - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) AS DOUBLE) / CAST(nullif(sum(CASE WHEN clamped THEN 0 ELSE w END) OVER (), 0) AS DOUBLE) END AS target
  FROM b
), e AS (
  SELECT d.doc_id, d.source, d.h, d.size, c.source_size, c.target, coalesce(floor(c.target / nullif(c.source_size, 0)), 0) AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), f AS (SELECT *, target - epochs * source_size AS rest, target - epochs * source_size > 0 AND upto <= target - epochs * source_size AS within FROM e),
g AS (SELECT *, rest - coalesce(sum(CASE WHEN within THEN size END) OVER (PARTITION BY source), 0) AS gap FROM f),
i AS (
  SELECT *, NOT within AND size > 0 AND gap > 0 AND size < 2 * gap AS open FROM g
), j AS (
  SELECT *, open AND row_number() OVER (PARTITION BY source, open ORDER BY abs(size - gap), h, doc_id, size) = 1 AS nearest FROM i
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN within OR nearest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j
"""
