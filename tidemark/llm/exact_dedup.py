"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Rows that share their length with no other row, or their prefix with no other
row of that length, are settled without a hash of the whole text. Only the
texts of surviving groups are hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, discard, join_counted, lower_ascii, materialize, table, text_of

PREFIX_CHARS = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z; a null text is the
    empty text. The largest id of a group stays. Rows that repeat an id count
    each in ``group_size`` and share one verdict; an id that is null loses to
    any other, and stays where its group has no other. A very long text is read
    once for its length and prefix, and hashed once if its prefix comes again.
    An empty table gives no rows. Other columns are ignored, whatever their
    names. With ``digest_col`` each row has the SHA-256 of its lower-cased text
    in a column of that name, so then every text is hashed, once.

    Rows are a length and a prefix hash from the first reading on, and those of
    groups that survive have a digest; no text is shuffled. Lengths and
    prefixes are counted with map-side combine, and a digest that many rows
    share is joined where the rows are.
    """
    text = text_of(text_col)
    # Lower-casing A-Z leaves the length as it is. The key of a prefix holds the length too.
    n, p = F.octet_length(text).alias("n"), F.xxhash64(F.octet_length(text), lower_ascii(F.substring(text, 1, prefix_chars))).alias("p")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), p)
    keyed = materialize(docs.select(F.col(id_col).alias("doc_id"), n, p), "keyed")
    repeated = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key)
    lengths = materialize(repeated(keyed, "n"), "lengths")
    prefixes = materialize(repeated(keyed.join(lengths, "n", "left_semi"), "p"), "prefixes")
    digest = F.unhex(F.sha2(lower_ascii(F.col("t")), 256)).alias("h")
    few = prefixes.count() <= BROADCAST_ROWS
    if few and digest_col is None:
        hashed = materialize(rows.join(F.broadcast(prefixes), "p", "left_semi").select("doc_id", digest), "hashed")
        single = keyed.join(F.broadcast(prefixes), "p", "left_anti").select("doc_id")
    else:
        # So many prefixes, or all digests asked for: each text is hashed where it is read, and only digests are shuffled.
        all_ = materialize(rows.select("doc_id", "p", digest), "digests")
        hint = F.broadcast(prefixes) if few else prefixes
        hashed, single = all_.join(hint, "p", "left_semi").select("doc_id", "h"), all_.join(hint, "p", "left_anti").select("doc_id", "h")
    groups = hashed.groupBy("h").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    shown = lambda: [] if digest_col is None else [F.lower(F.hex("h")).alias(digest_col)]
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *shown())
    survivors = join_counted(hashed, groups, "h", "group_size", total)
    survivors = survivors.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), *shown())
    discard(lengths)
    return survivors.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
