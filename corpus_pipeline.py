"""A corpus pipeline of five stages: quality rules, exact dedup, near dedup, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. Rows are known by ``doc_id``, and get
a key of their own where one is null or comes twice, so one row of equal ones
stays. No stage shuffles texts to apply its verdict: quality and mixing judge
rows where they are read, the dedup stages leave out the ids that they drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import broadcast_within, delete, materialize, scratch
from tidemark.llm.bpe import encode, vocabulary
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.quality import quality

#: Ids of dropped documents that are broadcast at most; beyond that Spark joins by a shuffle.
BROADCAST_DROPPED = 2_000_000
KEY = "_pipeline_key"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, and a column of them that tells all rows apart: ``doc_id`` unless that is null or repeated somewhere."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    return materialize(docs.withColumn(KEY, F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "keyed"), KEY


def _kept(docs: DataFrame, key: str, verdict: DataFrame) -> DataFrame:
    """The documents that a verdict doesn't drop. Only ids of dropped ones are joined."""
    dropped = materialize(verdict.where("not kept").select(F.col("doc_id").alias("_dropped")), "dropped")
    return docs.join(broadcast_within(dropped, BROADCAST_DROPPED), F.col(key) == F.col("_dropped"), "left_anti").drop(KEY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's histograms, judged where they are read."""
    return quality(docs, carry="row").where("kept").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    docs, key = _keyed(docs)
    return _kept(docs, key, exact_dedup(docs, id_col=key))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: shingles of five words, similarity of 0.8 or more."""
    docs, key = _keyed(docs)
    return _kept(docs, key, near_duplicates(docs, id_col=key))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    mixed = mix(docs, carry="row").where("repeats > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded_sha256`` of every row: its tokens, and the digest of what they decode to."""
    path, pattern = vocabulary()
    encoded = encode(docs, path, pattern, offsets=False, decoded=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicate_groups),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: Signatures, seeded draws and byte-pair merges can't be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again for the next, which is then the last to need it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
