"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has 72 symbols of 8 bits, each from one minimum over a document's
shingles. It is split into 12 chunks of 6 symbols. By pigeonhole two signatures
that differ in at most 23 symbols have a chunk with at most one error; a key
for each chunk and each place that may be wrong holds the five other symbols,
so all pairs under that distance meet in a bucket. (A pair of similarity 0.8
that is farther apart meets nearly always too: it misses with odds below 1e-5.)
Links are confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, broadcast_within, discard, join_counted, lower_ascii, materialize, table, text_of, words_of
from .components import components

CHUNKS, SYMBOLS = 12, 6
WIDTH, PERCENT = 5, 80
SEED = 20_240_229


def constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of all words as one run if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    by = constants(width, SEED)
    short = n < width
    runs = 1 if short else n - width + 1
    total = np.zeros(runs, np.uint64)
    for j in range(min(n, width)):
        total += hashes[j : j + runs] * by[j]
    return np.unique(mix(total + np.uint64(n if short else 0)))


def signature(found: np.ndarray) -> bytes:
    """One symbol for each multiplier: eight bits of the least product."""
    least = np.full(CHUNKS * SYMBOLS, np.iinfo(np.uint64).max)
    by, plus = constants(CHUNKS * SYMBOLS, SEED + 1), constants(CHUNKS * SYMBOLS, SEED + 2)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048]
        least = np.minimum(least, (part[:, None] * by + plus).min(0))
    return (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a batch as unsigned arrays."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(words_of(lower_ascii(text_of(text_col))), lambda w: F.xxhash64(w)).alias("h"))


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, node, signature``; equal sets have the same node. Without words: no node."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signs = [], [], []
            for hashes in lists(batch.column(1)):
                found = shingles(hashes, width)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "node", "signature"])

    return word_hashes(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint, signature binary")


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """``key, node, n`` of ``node, signature, n``: a key for each chunk and place left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                signs = np.array([np.frombuffer(s.as_py(), np.uint8) for s in part.column(1)]).astype(np.int64).reshape(-1, CHUNKS, SYMBOLS)
                keys = np.empty((len(signs), CHUNKS, SYMBOLS), np.int64)
                for out in range(SYMBOLS):
                    kept = [s for s in range(SYMBOLS) if s != out]
                    keys[:, :, out] = sum(signs[:, :, s] << (8 * i) for i, s in enumerate(kept)) | ((np.arange(CHUNKS) * SYMBOLS + out) << 40)
                each = np.repeat(np.arange(len(signs)), CHUNKS * SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(each)), part.column(2).take(pa.array(each))], ["key", "node", "n"])

    return nodes.select("node", "signature", "n").mapInArrow(run, "key bigint, node bigint, n bigint")


def full_sets(docs: DataFrame, chosen: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` of the nodes in ``chosen`` (``doc_id, node``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [shingles(h, width) for h in lists(batch.column(0).slice(at, 200))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "shingles"])

    chosen = broadcast_within(chosen.select(F.col("doc_id").alias("of")), BROADCAST_ROWS)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    some = some.join(chosen, F.col("id").eqNullSafe(F.col("of")), "left_semi")
    return word_hashes(some, "id", "t").where(F.size("h") > 0).select("h").mapInArrow(run, "node bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` pairs whose sets share enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("s"))
    return both.where(100 * F.col("s") >= percent * (F.col("p") + F.col("q") - F.col("s"))).select("a", "b")


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of ``node, comp, n`` rows of different components that may share enough.

    Sets that share ``percent`` of their union have more than a bounded number
    of shingles in common, so they share one among the first few of either in
    any fixed order (the prefix filter). In order of how many sets hold them,
    shingles of a single set come first; a set with enough of those is in no
    pair. The first shingle that a pair shares also bounds what they share by
    what comes after it in either (the positional filter).
    """
    shingle = sets.join(nodes, "node").select("node", "comp", "n", F.explode("shingles").alias("s"))
    shared = materialize(shingle.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    ordered = shingle.join(shared, "s").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("l"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("l"))
    rows = ordered.where(first > 0).select("node", "comp", "n", F.size("l").alias("c"), F.posexplode(F.slice("l", F.lit(1), first.cast("int"))["s"]).alias("i", "s"))
    # ``after``: how many shingles from this one on.
    rows = materialize(rows.select("s", "node", "comp", "n", (F.col("c") - F.col("i")).alias("after")), "first")
    # Shingles of one component pair nothing; they are known from a minimum and a maximum, combined before the shuffle.
    several = rows.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("s")
    rows = materialize(rows.join(several, "s", "left_semi"), "several")
    other = rows.select("s", F.col("node").alias("h"), F.col("comp").alias("hcomp"), F.col("n").alias("hn"), F.col("after").alias("hafter"))
    enough = (100 + percent) * F.least("after", "hafter") >= percent * (F.col("n") + F.col("hn"))
    return rows.join(other, "s").where((F.col("node") < F.col("h")) & (F.col("comp") != F.col("hcomp")) & enough).select(F.col("node").alias("a"), F.col("h").alias("b")).distinct()


def linked(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, comp`` over the links among ``key, node, n`` rows, n being the set's size.

    Only links between nodes that aren't connected yet matter, so no bucket
    makes all its pairs. First every bucket tries one member, by a seeded hash,
    against the others. Nodes of buckets that then still hold several
    components are paired by their rarest shingles, which finds every link
    among them.
    """
    like = 100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")
    hubs = rows.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "key")).alias("hub"))
    hubs = materialize(hubs.select("key", F.col("hub.node").alias("h"), F.col("hub.n").alias("hn")), "hubs")
    stars = rows.join(hubs, "key").where((F.col("node") != F.col("h")) & like).select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()
    edges = materialize(confirmed(materialize(stars, "pairs"), sets, percent), "links")
    labels = components(edges)
    known = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = materialize(known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "mixed")
    live = materialize(known.join(mixed, "key").select("node", "comp", "n").distinct(), "live")
    pairs = materialize(rare_pairs(live, sets, percent), "pairs")
    more = materialize(confirmed(pairs, sets, percent), "links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``width``-word shingles (words lower-cased A-Z)
    share ``percent`` of their union are linked; a component's id is its
    smallest document id. A text with fewer words is one shingle; one without
    words, or null, has none, and is linked with nothing. A very long text is
    one set, made whole by one task. Equal sets are one node, so copies make no
    pairs. Sets hold 64-bit hashes. Rows that repeat are copies; a null id
    never names a component that has another, and is kept where it has none.
    An empty table gives no rows; other columns are ignored.
    """
    prints = materialize(signatures(docs, width, id_col, text_col), "signatures")
    nodes = materialize(prints.where("n_shingles > 0").groupBy("node").agg(F.min("signature").alias("signature"), F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "nodes")
    keys = chunk_keys(nodes)
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
    rows = materialize(keys.join(shared, "key").select("key", "node", "n"), "rows")
    chosen = materialize(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("doc_id", "node"), "chosen")
    sets = full_sets(docs, chosen, width, id_col, text_col)
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    labels = linked(rows, sets, percent)
    # A node knows its component's name, and a document its node's: neither a node of many copies nor a large component is a hot task.
    labelled = materialize(nodes.join(labels, "node", "left").select("node", "copies", "doc_id", F.coalesce("comp", "node").alias("comp")), "labelled")
    names = materialize(labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    total, texts = labelled.count(), prints.where("n_shingles > 0").count()
    named = materialize(join_counted(labelled.select("node", "copies", "comp"), names, "comp", "members", total).select("node", "copies", "component_id"), "named")
    discard(nodes, shared, rows, chosen, sets, labelled, names)
    out = join_counted(prints.select("doc_id", "n_shingles", "node"), named, "node", "copies", texts)
    out = out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
