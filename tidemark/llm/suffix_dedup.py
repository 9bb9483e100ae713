"""Repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix is sorted only through its first ``depth`` bytes, its window, by
passes over digits, and a pass keeps only suffixes whose group has others. The
groups that are left after the last pass are exactly the repeated windows.

The first digit is chosen by content: the 64-byte string of the window with the
least hash, the leftmost of equal ones. Equal windows have equal first digits
at equal places, and neighbouring windows nearly always share theirs, so one
row stands for a run of about 170 suffixes. The next pass tells runs that are
equal throughout. What is left is divided by the digit's place in the window
into blocks of 64, then of 8, then single suffixes: a block whose common bytes
stand nowhere else is done, one that is equal throughout elsewhere is repeated,
any other is divided by the next pass. Of each group of equal runs or blocks
one goes on as a witness for those that equal only a part of it.

A text's symbols are its bytes, or 64-bit hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ._common import BROADCAST_ROWS, broadcast_within, bytes_of, discard, materialize, table, text_of, word_hashes
from .near_dedup import mix

#: Bytes of a repeated string and of its first digit; words of a repeated passage and of its first digit; widths of the blocks that the passes divide.
DEPTH, GRAM = 400, 64
PASSAGE, PASSAGE_GRAM = 50, 8
WIDTHS = (64, 8, 1)
#: Window starts of a text that are worked on at a time.
SEGMENT = 1 << 20
#: Documents with repeats whose ids are broadcast at most; beyond that their texts are joined by a shuffle.
BROADCAST_IDS = 500_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def symbols(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, or the hashes of their words, one text after another; and the edges of each."""
    data, edges = bytes_of(column)
    data, edges = data[edges[0] : edges[-1]], edges - edges[0]
    if words:
        data, counts = word_hashes(data, edges)
        edges = np.append(0, np.cumsum(counts))
    return data, edges


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` symbols; equal runs have equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(INVERSE, n - size + 1))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width``, from running minima of blocks to either side."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(data: np.ndarray, edges: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """``text, low, high, anchor, hash`` of a part's runs: windows from ``low`` to ``high`` of a text have their first digit at ``anchor``; places in ``data``, which has the texts between ``edges``."""
    place = np.uint64((1 << 24) - 1)
    for at in range(0, len(data) - depth + 1, SEGMENT):
        part = data[at : at + SEGMENT + depth - 1]
        hashes = gram_hashes(part, gram)
        least = sliding_least((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), depth - gram + 1) & place
        starts = np.arange(at, at + len(least))
        text = np.searchsorted(edges, starts, "right") - 1
        whole = starts + depth <= edges[text + 1]  # other windows run into the next text
        starts, text, least = starts[whole], text[whole], least[whole].astype(np.int64)
        if not len(starts):
            continue
        first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
        last = np.append(first[1:], len(starts)) - 1
        yield text[first], starts[first], starts[last], least[first] + at, hashes[least[first]].view(np.int64)


def mapped(df: DataFrame, rows_of, columns: dict[str, pa.DataType], schema: str, most: int = 100_000) -> DataFrame:
    """``df`` by a function from a batch's rows to tuples, in batches of ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for row in rows_of(batch.slice(at, 100).to_pylist()):
                    out.append(row)
                    if len(out) >= most:
                        yield made(out)
                        out = []
        yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())], list(columns))

    return df.mapInArrow(run, schema)


def key_of(*parts: bytes | int) -> bytes:
    h = blake2b(digest_size=16)
    for p in parts:
        h.update(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True))
    return h.digest()


def whole_keys(data: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, depth: int) -> pa.Array:
    """128 bits of all that the windows of each run hold, and of the digit's places in them."""
    size = data.itemsize
    held = memoryview(np.ascontiguousarray(data)).cast("B")
    digests = b"".join([blake2b(held[a:b], digest_size=16).digest() for a, b in zip((low * size).tolist(), ((high + depth) * size).tolist(), strict=True)])
    places = mix(((anchor - low) << 32 | (anchor - high)).astype(np.uint64) + np.uint64(BASE))
    keys = np.frombuffer(digests, np.uint64).reshape(-1, 2) ^ np.stack([places, mix(places)], 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(low), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def first_digits(texts: DataFrame, depth: int, gram: int, words: bool) -> DataFrame:
    """The runs of all texts, with a key of all that a run's windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, edges = symbols(part.column(2), words)
                for of, low, high, anchor, digit in runs(data, edges, depth, gram):
                    keys, begin = whole_keys(data, low, high, anchor, depth), edges[of]
                    of = pa.array(of)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *[pa.array(x) for x in (low - begin, high - begin, anchor - begin, digit)], keys], names)

    names = ["doc_id", "v", "low", "high", "anchor", "digit", "whole"]
    return texts.select("doc_id", "v", "t").mapInArrow(run, f"{id_schema(texts)}, v bigint, low bigint, high bigint, anchor bigint, digit bigint, whole binary")


def id_type(df: DataFrame) -> dict[str, pa.DataType]:
    return {"doc_id": to_arrow_type(df.schema["doc_id"].dataType)}


def id_schema(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def several(df: DataFrame, key: str) -> DataFrame:
    """The keys that more than one row has."""
    found = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key), key)
    return broadcast_within(found, BROADCAST_ROWS)


def same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["d"]) & (a["v"] == b["dv"])


def by_doc(df: DataFrame, *columns: str) -> DataFrame:
    """``d, dv, items``: the rows of each document in one."""
    return df.groupBy(F.col("doc_id").alias("d"), F.col("v").alias("dv")).agg(F.collect_list(F.struct(*columns)).alias("items"))


def texts_with(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The texts of the documents in ``items``, each with its items."""
    ids = items.select("d", "dv")
    some = texts.join(broadcast_within(ids, BROADCAST_IDS), same_doc(texts, ids), "left_semi")
    return some.join(items, same_doc(some, items))


def witnesses(equal: DataFrame, shared: str, rest: DataFrame, *columns: str) -> DataFrame:
    """One row of each group of equal ones, where ``rest`` has rows that share a key with it and may equal a part of it."""
    some = materialize(equal.groupBy("whole", shared).agg(F.min(F.struct(*columns)).alias("x")), "witnesses")
    return some.join(rest.select(shared).distinct(), shared, "left_semi").select("x.*")


def divide(pieces: DataFrame, depth: int, item: int) -> list[DataFrame]:
    """``doc_id, v, first, last``: the repeated windows among ``pieces``, by passes over ever smaller blocks.

    A block holds the windows in which the digit's place is from its start on.

    ``pieces``: ``piece, doc_id, v, low, high, anchor, data``, the symbols of ``item`` bytes from ``low`` on that the windows hold.
    """
    found, active = [], pieces.withColumn("blocks", F.lit(None).cast("array<bigint>"))
    outer = None
    for width in (w for w in WIDTHS if 2 * w <= depth):  # what a block's windows have in common is never empty

        def rows_of(batch, width=width, outer=outer):
            for r in batch:
                at = r["anchor"] - r["low"]
                near, far = r["anchor"] - r["high"], at  # the places that the digit has in the run's windows
                for start in [0] if outer is None else r["blocks"]:
                    stop = far + 1 if outer is None else min(far + 1, start + outer)
                    for d in range(max(start, near // width * width), stop, width):
                        end = d + width - 1
                        core = key_of(d, width, r["data"][(at - d) * item : (at - end + depth) * item])
                        inside = near <= d and end <= far
                        yield r["piece"], d, core, key_of(d, -width, r["data"][(at - end) * item : (at - d + depth) * item]) if inside and width > 1 else None

        columns = {"piece": pa.int64(), "block": pa.int64(), "core": pa.binary(), "whole": pa.binary()}
        keys = materialize(mapped(active.select("piece", "low", "high", "anchor", "data", "blocks"), rows_of, columns, "piece bigint, block bigint, core binary, whole binary"), "keys")
        left = materialize(keys.join(several(keys, "core"), "core", "left_semi"), "left")
        if width > 1:
            equal = broadcast_within(several(left, "whole").withColumn("equal", F.lit(True)), BROADCAST_ROWS)
            left = materialize(left.join(equal, "whole", "left").select("piece", "block", "core", "whole", F.coalesce("equal", F.lit(False)).alias("equal")), "left")
        else:
            left = left.withColumn("equal", F.lit(True))
        hits = left.where("equal").join(pieces.select("piece", "doc_id", "v", "anchor"), "piece")
        found.append(materialize(hits.select("doc_id", "v", (F.col("anchor") - F.col("block") - (width - 1)).alias("first"), (F.col("anchor") - F.col("block")).alias("last")), "hits"))
        if width == 1:
            break
        open_ = left.where("not equal")
        blocks = open_.select("piece", "block").unionByName(witnesses(left.where("equal"), "core", open_, "piece", "block")).groupBy("piece").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
        active, outer = pieces.join(blocks, "piece"), width
    return found


def repeated_spans(texts: DataFrame, depth: int, gram: int, words: bool = False) -> DataFrame:
    """``doc_id, v, first, last``: runs of starts of windows that start elsewhere too, of ``doc_id, v, t``; starts are bytes, or words."""
    long_ = texts.where(F.octet_length("t") >= (2 * depth - 1 if words else depth))
    digits = materialize(first_digits(long_, depth, gram, words), "digits")
    again = materialize(digits.join(several(digits, "digit"), "digit", "left_semi"), "again")
    wholes = several(again, "whole")
    equal = materialize(again.join(wholes, "whole", "left_semi"), "equal")
    rest = materialize(again.join(wholes, "whole", "left_anti"), "rest")
    run = ("doc_id", "v", "low", "high", "anchor")
    rest = materialize(by_doc(rest.select(*run).unionByName(witnesses(equal, "digit", rest, *run)), "low", "high", "anchor"), "rest")
    discard(digits, again)
    equal = equal.select("doc_id", "v", F.col("low").alias("first"), F.col("high").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part, lots, n = batch.slice(at, 100), [], 0
                items = part.column(3)
                low, high, anchor = (items.flatten().field(name).to_numpy() for name in ("low", "high", "anchor"))
                ends = np.cumsum(pa.compute.list_value_length(items).to_numpy())
                texts_, edges = symbols(part.column(2), words)
                for i in range(part.num_rows):
                    data = texts_[edges[i] : edges[i + 1]]
                    for a in range(int(ends[i - 1]) if i else 0, int(ends[i]), 10_000):
                        k = slice(a, min(a + 10_000, int(ends[i])))
                        lots.append((np.full(k.stop - a, i), low[k], high[k], anchor[k], pa.array([data[x : y + depth].tobytes() for x, y in zip(low[k].tolist(), high[k].tolist(), strict=True)], pa.binary())))
                        n += k.stop - a
                        if n >= 10_000:
                            yield made(part, lots)
                            lots, n = [], 0
                if lots:
                    yield made(part, lots)

    def made(part: pa.RecordBatch, lots: list[tuple]) -> pa.RecordBatch:
        *numbers, held = zip(*lots, strict=True)
        of, *numbers = (pa.array(np.concatenate(x)) for x in numbers)
        return pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *numbers, pa.concat_arrays(held)], ["doc_id", "v", "low", "high", "anchor", "data"])

    pieces = texts_with(long_, rest).select("doc_id", "v", "t", "items").mapInArrow(run, f"{id_schema(texts)}, v bigint, low bigint, high bigint, anchor bigint, data binary")
    pieces = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    for part in divide(pieces, depth, 8 if words else 1):
        equal = equal.unionByName(part)
    discard(rest, pieces)
    return equal


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("t"))


def repeated_words(docs: DataFrame, width: int = PASSAGE, gram: int = PASSAGE_GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, v, n_repeat_words``: words in runs of ``width`` words that start anywhere else too, for each distinct ``doc_id`` and text with any.

    Words are lower-cased A-Z; white space between them doesn't count. ``v`` is
    the 64-bit hash of the text. A passage of few bytes is found too, which
    ``remove_repeats`` leaves alone. Rows that repeat are copies; texts of fewer
    words, null ones and empty tables have no repeats; ids may be null.
    """
    spans = by_doc(repeated_spans(keyed(docs, id_col, text_col), width, gram, words=True), "first", "last").select("d", "dv", F.sort_array("items").alias("items"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] + width - F.greatest(a["end"], x["first"]))).alias("n"), F.greatest(a["end"], x["last"] + width).alias("end"))
    zero = F.lit(0).cast("bigint")
    return spans.select(F.col("d").alias("doc_id"), F.col("dv").alias("v"), F.aggregate("items", F.struct(zero.alias("n"), zero.alias("end")), step)["n"].alias("n_repeat_words"))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, v, n_bytes, spans, kept``.

    ``spans`` are the maximal runs of bytes (``start, end``, exclusive) that
    are covered by a string of ``depth`` bytes that starts anywhere else too;
    ``kept`` are the other bytes; ``v`` is the 64-bit hash of the text. Matches
    never cross documents; texts are UTF-8, so a span may split a character.
    Null texts are empty; texts shorter than ``depth`` keep all; very long ones
    are read whole, a part at a time. Rows that repeat are copies, and lose all
    that is long enough; rows with one id and different texts are told apart.
    Ids may be of any type, and null. An empty table gives no rows; other
    columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    spans = by_doc(repeated_spans(texts, depth, gram), "first", "last")
    spans = materialize(spans.select("d", "dv", F.sort_array("items").alias("items")), "spans")

    def rows_of(batch):
        for r in batch:
            data, merged = r["t"].encode(), []
            for x in r["items"]:
                a, b = x["first"], x["last"] + depth
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(e for m in merged for e in m), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield r["doc_id"], r["v"], len(data), [{"start": a, "end": b} for a, b in merged], kept

    columns = id_type(texts) | {"v": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
    schema = f"{id_schema(texts)}, v bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    changed = mapped(texts_with(texts, spans).select("doc_id", "v", "t", "items"), rows_of, columns, schema, 1_000)
    ids = broadcast_within(spans.select("d", "dv"), BROADCAST_IDS)
    whole = texts.join(ids, same_doc(texts, spans), "left_anti")
    whole = whole.select("doc_id", "v", F.octet_length("t").cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("t").cast("binary").alias("kept"))
    return changed.unionByName(whole)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the bytes that are left and the words in repeated passages of 50 words, which may have fewer than 400 bytes."""
    docs = table(spark, sf_dir, "documents")
    passages = materialize(repeated_words(docs), "passages").select(F.col("doc_id").alias("d"), F.col("v").alias("dv"), "n_repeat_words")
    found = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("doc_id", "v", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    joined = found.join(broadcast_within(passages, BROADCAST_IDS), same_doc(found, passages), "left")
    return joined.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_left"), F.coalesce("n_repeat_words", F.lit(0).cast("bigint")).alias("n_repeat_words"))
