"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_of

#: Bytes of text that are encoded, and tokens that are decoded, at a time.
SLICE_BYTES, SLICE_TOKENS = 1_000_000, 1_000_000
#: Distinct pieces whose tokens a worker remembers; beyond that it forgets all and goes on. Pieces that are encoded in one call.
PIECES, LOT = 300_000, 2_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2 ...")
    return [ranks[i] for i in range(len(ranks))]


def tokenizer_json(tokens: list[bytes]) -> str:
    """A tokenizers BPE model of the ranks: each longer token is merged from the two parts that the lower ranks leave of it."""
    rank, chars = {t: i for i, t in enumerate(tokens)}, byte_chars()
    shown = lambda t: "".join(chars[b] for b in t)
    merges = []
    for own, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := rank.get(parts[i] + parts[i + 1], own)) < own else len(tokens) + i)
            if rank.get(parts[best] + parts[best + 1], own) >= own:
                raise ValueError(f"token {own} can't be merged from lower ranks")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append([shown(parts[0]), shown(parts[1])])
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {shown(t): i for i, t in enumerate(tokens)}, "merges": merges}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model})


class Numbers(dict):
    """Numbers of pieces, in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Tokens of texts. Each distinct piece is encoded once; its tokens lie in flat arrays, by its number."""

    def __init__(self, model: str, pattern: str, offsets: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.find, self.offsets = Tokenizer.from_str(model), regex.compile(pattern).findall, offsets
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.begin, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((1 + 2 * self.offsets, 0), np.int32)

    def learn(self, new: list[str]) -> None:
        """Encodes the pieces that have the next numbers; a token's offsets are code points within its piece."""
        ids, sizes, places = [], [], []
        for at in range(0, len(new), LOT):
            part = new[at : at + LOT]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
            if self.offsets:
                places.append(np.array(e.offsets, np.int32).reshape(-1, 2).T)
        sizes = np.concatenate(sizes)
        self.begin = np.concatenate([self.begin, self.flat.shape[1] + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        rows = [np.concatenate(ids)[None], *([np.concatenate(places, 1)] if self.offsets else [])]
        self.flat = np.concatenate([self.flat, np.concatenate(rows)], 1)

    def tokens(self, texts: list[str]) -> list[pa.ListArray]:
        """The ids of each text, and with offsets the starts and ends of its tokens."""
        if len(self.known) > PIECES:
            self.forget()
        found = [self.find(t) for t in texts]
        counts = np.array([len(x) for x in found], np.int64)
        had = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, counts.sum())
        if len(self.known) > had:
            self.learn(list(islice(self.known, had, None)))
        size = self.size[number]
        ends = np.cumsum(size)
        place = np.repeat(self.begin[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        edges = np.append(0, ends)[np.append(0, np.cumsum(counts))].astype(np.int32)
        rows = self.flat[:, place]
        if self.offsets:
            # Where a piece starts in its text: the code points before it, less those of the texts before.
            length = np.fromiter(map(len, chain.from_iterable(found)), np.int64, len(number))
            before = np.cumsum(length) - length
            first = np.append(before, length.sum())[np.cumsum(counts) - counts]
            rows[1:] += np.repeat(before - np.repeat(first, counts), size).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in rows]


class Decoder:
    """The bytes of lists of ids."""

    def __init__(self, tokens: list[bytes]):
        self.pool = pa.array(tokens, pa.binary())

    def bytes_of(self, lists: pa.ListArray) -> pa.Array:
        ids, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if not len(ids):
            return pa.array([b""] * len(lists), pa.binary())
        if not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(self.pool):
            raise ValueError("an id is not in the vocabulary")
        # The tokens' bytes, taken in order, lie end to end: a text's are those between its edges.
        _, ends, data = self.pool.take(ids).buffers()
        edges = np.frombuffer(ends, np.int32)[np.append(0, np.cumsum(sizes))]
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edges.tobytes()), data])


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` in all; a larger row stands alone."""
    group = (np.cumsum(sizes) - sizes) // most
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield slice(a, b)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``, and with ``offsets`` also ``starts, ends``, with ``decoded`` also ``bytes``, one row per input row.

    Each match of ``pattern`` is encoded by itself, by the ranks in the file at
    ``path``, without special tokens. Starts and ends are code points in the
    text; the tokens of a split character all have that character's span.
    ``bytes`` is what ``decode`` makes of the ids, in the same pass. A null
    text is the empty text, and has no tokens. A very long text is encoded
    whole. Rows may repeat; a null id is kept; an empty table gives no rows;
    other columns are ignored.
    """
    tokens = read_ranks(path)
    model = docs.sparkSession.sparkContext.broadcast((tokenizer_json(tokens), pattern, offsets, tokens if decoded else []))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decoder = None
        for batch in batches:
            encoder, decoder = encoder or Encoder(*model.value[:3]), decoder or Decoder(model.value[3])
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for s in slices(sizes, SLICE_BYTES):
                part = batch.slice(s.start, s.stop - s.start)
                columns = [part.column(0), *encoder.tokens(part.column(1).to_pylist())]
                if decoded:
                    columns.append(decoder.bytes_of(columns[1]))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", *["starts", "ends"] * offsets, *["bytes"] * decoded]
    schema = f"doc_id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", bytes binary" * decoded
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes`` of ``doc_id, ids``: the tokens' bytes in order.

    The bytes of a character that several tokens share come together again, so
    the bytes of an encoded text are its UTF-8. Null or no ids give no bytes;
    an id outside the file raises ValueError.
    """
    table_ = tokens.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(table_.value)
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for s in slices(sizes, SLICE_TOKENS):
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part.column(0), decoder.bytes_of(part.column(1))], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def vocabulary() -> tuple[str, str]:
    """The installed vocabulary file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    tokens = encode(table(spark, sf_dir, "documents"), path, pattern, offsets=False, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
