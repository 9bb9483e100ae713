"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of small columns (an id or a digest) that are broadcast at most: some tens of MB.
BROADCAST_ROWS = 1_000_000
#: A key with this share of all rows is heavy.
HEAVY_SHARE = 0.001


def text_of(col: str) -> Column:
    """The text of a column as a string; null is the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
#: A random number for each byte, the same for a letter A-Z and its lower case, and for each place in a word.
LETTERS = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
PLACES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, lower-cased A-Z, of texts that lie one after another in ``data`` (UTF-8) between ``edges``; and the words of each text."""
    before = np.append(True, IS_BLANK[data[:-1]])
    before[edges[:-1][edges[:-1] < len(data)]] = True
    inside = np.flatnonzero(~IS_BLANK[data])
    heads = np.flatnonzero(before[inside]) if len(inside) else inside
    if not len(heads):
        return np.zeros(0, np.uint64), np.zeros(len(edges) - 1, np.int64)
    sizes = np.diff(np.append(heads, len(inside)))
    place = np.arange(len(inside)) - np.repeat(heads, sizes)
    most = int(sizes.max())
    places = PLACES if most <= len(PLACES) else mixed(np.arange(1, most + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    hashes = mixed(np.add.reduceat(LETTERS[data[inside]] * places[place], heads))
    return hashes, np.diff(np.searchsorted(inside[heads], edges))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and the edges of each."""
    column = column.cast(pa.large_binary())
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), edges


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value: whole numbers in the least type that holds them, all byte by byte, compressed."""
    out = []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind != "f":
            a = a.view(np.uint64) if a.dtype == np.int64 else a
            a = a.astype(np.min_scalar_type(a.max())) if a.size else a.astype(np.uint8)
        out.append((a.dtype.str, a.size, np.ascontiguousarray(a).view(np.uint8).reshape(a.size, -1).T.tobytes() if a.size else b""))
    data = pickle.dumps(out)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """What ``pack`` was given: 64-bit whole numbers, and floats."""
    out = []
    for kind, n, planes in pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)):
        kind = np.dtype(kind)
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        out.append(a if kind.kind == "f" else a.view(np.int64) if kind.itemsize == 8 else a.astype(np.int64))
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a new folder of this machine, which only a local
    session can use; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: what follows survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)
    if tables:
        tables[0].sparkSession._jvm.System.gc()  # Spark deletes shuffle files of plans that are gone


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` (a row per key, with the ``count`` of its rows) without a task for a hot key.

    At most 1 / ``HEAVY_SHARE`` groups have that share of the ``total`` of all
    counts: those are joined by broadcast, where the rows are. The rest is
    shuffled. A null key has no group. Both sides are read twice.
    """
    names = [c for c in groups.columns if c != key]
    of = groups.withColumnRenamed(key, "_group")
    heavy = F.broadcast(of.where(F.col(count) >= HEAVY_SHARE * total))
    light = of.where(F.col(count) < HEAVY_SHARE * total)
    same = F.col(key) == F.col("_group")
    first = rows.join(heavy, same).drop("_group")
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in names])
    rest = rows.where(F.col(key).isNotNull()).join(heavy, same, "left_anti").join(light, same, "left").drop("_group")
    return first.unionByName(rest).unionByName(none)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
