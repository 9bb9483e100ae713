"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs. A run of three letters is the product
of its letters' vectors, each rotated by its place in the run; a text is the sum
of its runs, a language the sum of its training texts. A document gets the
language whose vector has the largest cosine with its own.

Letters' vectors come from a hash of the code point, so every task has the same
without sharing anything. All sums are of whole numbers, so results don't depend
on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table
from .near_dedup import mix

#: Signs of a vector, and letters of a run.
SIZE, RUN = 1024, 3
#: Texts, and characters, that a worker bundles at a time, and runs whose vectors it holds.
TEXTS, CHARS, RUNS = 256, 1_000_000, 8192
#: Languages whose vectors a task holds at a time; more are compared in several steps.
LANGUAGES = 1024
#: Stands for what is no letter, and for the ends of a text.
GAP = 0
#: Keys below this bound are told apart by a table of all of them, others by sorting.
TABLE = 1 << 22


def letters() -> np.ndarray:
    """The lower-case letter of each code point, or ``GAP``; a worker builds it once."""
    found = globals().get("_LETTERS")
    if found is None:
        lower = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
        found = globals()["_LETTERS"] = np.array([lower(chr(i)) if chr(i).isalpha() else GAP for i in range(0x110000)], np.int64)
    return found


def signs(codes: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` random signs for each code point."""
    words = mix(mix(codes.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(size // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def compact(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, which are below ``bound``, in order, and the place of each key among them."""
    if bound > TABLE:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(bound, bool)
    there[keys] = True
    known = np.flatnonzero(there)
    place = np.empty(bound, np.int64)
    place[known] = np.arange(len(known))
    return known, place[keys]


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, and place among the distinct runs, of each run of letters and gaps; the distinct runs; and whether a text has a letter."""
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = letters()[codes]
    of = np.append(np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]), len(texts) - 1)  # each text has the gap before it, the last one also that after it
    some = np.zeros(len(texts), bool)
    some[of[code != GAP]] = True
    stays = (code != GAP) | np.append(True, (code[:-1] != GAP) | (of[1:] != of[:-1]))
    code, of = code[stays], of[stays]
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True) & (code != GAP))
    code, of = np.insert(code, ends + 1, GAP), np.insert(of, ends + 1, of[ends])
    used, small = compact(code, len(letters()))
    n = max(0, len(code) - RUN + 1)
    whole = (of[:n] == of[RUN - 1 :][:n]) & some[of[:n]]
    run = np.zeros(whole.sum(), np.int64)
    for k in range(RUN):
        run = run * len(used) + small[k : k + n][whole]
    runs, at = compact(run, len(used) ** RUN)
    rows = np.stack([used[runs // len(used) ** (RUN - 1 - k) % len(used)] for k in range(RUN)], 1)
    return of[:n][whole], at, rows, some


def vectors(runs: np.ndarray, size: int) -> np.ndarray:
    """The product of each run's letters, rotated by their places from the end."""
    out = np.ones((len(runs), size), np.int8)
    for k in range(RUN):
        letter, inverse = np.unique(runs[:, k], return_inverse=True)
        out *= np.roll(signs(letter, size), RUN - 1 - k, axis=1)[inverse]
    return out


def bundles(of: np.ndarray, at: np.ndarray, runs: np.ndarray, n: int, size: int) -> np.ndarray:
    """A row for each of ``n`` texts or groups of them: the sum of its runs' vectors. Distinct runs are worked on some at a time."""
    exact = np.float32 if len(at) < 1 << 24 else np.float64
    out = np.zeros((n, size), exact)
    for begin in range(0, len(runs), RUNS):
        lot = runs[begin : begin + RUNS]
        held = slice(None) if len(runs) <= RUNS else (at >= begin) & (at < begin + RUNS)
        counts = np.bincount(of[held] * len(lot) + at[held] - begin, minlength=n * len(lot)).reshape(n, len(lot))
        out += counts.astype(exact) @ vectors(lot, size).astype(exact)
    return out


def lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``TEXTS`` texts, and ``CHARS`` characters unless one text has more."""
    sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (i - begin >= TEXTS or held + size > CHARS):
            yield begin, i
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield begin, len(sizes)


def summed(size: int) -> Callable:
    """By language the sum of its texts' vectors: a row a language and component, at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in lots(batch.column(1)):
                langs, texts = batch.column(0)[a:b].to_pylist(), [t or "" for t in batch.column(1)[a:b].to_pylist()]
                names = sorted(set(langs))
                of, at, runs, some = runs_of(texts)
                number = np.array([names.index(x) for x in langs], np.int64)
                found = bundles(number[of], at, runs, len(names), size)
                for i in np.unique(number[some]).tolist():
                    sums[names[i]] = sums.get(names[i], 0) + found[i].astype(np.int64)
            if len(sums) > LANGUAGES:
                yield from emitted(sums, size)
                sums = {}
        yield from emitted(sums, size)

    return run


def emitted(sums: dict[str, np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    for lang, values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.arange(size, dtype=np.int32)), pa.array(values)], ["lang", "at", "value"])


def judged(names: list[str], profiles: np.ndarray, size: int) -> Callable:
    """Sets ``_lang`` and ``_cosine`` of each row to the best of these languages, if that is better than what the row has; the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = profiles / np.maximum(np.sqrt((profiles**2).sum(1, keepdims=True)), 1e-300)
        for batch in batches:
            texts = batch.column("_text")
            best, cosine = batch.column("_lang").to_pylist(), batch.column("_cosine").to_numpy(zero_copy_only=False).copy()
            for a, b in lots(texts):
                of, at, runs, some = runs_of([t or "" for t in texts[a:b].to_pylist()])
                found = bundles(of, at, runs, b - a, size).astype(np.float64)
                found /= np.maximum(np.sqrt((found**2).sum(1, keepdims=True)), 1e-300)
                alike = np.round(found @ unit.T, 9)
                top = alike.argmax(1)
                for i in np.flatnonzero(some).tolist():
                    if best[a + i] is None or alike[i, top[i]] > cosine[a + i]:
                        best[a + i], cosine[a + i] = names[top[i]], alike[i, top[i]]
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(cosine)], schema=pa.schema(list(batch.schema)[:-2] + [pa.field("_lang", pa.string()), pa.field("_cosine", pa.float64())]))

    return run


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Learns from the texts and languages of rows for which ``held_out`` isn't
    true and whose language isn't null; every such row counts, repeated ones
    each. ``score`` is the cosine with the language's vector, 0 where it is
    negative. A text that is null, empty or without a letter is ``und`` with
    score 0, and so are all texts if nothing could be learned. Of languages
    with equal cosines (to 9 digits) the smallest is taken. A very long text is
    read whole, its runs some thousands at a time. Null and repeated ids are
    kept, an empty table gives no rows, other columns are ignored whatever
    their names.

    Tasks add up vectors by language; what is shuffled and gathered is one
    number a language and component. Languages are compared ``LANGUAGES`` at a
    time, so a task's memory doesn't grow with their number.
    """
    if size % 64:
        raise ValueError("size must be a multiple of 64")
    text, held = F.col(text_col).cast("string"), F.coalesce(held_out, F.lit(False))
    learn = docs.where(~held & F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    sums = learn.mapInArrow(summed(size), "lang string, at int, value bigint").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    profiles = materialize(sums, "profiles")
    names = profiles.select("lang").distinct().orderBy("lang")
    out = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text.alias("_text"), F.lit(None).cast("string").alias("_lang"), F.lit(0.0).alias("_cosine"))
    after: str | None = None
    while block := [r.lang for r in (names if after is None else names.where(F.col("lang") > after)).limit(LANGUAGES).collect()]:
        found = np.zeros((len(block), size))
        place = {x: i for i, x in enumerate(block)}
        for r in profiles.where(F.col("lang").between(block[0], block[-1])).toLocalIterator():
            found[place[r.lang], r.at] = r.value
        out = out.mapInArrow(judged(block, found, size), out.schema)
        after = block[-1]
    score = F.least(F.greatest(F.col("_cosine"), F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", "held_out", F.coalesce("_lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
