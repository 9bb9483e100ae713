"""Phrase collocations: frequent phrases of two to five words, scored by their weakest cut.

Words that are frequent enough get ids by rank. A text is then a row of ids, and
a phrase of k words is a pair of neighbouring phrases of k - 1 words: frequent
pairs are ranked anew, put in the place of what they join, and paired again. So
one counter of pairs does all lengths. It splits the square of ranks into
tiles; tiles of frequent ids with enough pairs are counted by direct addresses
(``bincount``), all other pairs as sorted coordinates.

Texts are held in blocks of a bounded number of words, each with a dictionary of
its own. Only what a block has is asked of the tables of words and pairs, so no
table of all words has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, broadcast_within, discard, materialize, table

#: Occurrences of a phrase, words of one, share (of 100) of a phrase's occurrences in a longer one that makes it superfluous, and phrases of a language.
LEAST, LONGEST, SHARE, FIRST = 100, 5, 100, 2000
#: Words of a block; a piece is never cut, so one with more makes a larger block.
BLOCK = 1 << 20
#: Bytes of a text that are split at a time (up to the next end of a piece).
BYTES = 1 << 20
#: Ids by side of a tile (in bits), tiles by side that may be counted by direct addresses, and pairs that one needs for that.
TILE_BITS, TILES, DENSE = 10, 16, 1 << 15
#: Ends of pieces.
STOPS = b".,;:!?\n\x0b\x0c\r"
PAIRS = "block bigint, a bigint, b bigint, c bigint"
#: Stands for the end of a piece, and for what has no id, in a text's ids of 32 bits.
NONE = np.uint32(0xFFFFFFFF)
#: Ids of a block that are looked up at a time.
STEP = 1 << 17
#: Stands for the end of a piece; no byte of UTF-8.
MARK = b"\xff"
#: Lower-cases A-Z and puts the mark in the place of stops.
TO_PIECES = bytes(MARK[0] if i in STOPS else i + 32 if 65 <= i <= 90 else i for i in range(256))


class Numbers(dict):
    """Numbers of words in the order in which they are met; several languages share one count."""

    def __init__(self, met: list):
        super().__init__({MARK: -1})
        self.met = met

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.met)
        self.met.append(word)
        return n


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: the numbers of their words with -1 after each piece, and the language, word and count of each number."""
    from pyspark import TaskContext

    task, done = TaskContext.get().partitionId(), 0

    def fresh():
        return [], {}, [], [], 0

    met, numbers, langs, parts, held = fresh()

    def block():
        ids = np.concatenate(parts)
        counts = np.bincount(ids[ids >= 0], minlength=len(met)).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([task << 32 | done]), pa.array([ids.tobytes()], pa.binary()), pa.array([langs], pa.list_(pa.string())),
            pa.array([[w.decode("utf-8", "surrogatepass") for w in met]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())),
        ], ["block", "ids", "langs", "words", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes().translate(TO_PIECES) if text.is_valid else b""
            begin = 0
            while begin < len(data):
                end = data.find(MARK, begin + BYTES)
                end = len(data) if end < 0 else end
                found = data[begin:end].replace(MARK, b" \xff ").split()
                found.append(MARK)
                if lang not in numbers:
                    numbers[lang] = Numbers(met)
                had = len(met)
                parts.append(np.fromiter(map(numbers[lang].__getitem__, found), np.int32, len(found)))
                langs.extend([lang] * (len(met) - had))
                held, begin = held + len(found), end + 1
                if held >= BLOCK:
                    yield block()
                    done += 1
                    met, numbers, langs, parts, held = fresh()
    if met:
        yield block()


def compact(ids: np.ndarray) -> np.ndarray:
    """Rows of two or more neighbouring ids, with ``NONE`` after each; all else is left out."""
    there = ids != NONE
    kept = there & (np.append(there[1:], False) | np.append(False, there[:-1]))
    return ids[kept | (~there & np.append(False, kept[:-1]))]


def recoded(block: pa.Table, names: pa.Table) -> pa.Table:
    """A block with ids in the place of its own numbers; ``NONE`` for those that have none."""
    out = pa.schema([("block", pa.int64()), ("ids", pa.binary())])
    if not len(block) or not len(names):
        return out.empty_table()
    own = np.frombuffer(block.column("ids")[0].as_buffer(), np.int32)
    to = np.full(max(own.max(initial=0), pa.compute.max(names.column("own")).as_py()) + 2, NONE)
    to[names.column("own").to_numpy()] = names.column("id").to_numpy()
    ids = compact(to[own])  # the number -1 is the last place, which has no name
    return pa.table({"block": block.column("block"), "ids": pa.array([ids.tobytes()], pa.binary())}) if len(ids) else out.empty_table()


def recoded_here(known: pa.Array) -> Callable:
    """The same where the words are few enough for each task to have them all; ``known`` has language and word in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, langs, words in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                asked = pa.compute.binary_join_element_wise(langs.values, words.values, " ")
                to = np.append(pa.compute.fill_null(pa.compute.index_in(asked, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32), NONE)
                if len(ids := compact(to[np.frombuffer(data.as_buffer(), np.int32)])):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()], pa.binary())], ["block", "ids"])

    return run


def first_texts(held: DataFrame, own: DataFrame, words: DataFrame) -> DataFrame:
    """Texts as rows of the ids of frequent ``words``. At most ``BROADCAST_ROWS`` words go to all tasks; of more, each block gets those that it has."""
    if words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = words.orderBy("id").select(F.concat_ws(" ", "lang", "phrase").alias("w")).toArrow().column(0).combine_chunks()
        return held.select("block", "ids", "langs", "words").mapInArrow(recoded_here(known), "block bigint, ids binary")
    names = own.join(words.select(F.col("lang").alias("langs"), F.col("phrase").alias("words"), "id"), ["langs", "words"]).select(F.col("block").alias("of"), "own", "id")
    return held.select("block", "ids").groupBy("block").cogroup(names.groupBy("of")).applyInArrow(recoded, "block bigint, ids binary")


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def named(ids: np.ndarray, key: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Row of ids with the names of pairs in the place of their first members; ``key`` is sorted."""
    out = np.full(len(ids), NONE)
    for i in range(0, len(ids) - 1, STEP):
        b = ids[i + 1 : i + 1 + STEP]
        a = ids[i : i + len(b)]
        both = np.flatnonzero((a != NONE) & (b != NONE))
        asked = joined(a[both], b[both])
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        same = key[at] == asked
        out[i + both[same]] = name[at[same]]
    return compact(out)


def sorted_names(names: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, name = joined(names.column("a").to_numpy(), names.column("b").to_numpy()), names.column("id").to_numpy()
    order = np.argsort(key)
    return key[order], name[order]


def paired(block: pa.Table, names: pa.Table) -> pa.Table:
    """A block with the ids of pairs in the place of their first members; ``names`` are those that it has."""
    out = pa.schema([("block", pa.int64()), ("ids", pa.binary())])
    if not len(block) or not len(names):
        return out.empty_table()
    ids = named(np.frombuffer(block.column("ids")[0].as_buffer(), np.uint32), *sorted_names(names))
    return pa.table({"block": block.column("block"), "ids": pa.array([ids.tobytes()], pa.binary())}) if len(ids) else out.empty_table()


def paired_here(key: np.ndarray, name: np.ndarray) -> Callable:
    """The same where the names are few enough for each task to have them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(ids := named(np.frombuffer(data.as_buffer(), np.uint32), key, name) if len(key) else key):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()], pa.binary())], ["block", "ids"])

    return run


def next_texts(texts: DataFrame, level: DataFrame) -> DataFrame:
    """Texts as rows of the ids of ``level``'s pairs. At most ``BROADCAST_ROWS`` pairs go to all tasks; of more, each block gets those that it has."""
    if level.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return texts.mapInArrow(paired_here(*sorted_names(level.select("a", "b", "id").toArrow())), "block bigint, ids binary")
    own = texts.mapInArrow(counted, PAIRS)
    names = own.join(level.select("a", "b", "id"), ["a", "b"]).select(F.col("block").alias("of"), "a", "b", "id")
    return texts.groupBy("block").cogroup(names.groupBy("of")).applyInArrow(paired, "block bigint, ids binary")


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each comes."""
    found = []
    ta, tb = a >> TILE_BITS, b >> TILE_BITS
    near = (ta < TILES) & (tb < TILES)
    tile = np.full(len(a), TILES * TILES, np.uint16)
    tile[near] = ta[near] * TILES + tb[near]
    del ta, tb, near
    sizes = np.bincount(tile, minlength=TILES * TILES + 1)
    side, low = 1 << TILE_BITS, (1 << TILE_BITS) - 1
    rest = np.ones(len(a), bool)
    for t in np.flatnonzero(sizes[:-1] >= DENSE).tolist():
        here = tile == t
        counts = np.bincount((a[here] & low) * side + (b[here] & low), minlength=side * side)
        at = np.flatnonzero(counts)
        found.append((at // side + (t // TILES) * side, at % side + (t % TILES) * side, counts[at]))
        rest &= ~here
    del tile
    key, counts = np.unique(joined(a[rest], b[rest]), return_counts=True)
    found.append(((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), counts))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, a, b, c``: the pairs of neighbours of each block, and how often each comes there."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(data.as_buffer(), np.uint32)
            a, b = ids[:-1], ids[1:]
            both = (a != NONE) & (b != NONE)
            a, b, c = count_pairs(a[both], b[both])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block)), pa.array(a), pa.array(b), pa.array(c)], ["block", "a", "b", "c"])


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``id``, its place in the order (from 0). Sorted by ranges and written once; a range's rows come after those of the ranges before."""
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    held = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (row + F.col("_start")).alias("id"))


def longer(pairs: DataFrame, shorter: DataFrame, least: int) -> DataFrame:
    """Frequent pairs of ``shorter`` phrases as phrases: what they join, their counts, and the counts of all their first and last parts."""
    frequent = materialize(pairs.groupBy("a", "b").agg(F.sum("c").alias("f")).where(F.col("f") >= least), "frequent")
    hint = lambda df: broadcast_within(df, BROADCAST_ROWS)
    first = shorter.select(F.col("id").alias("a"), F.col("f").alias("fa"), "lang", F.col("phrase").alias("begin"), "pre")
    last = shorter.select(F.col("id").alias("b"), F.col("f").alias("fb"), "last", "suf")
    both = frequent.join(hint(first), "a").join(hint(last), "b")
    rows = both.select(
        "a", "b", "f", "fa", "fb", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last",
        F.concat("pre", F.array("fa")).alias("pre"), F.concat("suf", F.array("fb")).alias("suf"),
    )
    out = materialize(numbered(rows, F.desc("f"), F.asc("a"), F.asc("b")), "phrases")
    discard(frequent)
    return out


def phrase_levels(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` of all words, and tables of the frequent phrases of one word, of two, and so on."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    held = materialize(docs.select(lang.alias("lang"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(blocks, "block bigint, ids binary, langs array<string>, words array<string>, counts array<bigint>"), "blocks")
    own = held.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts"))).select("block", F.col("pos").alias("own"), "col.langs", "col.words", "col.counts")
    totals = materialize(own.groupBy(F.col("langs").alias("lang")).agg(F.sum("counts").alias("n")), "totals")
    none = F.array().cast("array<bigint>")
    words = own.groupBy(F.col("langs").alias("lang"), F.col("words").alias("phrase")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    words = materialize(numbered(words.select("f", "lang", "phrase", F.col("phrase").alias("last"), none.alias("pre"), none.alias("suf")), F.desc("f"), F.asc("lang"), F.asc("phrase")), "words")
    texts = materialize(first_texts(held, own, words), "texts")
    discard(held)
    levels = [words]
    while len(levels) < longest:
        levels.append(longer(texts.mapInArrow(counted, PAIRS), levels[-1], least))
        old = texts
        if len(levels) < longest:
            texts = materialize(next_texts(texts, levels[-1]), "texts")
        discard(old)
    return totals, levels


#: The cut with the lowest floor(1000 * a * n / (l * r)), the first of equal ones. Decimals are exact to 38 digits.
CUT = """array_min(transform(sequence(1, size(pre)), k -> named_struct(
  'score', (cast(1000 as decimal(4, 0)) * cast(f as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(pre[k - 1] as decimal(18, 0)) * cast(suf[size(pre) - k] as decimal(18, 0))),
  'k', k, 'l', pre[k - 1], 'r', suf[size(pre) - k])))"""


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    Texts are lower-cased (A-Z only), split at ``.,;:!?`` and line ends into
    pieces, and those at spaces and tabs into words. A phrase has 2 to
    ``longest`` words of one piece and comes ``a >= least`` times, overlaps
    included, among the ``n`` words of its language. Of the cuts of a phrase
    into a first part that comes ``l`` times and a rest that comes ``r`` times,
    that with the lowest ``score``, floor(1000 * a * n / (l * r)), counts; of
    equal ones the first. A phrase with ``share`` hundredths of its occurrences
    inside a longer one is left out. The ``first`` by score, count and phrase
    (as bytes) of a language are returned.

    A null text has no words, a null language is ``und``, an empty table gives
    no rows. Repeated rows and ids count each; ids aren't read. A very long text
    is split some megabytes at a time, at ends of pieces; a piece stays whole.
    Other columns are ignored, whatever their names. Ids of phrases of one
    length have 32 bits.
    """
    totals, levels = phrase_levels(docs, text_col, lang_col, least, longest)
    kept = []
    for i, level in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            within = lambda side: F.when(100 * F.col("f") >= share * F.col(f"f{side}"), F.col(side))
            dropped = levels[i + 1].select(F.explode(F.array_compact(F.array(within("a"), within("b")))).alias("id")).distinct()
            level = level.join(dropped, "id", "left_anti")
        kept.append(level.select("lang", "phrase", "f", "pre", "suf"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    scored = rows.join(broadcast_within(totals, BROADCAST_ROWS), "lang").withColumn("cut", F.expr(CUT))
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("_part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part of a language, then the first of those: no task sorts all phrases of one.
    parts = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), f AS (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS a
  FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, phrase HAVING count(*) >= 100
), totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
split AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT s.lang, s.phrase, s.k, s.a, c, l.a AS l, r.a AS r, (1000 * CAST(s.a AS HUGEINT) * n) // (CAST(l.a AS HUGEINT) * r.a) AS score, n
  FROM (SELECT *, unnest(range(1, k)) AS c FROM split) s
  JOIN totals USING (lang)
  JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1 : c], ' ')
  JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[c + 1 : s.k], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT DISTINCT lang, phrase, a FROM (
    SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM split, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS m) WHERE m < k AND i + m - 1 <= k)
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.a >= 100 * b.a)
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept
) WHERE rank <= 2000
"""
