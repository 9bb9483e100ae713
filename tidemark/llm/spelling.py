"""Spelling variants: words one edit apart, found by search schemes over an FM-index.

A word that differs by one edit agrees with the query in one of its halves. So
each half is matched exactly, from its end of the word inward, and the search
goes on across the other half, where it allows one error. An interval of
suffix ranks stands for all words that agree so far. One index has the words as
they are and is searched from their ends, the other has them reversed and is
searched from their starts; both are the same code.

Words and queries meet in cells, by three letters of the half that must agree
and by the length of the words looked for, which also tells the kind of the
error. A cell has so many letters at most; larger groups are split into a grid
of cells. So an index fits in a task whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, broadcast_within, discard, lower_ascii, materialize, table, text_of

#: Letters of a run, before A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points of a word at least, its occurrences at least, and how many times a form's occurrences are the word's.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence of so many is damaged.
DAMAGED = 31
#: Letters at the outer end of a half by which words and queries meet: no half has fewer.
KEY = 3
#: Letters of the words, and of the queries, of a cell.
CELL = 1_000_000
#: States, and symbols of their intervals, that a search extends at a time.
STATES = 1_000_000


class Index:
    """An FM-index of distinct words, searched from their ends.

    The text has each word and then its end; ends are told apart and ordered by
    length, so the words of a length have one interval of ranks at the start of
    a search, and no suffix runs on into the next word.
    """

    def __init__(self, words: list[str]):
        self.order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
        held = [words[i] for i in self.order]
        sizes = np.array([len(w) for w in held], np.int64)
        codes = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.letters = np.unique(codes)
        n = len(codes) + len(held)
        ends = np.cumsum(sizes + 1) - 1
        self.words = len(held)
        self.of_length = lambda t: (np.searchsorted(sizes, t), np.searchsorted(sizes, t, "right"))
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        rank = np.empty(n, np.int64)
        rank[ends] = np.arange(len(held))
        rank[~is_end] = len(held) + np.searchsorted(self.letters, codes)
        symbol = np.where(is_end, -1, rank - len(held))
        # Ranks of suffixes by doubling the length by which they are told apart; an end ends every comparison.
        width, longest = 1, int(sizes.max(initial=0)) + 1
        place = np.argsort(rank, kind="stable")
        while width < longest:
            further = rank[np.minimum(np.arange(n) + width, n - 1)]
            key = rank * (n + len(self.letters) + 1) + further
            # A suffix that has ended within the width is alone in its rank already: what follows it doesn't matter.
            place = np.argsort(key, kind="stable")
            key = key[place]
            rank[place] = np.append(0, np.cumsum(key[1:] != key[:-1])) if n else key
            width *= 2
        self.owner = np.repeat(np.arange(len(held)), sizes + 1)[place]
        before = symbol[place - 1]
        before[place == 0] = -1
        self.before = before  # -1 at the start of a word
        at = np.flatnonzero(before >= 0)
        self.keys = np.sort(before[at] * n + at)
        self.n = n

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes with one more symbol before them; empty for a symbol that the words don't have."""
        base = symbol * self.n
        return self.words + np.searchsorted(self.keys, base + low), self.words + np.searchsorted(self.keys, base + high)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; one beyond the last for those that no word has."""
        at = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == codes, at, len(self.letters)) if len(self.letters) else np.zeros(len(codes), np.int64)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state with each symbol that stands before a suffix of its interval."""
        sizes, alphabet = high - low, len(self.letters)
        wide = np.flatnonzero(sizes > alphabet)
        state, symbol = [np.repeat(wide, alphabet)], [np.tile(np.arange(alphabet), len(wide))]
        narrow = np.flatnonzero(sizes <= alphabet)
        size = sizes[narrow]
        of = np.repeat(narrow, size)
        found = self.before[np.repeat(low[narrow] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        key = np.unique((of * (alphabet + 1) + found)[found >= 0])
        return np.concatenate([*state, key // (alphabet + 1)]), np.concatenate([*symbol, key % (alphabet + 1)])


def search(index: Index, queries: list[str], lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and word of each pair one edit apart, the word having the given length and the query's last ``exact`` letters.

    The difference of lengths tells the edit: a letter left out, replaced or
    put in. States move inward together, a letter of the query a step; those
    without an error so far branch, those with one match the rest exactly.
    """
    size = np.array([len(q) for q in queries], np.int64)
    codes = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32).astype(np.int64)
    flat, last = index.symbols(codes), np.cumsum(size) - 1
    letter = lambda q, j: flat[np.maximum(last[q] - j, 0)]
    low, high = index.of_length(lengths)
    q = np.flatnonzero(low < high)
    clean = (q, low[q], high[q])
    none = (np.empty(0, np.int64),) * 3
    erred, found = none, []
    join = lambda *parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    some = lambda state, mask: tuple(x[mask] for x in state)

    def extended(state, symbol):
        a, b = index.extend(symbol, state[1], state[2])
        return some((state[0], a, b), a < b)

    for j in range(int(size.max(initial=0)) + 1):
        if not len(clean[0]) and not len(erred[0]):
            break
        q = clean[0]
        open_ = some(clean, (j >= exact[q]) & (j <= size[q]))
        q = open_[0]
        kind, inside = lengths[q] - size[q], j < size[q]
        here = np.where(inside, letter(q, j), -1)
        later = none
        # Left out: of a run of one letter only the first is.
        out = inside & (kind == -1) & ((j == exact[q]) | (here != letter(q, j - 1) if j else True))
        later = join(later, some(open_, out))
        # Replaced, or put in before this letter; a letter put in next to its like is put in after it.
        for own, mask in ((False, inside & (kind == 0)), (True, kind == 1)):
            at, mine = some(open_, mask), here[mask]
            for begin in range(0, len(at[0]), max(1, STATES // (len(index.letters) + 1))):
                k = slice(begin, begin + max(1, STATES // (len(index.letters) + 1)))
                part = tuple(x[k] for x in at)
                state, symbol = index.branches(part[1], part[2])
                new = symbol != mine[k][state]
                made = extended(some(part, state[new]), symbol[new])
                erred, later = (join(erred, made), later) if own else (erred, join(later, made))
        done = size[erred[0]] == j
        found.append(some(erred, done))
        erred = some(erred, ~done)
        erred = join(extended(erred, letter(erred[0], j)), later)
        clean = some(clean, size[clean[0]] > j)
        clean = extended(clean, letter(clean[0], j))
    q, low, _ = join(none, *found)
    pairs = np.unique(np.column_stack([q, index.owner[low]]), axis=0) if len(q) else np.empty((0, 2), np.int64)
    return pairs[:, 0], np.array(index.order, np.int64)[pairs[:, 1]] if len(pairs) else pairs[:, 1]


def searched(cell: pa.Table) -> pa.Table:
    """Of each query of a cell: how many words are near, and the first of them by count and order."""
    looks = cell.filter(pa.compute.field("target") > 0)
    words = cell.filter(pa.compute.field("target") == 0)
    texts, counts = words.column("word").to_pylist(), words.column("n").to_numpy()
    queries, lengths = looks.column("word").to_pylist(), looks.column("target").to_numpy().astype(np.int64)
    from_start = cell.column("side")[0].as_py() == "start"
    turned = (lambda w: w[::-1]) if from_start else (lambda w: w)
    half = np.array([len(x) // 2 for x in queries], np.int64)
    exact = half if from_start else np.array([len(x) for x in queries], np.int64) - half
    q, w = search(Index([turned(x) for x in texts]), [turned(x) for x in queries], lengths, exact) if texts and queries else (np.empty(0, np.int64),) * 2
    if not from_start:
        # A word that agrees in both halves has been found from the start.
        new = np.array([not texts[b].startswith(queries[a][: len(queries[a]) // 2]) for a, b in zip(q.tolist(), w.tolist(), strict=True)], bool)
        q, w = q[new], w[new]
    place = np.empty(len(texts), np.int64)
    place[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    order = np.lexsort([place[w], -counts[w], q])
    q, w = q[order], w[order]
    heads = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
    return pa.table({
        "word": pa.array([queries[i] for i in q[heads]], pa.string()), "n_near": np.diff(np.append(heads, len(q))).astype(np.int64),
        "best": pa.array([texts[i] for i in w[heads]], pa.string()), "best_n": counts[w[heads]].astype(np.int64),
    })


def placed(words: DataFrame) -> DataFrame:
    """``cell, side, word, n, target`` of each word (``target`` 0) and of each look for words of a length, in the cells where they meet."""
    size = F.length("word")
    sides = F.array(F.struct(F.lit("start").alias("side"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit("end").alias("side"), F.substring("word", -KEY, KEY).alias("key")))
    looks = F.array(*[F.struct((size + d).alias("t"), (size + d).alias("target")) for d in (-1, 0, 1)])
    roles = F.concat(F.array(F.struct(size.alias("t"), F.lit(0).alias("target"))), F.filter(looks, lambda x: x["t"] >= LEAST_LENGTH))
    rows = words.select("word", "n", F.explode(sides).alias("s"), roles.alias("roles")).select("word", "n", "s.*", F.explode("roles").alias("r")).select("word", "n", "side", "key", "r.*")
    groups = rows.groupBy("side", "key", "t").agg(F.sum(F.when(F.col("target") == 0, size).otherwise(0)).alias("letters"), F.sum(F.when(F.col("target") > 0, size).otherwise(0)).alias("asked"))
    groups = materialize(groups, "groups")
    total = groups.agg(F.coalesce(F.sum(F.greatest("letters", F.col("asked") / 3)), F.lit(0.0))).first()[0]
    large = groups.where((F.col("letters") > CELL) | (F.col("asked") > 3 * CELL))
    parts = large.select("side", "key", "t", F.ceil(F.col("letters") / CELL).cast("int").alias("a"), F.ceil(F.col("asked") / (3 * CELL)).cast("int").alias("b"))
    rows = rows.join(broadcast_within(parts, BROADCAST_ROWS), ["side", "key", "t"], "left")
    a, b = F.greatest(F.coalesce("a", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("b", F.lit(1)), F.lit(1))
    own = F.xxhash64("word")
    spread = F.when(F.col("target") == 0, F.transform(F.sequence(F.lit(0), b - 1), lambda j: F.struct(F.pmod(own, a).cast("int").alias("i"), j.alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), a - 1), lambda i: F.struct(i.alias("i"), F.pmod(own, b).cast("int").alias("j"))))
    bucket = F.when(F.col("a").isNull(), F.concat_ws(":", "side", F.pmod(F.xxhash64("key", "t"), F.lit(int(total // CELL) + 1)))).otherwise(F.concat_ws(":", "side", "t", "m.i", "m.j", "key"))
    return rows.select("*", F.explode(spread).alias("m")).select(bucket.alias("cell"), "side", "word", "n", "target")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of each of the distinct ``word, n`` with a word one edit away; ``best`` is the most frequent of those, the first of equal ones."""
    found = placed(words).groupBy("cell").applyInArrow(searched, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of distinct ``word, form``: forms followed to the last. Each round doubles how far; a form is ten times as frequent, so few rounds do."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        longer = materialize(reached.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(reached)
        reached = longer
        if reached.where("moved").isEmpty():
            return reached.drop("moved")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """``word, n``: maximal runs of letters, A-Z lower-cased, one in ``damaged`` without one of its letters (by a hash of id and run)."""
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(text_of(text_col)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length(run)).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word with at least 7 code points and 2 occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, of
    which only A-Z are lower-cased; one occurrence in 31 has lost a letter, told
    by a hash of the id and the run. ``n_near`` counts the words that one
    inserted, deleted or replaced code point makes of the word. ``form`` is the
    most frequent of those (ties: the first in code-point order) if it has
    ``ratio`` times the word's occurrences, else null; ``root`` is where forms
    lead in the end, the word itself without a form.

    A null text has no words, an empty table gives no rows, rows that repeat an
    id or a text count each, a null id counts as an empty one. Very long texts
    are read whole, and very long runs are words like others. Other columns are
    ignored, whatever their names.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    near = materialize(near_words(words), "near")
    judged = words.join(near, "word", "left").withColumn("named", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    judged = materialize(judged.select("word", F.when(F.col("named"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("named"), F.col("best_n")).alias("form_n")), "judged")
    discard(words, near)
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
