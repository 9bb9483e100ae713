"""Quality rules: divergence of character-class and common-word histograms from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_within, materialize, table, text_of, words_of

#: Words of a window whose repeats count; base limits.
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
#: A word is common in a language from this share of its words on, so a language has at most 1 / share of them.
COMMON_SHARE = 0.005
#: Words that a document, and a language, must have to be judged by divergence.
GUARD_WORDS, GUARD_LANGUAGE_WORDS = 50, 2_000
#: Largest Jensen-Shannon distances (base 2) of what is kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.42
BROADCAST_LANGUAGES = 1_000
#: Character classes by pattern; the last two are bytes beyond a character's first, and all other characters.
CLASSES = {"blank": r"\x20\x09-\x0D", "digit": "0-9", "upper": "A-Z", "symbol": "#*$%&|<>", "mark": r"!\x22'()+,./:;=?@\x5B-\x60{}~-"}

SYMBOL, BEYOND = list(CLASSES).index("symbol"), len(CLASSES)
#: Places of a language's table of common words.
SLOTS = 512


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), (total(F.zip_with(p, q, term)) + total(F.zip_with(q, p, term))) / 2))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total.cast("double")), F.lit(0.0)))


def window_hashes(hashes: Column, width: int = WINDOW) -> Column:
    """64-bit hashes of the windows of ``width`` words, in order, from the words' hashes.

    ``hashes`` is named twice, so that Catalyst doesn't compute it anew for each window.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    return F.when(F.size(hashes) >= width, windows).otherwise(F.array().cast("array<bigint>"))


def covered_count(ordered: Column, width: int = WINDOW) -> Column:
    """Positions within ``width`` from the starts of those of the sorted windows whose hash comes twice."""
    twice = F.filter(ordered, lambda s, k: F.coalesce(s["h"] == F.get(ordered, k - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(ordered, k + 1)["h"], F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i + width - a["end"])).cast("long").alias("n"), (i + width).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def class_counts(text: Column) -> list[Column]:
    """Characters of each class, then bytes beyond a character's first, then all other characters."""
    n = F.length(text).cast("long")
    found = [F.length(F.regexp_replace(text, f"[^{x}]+", "")).cast("long") for x in CLASSES.values()]
    return [*found, F.octet_length(text).cast("long") - n, n - sum(found[1:], found[0])]


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def references(docs: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """A row per language of ``lang, t``: its words and characters by class over all texts, and its common words.

    ``words`` holds the common words as a hash table: in place ``h mod SLOTS``
    the words (``h``, and their share ``q``) of that remainder, or null.
    """
    words = docs.select("lang", F.explode(word_hashes(F.col("t"))).alias("h"))
    counts = materialize(words.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("c")), "counts")
    totals = materialize(counts.groupBy(F.col("lang").alias("of")).agg(F.sum("c").alias("lang_words")), "totals")
    totals = broadcast_within(totals, BROADCAST_LANGUAGES)
    common = counts.join(totals, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("c") >= F.col("lang_words") * share)
    listed = common.groupBy("lang", "lang_words").agg(F.sort_array(F.collect_list(F.struct("h", (F.col("c") / F.col("lang_words")).alias("q")))).alias("x"))
    slot = lambda i: F.filter("x", lambda w: F.pmod(w["h"], F.lit(SLOTS)) == i)
    slots = F.transform(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot), lambda found: F.when(F.size(found) > 0, found))
    common = listed.select(F.col("lang").alias("of"), "lang_words", slots.alias("words"), F.aggregate("x", F.lit(0.0), lambda n, w: n + w["q"]).alias("common_share"))
    classes = docs.groupBy("lang").agg(F.array(*[F.sum(c) for c in class_counts(F.col("t"))]).alias("lang_classes"))
    joined = classes.join(broadcast_within(common, BROADCAST_LANGUAGES), F.col("lang").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("lang").alias("of"), F.coalesce("lang_words", F.lit(0).cast("long")).alias("lang_words"), "words", "common_share", "lang_classes")


def divergence(p: Column, q: Column) -> Column:
    """A word's part of twice the squared Jensen-Shannon distance."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return term(p, q) + term(q, p)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, base measures, ``base_failed``, ``kept``, ``char_distance``, ``word_distance``.

    A document fails the base rules with fewer than 20 words, or with more than
    30% of its words in repeated windows. Otherwise it goes if its histogram of
    character classes, or of its language's common words and the rest, lies too
    far from its language's, which are taken over all documents. Documents of
    fewer than 50 words, and those of languages of fewer than 2,000, aren't
    judged by distance; their distances are null, as are those of texts without
    words. A null text is empty and fails; a null language is a language of its
    own. Very long texts are read whole, each by one task; their windows are
    sorted only if one comes again. Rows may repeat; an empty table gives no
    rows; other columns are ignored, whatever their names, or travel in a
    struct column named ``carry``: a row is judged where it is read, so
    nothing is joined to apply the verdict.
    """
    carried = [] if carry is None else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("t"), *carried)
    known = broadcast_within(materialize(references(base.select("lang", "t")), "references"), BROADCAST_LANGUAGES)
    others = ["doc_id", *([carry] if carry else [])]
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = base.select(*others, "lang", word_hashes(F.col("t")).alias("hashes"), lines.alias("lines"), F.array(*class_counts(F.col("t"))).alias("classes"))
    read = read.withColumns({"windows": window_hashes(F.col("hashes")), "n_words": F.size("hashes").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    # Only texts in which a window comes again sort theirs.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    read = read.withColumn("ordered", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    read = read.withColumn("n_repeat_words", F.coalesce(covered_count(F.col("ordered")), F.lit(0).cast("long"))).drop("ordered")
    read = read.join(known, F.col("lang").eqNullSafe(F.col("of")), "left")
    slot = lambda h: F.get("words", F.pmod(h, F.lit(SLOTS)).cast("int"))
    # The text's common words in order; a word's first place, and the next one's, give its count.
    read = read.withColumn("common", F.sort_array(F.filter("hashes", lambda h: F.exists(slot(h), lambda w: w["h"] == h)))).drop("hashes")
    firsts = F.filter(F.sequence(F.lit(0), F.size("common")), lambda i: (i == 0) | (i == F.size("common")) | (F.get("common", i) != F.get("common", i - 1)))
    read = read.withColumn("firsts", firsts)
    used = F.transform(F.slice("firsts", F.lit(1), F.size("firsts") - 1), lambda i, k: F.struct((F.get("firsts", k + 1) - i).alias("c"), F.get(F.filter(slot(F.get("common", i)), lambda w: w["h"] == F.get("common", i)), F.lit(0))["q"].alias("q")))
    read = read.withColumn("used", F.when(F.size("common") > 0, used).otherwise(F.array().cast("array<struct<c:int,q:double>>"))).drop("common", "firsts", "words")
    n, total = F.col("n_words"), lambda term: F.aggregate("used", F.lit(0.0), lambda sum_, w: sum_ + term(w))
    share = F.coalesce("common_share", F.lit(0.0))
    read = read.withColumn("sums", F.struct(total(lambda w: divergence(w["c"] / n, w["q"])).alias("part"), total(lambda w: w["q"]).alias("q"), total(lambda w: w["c"] / n).alias("p")))
    unused = F.greatest(F.lit(0.0), share - F.col("sums.q"))  # where p is 0, the part is q
    rest = divergence(F.greatest(F.lit(0.0), 1 - F.col("sums.p")), F.greatest(F.lit(0.0), 1 - share))
    fair = (n >= GUARD_WORDS) & (F.coalesce("lang_words", F.lit(0)) >= GUARD_LANGUAGE_WORDS)
    judged = read.withColumns({
        "char_distance": F.when(fair, distance(shares(F.col("classes")), shares(F.col("lang_classes")))),
        "word_distance": F.when(fair, F.sqrt((F.col("sums.part") + unused + rest) / 2)),
        "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    # Always true, but not for the optimizer: it would push a filter on the verdict below all this, and work it out anew for each part.
    kept = ~F.col("base_failed") & ~far & (F.monotonically_increasing_id() >= 0)
    word_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda sum_, c: sum_ + c) - F.col("classes")[0] - F.col("classes")[BEYOND]
    return judged.select(*others, "n_words", word_chars.alias("word_chars"), F.col("classes")[SYMBOL].alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM s) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
f AS (
  SELECT doc_id, lang, w, len(w) AS n_words, n_repeat_words,
         length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS blank,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[!"''()+,./:;=?@\x5B-\x60{}~-]', '', 'g')) AS mark,
         strlen(t) - length(t) AS beyond, length(t) AS n_chars,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d LEFT JOIN v USING (doc_id)
), a AS (SELECT doc_id, lang, n_words, [blank, digit, upper_, n_symbols, mark, beyond, n_chars - blank - digit - upper_ - n_symbols - mark] AS k FROM f),
u AS (SELECT doc_id, lang, n_words, unnest(k) AS c, unnest(range(7)) AS j FROM a),
g AS (SELECT *, c / nullif(sum(c) OVER (PARTITION BY doc_id), 0) AS p, sum(c) OVER (PARTITION BY lang, j) / nullif(sum(c) OVER (PARTITION BY lang), 0) AS q FROM u),
cd AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM g GROUP BY doc_id),
o AS (SELECT lang, doc_id, word, count(*) AS c FROM (SELECT lang, doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS lang_words FROM d GROUP BY lang),
m AS (SELECT lang, word, sum(c) AS c, any_value(lang_words) AS lang_words FROM o JOIN n USING (lang) GROUP BY lang, word HAVING sum(c) >= any_value(lang_words) * 0.005),
h AS (SELECT f.doc_id, m.c / lang_words AS q, coalesce(o.c, 0) / n_words AS p FROM f JOIN m USING (lang) LEFT JOIN o ON o.doc_id = f.doc_id AND o.lang = m.lang AND o.word = m.word WHERE n_words > 0),
h2 AS (SELECT doc_id, q, p FROM h UNION ALL SELECT doc_id, 1 - sum(q), 1 - sum(p) FROM h GROUP BY doc_id),
wd AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM h2 GROUP BY doc_id),
e AS (
  SELECT f.doc_id, n_words, n_chars - blank AS word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
         n_words >= 50 AND lang_words >= 2000 AND (coalesce(cd.x, 0) > 0.30 OR coalesce(wd.x, 0) > 0.42) AS far
  FROM f JOIN n USING (lang) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM e
"""
