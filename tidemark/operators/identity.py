"""Identity of securities across two listings: codes, symbols and names, with confidence and ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of names that tell nothing. Fixed values.
PLAIN_WORDS = ["INC", "CORP", "CO", "COMMON", "CLASS", "LTD", "PLC", "THE", "GROUP", "HOLDINGS", "COMPANY", "CORPORATION", "STOCK", "SHARES"]
#: Rows of a key, on each side of a pairing join, that one task gets at most.
CELL = 20_000


def name_tokens(name: Column) -> Column:
    """The distinct words of a name, upper case, without single letters and plain words."""
    words = F.split(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(PLAIN_WORDS))))


def paired(left: DataFrame, right: DataFrame, key: str, cell: int | None = None) -> DataFrame:
    """Inner join by ``key`` whose hot keys are a grid of tasks: each side's rows of a key are split by a hash, and meet all parts of the other side.

    A row is repeated as often as the other side's key has parts, so once for
    keys with at most ``cell`` rows. Columns but for the key must differ.
    """
    cell = cell or CELL
    counts = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(name))
    parts = counts(left, "_a").join(counts(right, "_b"), key).where("_a > 1 or _b > 1")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.withColumn("_h", F.xxhash64(*[c for c in df.columns if c != key])).join(parts, key, "left").na.fill(1, ["_a", "_b"])
        return rows.withColumns({f"_p{own}": F.pmod("_h", F.col(own)).cast("int"), f"_p{other}": F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_h", "_a", "_b")

    return dealt(left, "_a", "_b").join(dealt(right, "_b", "_a"), [key, "_p_a", "_p_b"]).drop("_p_a", "_p_b")


def spread(key: Column, there: Column, row: Column) -> Column:
    """``key`` as a join key for rows of which many have none: those are told apart by ``row``, so they aren't one task, and match nothing."""
    return F.struct(there.alias("there"), F.when(there, key).alias("key"), F.when(~there, row.cast("string")).alias("row"))


def weighted_names(names: DataFrame, weights: DataFrame, share: float) -> DataFrame:
    """``tokens, weight, items, prefix`` of distinct token lists: their tokens with weights, rare ones first, and those of which two alike names share one.

    Names whose common weight is ``share`` of each one's weight have a common
    token whose followers, itself included, weigh that share; so only those
    tokens have to be looked up.
    """
    rows = names.select("tokens", F.explode("tokens").alias("token")).join(weights, "token")
    item = F.struct("df", "token", "w")
    out = rows.groupBy("tokens").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("w").alias("weight"))  # a name's tokens are few
    rest = lambda i: F.aggregate(F.slice("items", i + 1, F.size("items")), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    kept = F.filter("items", lambda x, i: rest(i) >= share * F.col("weight"))
    return out.withColumn("prefix", F.transform(kept, lambda x: x["token"]))


def alike_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``tokens, match, copies, score, runner_up``: each distinct token list of ``left`` with the most alike of ``right`` (``tokens, match, copies``).

    ``score`` is the weight of the common tokens over that of all; a token weighs
    1000 ln(1 + n / df), rounded, ``df`` of ``right``'s ``n`` lists having it.
    Scores of ``least`` and more are all found: candidates share one of their
    rare tokens, hot tokens are split. ``runner_up`` is the next score, or 0.
    """
    n = right.agg(F.count(F.lit(1)).alias("n"))
    df = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    every = left.select(F.explode("tokens").alias("token")).distinct().join(df, "token", "full").withColumn("df", F.coalesce("df", F.lit(1).cast("long")))
    weights = every.crossJoin(F.broadcast(n)).select("token", "df", F.round(1000 * F.log(1 + F.col("n") / F.col("df"))).cast("long").alias("w"))
    a = weighted_names(left, weights, least).select("tokens", "items", "weight", F.explode("prefix").alias("token"))
    b = weighted_names(right.select("tokens"), weights, least).select(F.col("tokens").alias("other"), F.col("weight").alias("other_weight"), F.explode("prefix").alias("token"))
    common = F.aggregate(F.filter("items", lambda x: F.array_contains("other", x["token"])), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    pairs = paired(a, b, "token").withColumn("common", common)
    score = F.col("common") / (F.col("weight") + F.col("other_weight") - F.col("common"))
    pairs = pairs.select("tokens", "other", score.alias("score")).where(F.col("score") >= least).distinct()
    order = Window.partitionBy("tokens").orderBy(F.desc("score"), F.asc("other"))
    first = pairs.withColumns({"_i": F.row_number().over(order), "runner_up": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).where("_i = 1")
    return first.join(right.withColumnRenamed("tokens", "other"), "other").select("tokens", "match", "copies", "score", "runner_up")


def identity_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, code: str = "code", symbol: str = "symbol", name: str = "name", removed: str = "removed", least: float = 0.5, margin: float = 0.05) -> DataFrame:
    """``<left_id>, match, rule, confidence, ambiguous, score, runner_up``: each left row with the right row it is the same as, if that is clear.

    Rules in order; the first that speaks decides, and what is ambiguous stays
    without a match:

    1. ``code``: a code that one right row has: high. Several: ambiguous.
    2. ``symbol``: a symbol that one right row has: medium for current names. A
       removed name needs a common word of both names as well (low), else the
       symbol may have been used again: ambiguous. Several right rows: ambiguous.
    3. ``name``: the most alike name by weighted words, from ``least`` on: low.
       Ambiguous where several right rows have that name, or the runner-up is
       within ``margin``.

    Both ids are unique; codes, symbols and names may be null, and then say
    nothing. Neither side grows: keys are grouped before they are joined.
    """
    tokens = name_tokens(F.col(name))
    a = left.select(F.col(left_id).alias("_id"), F.col(code).alias("_code"), F.col(symbol).alias("_symbol"), tokens.alias("tokens"), F.coalesce(F.col(removed), F.lit(False)).alias("_removed"))
    b = right.select(F.col(right_id).alias("_match"), F.col(code).alias("_code"), F.col(symbol).alias("_symbol"), tokens.alias("tokens"))
    n = F.count(F.lit(1))
    codes = b.where("_code is not null").groupBy("_code").agg(F.min("_match").alias("c_match"), n.alias("c_n"))
    symbols = b.where("_symbol is not null").groupBy("_symbol").agg(F.min("_match").alias("s_match"), n.alias("s_n"), F.min_by("tokens", "_match").alias("s_tokens"))
    names = b.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("_match").alias("match"), n.alias("copies"))
    own = lambda c: spread(F.col(c), F.col(c).isNotNull(), F.col("_id"))
    of = lambda df, c: df.withColumn(f"{c}_of", spread(F.col(c), F.lit(True), F.lit(None))).drop(c)
    rows = a.withColumns({"_code_of": own("_code"), "_symbol_of": own("_symbol")})
    rows = rows.join(of(codes, "_code"), "_code_of", "left").join(of(symbols, "_symbol"), "_symbol_of", "left")
    asked = rows.where("c_n is null and s_n is null").where(F.size("tokens") > 0).select("tokens").distinct()
    rows = rows.withColumn("_tokens_of", spread(F.col("tokens"), F.size("tokens") > 0, F.col("_id")))
    rows = rows.join(of(alike_names(asked, names, least).withColumnRenamed("match", "n_match").withColumnRenamed("tokens", "_tokens"), "_tokens"), "_tokens_of", "left")
    shared = F.size(F.array_intersect("tokens", "s_tokens")) > 0
    by_code, by_symbol, by_name = F.col("c_n").isNotNull(), F.col("s_n").isNotNull(), F.col("copies").isNotNull()
    why = (
        F.when(by_code, F.when(F.col("c_n") > 1, "code of several"))
        .when(by_symbol, F.when(F.col("s_n") > 1, "symbol of several").when(F.col("_removed") & ~shared, "symbol may be used again"))
        .when(by_name, F.when(F.col("copies") > 1, "name of several").when(F.col("score") - F.col("runner_up") < margin, "close runner-up"))
    )
    rule = F.when(by_code, "code").when(by_symbol, F.when(F.col("_removed"), "symbol and name").otherwise("symbol")).when(by_name, "name")
    sure = F.when(by_code, "high").when(by_symbol & ~F.col("_removed"), "medium").otherwise("low")
    clear = rule.isNotNull() & F.col("ambiguous").isNull()
    out = rows.withColumn("ambiguous", why).withColumn("match", F.when(clear, F.when(by_code, F.col("c_match")).when(by_symbol, F.col("s_match")).otherwise(F.col("n_match"))))
    told = rule.isNotNull() & ~by_code & ~by_symbol
    return out.select(F.col("_id").alias(left_id), "match", F.when(clear, rule).alias("rule"), F.when(clear, sure).otherwise("none").alias("confidence"), "ambiguous", F.when(told, F.col("score")).alias("score"), F.when(told, F.col("runner_up")).alias("runner_up"))
