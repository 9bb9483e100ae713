"""Queries of identity mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity as ID
from tidemark.plans.base import register
from tidemark.sources import panels

#: A directory of customers: some share a code, many a symbol; and a listing of them under names with words changed, left out or added.
NAMED = "(SELECT c_custkey AS k, c_name, c_mktsegment AS seg, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
DIRECTORY = f"(SELECT k AS id, CASE WHEN k % 4 <> 0 THEN 'K' || (k - CASE WHEN k % 20 = 3 THEN 1 ELSE 0 END) END AS code, substr(seg, 1, 2) || (k % 400) AS symbol, c_name || ' ' || seg || ' of ' || n_name || ' Inc' AS name FROM {NAMED})"
LISTING = f"(SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'K' || k END AS code, CASE WHEN k % 2 = 0 THEN substr(seg, 1, 2) || (k % 400) WHEN k % 14 = 1 THEN substr(seg, 1, 2) || ((k + 1) % 400) END AS symbol, CASE WHEN k % 11 = 1 THEN upper(seg) || ' / ' || n_name WHEN k % 11 = 2 THEN 'the ' || c_name || ' Holdings' WHEN k % 11 = 3 THEN 'Number ' || k || ' of ' || n_name ELSE n_name || ' ' || seg || ' ' || c_name END AS name, k % 5 = 0 AS removed FROM {NAMED})"
WORDS = "list_sort(list_distinct(list_filter(regexp_split_to_array(upper(name), '[^A-Z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('INC', 'CORP', 'CO', 'COMMON', 'CLASS', 'LTD', 'PLC', 'THE', 'GROUP', 'HOLDINGS', 'COMPANY', 'CORPORATION', 'STOCK', 'SHARES'))))"


def named(spark, sf):
    nation = panels.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return panels.table(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey").select(F.col("c_custkey").alias("k"), "c_name", F.col("c_mktsegment").alias("seg"), "n_name")


def directory(spark, sf):
    k, seg = F.col("k"), F.col("seg")
    code = F.when(k % 4 != 0, F.concat(F.lit("K"), (k - F.when(k % 20 == 3, 1).otherwise(0)).cast("string")))
    return named(spark, sf).select(k.alias("id"), code.alias("code"), F.concat(F.substring(seg, 1, 2), (k % 400).cast("string")).alias("symbol"), F.concat("c_name", F.lit(" "), seg, F.lit(" of "), "n_name", F.lit(" Inc")).alias("name"))


def listing(spark, sf):
    k, seg, kind = F.col("k"), F.col("seg"), F.col("k") % 11
    symbol = lambda n: F.concat(F.substring(seg, 1, 2), (n % 400).cast("string"))
    name = (
        F.when(kind == 1, F.concat(F.upper(seg), F.lit(" / "), "n_name")).when(kind == 2, F.concat(F.lit("the "), "c_name", F.lit(" Holdings")))
        .when(kind == 3, F.concat(F.lit("Number "), k.cast("string"), F.lit(" of "), "n_name")).otherwise(F.concat("n_name", F.lit(" "), seg, F.lit(" "), "c_name"))
    )
    return named(spark, sf).select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("K"), k.cast("string"))).alias("code"), F.when(k % 2 == 0, symbol(k)).when(k % 14 == 1, symbol(k + 1)).alias("symbol"), name.alias("name"), (k % 5 == 0).alias("removed"))


@register(
    "j17_identity_join",
    f"""WITH b AS (SELECT id, code, symbol, {WORDS} AS ws FROM {DIRECTORY}), a AS (SELECT id, code, symbol, removed, {WORDS} AS ws FROM {LISTING}),
c AS (SELECT code, min(id) AS m, count(*) AS n FROM b WHERE code IS NOT NULL GROUP BY code),
s AS (SELECT symbol, min(id) AS m, count(*) AS n, arg_min(ws, id) AS ws FROM b WHERE symbol IS NOT NULL GROUP BY symbol),
nm AS (SELECT ws, min(id) AS m, count(*) AS copies FROM b WHERE len(ws) > 0 GROUP BY ws),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM nm) GROUP BY w),
asked AS (SELECT DISTINCT a.ws FROM a LEFT JOIN c USING (code) LEFT JOIN s ON s.symbol = a.symbol WHERE c.n IS NULL AND s.n IS NULL AND len(a.ws) > 0),
wt AS (SELECT w, CAST(round(1000 * ln(1 + (SELECT count(*) FROM nm) / coalesce(df, 1))) AS BIGINT) AS v FROM (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM asked UNION ALL SELECT unnest(ws) FROM nm)) LEFT JOIN df USING (w)),
qa AS (SELECT ws, w, v, sum(v) OVER (PARTITION BY ws) AS total FROM (SELECT ws, unnest(ws) AS w FROM asked) JOIN wt USING (w)),
qb AS (SELECT ws, w, v, sum(v) OVER (PARTITION BY ws) AS total FROM (SELECT ws, unnest(ws) AS w FROM nm) JOIN wt USING (w)),
sim AS (SELECT qa.ws, qb.ws AS o, sum(qa.v) / (any_value(qa.total) + any_value(qb.total) - sum(qa.v)) AS score FROM qa JOIN qb USING (w) GROUP BY qa.ws, qb.ws HAVING score >= 0.5),
best AS (SELECT ws, o, score, coalesce(lead(score) OVER (PARTITION BY ws ORDER BY score DESC, o), 0) AS runner_up, row_number() OVER (PARTITION BY ws ORDER BY score DESC, o) AS i FROM sim),
j AS (SELECT a.*, c.n AS cn, c.m AS cm, s.n AS sn, s.m AS sm, len(list_intersect(a.ws, s.ws)) > 0 AS shared, nm.m AS nm, copies, score, runner_up
  FROM a LEFT JOIN c ON c.code = a.code LEFT JOIN s ON s.symbol = a.symbol LEFT JOIN (SELECT * FROM best WHERE i = 1) t ON t.ws = a.ws AND c.n IS NULL AND s.n IS NULL LEFT JOIN nm ON nm.ws = t.o),
w AS (SELECT *, CASE WHEN cn IS NOT NULL THEN CASE WHEN cn > 1 THEN 'code of several' END WHEN sn IS NOT NULL THEN CASE WHEN sn > 1 THEN 'symbol of several' WHEN removed AND NOT shared THEN 'symbol may be used again' END WHEN copies IS NOT NULL THEN CASE WHEN copies > 1 THEN 'name of several' WHEN score - runner_up < 0.05 THEN 'close runner-up' END END AS ambiguous,
  CASE WHEN cn IS NOT NULL THEN 'code' WHEN sn IS NOT NULL THEN CASE WHEN removed THEN 'symbol and name' ELSE 'symbol' END WHEN copies IS NOT NULL THEN 'name' END AS r FROM j)
SELECT id, CASE WHEN r IS NOT NULL AND ambiguous IS NULL THEN CASE r WHEN 'code' THEN cm WHEN 'name' THEN nm ELSE sm END END AS match, CASE WHEN ambiguous IS NULL THEN r END AS rule,
  CASE WHEN r IS NULL OR ambiguous IS NOT NULL THEN 'none' WHEN r = 'code' THEN 'high' WHEN r = 'symbol' THEN 'medium' ELSE 'low' END AS confidence, ambiguous, score, runner_up FROM w""",
    "score runner_up",
)
def j17(spark, sf):
    """A listing of names against a directory: by code, by symbol, by rare words."""
    return ID.identity_join(listing(spark, sf), directory(spark, sf), "id", "id")
