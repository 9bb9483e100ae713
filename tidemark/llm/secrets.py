"""Secret scans: multipart credential linking by an interval join within scopes."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_within, materialize, table, text_of

#: Kinds in the order in which spans with equal starts are listed; the first three are reported wherever they stand.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
BASE = KINDS[:3]
#: Parts that stand at most so many code points apart belong to one scope.
SCOPE = 240
#: Rows with linked parts that are broadcast at most.
BROADCAST_LINKED = 100_000
#: What makes a part count: kind -> roles it has, and kind -> roles of which it needs one nearby.
ROLES = {"assign": ("secret",), "access": ("access",), "hex": ("secret",), "weak_access": ("access",), "weak_secret": ("secret",), "endpoint": ("endpoint",)}
NEEDS = {"weak_access": ("secret",), "weak_secret": ("access",), "endpoint": ("access", "secret")}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
USER = re.compile(r"""(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:@%-]+[A-Za-z0-9]", re.ASCII)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key"), ("user", "login", "client", "account", "access")


def parts(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of every part of a text, in code points; end exclusive.

    Base kinds are leftmost, non-overlapping matches of their own; shorter
    ones are dropped after matching. Weak kinds: named accounts, opaque
    strings of 32 or more with a digit and a letter, and addresses with a
    scheme. A weak part that only repeats a base one is left out.
    """
    found = []
    low = text.lower()
    if any(h in low for h in HINTS[0]):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    weak = []
    if any(h in low for h in HINTS[1]):
        weak += [(*m.span(), "weak_access") for m in USER.finditer(text)]
    weak += [(*m.span(), "weak_secret") for m in OPAQUE.finditer(text) if re.search(r"[0-9]", m[0]) and re.search(r"[A-Za-z]", m[0])]
    if "://" in low:
        weak += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    if weak and found:
        # A base part that begins before a weak one's end overlaps it if the furthest end of those lies beyond its start.
        base = sorted((a, b) for a, b, _ in found)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        weak = [w for w in weak if not (k := bisect_left(starts, w[1])) or reach[k - 1] <= w[0]]
    return found + weak


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, parts`` (array of start, end, kind), one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in parts(t.as_py())] for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, item)], ["doc_id", "parts"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, parts array<struct<start:bigint,end:bigint,kind:string>>")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, start, end, kind`` of the parts to report among ``doc_id, start, end, kind``.

    Base kinds are reported. A weak part is reported if a part of a role that
    it needs starts within ``scope`` code points of its own start, in the same
    document. The interval join is on document and cell of ``scope`` code
    points: what counts of a cell is its first and last start for each role,
    since all starts of one cell are within scope of each other. So however
    many parts stand together, no pairs are made.
    """
    cell = F.floor(F.col("start") / scope)
    roles = F.create_map(*[x for k, r in ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, r)))])
    ends = found.withColumn("role", F.explode(roles[F.col("kind")])).groupBy("doc_id", cell.alias("cell"), "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    ends = ends.select(F.col("doc_id").alias("d"), "role", "first", "last", F.col("cell").alias("own"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("c"))
    needs = F.create_map(*[x for k, r in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, r)))])
    weak = found.where(~F.col("kind").isin(*BASE)).withColumn("need", F.explode(needs[F.col("kind")])).withColumn("c", cell)
    near = F.col("own") == F.col("c")
    near = near | ((F.col("own") < F.col("c")) & (F.col("start") - F.col("last") <= scope)) | ((F.col("own") > F.col("c")) & (F.col("first") - F.col("start") <= scope))
    joined = weak.join(ends.withColumnRenamed("c", "cell"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("c") == F.col("cell")) & (F.col("need") == F.col("role"))).where(near)
    kept = joined.select("doc_id", "start", "end", "kind").distinct()
    return found.where(F.col("kind").isin(*BASE)).select("doc_id", "start", "end", "kind").unionByName(kept)


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (array of start, kind number, kind, end, sorted), one row per input row.

    A null or empty text has no spans. Each row is scanned and linked by
    itself, also where ids repeat or are null. Very long texts are read whole,
    by one pass a pattern. An empty table gives no rows; other columns are
    ignored.
    """
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    shown = lambda p: F.struct(p["start"].alias("start"), number[p["kind"]].alias("place"), p["kind"].alias("kind"), p["end"].alias("end"))
    # A row's number is written with its parts, so it stays the same from then on.
    rows = materialize(find_parts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "parts")
    is_weak = lambda p: ~p["kind"].isin(*BASE)
    # Only rows with a weak part need the join.
    parts_ = rows.where(F.exists("parts", is_weak)).select(F.col("row").alias("doc_id"), F.explode("parts").alias("p")).select("doc_id", "p.*")
    linked = link(parts_, scope).where(~F.col("kind").isin(*BASE))
    linked = linked.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", number[F.col("kind")].alias("place"), "kind", "end")).alias("more"))
    linked = broadcast_within(materialize(linked, "linked"), BROADCAST_LINKED)
    base = F.transform(F.filter("parts", lambda p: ~is_weak(p)), shown)
    joined = rows.join(linked, F.col("row") == F.col("of"), "left")
    return joined.select("doc_id", F.sort_array(F.when(F.col("more").isNull(), base).otherwise(F.concat(base, "more"))).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["place"] < len(BASE)), shown), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"))
