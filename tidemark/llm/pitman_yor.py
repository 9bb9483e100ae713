"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

A token's context is the word before it, whichever it is, or the start of the
text. Each context is a restaurant whose customers are the training tokens
after it; all restaurants share one parent, whose customers are their tables,
and whose base is uniform over the known words and one unknown. A Gibbs sweep
seats the customers of every dish of every restaurant anew, given all others as
the sweep before left them: how many tables a dish has is drawn given the other
dishes' tables in its restaurant and the word's tables in the others. A number
of tables weighs what all seatings with so many do: of the customers, of the
new tables among the restaurant's, and of the guests they send to the parent,
whose own tables for the word are summed out. All dishes of a sweep are drawn
at once, so they see one another as they were before it. Predictive
probabilities are averaged over the last states.

Texts are read in chunks. A chunk sends its pairs, and which texts have them, to
parts by context (those of frequent words by context and word), where equal pairs
are counted; a word's totals are kept in parts by word. A sweep passes over the
pairs that were seen twice or more (a single customer has one table): a part of
words adds the tables that it was sent and seats the parent, then tells the parts
of pairs, in the order in which they first named their words; those seat their
dishes and send the new tables. All messages of a sweep go by one shuffle either
way, and are as long as the words of the parts. So all probabilities of a state
come from the tables of that state, and sum to one. After the last each part adds
up what its pairs score by text. Only the totals of the frequent words' own
restaurants, at most 1,000, and of the parent pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bytes_of, materialize, pack, table, text_of, unpack, word_hashes
from .near_dedup import mix

#: A frequent word has at least this share of the tokens; so there are at most 1,000.
FREQUENT_SHARE = 0.001
#: Tokens that a worker pairs at a time, bytes of text that it hashes at a time, and the least and the most tokens of a part, of which there are 32 between.
TOKENS, HASHED, LEAST, MOST = 2_000_000, 1 << 20, 100_000, 2_000_000
#: Bytes of messages that a worker holds before it passes them on.
SENT = 1 << 21
#: Discount and strength of the restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 1.0
BURN_IN, SAMPLES = 3, 5
#: Up to so many customers of a dish have a table of exact weights; above, weights are those of the saddlepoint, set right by the table's last row.
EXACT = 256
#: Numbers of tables at which the weights of a dish with more customers are taken, and the share of the heaviest below which they are left out.
NODES, NEGLIGIBLE = 128, 1e-12


def log_seatings(discount: float, most: int = EXACT) -> np.ndarray:
    """Log weight of all seatings of c customers at t tables: (c - 1)-step sums of new tables, and of joining with weight n - discount."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        joined = np.log(np.maximum(c - discount * t[:-1], 1e-300)) + out[c, 1 : c + 1]
        out[c + 1, 1 : c + 2] = np.logaddexp(np.append(joined, -np.inf), out[c, 0 : c + 1])
    return out


def newton(value, slope, target: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a concave function that falls from infinity at -infinity is ``target``, below 0."""
    z = np.minimum(start, -1e-3)
    for _ in range(8):
        z = np.minimum(z - (value(z) - target) / slope(z), z / 16)
    return z


def log_factorial(n: np.ndarray) -> np.ndarray:
    return n * np.log(n) - n + np.log(2 * np.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)


def saddlepoint(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``log_seatings`` of many customers by the saddlepoint of c! / (t! discount^t) [x^c] (1 - (1 - x)^discount)^t; z is log(1 - x)."""
    d = DISCOUNT
    slope = lambda z: np.exp(z) / np.expm1(z) + d - 1 - d * np.exp(d * z) / np.expm1(d * z)
    z = newton(lambda z: np.log(d * np.expm1(z) / np.expm1(d * z)) + (d - 1) * z, slope, np.log(c / t), np.log(c / t / d) / (d - 1))
    x = -np.expm1(z)
    spread = -c * slope(z) * x / np.exp(z)
    return log_factorial(c) - log_factorial(t) + t * np.log(-np.expm1(d * z) / d) - c * np.log1p(-np.exp(z)) - np.log(2 * np.pi * spread) / 2


def log_rising(x: np.ndarray, t: np.ndarray, step: float = 1.0) -> np.ndarray:
    """log x (x + step) ... of ``t`` factors, x above 0: a difference of Stirling's series, with 8 factors more below it."""
    x = x / step
    y = x + 8
    rest = lambda z: (1 / 12 - 1 / (360 * z**2)) / z
    above = (y - 0.5) * np.log1p(t / y) + t * (np.log(y + t) - 1) + rest(y + t) - rest(y)
    ratio = 1.0
    for i in range(8):
        ratio = ratio * ((x + t + i) / (x + i))
    return above - np.log(ratio) + t * np.log(step)


SEATINGS = log_seatings(DISCOUNT)
#: What the saddlepoint lacks, and log t more (which is flat for small t): a function of t / c^discount, for many customers.
LACKS = np.log(np.arange(1, EXACT // 2) / EXACT**DISCOUNT) + SEATINGS[EXACT, 1 : EXACT // 2] - saddlepoint(np.full(EXACT // 2 - 1, float(EXACT)), np.arange(1.0, EXACT // 2))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key; the same wherever the key is worked on."""
    return ((mix(key + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def drawn(log_weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column for each row, by its weights."""
    weights = np.exp(log_weights - log_weights.max(1, keepdims=True)).cumsum(1)
    return (weights < (u * weights[:, -1])[:, None]).sum(1)


def seat(customers: np.ndarray, weight: np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray], key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of each dish, all its customers seated jointly.

    ``weight(rows, t)`` is the log of what t tables weigh in each of ``rows``
    beside the seatings of the customers; an array is the weight of each table.
    """
    of = weight if callable(weight) else lambda at, t: np.log(weight[at])[:, None] * t
    tables = np.minimum(customers, 1).astype(np.float64)
    many = np.flatnonzero(customers > 1)
    order = many[np.argsort(customers[many], kind="stable")]
    counts, edges = np.unique(customers[order], return_index=True)
    for c, a, b in zip(counts.tolist(), edges.tolist(), [*edges.tolist(), len(order)][1:], strict=True):
        if c > EXACT:
            break
        for at in np.split(order[a:b], range(1_000_000 // c, b - a, 1_000_000 // c)):
            tables[at] = 1 + drawn(of(at, np.arange(1.0, c + 1)[None, :]) + SEATINGS[c, 1 : c + 1], uniform(key[at], salt))
    large = np.flatnonzero(customers > EXACT)
    for at in np.split(large, range(4096, len(large), 4096)):
        if len(at):
            tables[at] = seat_many(customers[at].astype(np.float64), lambda t, at=at: of(at, t), uniform(key[at], salt), uniform(key[at], salt + 104_729))
    return tables


def log_many(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``log_seatings`` of dishes with many customers, by row, but for a factor of each row."""
    share = np.log(t) - DISCOUNT * np.log(c)[:, None]
    known = np.log(np.arange(1, EXACT // 2) / EXACT**DISCOUNT)
    return saddlepoint(np.broadcast_to(c[:, None], t.shape), t) + np.interp(share, known, LACKS) - np.minimum(share, known[-1])


def seat_many(c: np.ndarray, of: Callable[[np.ndarray], np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables of dishes with many customers: a node by its weight, then a number about the node.

    Nodes first lie at equal ratios over all numbers of tables; then evenly, twice, between
    the neighbours of those that weigh more than ``NEGLIGIBLE`` of the heaviest.
    """
    low, high = np.ones_like(c), c - 1
    places = np.arange(NODES) / (NODES - 1)
    t = np.maximum(np.floor(np.exp(np.log(high)[:, None] * places)), 1)
    step = np.ones_like(c)
    for last in (False, False, True):
        inside = t <= high[:, None]
        t = np.minimum(t, high[:, None])
        weights = np.where(inside, of(t) + log_many(c, t), -np.inf)
        if last:
            break
        heavy = weights > weights.max(1, keepdims=True) + np.log(NEGLIGIBLE)
        first, final = heavy.argmax(1), NODES - 1 - heavy[:, ::-1].argmax(1)
        rows = np.arange(len(c))
        low, high = t[rows, np.maximum(first - 1, 0)], t[rows, np.minimum(final + 1, NODES - 1)]
        step = np.ceil((high - low + 1) / NODES)
        t = low[:, None] + step[:, None] * np.arange(NODES)
    node = t[np.arange(len(c)), drawn(weights, u)]
    return np.clip(node + np.floor((v - 0.5) * step + 0.5), 1, c)


def log_parent(others: float, words: int) -> np.ndarray:
    """Log weight of 0, 1, ... ``EXACT`` guests of one word at the parent, over all their seatings, beside the other words' tables."""
    t = np.arange(1.0, EXACT + 1)
    weights = SEATINGS[:, 1:] + (log_rising(np.float64(STRENGTH + DISCOUNT * others), t, DISCOUNT) - t * np.log(words + 1))[None, :]
    weights[0] = -np.inf
    most = weights.max(1, initial=-1e300)
    out = most + np.log(np.exp(weights - most[:, None]).sum(1), where=np.arange(EXACT + 1) > 0, out=np.zeros(EXACT + 1))
    out[0] = 0.0
    return out


def log_parents(others: np.ndarray, words: int) -> np.ndarray:
    """``log_parent`` of each of ``others``, by the weights of the largest times what each number of tables weighs less."""
    t = np.arange(1.0, EXACT + 1)
    rising = lambda x: log_rising(np.asarray(STRENGTH + DISCOUNT * x, float)[..., None], t, DISCOUNT)
    ref = others.max()
    weights = SEATINGS[1:, 1:] + (rising(ref) - t * np.log(words + 1))[None, :]
    most = weights.max(1)
    less = rising(others) - rising(ref)
    out = np.zeros((len(others), EXACT + 1))
    near = less.min(1) > -200
    out[near, 1:] = most + np.log(np.exp(less[near]) @ np.exp(weights - most[:, None]).T)
    for i in np.flatnonzero(~near).tolist():
        out[i] = log_parent(others[i], words)
    return out


def guest_weight(parents: np.ndarray, kind: np.ndarray, guests: np.ndarray) -> np.ndarray:
    """Row ``kind`` of ``parents`` at any number of guests: beyond its end, the tables of a word hardly change, and each guest weighs one more than the last."""
    beyond = np.maximum(guests - EXACT, 0.0)
    step = np.exp(parents[:, EXACT] - parents[:, EXACT - 1])[kind]
    return parents[kind, np.minimum(guests, EXACT).astype(np.int64)] + np.where(beyond > 0, log_rising(step + 1, beyond), 0.0)


def counts_up(t: np.ndarray) -> bool:
    """Whether ``t`` is one row 1, 2, 3 and so on, whose weights are sums of what each table adds."""
    return len(t) == 1 and np.array_equal(t[0], np.arange(1, t.shape[1] + 1))


def dish_weight(tables: np.ndarray, guests: np.ndarray, all_guests: np.ndarray, others: np.ndarray, words: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Log weight of t tables of a dish, given what there is without it.

    Those are the restaurant's ``tables``, the word's ``guests`` from other
    restaurants, ``all_guests`` of the parent, and the parent's tables of
    ``others`` among the ``words``.
    """
    values, kinds = np.unique(others, return_inverse=True)
    parents = log_parents(values, words) if len(values) else np.zeros((0, EXACT + 1))
    gains, steps = np.diff(parents, axis=1), np.exp(parents[:, EXACT] - parents[:, EXACT - 1])

    def of(at: np.ndarray, t: np.ndarray) -> np.ndarray:
        own, sent, every = (x[at].astype(np.float64)[:, None] for x in (tables, guests, all_guests))
        kind = kinds[at][:, None]
        if counts_up(t):
            i = t - 1
            before = sent + i
            gain = gains[kind, np.minimum(before, EXACT - 1).astype(np.int64)]
            beyond = before >= EXACT
            if beyond.any():
                gain = np.where(beyond, np.log(steps[kind] + np.maximum(before - EXACT, 0) + 1), gain)
            return np.cumsum(np.log((STRENGTH + DISCOUNT * (own + i)) / (STRENGTH + every + i)) + gain, 1)
        return log_rising(STRENGTH + DISCOUNT * own, t, DISCOUNT) + guest_weight(parents, kind, sent + t) - guest_weight(parents, kind, sent) - log_rising(STRENGTH + every, t)

    return of


def word_weight(others: np.ndarray, words: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Log weight of t tables of a word at the parent, which has ``others`` for the other words."""

    def of(at: np.ndarray, t: np.ndarray) -> np.ndarray:
        own = others[at].astype(np.float64)[:, None]
        if counts_up(t):
            return np.cumsum(np.log((STRENGTH + DISCOUNT * (own + t - 1)) / (words + 1)), 1)
        return log_rising(STRENGTH + DISCOUNT * own, t, DISCOUNT) - t * np.log(words + 1)

    return of


END = np.uint64(0x2545F4914F6CDD1D)
#: Rows that travel between parts: ``src`` is the sender, ``a`` and ``b`` are packed arrays, ``x`` and ``y`` totals.
MESSAGE = "part int, kind string, src bigint, a binary, b binary, x bigint, y bigint"
COLUMNS = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("src", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("x", pa.int64()), ("y", pa.int64())])


def index(docs: DataFrame) -> DataFrame:
    """``ctx, w, c``: pairs of neighbouring tokens, with their training tokens, of texts given as hashes ``h``; all texts end alike, so the first word's context is the end."""
    ctx = F.concat(F.slice("h", -1, 1), F.slice("h", 1, F.size("h") - 1))
    pairs = docs.select("held_out", F.explode(F.arrays_zip(ctx.alias("ctx"), F.col("h").alias("w"))).alias("x"))
    return pairs.groupBy("x.ctx", "x.w").agg(F.count_if(~F.col("held_out")).alias("c"))


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Chunks of whole texts of about ``TOKENS`` tokens: their rows without ``t``, the tokens' hashes, and the tokens of each text."""
    rows, words, sizes, n = [], [], [], 0
    for batch in batches:
        data, edges = bytes_of(batch.column(batch.num_columns - 1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + HASHED, "right")) - 1)
            w, size = word_hashes(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at])
            words.append(np.insert(w, np.cumsum(size), END))
            sizes.append(size + 1)
            rows.append(batch.slice(at, to - at).select(batch.schema.names[:-1]))
            n += len(words[-1])
            at = to
            if n >= TOKENS:
                chunk = [pa.Table.from_batches(rows), np.concatenate(words), np.concatenate(sizes)]
                rows, words, sizes, n = [], [], [], 0
                yield tuple(chunk.pop(0) for _ in range(3))  # nothing is held here while a chunk is worked on
    if rows:
        chunk = [pa.Table.from_batches(rows), np.concatenate(words), np.concatenate(sizes)]
        rows, words, sizes = [], [], []
        yield tuple(chunk.pop(0) for _ in range(3))


def ranks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and where among them each is, in 32 bits if they do."""
    order = np.argsort(words)
    words = words[order]
    new = np.append(True, words[1:] != words[:-1])
    out = np.empty(len(words), np.int32 if len(words) < 1 << 31 else np.int64)
    out[order] = np.cumsum(new, dtype=out.dtype) - 1
    return words[new], out


def text_pairs(words: np.ndarray, sizes: np.ndarray, most: int = 1 << 63) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, and sorted: the pairs of a word's place and its next one's (as one number, the word before times the number of words), the text, and how often the text has the pair."""
    vocabulary, w = ranks(words)
    v, n = len(vocabulary), len(sizes)
    code = np.roll(w, 1).astype(np.int64)
    code *= v
    code += w
    text = np.repeat(np.arange(n, dtype=np.int32), sizes)
    del words, w
    if v * v * n < most:  # sorted as one number with the text
        code *= n
        code += text
        code.sort()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        times = np.diff(np.append(first, len(code)))
        code = code[first]
        text = (code % n).astype(np.int32)
        code //= n
        return vocabulary, code, text, times
    order = np.argsort(code, kind="stable")
    code, text = code[order], text[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])))
    return vocabulary, code[first], text[first], np.diff(np.append(first, len(code)))


def placing(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of parts, and the frequent words. Both only say where the work is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, _ in tokens(batches):
            found, n = np.unique(words, return_counts=True)
            often = n >= FREQUENT_SHARE * len(words)
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array([len(words), *n[often].tolist()], pa.int64())], ["w", "n"])

    counts = texts.select("t").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("w").isNull().desc(), F.col("n").desc()).limit(1 + round(1 / FREQUENT_SHARE)).collect()
    total = top[0].n if top else 0
    return parts_of(total), np.array(sorted(r.w % (1 << 64) for r in top[1:] if r.n >= FREQUENT_SHARE * total), np.uint64)


def parts_of(total: int) -> int:
    return max(1, -(-total // min(max(total // 32, LEAST), MOST)))


def among(keys: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are in ``some`` (sorted), and where."""
    at = np.minimum(np.searchsorted(some, keys), max(len(some) - 1, 0))
    return some[at] == keys if len(some) else np.zeros(len(keys), bool), at


def sending(ctx: np.ndarray, w: np.ndarray, c: np.ndarray, parts: int, hot: np.ndarray, src: int, posts: list[np.ndarray] | None) -> Iterator[list[dict]]:
    """A message to each part with its pairs, sorted, some megabytes at a time; with ``posts`` (texts of each pair, then text and tokens of each; the list is emptied) also those."""
    key = mix(ctx)
    often, _ = among(ctx, hot)
    key[often] = mix(mix(w[often]) + ctx[often])
    key %= np.uint64(parts)
    part = key.astype(np.uint16 if parts < 1 << 16 else np.int64)
    del key, often
    order = np.argsort(part, kind="stable")
    ctx = ctx[order]
    w = w[order]
    c, part = c[order], part[order]
    own, starts = np.unique(part, return_index=True)
    ends = np.append(starts[1:], len(part))
    if posts:
        posted, text, n = posts
        posts[:2] = []
        first = np.cumsum(posted)
        first -= posted
        first, posted = first[order], posted[order]
    del order
    out, held = [], 0
    for p, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True):
        heads = np.flatnonzero(np.append(True, ctx[a + 1 : b] != ctx[a : b - 1]))
        words, wi = np.unique(w[a:b], return_inverse=True)
        row = {"part": p, "kind": "pairs", "src": src, "a": pack(ctx[a:b][heads], np.diff(np.append(heads, b - a)), words, wi, c[a:b])}
        if posts:
            ends_ = np.cumsum(posted[a:b])
            at = np.repeat(first[a:b] - ends_ + posted[a:b], posted[a:b]) + np.arange(ends_[-1])
            row["b"] = pack(posted[a:b], text[at], n[at])
        out.append(row)
        held += len(row["a"]) + len(row.get("b", b""))
        if held >= SENT:
            yield out
            out, held = [], 0
    if out:
        yield out


def chunks(texts: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Of ``row, doc_id, held_out, t``: a row per text, and what each chunk sends to each part."""
    kind = texts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, *read in tokens(batches):
            ids, of = rows["row"].to_numpy(), rows.schema.field("doc_id").type
            columns = COLUMNS.append(pa.field("doc_id", of)).append(pa.field("held_out", pa.bool_()))
            none = [pa.nulls(len(ids), t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())]
            yield from pa.Table.from_arrays([pa.array(ids % parts, pa.int32()), pa.array(["text"] * len(ids)), pa.array(ids), *none, rows["doc_id"], rows["held_out"]], schema=columns).combine_chunks().to_batches()
            vocabulary, code, text, n = text_pairs(read.pop(0), read.pop(0))
            v = len(vocabulary)
            n = n.astype(np.min_scalar_type(n.max()))
            begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            posted = np.diff(np.append(begins, len(code))).astype(np.int32)
            code = code[begins]
            train = ~rows["held_out"].to_numpy()
            c = np.add.reduceat(np.where(train[text], n, 0), begins, dtype=np.int64)
            read = [vocabulary[code // v], vocabulary[code % v], c.astype(np.min_scalar_type(c.max()))]
            posts = [posted, text, n]
            del begins, code, vocabulary, c, posted, text, n
            for sent in sending(read.pop(0), read.pop(0), read.pop(0), parts, hot, int(ids[0]), posts):
                yield from pa.Table.from_pylist(sent, schema=columns).to_batches()

    return texts.mapInArrow(run, f"{MESSAGE}, doc_id {kind.simpleString()}, held_out boolean")


def received(table: pa.Table, kind: str) -> list[dict]:
    """Rows of a kind, by sender."""
    rows = table.filter(pa.compute.equal(table["kind"], kind)).select(COLUMNS.names).to_pylist()
    return sorted(rows, key=lambda r: r["src"])


def counting(parts: int, hot: np.ndarray):
    """A part's pairs, from what the chunks sent: those of all, the texts that have them, what sweeps need, and which words it asks the parts of words about."""

    def run(table: pa.Table) -> pa.Table:
        part, out = table["part"][0].as_py(), []
        sent = received(table, "pairs")
        texts = table.filter(pa.compute.equal(table["kind"], "text"))
        if not sent:
            return texts
        lots = [unpack(r["a"]) for r in sent]
        ctx = np.concatenate([np.repeat(x[0], x[1]) for x in lots]).view(np.uint64)
        w = np.concatenate([x[2][x[3]] for x in lots]).view(np.uint64)
        order = np.lexsort((w, ctx))
        ctx, w = ctx[order], w[order]
        new = np.append(True, (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1]))
        place = np.empty(len(ctx), np.int64)
        place[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        c = np.add.reduceat(np.concatenate([x[4] for x in lots])[order], heads)
        ctx, w = ctx[heads], w[heads]
        ends = np.cumsum([len(x[4]) for x in lots])
        for r, x, end in zip(sent, lots, ends.tolist(), strict=True):
            if r["b"] is not None:
                out.append({"part": part, "kind": "posts", "src": r["src"], "a": pack(np.diff(place[end - len(x[4]) : end], prepend=0)), "b": r["b"]})
        many = c > 1
        words, wi = np.unique(w, return_inverse=True)
        swept = np.bincount(wi[many], minlength=len(words)) > 0
        home = (mix(words + END) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((words, ~swept, home))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        wi, words, swept, home = rank[wi], words[order], swept[order], home[order]
        homes, starts = np.unique(home, return_index=True)
        firsts = np.append(True, ctx[1:] != ctx[:-1])
        ci, contexts = np.cumsum(firsts) - 1, ctx[firsts]
        ones = np.bincount(ci[c == 1], minlength=len(contexts))
        often, _ = among(contexts, hot)
        needed = np.flatnonzero((np.bincount(ci[many], minlength=len(contexts)) > 0) | often)
        tables = ones + np.bincount(ci[many], minlength=len(contexts))
        alls = np.bincount(ci, c, len(contexts)).astype(np.int64)
        for i in np.flatnonzero(often).tolist():
            out.append({"part": part, "kind": "hot", "src": int(contexts[i : i + 1].view(np.int64)[0]), "x": int(tables[i]), "y": int(alls[i])})
        sums, swept_of = np.bincount(wi[many], minlength=len(words)), np.add.reduceat(swept.astype(np.int64), starts)
        t = np.ones(int(many.sum()), np.int64)
        state = pack(np.searchsorted(needed, ci[many]), wi[many], c[many], ones[needed], contexts[needed], needed, homes, starts, swept_of)
        out.append({"part": part, "kind": "state", "src": part, "a": state, "b": pack(t, 0 * t)})
        posts = sent[0]["b"] is not None
        out.append({"part": part, "kind": "all", "src": part, "a": pack(contexts, np.diff(np.append(np.flatnonzero(firsts), len(ctx))), wi, c), "b": None if posts else pack(words)})
        known, single = np.bincount(wi, c, len(words)).astype(np.int64), np.bincount(wi[c == 1], minlength=len(words))
        for q, a, b, m in zip(homes.tolist(), starts.tolist(), [*starts.tolist(), len(words)][1:], swept_of.tolist(), strict=True):
            out.append({"part": q, "kind": "ask", "src": part, "a": pack(words[a:b], known[a:b], single[a:b], [m])})
            out.append({"part": q, "kind": "sums", "src": part, "a": pack(sums[a : a + m])})
        return pa.concat_tables([texts, pa.Table.from_pylist(out, schema=texts.schema)])

    return run


def naming(table: pa.Table) -> pa.Table:
    """A part of words, from what the parts of pairs ask about."""
    part, sent = table["part"][0].as_py(), received(table, "ask")
    lots = [unpack(r["a"]) for r in sent]
    words, of = np.unique(np.concatenate([x[0] for x in lots]).view(np.uint64), return_inverse=True)
    known, ones = (np.bincount(of, np.concatenate([x[i] for x in lots]), len(words)).astype(np.int64) for i in (1, 2))
    a = pack(words, known, ones, of, [r["src"] for r in sent], [len(x[0]) for x in lots], [x[3][0] for x in lots])
    rows = [{"part": part, "kind": "words", "src": part, "a": a, "b": pack(np.minimum(known, 1))}, {"part": part, "kind": "total", "src": part, "x": int(known.sum()), "y": int((known > 0).sum())}]
    return pa.Table.from_pylist(rows, schema=COLUMNS)


def seated_words(parent_tables: int, words: int, salt: int, sampled: bool, last: bool):
    """A part of words, with the parent's tables drawn anew given those of the other words; tells the parts of pairs, after the last sweep about all samples."""

    def run(table: pa.Table) -> pa.Table:
        own = received(table, "words")[0]
        part, (w, known, ones, of, srcs, sizes, swept) = own["part"], unpack(own["a"])
        top, *past = unpack(own["b"])
        sent = {r["src"]: unpack(r["a"])[0] for r in received(table, "sums")}
        asked = dict(zip(srcs.tolist(), zip(np.split(of, np.cumsum(sizes)[:-1]), swept.tolist(), strict=True), strict=True))
        guests = ones.copy()
        for src, (at, m) in asked.items():
            guests[at[:m]] += sent[src]
        top = seat(guests, word_weight(parent_tables - top, words), mix(w.view(np.uint64)), salt).astype(np.int64)
        if sampled:
            past += [guests, top]
        out = [{"part": part, "kind": "words", "src": part, "a": own["a"], "b": pack(top, *past)}]
        out.append({"part": part, "kind": "total", "src": part, "x": int(guests.sum()), "y": int(top.sum())})
        for src, (at, m) in asked.items():
            told = [known[at], *[x[at] for x in past]] if last else [guests[at[:m]], top[at[:m]]]
            out.append({"part": src, "kind": "told", "src": part, "a": pack(*told)})
        return pa.Table.from_pylist(out, schema=COLUMNS)

    return run


def tables_of(contexts: np.ndarray, ones: np.ndarray, ci: np.ndarray, t: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tables of restaurants; those of frequent words have them in all parts."""
    tables = ones + np.bincount(ci, t, len(contexts)).astype(np.int64)
    often, at = among(contexts.view(np.uint64), hot[0])
    tables[often] = hot[1][at[often]]
    return tables


def seated(parent_tables: int, all_guests: int, words: int, salt: int, sampled: bool, hot: tuple[np.ndarray, np.ndarray]):
    """A part's pairs with their tables drawn anew, sent to the parts of words; with ``sampled`` the tables before are kept."""

    def run(table: pa.Table) -> pa.Table:
        own = received(table, "state")[0]
        part, (ci, wi, c, ones, contexts, _, homes, starts, swept) = own["part"], unpack(own["a"])
        t, before, *past = unpack(own["b"])
        guests, top = np.zeros((2, int((starts + swept).max())), np.int64)
        begins = dict(zip(homes.tolist(), starts.tolist(), strict=True))
        for r in received(table, "told"):
            x, y = unpack(r["a"])
            a = begins[r["src"]]
            guests[a : a + len(x)], top[a : a + len(x)] = x, y
        tables = tables_of(contexts, ones, ci, t, hot)
        if sampled:
            before, past = before + t, [*past, tables]
        if len(t):
            key = mix(mix(np.arange(len(t), dtype=np.uint64)) + np.uint64(part))
            of = dish_weight(tables[ci] - t, guests[wi] - t, all_guests - t, parent_tables - top[wi], words)
            t = seat(c, of, key, salt).astype(np.int64)
        out = [{"part": part, "kind": "state", "src": part, "a": own["a"], "b": pack(t, before, *past)}]
        sums = np.bincount(wi, t, len(guests)).astype(np.int64)
        for q, a, m in zip(homes.tolist(), starts.tolist(), swept.tolist(), strict=True):
            out.append({"part": q, "kind": "sums", "src": part, "a": pack(sums[a : a + m])})
        mine = ones + np.bincount(ci, t, len(contexts)).astype(np.int64)
        for i in np.flatnonzero(among(contexts.view(np.uint64), hot[0])[0]).tolist():
            out.append({"part": part, "kind": "hot", "src": int(contexts[i]), "x": int(mine[i])})
        return pa.Table.from_pylist(out, schema=COLUMNS)

    return run


def chances(table: pa.Table, hot: tuple[np.ndarray, np.ndarray], hot_all: np.ndarray, parents: list[tuple[int, int]], words: int) -> tuple[np.ndarray, ...]:
    """A part's pairs in order: context's place, word's place, mean probability, and the word's training tokens; and the contexts."""
    contexts, sizes, wi, c = unpack(received(table, "all")[0]["a"])
    own = received(table, "state")[0]
    ci, _, _, ones_, contexts_, needed, homes, starts, _ = unpack(own["a"])
    t, before, *past = unpack(own["b"])
    past = [*past, tables_of(contexts_, ones_, ci, t, hot)]
    begins = dict(zip(homes.tolist(), starts.tolist(), strict=True))
    told = sorted(((begins[r["src"]], unpack(r["a"])) for r in received(table, "told")), key=lambda x: x[0])
    known, *states = (np.concatenate(x) for x in zip(*[x for _, x in told], strict=True))
    ci = np.repeat(np.arange(len(contexts)), sizes)
    alls, ones = np.bincount(ci, c, len(contexts)), np.bincount(ci[c == 1], minlength=len(contexts))
    often, at = among(contexts.view(np.uint64), hot[0])
    alls[often] = hot_all[at[often]]
    taken = np.where(c == 1, SAMPLES, 0)
    taken[c > 1] = before + t
    shared = 0.0
    for i, (all_guests, parent_tables) in enumerate(parents):
        tables = ones.copy()
        tables[needed] = past[i]
        share = (states[2 * i] - DISCOUNT * states[2 * i + 1] + (STRENGTH + DISCOUNT * parent_tables) / (words + 1)) / (STRENGTH + all_guests)
        shared = shared + (STRENGTH + DISCOUNT * tables)[ci] * share[wi]
    return ci, wi, (c * SAMPLES - DISCOUNT * taken + shared) / (STRENGTH + alls[ci]) / SAMPLES, known[wi], contexts


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()  # Spark deletes shuffle files of plans that are gone


def by_part(name: str, run, *tables: DataFrame) -> DataFrame:
    """The rows that a step makes of each part's, written."""
    rows = tables[0].select(COLUMNS.names)
    for df in tables[1:]:
        rows = rows.unionByName(df.select(COLUMNS.names))
    return materialize(rows.groupBy("part").applyInArrow(run, MESSAGE), name)


def sampled_parts(sent: DataFrame, parts: int, hot: np.ndarray) -> tuple[DataFrame, DataFrame, Callable, int, int]:
    """All sweeps over what the chunks sent: the parts' pairs and texts, what the last step reads, how it gets probabilities, the number of training tokens, and of known words."""
    base = materialize(sent.groupBy("part").applyInArrow(counting(parts, hot), sent.schema), "parts")
    base.sparkSession._jvm.System.gc()  # Spark deletes the shuffle files of what the chunks sent before sweeps write more
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))

    def totals(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = sorted((r.src % (1 << 64), r.x, r.y or 0) for r in of(df, "hot").groupBy("src").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect())
        return tuple(np.array([r[i] for r in found], t) for i, t in enumerate((np.uint64, np.int64, np.int64)))

    def total(df: DataFrame) -> tuple[int, int]:
        return tuple(of(df, "total").agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first())

    state, *tables, hot_all = base, *totals(base)
    words = by_part("words", naming, of(base, "ask"))
    tokens_, vocabulary = total(words)
    parent_tables, parents, last = vocabulary, [], BURN_IN + SAMPLES - 1
    for sweep in range(last + 1):
        sampled, old = sweep >= BURN_IN, [words, *([] if state is base else [state])]
        words = by_part("words", seated_words(parent_tables, vocabulary, 2 * sweep, sampled, sweep == last), of(words, "words"), of(state, "sums"))
        all_guests, parent_tables = total(words)
        if sampled:
            parents.append((all_guests, parent_tables))
        if sweep < last:
            state = by_part("state", seated(parent_tables, all_guests, vocabulary, 2 * sweep + 1, sampled, tuple(tables)), of(words, "told"), of(state, "state"))
            tables = totals(state)[:2]
            for df in old:
                remove(df)
        else:
            remove(old[0])
    rows = of(base, "all", "posts").select(COLUMNS.names).unionByName(of(state, "state")).unionByName(of(words, "told"))
    return base, rows, lambda table: chances(table, tuple(tables), hot_all, parents, vocabulary), tokens_, vocabulary


def seatings(pairs: DataFrame) -> tuple[DataFrame, int, int]:
    """``pairs`` (``ctx, w, c``, one row each) with ``p``, the mean probability of the word after the context, and ``known``, the word's training tokens; the number of those, and of known words."""
    pairs = materialize(pairs.select("ctx", "w", "c"), "pairs")
    parts = parts_of(pairs.count())
    contexts = pairs.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
    often = contexts.where(F.col("n") >= max(1.0, FREQUENT_SHARE * pairs.count())).orderBy(F.col("n").desc()).limit(round(1 / FREQUENT_SHARE)).collect()
    hot = np.array(sorted(r.ctx % (1 << 64) for r in often), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            ctx, w, c = (x.to_numpy() for x in batch.columns)
            order = np.lexsort((w.view(np.uint64), ctx.view(np.uint64)))
            for sent in sending(ctx[order].view(np.uint64), w[order].view(np.uint64), c[order], parts, hot, i, None):
                yield from pa.Table.from_pylist(sent, schema=COLUMNS).to_batches()

    _, rows, probabilities, total, words = sampled_parts(pairs.mapInArrow(run, MESSAGE), parts, hot)

    def told(table: pa.Table) -> pa.Table:
        ci, wi, p, known, contexts = probabilities(table)
        vocabulary = unpack(received(table, "all")[0]["b"])[0]
        return pa.table({"ctx": contexts[ci], "w": vocabulary[wi], "p": p, "known": known})

    return materialize(rows.groupBy("part").applyInArrow(told, "ctx bigint, w bigint, p double, known bigint"), "chances"), total, words


def scores(probabilities: Callable, total: int, words: int):
    """What a part's pairs score in each chunk's texts: sums of the base's and the model's log10 probabilities, known tokens and tokens."""

    def run(table: pa.Table) -> pa.Table:
        _, _, p, known, _ = probabilities(table)
        part, out = table["part"][0].as_py(), []
        values = np.log10((known + 1) / (total + words + 1)), np.log10(p), (known > 0).astype(np.float64)
        for r in received(table, "posts"):
            posted, text, n = unpack(r["b"])
            pair = np.repeat(np.cumsum(unpack(r["a"])[0]), posted)
            sums = [np.bincount(text, n * x[pair]) for x in values]
            out.append({"part": part, "kind": "score", "src": r["src"], "a": pack(*sums[:2], sums[2].astype(np.int64), np.bincount(text, n).astype(np.int64))})
        return pa.Table.from_pylist(out, schema=COLUMNS)

    return run


def added(table: pa.Table) -> pa.Table:
    """The texts of a chunk with all parts' sums."""
    rows = sorted(table.select(["part", "src", "a"]).to_pylist(), key=lambda r: r["part"])
    lots = [unpack(r["a"]) for r in rows]
    sums = [np.zeros(max(len(x[0]) for x in lots), t) for t in (float, float, np.int64, np.int64)]
    for lot in lots:
        for to, x in zip(sums, lot, strict=True):
            to[: len(x)] += x
    return pa.table({"of": rows[0]["src"] + np.arange(len(sums[0])), "base": sums[0], "score": sums[1], "known": sums[2], "n": sums[3]})


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Tokens are words, lower-cased A-Z, then one end. The model learns from the
    rows for which ``held_out`` isn't true. ``score`` is the log10 probability
    of the text, ``base_score`` that of the add-one unigram model. A null text
    is one end. Repeated rows are counted and scored each; null ids are kept. If no row is for
    training all words are unknown. An empty table gives no rows. Other columns are
    ignored.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("t"))
    parts, hot = placing(texts)
    base, rows, probabilities, total, words = sampled_parts(chunks(texts, parts, hot), parts, hot)
    sums = materialize(rows.groupBy("part").applyInArrow(scores(probabilities, total, words), MESSAGE), "scores")
    sums = sums.groupBy("src").applyInArrow(added, "of bigint, base double, score double, known bigint, n bigint")
    texts = base.where("kind = 'text'").select(F.col("src").alias("row"), "doc_id", "held_out")
    return texts.join(sums, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n")).alias("perplexity"),
    )


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    return scored.drop("perplexity")
