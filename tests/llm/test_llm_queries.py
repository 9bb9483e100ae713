"""The queries over whole tables, against their SQL or against plain versions."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest
from oracle import DATA, compare

from tidemark.llm.queries import QUERIES, SQL

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_model_base(spark, texts):
    got = result(spark, "op2_pitman_yor")
    tokens = {d: [*WORD.findall(t.translate(LOWER)), "\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = collections.Counter(w for d in texts if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert sum(r.score for d, r in got.items() if held[d]) > sum(r.base_score for d, r in got.items() if held[d])


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in sets}


def shingles(text, width):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def texts_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near(spark, sf):
    sets = {d: shingles(t, 2) for d, t in texts_of(spark, sf).items()}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op3_near_dedup"](spark, f"{DATA}/{sf}").collect()}
    assert got == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


def test_near_loses_no_link_on_a_larger_table(spark):
    """All links of sf0.1, from a prefix filter over the whole sets, lie within components; nothing else is joined."""
    sets = {d: shingles(t, 2) for d, t in texts_of(spark, "sf0.1").items()}
    count = collections.Counter(x for s in sets.values() for x in s)
    postings, links = collections.defaultdict(list), []
    for d, s in sorted(sets.items(), key=lambda x: len(x[1])):
        first = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-len(s) * 80 // 100) + 1]
        for e in {e for x in first for e in postings[x]}:
            if 100 * len(s & sets[e]) >= 80 * len(s | sets[e]):
                links.append((d, e))
        for x in first:
            postings[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in QUERIES["op3_near_dedup"](spark, f"{DATA}/sf0.1").collect()}
    assert links and got == {d: find(d) for d in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repeats(spark, sf):
    data = {d: t.encode() for d, t in texts_of(spark, sf).items()}
    seen = collections.Counter(hash(b[i : i + 400]) for b in data.values() for i in range(len(b) - 399))
    got = {r.doc_id: r for r in QUERIES["op4_repeats"](spark, f"{DATA}/{sf}").collect()}
    for d, b in data.items():
        covered = bytearray(len(b))
        end = 0
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                covered[max(i, end) : i + 400] = b"\1" * (i + 400 - max(i, end))
                end = i + 400
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())


def test_tokens(spark, texts):
    import tiktoken

    from tidemark.llm import bpe

    path, pattern = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    for d, r in result(spark, "op6_bpe").items():
        ids = own.encode_ordinary(texts[d])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest())


def test_secrets(spark, texts):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for d, r in result(spark, "op7_secrets").items():
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(texts[d]) if len(m[1]) >= 12]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", texts[d]) if len(m[0]) >= 18]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", texts[d]) if len(m[0]) >= 16]
        shown = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_pages(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/{sf}/pages.parquet").collect()}
    got = QUERIES["op8_html_text"](spark, f"{DATA}/{sf}").collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pipeline(spark, texts):
    import corpus_pipeline

    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert docs.columns == columns or name == "bpe"
    clean, exact, near, mixed, tokens = kept
    quality = {r.doc_id for r in QUERIES["op1_quality"](spark, SF).collect() if r.kept}
    assert set(clean) == quality and len(clean) == len(quality)
    largest = {}
    for d in clean:
        largest[texts[d].translate(LOWER)] = max(d, largest.get(texts[d].translate(LOWER), d))
    assert sorted(exact) == sorted(largest.values())
    comp = components({d: shingles(texts[d], 5) for d in sorted(exact)})
    assert sorted(near) == sorted(set(comp.values()))
    assert set(mixed) <= set(near) and max(collections.Counter(mixed).values()) <= 3
    assert sorted(tokens) == sorted(mixed)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in docs.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repeated_passages_of_words(spark, sf):
    rows = spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()
    words = {r.doc_id: WORD.findall((r.text or "").translate(LOWER)) for r in rows}
    seen = collections.Counter(hash(tuple(w[i : i + 50])) for w in words.values() for i in range(len(w) - 49))
    want = {d: len({i + k for i in range(len(w) - 49) if seen[hash(tuple(w[i : i + 50]))] > 1 for k in range(50)}) for d, w in words.items()}
    got = {r.doc_id: r for r in QUERIES["op4_repeats"](spark, f"{DATA}/{sf}").collect()}
    assert {d: r.n_repeat_words for d, r in got.items()} == want and any(want.values())
    assert all(r.n_left == r.n_bytes - r.n_removed for r in got.values())


def test_mix_comes_near_its_targets(spark):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    taken, target = collections.Counter(), {}
    for r in QUERIES["op10_mixing"](spark, f"{DATA}/sf0.01").collect():
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
