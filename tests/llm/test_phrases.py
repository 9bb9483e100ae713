"""Phrase collocations against a plain count of all phrases, at small blocks and tiles, and edge cases."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, rank string, n int"


def plain(docs, least, longest=5, first=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {p: a for p, a in f.items() if a >= least}
    inside = collections.defaultdict(int)
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    by = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and inside[lang, p] < a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode("utf-8", "surrogatepass"), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode("utf-8", "surrogatepass"), -a, left, right, n[lang], -s) for lang, rows in by.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)}


def rows(df):
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block, dense", [(1 << 20, 1 << 15), (50, 1)])
def test_all_phrases(spark, monkeypatch, block, dense):
    rnd = random.Random(3)
    docs = [(" ".join(rnd.choice(["Ab", "b", "c", "d.", "e\n", "ê", "b"]) for _ in range(60)), rnd.choice(["en", "de", None, "und"])) for _ in range(80)]
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "DENSE", dense)
    monkeypatch.setattr(P, "TILE_BITS", 1 if dense == 1 else 10)
    monkeypatch.setattr(P, "BYTES", 16 if dense == 1 else 1 << 20)
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0 if dense == 1 else 1_000_000)
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(3)
    want = plain(docs, 4)
    assert rows(P.collocations(df, least=4)) == want and len(want) > 300
    assert rows(P.collocations(df, least=4, first=5)) == {r for r in want if r[1] <= 5}


def test_counts_do_not_depend_on_tiles(monkeypatch):
    rnd = np.random.default_rng(1)
    a, b = rnd.zipf(1.3, 20_000) % 5000, rnd.zipf(1.3, 20_000) % 70_000
    want = collections.Counter(zip(a.tolist(), b.tolist(), strict=True))
    for dense in (1, 50, 1 << 30):
        monkeypatch.setattr(P, "DENSE", dense)
        x, y, c = P.count_pairs(a, b)
        assert len(x) == len(want) and dict(zip(zip(x.tolist(), y.tolist(), strict=True), c.tolist(), strict=True)) == want


def test_scores_beyond_64_bits(spark):
    a, left, right, n = 10**11, 10**11 + 7, 3 * 10**11, 10**13
    df = spark.createDataFrame([(a, n, [left], [right]), (a, n, [left, right], [right, left])], "f bigint, n bigint, pre array<bigint>, suf array<bigint>")
    got = [tuple(r.c) for r in df.selectExpr(f"{P.CUT} AS c").collect()]
    score = 1000 * a * n // (left * right)
    assert got == [(score, 1, left, right), (min(1000 * a * n // (left * left), 1000 * a * n // (right * right)), 2, right, right)]


def test_edges(spark):
    long = "one two. " * 100_000 + "x" * 100_000
    docs = [(None, "en"), ("", "en"), (long, "en"), ("A\tb  a\tb\x0bA b", None), ("a b,a b", "und"), ("\x00 \x00 \x00", "en"), ("aa aa aa aa", "de")]
    df = spark.createDataFrame([(None, t, lang, None, 1) for t, lang in docs], SCHEMA)
    assert rows(P.collocations(df, least=2)) == plain(docs, 2)
    assert P.collocations(df.limit(0), least=2).collect() == []
    assert P.collocations(df, least=10**9).collect() == []


def test_a_block_takes_few_bytes_a_word():
    rnd, n, words = np.random.default_rng(1), 1 << 19, [f"w{i}" for i in range(30_000)]
    own = (rnd.zipf(1.2, n) % len(words)).astype(np.int32)
    own[::12] = -1
    held = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([own.tobytes()], pa.binary()), pa.array([["en"] * len(words)]), pa.array([words])], ["block", "ids", "langs", "words"])
    (texts,) = P.recoded_here(pa.array([f"en {w}" for w in words]))(iter([held]))
    assert texts.column(1).nbytes <= 4 * n + 64  # twice that before
    (pairs,) = P.counted(iter([texts]))
    a, b, c = (x.to_numpy() for x in pairs.columns[1:])
    both = (own[:-1] >= 0) & (own[1:] >= 0)
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), c.tolist(), strict=True)) == collections.Counter(zip(own[:-1][both].tolist(), own[1:][both].tolist(), strict=True))
    key = np.sort(P.joined(a, b)[c >= 5])
    # Bytes a word, before: 34 and 68.
    for step, most in ((P.paired_here(key, np.arange(len(key))), 24), (P.counted, 50)):
        tracemalloc.start()
        for _ in step(iter([texts])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * n, (step, peak / n)


def test_slices_of_a_block_change_no_name(monkeypatch):
    rnd = np.random.default_rng(2)
    ids = rnd.integers(0, 6, 500).astype(np.uint32)
    ids[rnd.random(500) < 0.1] = P.NONE
    names = {(a, b): 10 * a + b for a in range(6) for b in range(6) if (a + b) % 3}
    key = np.array([a << 32 | b for a, b in names], np.uint64)
    want = [names.get(x) for x in zip(ids.tolist(), ids[1:].tolist(), strict=False)] + [None]
    want = P.compact(np.array([P.NONE if x is None else x for x in want], np.uint32))
    for step in (1, 7, 499, 500, 1 << 17):
        monkeypatch.setattr(P, "STEP", step)
        assert P.named(ids, key, np.array([*names.values()])).tolist() == want.tolist()
