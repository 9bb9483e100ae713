"""Spelling variants against all pairs, the index against plain search, and edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from oracle import DATA

from tidemark.llm import spelling as S
from tidemark.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits_apart(words):
    """Pairs one edit apart, by what is left when a letter is taken out."""
    by, out = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                out[w].add(w[:i] + w[i + 1 :])
                out[w[:i] + w[i + 1 :]].add(w)
    for same in by.values():
        for w in same:
            out[w] |= same - {w}
    return out


def plain(docs):
    count = collections.Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near, form = edits_apart(set(n)), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(QUERIES["op12_spelling_variants"](spark, f"{DATA}/{sf}"))
    assert got == plain(docs) and any(r[1] for r in got) and any(r[1] and r[1] != r[2] for r in got) == any(r[1] and r[1] != r[2] for r in plain(docs))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghé", "a"])
def test_search_finds_all_pairs(alphabet):
    rnd = random.Random(len(alphabet))
    words = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(7, 12))) for _ in range(400)})
    near = edits_apart(set(words))
    for turned in (False, True):
        turn = (lambda w: w[::-1]) if turned else (lambda w: w)
        index, got = S.Index([turn(w) for w in words]), set()
        for d in (-1, 0, 1):
            size = np.array([len(w) for w in words])
            exact = size // 2 if turned else size - size // 2
            q, w = S.search(index, [turn(x) for x in words], size + d, exact)
            got |= {(words[a], words[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True)}
        half = (lambda a, b: b.startswith(a[: len(a) // 2])) if turned else (lambda a, b: b.endswith(a[len(a) // 2 :]))
        assert got == {(a, b) for a in words for b in near[a] if half(a, b)}


def test_split_groups_give_the_same(spark, monkeypatch):
    """Cells of so few letters that groups are split into grids, and states worked on few at a time."""
    rnd = random.Random(5)
    docs = [(i, " ".join("pre" + "".join(rnd.choice("abc") for _ in range(rnd.randint(4, 6))) + "end" for _ in range(40))) for i in range(40)]
    want = plain(docs)
    monkeypatch.setattr(S, "CELL", 500)
    monkeypatch.setattr(S, "STATES", 7)
    assert rows(S.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string"))) == want and len(want) > 100


def test_edges(spark):
    words = ["a" * 3000, "a" * 3001, "Éclairs×", "éclairs×", "STRAßEN", "strasseßn", "variant", "variants"]
    docs = [(1, None, "x", 1), (2, "", "x", 1), (None, " ".join(words), "x", 2), (2, "一".join(words * 3), None, 1), (2, "一".join(words * 3), None, 1), (9, "variant, " * 90, "x", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word string, n int")
    assert rows(S.spelling_variants(df)) == plain([d[:2] for d in docs])
    assert S.spelling_variants(df.limit(0)).collect() == []


def test_chains_are_followed_to_the_end(spark):
    chain = [("w0", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "w4"), ("w4", "w5"), ("x", "w3")]
    got = dict(tuple(r) for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w5" for w, _ in chain}
