"""Language identification: held-out accuracy over a whole table, sums against a plain version, and edge cases."""

import zlib

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tidemark.llm import language_id as L
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, _lang string, value int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = QUERIES["op13_language_id"](spark, f"{DATA}/sf0.01")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def plain(text, size):
    """The sum of products of rotated letters, run by run."""
    code = [0]
    for c in text:
        x = int(L.letters()[ord(c)])
        if x or code[-1]:
            code.append(x)
    if code[-1]:
        code.append(0)
    out = np.zeros(size, np.int64)
    for i in range(len(code) - 2):
        a, b, c = (L.signs(np.array([x]), size)[0].astype(np.int64) for x in code[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_bundles_are_sums_of_bound_runs(monkeypatch):
    texts = ["Der die, das", "", "a", "12 .. 3", "aaaa aaaa\n  aaaa", "éÀß日本語 x", "\ud800x"]
    for table, runs in ((L.TABLE, L.RUNS), (1, 3)):
        monkeypatch.setattr(L, "TABLE", table)
        monkeypatch.setattr(L, "RUNS", runs)
        of, at, known, some = L.runs_of(texts)
        got = L.bundles(of, at, known, len(texts), 128)
        assert some.tolist() == [True, False, True, False, True, True, True]
        for i, t in enumerate(texts):
            assert (got[i] == (plain(t, 128) if some[i] else 0)).all()


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x", 1), (2, "der hund und die katze", "de", "x", 1), (2, None, "de", None, None), (None, "", "en", "x", 1), (5, "123 !?", None, "x", 1), (6, "the dog", None, "x", 1), (7, "und die " * 50_000, "und", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.held_out, r.lang_pred) for r in L.language_id(docs, F.col("doc_id") > 2).collect()]
    assert sorted(got, key=str) == sorted([(1, False, "en"), (2, False, "de"), (2, False, "und"), (None, False, "und"), (5, True, "und"), (6, True, "en"), (7, True, "de")], key=str)
    assert L.language_id(docs.limit(0), F.lit(False)).collect() == []
    assert {(r.lang_pred, r.score) for r in L.language_id(docs, F.lit(True)).collect()} == {("und", 0.0)}


def test_many_languages_are_compared_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, f"l{i}", "x", 1) for i, t in enumerate(["the cat", "der hund", "le chat", "the cat", "el gato"])], SCHEMA)
    want = [(r.doc_id, r.lang_pred, pytest.approx(r.score)) for r in L.language_id(docs, F.lit(False)).orderBy("doc_id").collect()]
    assert want[3][1] == "l0"  # the smaller of two equal ones
    monkeypatch.setattr(L, "LANGUAGES", 2)
    assert [(r.doc_id, r.lang_pred, r.score) for r in L.language_id(docs, F.lit(False)).orderBy("doc_id").collect()] == want
