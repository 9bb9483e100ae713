"""The model of word pairs over several parts, and what it writes; hashes of words from bytes."""

import re
import tracemalloc
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm import _common, pitman_yor, suffix_dedup

SF = "/root/testdata/sf0.01"


def test_words_are_hashed_from_bytes():
    texts = ["The cat  sat\n", " the CAT", "", "\t \n", "Éa b\x0bc É x\x85y", "z" * 400 + " " + "Z" * 400, "tab\tend"]
    data = [t.encode() for t in texts]
    hashes, counts = _common.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    words = [re.findall(_common.WORD, t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    lower = [w.translate({c: c + 32 for c in range(65, 91)}) for found in words for w in found]
    of = dict(zip(lower, hashes.tolist(), strict=True))
    assert [of[w] for w in lower] == hashes.tolist() and len(set(of.values())) == len(of)


def test_arrays_are_unpacked_as_they_were_packed():
    given = [np.array([1, 2**40, 5]), np.array([0.5, -2.0]), np.array([], np.int64), np.array([3, 0], np.uint8)]
    assert [x.tolist() for x in _common.unpack(_common.pack(*given))] == [x.tolist() for x in given]
    high = np.array([2**64 - 1, 7], np.uint64)
    assert (_common.unpack(_common.pack(high))[0].view(np.uint64) == high).all()


def test_probabilities_sum_to_one_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "LEAST", 500)
    counts = [(x, w, 0 if (x + w) % 50 == 7 else 1 + 20_000 // ((x + 1) * (w + 1)) % 40) for x in range(20) for w in range(400)]
    unknown = [(x, 1000, 0) for x in range(20)]
    assert pitman_yor.parts_of(len(counts) + len(unknown)) > 10
    pairs, total, words = pitman_yor.seatings(spark.createDataFrame(counts + unknown, "ctx bigint, w bigint, c bigint"))
    assert (total, words, pairs.count()) == (sum(c for _, _, c in counts), 400, 8020)
    sums = [r.p for r in pairs.groupBy("ctx").agg(F.sum("p").alias("p")).collect()]
    assert len(sums) == 20 and all(x == pytest.approx(1, abs=1e-9) for x in sums)


def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4, "doc_id")
    return {r.doc_id: r for r in pitman_yor.score_texts(docs, F.col("doc_id") % 7 == 2).collect()}


def test_parts_and_chunks_change_no_count_and_what_is_written_stays_small(spark, monkeypatch):
    written, write = [], pitman_yor.materialize

    def weighed(df, name):
        found = write(df, name)
        written.append(sum(Path(urlparse(f).path).stat().st_size for f in found.inputFiles()))
        return found

    monkeypatch.setattr(pitman_yor, "materialize", weighed)
    few = scored(spark)
    text = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    # With a row for each pair the largest table, of all pairs' probabilities, had 2.09 times the text's bytes.
    assert max(written) < 1.7 * text, [w / text for w in written]
    monkeypatch.setattr(pitman_yor, "LEAST", 20_000)
    monkeypatch.setattr(pitman_yor, "TOKENS", 30_000)
    many = scored(spark)
    assert few.keys() == many.keys()
    for d, r in few.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (many[d].n_tokens, many[d].n_known, many[d].train_tokens)
        assert r.base_score == pytest.approx(many[d].base_score)
    held = [d for d, r in few.items() if r.held_out]
    mean = [sum(x[d].score for d in held) / sum(x[d].n_tokens for d in held) for x in (few, many)]
    assert mean[0] == pytest.approx(mean[1], abs=0.002)


def test_first_digits_read_words_from_bytes(spark):
    """No list of words or of their hashes is made by the JVM or for Python; equal runs have equal keys and others have not."""
    text = " ".join(f"w{i * i % 101}" for i in range(300))
    rows = [(1, f"x y {text}"), (2, f"Other START {text.upper()} end"), (3, text.replace("w5 ", "v5 "))]
    docs = spark.createDataFrame(rows, "doc_id bigint, t string").withColumn("v", F.col("doc_id"))
    digits = suffix_dedup.first_digits(docs, 50, 8, True)
    plan = digits._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan
    words = {d: re.findall(_common.WORD, t.lower()) for d, t in rows}
    found = digits.collect()
    assert {(r.doc_id, i) for r in found for i in range(r.low, r.high + 1)} == {(d, i) for d, w in words.items() for i in range(len(w) - 49)}
    of = {}
    for r in found:
        held = (r.anchor - r.low, r.anchor - r.high, *words[r.doc_id][r.low : r.high + 50])
        assert of.setdefault(bytes(r.whole), held) == held
    assert len(of) == len(set(of.values())) < len(found)


def test_pairs_of_texts_are_the_same_however_they_are_sorted():
    words = np.array([5, 9, 5, 9, 1, 2**64 - 1, 9, 5, 9, 1], np.uint64)
    sizes = np.array([4, 1, 5])
    vocabulary, code, text, times = pitman_yor.text_pairs(words, sizes)
    assert vocabulary.tolist() == [1, 5, 9, 2**64 - 1]
    before = np.roll(words, 1)
    want = sorted(Counter((b, w, t) for b, w, t in zip(before.tolist(), words.tolist(), np.repeat([0, 1, 2], sizes).tolist(), strict=True)).items())
    assert [((vocabulary[c // 4], vocabulary[c % 4], t), n) for c, t, n in zip(code.tolist(), text.tolist(), times.tolist(), strict=True)] == want
    for x, y in zip((vocabulary, code, text, times), pitman_yor.text_pairs(words, sizes, 0), strict=True):
        assert x.tolist() == y.tolist()


def test_a_chunk_takes_few_bytes_a_token():
    class Texts:
        schema = StructType([StructField("doc_id", LongType())])

        def mapInArrow(self, run, schema):
            return run

    rnd, n = np.random.default_rng(1), 800
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.3, 500) % 100_000) for _ in range(n)]
    rows = pa.table({"row": range(n), "doc_id": range(n), "held_out": [False] * n, "t": texts})
    run, sent = pitman_yor.chunks(Texts(), 32, np.zeros(0, np.uint64)), 0
    tracemalloc.start()
    for batch in run(iter(rows.combine_chunks().to_batches())):
        sent += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == n + 32 and peak < 90 * 501 * n  # 113 bytes before
