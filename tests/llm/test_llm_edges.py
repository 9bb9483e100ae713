"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, html_extract, mixing, near_dedup, pitman_yor, quality, secrets, suffix_dedup, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept boolean, comp string, h string, t string"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
SENTENCE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, SENTENCE), (5, SENTENCE.upper()), (6, SENTENCE + " thirteen"), (None, "lonely text with a null id"), (7, " \t\n"), (8, "é" * 500), (9, "é" * 500)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None if i == 8 else "en", None if i in (8, 9) else "s", 0, 1, True, "x", "y", "z") for i, t in rows], SCHEMA)


VOCABULARY = bpe.vocabulary()
OPERATORS = {
    "quality": quality.quality,
    "exact": exact_dedup.exact_dedup,
    "near": near_dedup.near_duplicates,
    "mix": mixing.mix,
    "bpe": lambda d: bpe.encode(d, *VOCABULARY),
    "secrets": secrets.scan_secrets,
    "repeats": suffix_dedup.remove_repeats,
    "model": lambda d: pitman_yor.score_texts(d, F.col("doc_id") == 4),
    "html": lambda d: html_extract.extract(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    rows = OPERATORS[name](docs(spark)).collect()
    assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark).where("false")).collect() == []


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_exact(spark):
    got = by_id(exact_dedup.exact_dedup(docs(spark)))
    assert (got[1].keep_id, got[2].kept, got[1].kept, got[1].group_size) == (2, True, False, 2)
    assert (got[4].keep_id, got[5].kept, got[6].group_size) == (5, True, 1)
    assert (got[3].group_size, got[3].kept, got[None].kept, got[8].keep_id) == (2, True, True, 9)


def test_exact_query_has_a_row_per_document_with_null_and_repeated_ids(spark, tmp_path):
    import hashlib

    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact_dedup.op9_exact_dedup(spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256((t or "").lower().encode()).hexdigest()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), digest(t)) for i, t in TEXTS)


def test_near(spark):
    got = by_id(near_dedup.near_duplicates(docs(spark), width=2))
    assert {got[i].component_id for i in (4, 5, 6)} == {4} and got[6].n_shingles == 12
    assert got[1].n_shingles == 0 and got[1].component_id == 1 and got[7].component_id == 7 and got[None].kept
    assert got[9].component_id == 8


def test_mix(spark):
    got = mixing.mix(docs(spark)).collect()
    assert {r.size for r in got if r.doc_id in (1, 2, 7)} == {0} and max(r.repeats for r in got) <= 3


def test_mix_clamps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30.0 and got["b"] == 300.0 and got["c"] == 780.0 and got[None] == 0.0
    assert mixing.source_targets(sizes.where("size = 0")).first().target == 0.0


def test_repeats(spark):
    got = by_id(suffix_dedup.remove_repeats(docs(spark)))
    assert got[1].n_bytes == 0 and got[3].kept == b"" and got[8].kept == b"" and len(got[8].spans) == 1
    assert got[4].kept.decode() == SENTENCE


def test_repeats_within_one_text_and_overlapping(spark):
    text = "".join(chr(33 + (i * 7919 + i * i * 31) % 90) for i in range(700))
    rows = [(1, text[:450] + "|" + text[100:600]), (2, "a" * 401), (3, "b" * 400), (4, text[:399])]
    got = by_id(suffix_dedup.remove_repeats(docs(spark, rows)))
    whole = rows[0][1].encode()
    covered = bytearray(len(whole))
    for i in range(len(whole) - 399):
        if whole.count(whole[i : i + 400]) > 1 or whole.find(whole[i : i + 400]) != whole.rfind(whole[i : i + 400]):
            covered[i : i + 400] = b"\1" * 400
    assert got[1].kept == bytes(b for b, c in zip(whole, covered, strict=True) if not c)
    assert got[2].kept == b"" and got[3].n_bytes == len(got[3].kept) and got[4].spans == []


def test_bpe_matches_tiktoken_and_round_trips(spark):
    import tiktoken

    path, pattern = VOCABULARY
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    odd = "".join(chr(c) for c in range(1, 0x3100, 3)) + " <|endoftext|>\r\n  x  'll 𝒳́ 12٣४½  ﻿ 🙂‍🙂"
    rows = [*TEXTS, (20, odd), (21, "a" * 3000), (22, "日本語のテキスト " * 50)]
    encoded = bpe.encode(docs(spark, rows), path, pattern)
    for r in encoded.collect():
        text = next(t or "" for i, t in rows if i == r.doc_id)
        assert r.ids == own.encode_ordinary(text)
        assert len(r.starts) == len(r.ids) and all(0 <= a <= b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
    for r in bpe.decode(encoded, path).collect():
        assert r["bytes"].decode() == next(t or "" for i, t in rows if i == r.doc_id)


def test_model_is_nearly_a_distribution_and_beats_the_base(spark):
    rows = [(i, " ".join(["the cat sat", "a dog ran", f"odd{i} thing"][(i + j) % 3] for j in range(30))) for i in range(60)]
    got = pitman_yor.score_texts(docs(spark, rows), F.col("doc_id") % 7 == 2).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.n_known <= r.n_tokens and r.score < 0 for r in got)
    again = {r.doc_id: r.score for r in pitman_yor.score_texts(docs(spark, rows), F.col("doc_id") % 7 == 2).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)


def test_seats_follow_their_conditional():
    import numpy as np

    n, c, new = 40_000, 3, 0.7
    drawn = pitman_yor.seat(np.full(n, c), np.full(n, new), pitman_yor.mix(np.arange(n, dtype=np.uint64)), 5)
    d = pitman_yor.DISCOUNT
    weights = np.array([new * (1 - d) * (2 - d), new**2 * ((1 - d) + (2 - 2 * d)), new**3])  # seatings of three customers at 1, 2, 3 tables
    want = weights / weights.sum()
    assert np.abs(np.bincount(drawn.astype(int), minlength=4)[1:] / n - want).max() < 0.01
    large = pitman_yor.seat(np.full(10, 5000), np.full(10, 2.0), np.arange(10, dtype=np.uint64), 1)
    assert (large >= 1).all() and 2 <= large.mean() <= 8  # exact weights are compared below


@pytest.mark.parametrize("new", [0.01, 1.0, 10.0, 100.0, 1000.0])
@pytest.mark.parametrize("c", [65, 300, 2000])
def test_tables_of_many_customers_follow_the_exact_weights(c, new):
    import numpy as np

    t = np.arange(1, c + 1)
    weights = pitman_yor.log_seatings(pitman_yor.DISCOUNT, c)[c, 1:] + t * np.log(new)
    weights = np.exp(weights - weights.max())
    mean = (weights @ t) / weights.sum()
    spread = np.sqrt((weights @ (t - mean) ** 2) / weights.sum())
    n = 10_000
    drawn = pitman_yor.seat(np.full(n, c), np.full(n, new), pitman_yor.mix(np.arange(n, dtype=np.uint64)), 5)
    assert abs(drawn.mean() - mean) < 0.05 * spread + 0.002
    assert abs(drawn.std() - spread) < 0.05 * spread + 0.01


def test_every_preceding_word_is_a_context(spark):
    # Each of 600 words, all rare, is followed by a word of its own.
    rows = [(i, " ".join(f"a{(i * 7 + j * 11) % 600} b{(i * 7 + j * 11) % 600}" for j in range(50))) for i in range(140)]
    indexed = pitman_yor.index(docs(spark, rows).select(F.col("doc_id").alias("row"), "doc_id", F.lit(False).alias("held_out"), F.transform(F.split(F.concat("text", F.lit(" \n")), " "), lambda w: F.xxhash64(w)).alias("h")))
    assert indexed.where("w is not null").agg(F.count_distinct("ctx")).first()[0] == 1201
    got = pitman_yor.score_texts(docs(spark, rows), F.col("doc_id") % 7 == 2).where("held_out").collect()
    # A word that follows for certain costs little, so a pair costs little more than its first word.
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_probabilities_sum_to_one_with_large_counts(spark):
    counts = [(x, w, 0 if (x + w) % 50 == 7 else 1 + 200_000 // ((x + 1) * (w + 1))) for x in range(20) for w in range(400)]
    pairs = spark.createDataFrame(counts, "ctx bigint, w bigint, c bigint")
    # A word that no context knows stands for the one unknown.
    unknown = spark.createDataFrame([(x, 1000, 0) for x in range(20)], "ctx bigint, w bigint, c bigint")
    chances, total, words = pitman_yor.seatings(pairs.union(unknown))
    assert (total, words) == (sum(c for _, _, c in counts), 400)
    sums = [r.p for r in chances.groupBy("ctx").agg(F.sum("p").alias("p")).collect()]
    assert len(sums) == 20 and all(x == pytest.approx(1, abs=1e-9) for x in sums)


def test_model_without_training_rows(spark):
    got = pitman_yor.score_texts(docs(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got)] == [(3, 0, 0), (1, 0, 0)]


def test_secrets(spark):
    key, secret = "AKIA" + "ABCDEFGHIJ234567", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab"
    pad = " lorem ipsum" * 60
    rows = [(1, f"id {key} then {secret} at https://api.example.com/v1"), (2, f"only {secret} here"), (3, f"{key}{pad}{secret}"), (4, 'Api_Key: "abcdefghijkl" password=short token = 0123456789abcdef'), (5, None), (6, "see https://example.com now")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert [k for k, _, _ in got[1]] == ["access", "weak_secret", "endpoint"]
    assert got[2] == [] and [k for k, _, _ in got[3]] == ["access"] and got[5] == [] and got[6] == []
    assert [k for k, _, _ in got[4]] == ["assign", "assign", "hex"]


def test_secrets_of_rows_with_one_id_stay_apart(spark):
    key, secret = "AKIA" + "ABCDEFGHIJ234567", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab"
    rows = [(1, f"id {key}"), (1, f"id xx {secret}"), (None, f"id {key} {secret}"), (None, f"see {secret}"), (None, None)]
    got = sorted((str(r.doc_id), [(s.kind, s.start) for s in r.spans]) for r in secrets.scan_secrets(docs(spark, rows)).collect())
    assert got == [("1", []), ("1", [("access", 3)]), ("None", []), ("None", []), ("None", [("access", 3), ("weak_secret", 24)])]


def test_overlaps_of_weak_parts_equal_all_pairs():
    text = " ".join(f"user=abcdefgh{i} token={'ab12' * (i % 12)} {'A1b2' * 9} AKIA{'Q' * (i % 20)}" for i in range(60))
    found = secrets.parts(text)
    base = [(a, b) for a, b, k in found if k in secrets.BASE]
    weak = {(a, b) for pattern in (secrets.USER, secrets.OPAQUE, secrets.ENDPOINT) for a, b in [m.span() for m in pattern.finditer(text)]}
    assert {(a, b) for a, b, k in found if k not in secrets.BASE} == {w for w in weak if not any(a < w[1] and w[0] < b for a, b in base)}


def test_interval_join_equals_all_pairs(spark):
    import random

    random.seed(5)
    parts = [(d, s, s + 5, random.choice(secrets.KINDS)) for d in range(8) for s in random.sample(range(3000), 30)]
    got = {tuple(r) for r in secrets.link(spark.createDataFrame(parts, "doc_id int, start bigint, end bigint, kind string"), 100).collect()}
    near = lambda p: any(q[0] == p[0] and abs(q[1] - p[1]) <= 100 and set(secrets.ROLES[q[3]]) & set(secrets.NEEDS[p[3]]) for q in parts)
    assert got == {p for p in parts if p[3] in secrets.BASE or near(p)}


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div><main><article><h1>Head &amp; tail</h1><p>First   <b>bold</b>\n text.<p>Second<!-- no --> one.</article></main><section id=comments><p>Reader says hi</section><footer>(c)</footer><script>var x='<p>';</script>"
    assert html_extract.main_text(page) == "Head & tail\nFirst bold text.\nSecond one."
    assert html_extract.main_text("") == "" and html_extract.main_text("<nav>only</nav>") == ""
    assert html_extract.main_text("plain words") == "plain words"


def test_ratio_decides_which_lines_stay(monkeypatch):
    import numpy as np

    links = "".join(f"<p><a href=/{i}>More about this {i}</a>" for i in range(6))
    page = f"<body><div class=promo><p>Buy now, it is cheap and good.</div><div><h2>Head</h2><p>A first paragraph of the text.<p>And a second one, a bit longer.{links}</div></body>"
    want = "Head\nA first paragraph of the text.\nAnd a second one, a bit longer."
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "content_lines", lambda lines: np.ones(len(lines), bool))
    off = html_extract.main_text(page)
    assert off != want and "More about" in off


def test_deep_pages_and_open_paragraphs():
    deep = "<div>" * 3000 + "<p>One<p>Two <b>and<p>three</b></p>" + "</div>" * 3000
    assert html_extract.main_text(deep) == "One\nTwo and\nthree"
    items = "<ul>" + "".join(f"<li>item number {i}</b>" for i in range(20_000)) + "</ul>"
    assert html_extract.main_text(items).count("\n") == 19_999


def test_web_archives(spark, tmp_path):
    tricky = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", tricky), (None, "u", "solo"), (6, "u", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, record_type string, d string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 7 and got[1].refers_to == 2 and got[1].record_type == "revisit" and got[1].payload_bytes == 4 and got[1].payload is None
    assert got[3].refers_to == 4 and got[5].payload == tricky.encode() and got[None].record_type == "response" and got[6].payload_bytes == 200_000
    import base64
    import hashlib

    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() for r in got.values() if r.payload is not None)
    warc.write_archives(pages.where("false"), str(tmp_path / "none"))


def test_web_archives_of_large_pages_repeated_and_named_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows = [("a", "u", "x" * 3000), ("b", "u", "x" * 3000), ("c", "u", "y" * 4000), ("c", "u", "y" * 4000), ("d", "u", "z"), (None, "u", "z")]
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1), str(tmp_path / "w"))
    got = sorted((r.page_id or "", r.record_type, r.refers_to or "", len(r.payload or "")) for r in warc.read_archives(spark, str(tmp_path / "w"), id_type="string").collect())
    assert got == [("", "revisit", "d", 0), ("a", "revisit", "b", 0), ("b", "response", "", 3000), ("c", "response", "", 4000), ("c", "response", "", 4000), ("d", "response", "", 1)]
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 5


def test_web_archives_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(30)]
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {i: ("revisit", 29) if i % 3 and i != 29 else ("response", None) for i in range(30)}


def test_quality(spark):
    clean = [(i, " ".join(f"the w{(i * 31 + j * j) % 400} of" if j % 4 == 0 else f"v{(i * 17 + j * 7) % 900}" for j in range(120))) for i in range(60)]
    rows = [*clean, (100, "### $$$ *** %%% &&& " * 3 + " ".join(f"{j}$$ %{j}" for j in range(90))), (101, "buy now cheap pills here today " * 40), (102, "too short"), (103, None)]
    got = by_id(quality.quality(docs(spark, rows)))
    assert all(got[i].kept for i, _ in clean)
    assert not got[100].kept and not got[100].base_failed and got[101].base_failed and got[102].base_failed and got[103].base_failed
    assert got[102].char_distance is None and got[103].n_words == 0


def test_pipeline_keeps_one_row_of_copies_that_share_an_id(spark):
    import corpus_pipeline

    near = SENTENCE + " " + " ".join(f"more{i}" for i in range(30))
    rows = [(1, "same text"), (1, "Same text"), (1, "other text"), (None, "third"), (None, "third"), (5, near), (5, near + " end"), (6, near + " stop"), (7, None), (7, "")]
    exact = corpus_pipeline.exact_duplicates(spark, docs(spark, rows), "")
    assert exact.columns == docs(spark, rows).columns
    kept = [(r.doc_id, (r.text or "").lower()) for r in exact.collect()]
    assert sorted(kept, key=str) == sorted([(1, "same text"), (1, "other text"), (None, "third"), (5, near), (5, near + " end"), (6, near + " stop"), (7, "")], key=str)
    left = corpus_pipeline.near_duplicate_groups(spark, exact, "").collect()
    assert len(left) == 5 and sum((r.text or "").startswith("one") for r in left) == 1
    assert corpus_pipeline.near_duplicate_groups(spark, docs(spark, rows).where("false"), "").collect() == []


def test_mix_breaks_ties_of_one_id_the_same_way_each_time(spark):
    rows = [(1, "a " * k) for k in (5, 9, 2, 9, 30)] + [(None, "b " * k) for k in (7, 7, 3)] + [(i, "c " * (i % 5 + 1)) for i in range(2, 40)]
    runs = [sorted((r.doc_id or 0, r.size, r.repeats) for r in mixing.mix(docs(spark, order)).collect()) for order in (rows, rows[::-1])]
    assert runs[0] == runs[1]


def test_joins_of_counted_groups_equal_a_plain_join(spark):
    from tidemark.llm._common import join_counted

    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i}") for i in range(3000)], "i int, k string")
    groups = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("m")).where("m < 2900 or c > 1")
    got = {(r.i, r.m) for r in join_counted(rows, groups, "k", "c", 3000).collect()}
    assert got == {(r.i, r.m) for r in rows.join(groups, "k", "left").collect()} and len(got) == 3000


@pytest.mark.parametrize("page", ["<a ", "<!--", '<p a="', "</a ", "<![CDATA[", "<![foo[", "<![if ", "<?x ", "<!x ", "<div>", "<b x='>", "&#x"])
def test_unclosed_markup_takes_linear_time(page):
    import time

    from tidemark.llm import html_extract

    began = time.time()
    for end in ("", ">", "<p>some words of the page that go on for a while</p>"):
        html_extract.main_text(page * (1_000_000 // len(page)) + end)
    assert time.time() - began < 60


def test_odd_declarations_are_comments():
    from tidemark.llm import html_extract

    text = "some words of the page that go on for a while, and on, and on"
    for odd in ("<![foo[bar]]>", "<![CDATA[x]]>", "<![if x]>", "<![endif]-->", "<![>", "<!>", "<![", "<!x y>", "<!--", "<!-->", "<!doctype", "<![CDATA[ never ends >"):
        assert text in html_extract.main_text(f"<html><body>{odd}<article><p>{text}</p></article></body></html>"), odd
    assert html_extract.main_text(f"<p>{text} &amp; <a href='x") .startswith(text)


def exact_tables(worlds, words):
    """Distribution of the tables of each (restaurant, word) of a small world, by enumeration of all tables of dishes and of the parent."""
    import itertools

    import numpy as np

    d, a = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    up = lambda x, n, step: float(np.prod([x + step * i for i in range(int(n))]))
    seats = np.exp(pitman_yor.log_seatings(d, 64))
    dishes = [(r, w, c) for r, dish in enumerate(worlds) for w, c in enumerate(dish) if c]
    found = {(r, w): np.zeros(c + 1) for r, w, c in dishes}
    for ts in itertools.product(*[range(1, c + 1) for _, _, c in dishes]):
        weight = np.prod([seats[c, t] for (_, _, c), t in zip(dishes, ts, strict=True)])
        for r in range(len(worlds)):
            weight *= up(a, sum(t for (q, _, _), t in zip(dishes, ts, strict=True) if q == r), d)
        guests = [sum(t for (_, q, _), t in zip(dishes, ts, strict=True) if q == w) for w in range(words)]
        parents = sum(
            np.prod([seats[g, k] for g, k in zip(guests, ks, strict=True)]) * up(a, sum(ks), d) / (words + 1) ** sum(ks)
            for ks in itertools.product(*[range(min(g, 1), g + 1) for g in guests])
        )
        weight *= parents / up(a, sum(guests), 1)
        for (r, w, _), t in zip(dishes, ts, strict=True):
            found[r, w][t] += weight
    return {k: v / v.sum() for k, v in found.items()}


@pytest.mark.parametrize("worlds", [[(3, 0), (0, 3)], [(5, 1), (3, 2)], [(8, 0), (2, 1)]])
def test_tables_of_small_worlds_follow_their_enumeration(worlds):
    import numpy as np

    want, n, words = exact_tables(worlds, 2), 20_000, 2
    c = np.array(worlds)[:, :, None] * np.ones(n, int)
    t = np.minimum(c, 1)  # n worlds side by side, each with totals of its own
    seen = {k: np.zeros(len(v)) for k, v in want.items()}
    key = pitman_yor.mix(np.arange(c.size, dtype=np.uint64)).reshape(c.shape)
    top = np.ones((words, n), int)
    for sweep in range(40):
        guests, tables = t.sum(0), t.sum(1)
        top = pitman_yor.seat(guests.ravel(), pitman_yor.word_weight((top.sum(0) - top).ravel(), words), key[0].ravel(), 2 * sweep).astype(int).reshape(top.shape)
        others = np.broadcast_to((top.sum(0) - top)[None], c.shape)
        own = pitman_yor.dish_weight((tables[:, None] - t).ravel(), (guests[None] - t).ravel(), (guests.sum(0) - t).ravel(), others.ravel(), words)
        t = pitman_yor.seat(c.ravel(), own, key.ravel(), 2 * sweep + 1).astype(int).reshape(c.shape)
        if sweep >= 10:
            for (r, w), counts in seen.items():
                counts += np.bincount(t[r, w], minlength=len(counts))
    for k, counts in seen.items():
        assert np.abs(counts / counts.sum() - want[k]).max() < 0.01, (k, counts / counts.sum(), want[k])
