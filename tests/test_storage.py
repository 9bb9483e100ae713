"""Stored upserts, footers, layouts and streamed bars: which files are touched, what a broken run leaves, what state is held."""

import datetime as dt

import pytest

from tidemark.operators import files as FI
from tidemark.operators import storage as ST
from tidemark.streaming import ingest

YEAR = {"year": "cast(floor(t / 10) as int)"}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("e", "t", "v").collect())


def stored(spark, path):
    table = spark.createDataFrame([(e, t, 1.0) for e in "ab" for t in (1, 2, 11, 12, 21)] + [("c", 31, 1.0)], "e string, t int, v double")
    ST.store(table, path, YEAR)
    return {r.file for r in ST.files_of(spark, path).collect()}


def test_upsert_touches_only_its_partitions_and_can_run_again(spark, tmp_path):
    path = f"{tmp_path}/table"
    before = stored(spark, path)
    block = spark.createDataFrame([("a", 2, 9.0), ("a", 2, 9.0), ("a", 13, 9.0), ("d", 41, 9.0)], "e string, t int, v double")
    want = [("a", 1, 1.0), ("a", 2, 9.0), ("a", 13, 9.0), ("a", 21, 1.0), *[("b", t, 1.0) for t in (1, 2, 11, 12, 21)], ("c", 31, 1.0), ("d", 41, 9.0)]
    touched = sorted(r.year for r in ST.upsert_range(spark, path, block, "e", "t", YEAR).collect())
    assert touched == [0, 1, 4] and rows_of(spark.read.parquet(path)) == want
    kept = before & {r.file for r in ST.files_of(spark, path).collect()}
    assert {f.split("year=")[1].split("/")[0] for f in kept} == {"2", "3"}
    ST.upsert_range(spark, path, block, "e", "t", YEAR)
    assert rows_of(spark.read.parquet(path)) == want and not ST.exists(spark, f"{path}-journal")


def test_emptied_partitions_go(spark, tmp_path):
    path = f"{tmp_path}/table"
    stored(spark, path)
    block = spark.createDataFrame([("c", 29, 5.0), ("c", 45, 5.0)], "e string, t int, v double")  # its span holds the only row of year 3
    ST.upsert_range(spark, path, block, "e", "t", YEAR)
    assert not ST.exists(spark, f"{path}/year=3") and ("c", 31, 1.0) not in rows_of(spark.read.parquet(path))


def test_a_broken_upsert_is_finished(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    stored(spark, path)
    block = spark.createDataFrame([("a", 1, 9.0)], "e string, t int, v double")

    def broken(spark, path, journal, parts):
        ST.delete(spark, f"{path}/year=0")  # half of a replacement
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(ST, "_replace", broken)
        with pytest.raises(RuntimeError):
            ST.upsert_range(spark, path, block, "e", "t", YEAR)
    assert ST.recover(spark, path, ["year"]) and not ST.recover(spark, path, ["year"])
    assert rows_of(spark.read.parquet(path))[:3] == [("a", 1, 9.0), ("a", 2, 1.0), ("a", 11, 1.0)]


def test_insert_keeps_all_files(spark, tmp_path):
    path = f"{tmp_path}/table"
    before = stored(spark, path)
    block = spark.createDataFrame([("a", 1, 9.0), ("a", 3, 9.0), ("a", 3, 9.0), ("z", 99, 9.0)], "e string, t int, v double")
    for _ in range(2):
        ST.insert_absent(spark, path, block, ["e", "t"], YEAR)
        after = {r.file for r in ST.files_of(spark, path).collect()}
        assert before < after and rows_of(spark.read.parquet(path)) == sorted([*[(e, t, 1.0) for e in "ab" for t in (1, 2, 11, 12, 21)], ("c", 31, 1.0), ("a", 3, 9.0), ("z", 99, 9.0)])


def test_footers_need_no_data(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1 + i) if i % 3 else None, float(i)) for i in range(9)], "i int, d date, x double")
    for name in ("a", "b"):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    df.limit(0).coalesce(1).write.parquet(f"{tmp_path}/empty")
    found = FI.footer_inventory(spark, str(tmp_path), "d")
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.file.split("/")[-2], r.rows, r.first, r.last, r.nulls, r.copies, r.columns) for r in found.collect())
    kinds = "i: int32, d: date32[day], x: double"
    assert got == [("a", 9, "2020-01-02", "2020-01-09", 3, 2, kinds), ("b", 9, "2020-01-02", "2020-01-09", 3, 2, kinds), ("empty", 0, None, None, 0, 1, kinds)]


def test_layouts_are_told_by_headers(spark, tmp_path):
    text = {
        "one.csv": "﻿Ticker,Date,Close,Adjusted_Close,Volume\naa,2020-01-02,1,2,3\nAA,2020-01-02,1,2,3\n",
        "spy.csv": 'Date,"Open",Close,Adj Close\n2020-01-02,5,,7\n2020-01-03,5,6,\n2020-01-04,5,,\n',
        "plain.csv": "close,date\n3,2020-01-02\n\n3,someday\n",
        "de.csv": 'Symbol;Datum;Kurs\n"x;y";02.01.2020;1.234,5\nz;03.01.2020;-1\n',
        "tab.csv": "Code\tTrade Date\tLast\nq\t01/02/2020\t4\n\t01/02/2020\t4\n",
        "odd.csv": "when,what\n1,2\n",
        "empty.csv": "",
        "notes.txt": "Date,Close\n2020-01-02,1\n",
    }
    for name, body in text.items():
        (tmp_path / name).write_text(body.lstrip("﻿"))
    got = sorted((r.file.split("/")[-1], r.layout or "", r.ticker or "", str(r.date), r.close, r.adj_close, r.reason or "") for r in FI.sniffed_prices(spark, str(tmp_path)).collect())
    day = "2020-01-02"
    assert got == [
        ("de.csv", "day_first", "X;Y", day, 1234.5, 1234.5, ""), ("de.csv", "day_first", "Z", "2020-01-03", -1.0, -1.0, "not_positive"), ("odd.csv", "", "ODD", "None", None, None, "unknown_layout:date,close"),
        ("one.csv", "symbol_adjusted", "AA", day, 1.0, 2.0, ""), ("one.csv", "symbol_adjusted", "AA", day, 1.0, 2.0, "repeated"), ("plain.csv", "plain", "PLAIN", day, 3.0, 3.0, ""), ("plain.csv", "plain", "PLAIN", "None", 3.0, 3.0, "bad_date"),
        ("spy.csv", "title_case", "SPY", day, 7.0, 7.0, ""), ("spy.csv", "title_case", "SPY", "2020-01-03", 6.0, 6.0, ""), ("spy.csv", "title_case", "SPY", "2020-01-04", None, None, "bad_price"),
        ("tab.csv", "tabbed", "", day, 4.0, 4.0, "no_ticker"), ("tab.csv", "tabbed", "Q", day, 4.0, 4.0, ""),
    ]


def test_streamed_bars_over_two_runs(spark, tmp_path):
    """Rows behind the delay go to their own table, closed bars are never written again, and only the open windows are held."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "event_id int, ts timestamp, k string, v double"

    def run(*batches):
        for rows in batches:
            spark.createDataFrame([(i, dt.datetime.fromtimestamp(t, dt.UTC).replace(tzinfo=None), "k", v) for i, t, v in rows], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.bars_with_late(ingest.read_events(spark, source, schema, 1), out, "ts", "v", 10, 20, ["k"]).awaitTermination()
        return {(r.start): (r.open, r.high, r.low, r.close, r.n, r.closed) for r in ingest.read_bars(spark, out, ["k"]).collect()}

    first = run([(1, 3, 5.0), (2, 4, 7.0)], [(3, 1, 2.0), (4, 35, 1.0)])
    assert first == {0: (2.0, 7.0, 2.0, 7.0, 3, True), 30: (1.0, 1.0, 1.0, 1.0, 1, False)}
    files = {r.file for r in ST.files_of(spark, out).where("file like '%closed=true%'").collect()}
    second = run([(5, 2, 99.0), (6, 31, 4.0), (7, 44, 3.0)], [(8, 200, 6.0)], [(9, 33, 8.0), (10, 190, 9.0)])
    assert second == {0: (2.0, 7.0, 2.0, 7.0, 3, True), 30: (4.0, 4.0, 1.0, 1.0, 2, True), 40: (3.0, 3.0, 3.0, 3.0, 1, True), 190: (9.0, 9.0, 9.0, 9.0, 1, False), 200: (6.0, 6.0, 6.0, 6.0, 1, False)}
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/late").collect()) == [5, 9]
    now = {r.file for r in ST.files_of(spark, out).collect()}
    assert files <= now and len({f.split("batch=")[1].split("/")[0] for f in now if "closed=false" in f}) <= 2
