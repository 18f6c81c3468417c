"""Streams over files that arrive in two batches."""

import datetime

from folioforge.streaming import events

SCHEMA = "ts timestamp, provider string, op string, err_kind string, tokens long, duration double, doc_id long"
T0 = datetime.datetime(2026, 4, 3, 12)


def row(seconds, bad=False, doc=1):
    return (T0 + datetime.timedelta(seconds=seconds), "p", "ocr", "unavailable" if bad else None, 2, 0.5, doc)


def drain(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def source(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_windows_and_outages(spark, tmp_path):
    df = source(spark, str(tmp_path / "e"), [row(0), row(10, True), row(20, True), row(290), row(310, True), row(4000)])
    got = sorted((r.start, r.n, r.errors, r.tokens) for r in drain(events.stage_metrics(df), "metrics"))
    utc = lambda s: T0 + datetime.timedelta(seconds=s)
    assert [g[1:] for g in got] == [(4, 2, 8), (1, 1, 2)] and (got[1][0] - got[0][0]).total_seconds() == 300 and utc(0).minute == got[0][0].minute
    seen = drain(events.outages(df), "outages", "complete")
    assert sorted(r.failures for r in seen) == [1, 2]


def test_breaker(spark, tmp_path):
    df = source(spark, str(tmp_path / "b"), [row(s, True) for s in range(5)] + [row(10), row(40, True), row(80)])
    assert [(r.state, (r.ts - T0).total_seconds() % 3600) for r in sorted(drain(events.breaker_states(df), "states", "append"), key=lambda r: r.ts)] == [("open", 4.0), ("open", 40.0), ("closed", 80.0)]


def test_files_and_redelivery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    assert [r.size for r in drain(events.arriving_files(spark, str(tmp_path / "in")), "files")] == [3]
    df = source(spark, str(tmp_path / "d"), [row(0, doc=1), row(1, doc=1), row(2, doc=2)])
    assert len(drain(events.once_delivered(df), "once")) == 2
