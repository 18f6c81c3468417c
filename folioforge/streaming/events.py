"""Streams: files as they arrive, and metrics over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.providers import COOLDOWN, FAILURES
from folioforge.sources.detect import Limits


def arriving_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, path, size, content) of files as they appear; files above the size limit are left to the batch reader's error rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.filter(F.col("length") <= limits.source).select(F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("size"), "content")


def once_delivered(docs: DataFrame, ts: str = "ts", wait: str = "1 hour") -> DataFrame:
    """Documents that are delivered again within `wait` pass once."""
    return docs.withWatermark(ts, wait).dropDuplicatesWithinWatermark(["doc_id"])


def stage_metrics(events: DataFrame, every: str = "5 minutes", wait: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, op, n, errors, tokens, seconds) per window of event time; events later than `wait` are dropped by the watermark."""
    span = F.window("ts", every, slide) if slide else F.window("ts", every)
    grouped = events.withWatermark("ts", wait).groupBy(span.alias("w"), "op")
    out = grouped.agg(F.count("*").alias("n"), F.count_if(F.col("err_kind").isNotNull()).alias("errors"), F.sum("tokens").alias("tokens"), F.sum("duration").alias("seconds"))
    return out.select(F.col("w.start").alias("start"), "op", "n", "errors", "tokens", "seconds")


def duration_histogram(events: DataFrame, by: str, value: str, width: float, bins: int) -> DataFrame:
    """(by, bucket, n, total): counts and sums of a duration in `bins` buckets of `width`, what lies beyond in the last; batch or stream."""
    slot = F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int")
    return events.groupBy(by, slot.alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def spans(events: DataFrame, micros: Column) -> DataFrame:
    """events with start_us and end_us: an event is told at its end, and its span began `micros` microseconds before."""
    end = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumns({"start_us": end - F.floor(micros).cast("bigint"), "end_us": end})


def outages(events: DataFrame, gap: str = "30 seconds", wait: str = "10 minutes") -> DataFrame:
    """(provider, start, end, failures): runs of failures closer together than `gap`."""
    failed = events.filter("err_kind is not null").withWatermark("ts", wait)
    return failed.groupBy("provider", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("failures")).select("provider", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "failures")


def breaker_states(events: DataFrame, failures: int = FAILURES, cooldown: float = COOLDOWN) -> DataFrame:
    """(provider, ts, state) whenever a provider's breaker opens or closes, by event time; batch or stream.

    State per provider: consecutive failures, and when it opened. In a stream it is kept between batches, whose events
    are taken in time order. Over a table a provider's events pass one task in time order, an Arrow batch in memory at a time:
    what a breaker does depends on all that it did before.
    """

    def advance(pdf: pd.DataFrame, count: int, opened: float) -> tuple[list, int, float]:
        rows = []
        for provider, at, bad in pdf[["provider", "ts", "bad"]].itertuples(index=False):
            now = at.timestamp()
            if opened >= 0 and now - opened < cooldown:
                continue
            if bad:
                count += 1
                if opened >= 0 or count >= failures:
                    opened = now
                    rows.append((provider, at, "open"))
            else:
                if opened >= 0:
                    rows.append((provider, at, "closed"))
                count, opened = 0, -1.0
        return rows, count, opened

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, opened = state.get if state.exists else (0, -1.0)
        made = []
        for pdf in frames:
            rows, count, opened = advance(pdf.assign(provider=key[0]).sort_values("ts"), count, opened)
            made += rows
        state.update((count, opened))
        yield pd.DataFrame(made, columns=columns)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count, opened = None, 0, -1.0
        for pdf in frames:
            for provider, part in pdf.groupby("provider", sort=False, dropna=False):
                if provider != last:
                    last, count, opened = provider, 0, -1.0
                rows, count, opened = advance(part, count, opened)
                yield pd.DataFrame(rows, columns=columns)

    columns, made = ["provider", "ts", "state"], "provider string, ts timestamp, state string"
    marked = events.select("provider", "ts", F.col("err_kind").isin("unavailable", "rate_limited", "timeout").alias("_b")).select("provider", "ts", F.coalesce("_b", F.lit(False)).alias("bad"))
    if not events.isStreaming:
        return marked.repartition("provider").sortWithinPartitions("provider", "ts").mapInPandas(walk, made)
    return marked.groupBy("provider").applyInPandasWithState(step, made, "count int, opened double", "append", "NoTimeout")
