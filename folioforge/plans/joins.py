"""Joins that the engine needs beside equi-joins: intervals, as-of, points in boxes, key prefixes, readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import values
from folioforge.operators import evidence


def interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the half-open spans that hold them: an equi-join on buckets of `width`, then the exact test.

    A span is repeated once per bucket that it touches, so `width` should be near the usual length of spans.
    """
    wide = spans.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(wide, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the latest right value of the same key at or before its time: one union, one sort by key and time, a running last value."""
    both = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*left.columns, value)


TILE_POINTS, TILE_BOXES = 20_000, 2_000  # of a grid cell, compared in one piece


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) with the boxes that hold them, through grid cells `cell` high and as wide as boxes are on average.

    A crowded cell is dealt over tiles of some of its points and some of its boxes, so that no task holds a whole cell; the
    numbers of tiles follow from counts by cell, of which there are fewer than rows.
    """
    mean = boxes.agg(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.lit(0.0)))).first()[0]
    width = mean if mean else 1.0
    steps = lambda low, high, size: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    wide = boxes.withColumn("_b", F.xxhash64(*boxes.columns)).withColumn("_c", steps("miny", "maxy", cell)).withColumn("_d", steps("minx", "maxx", width))
    near = points.withColumn("_p", F.xxhash64(*points.columns)).withColumn("_c", F.floor(F.col("y") / cell)).withColumn("_d", F.floor(F.col("x") / width))
    tiles = lambda side, size, name: side.groupBy("_c", "_d").agg(F.ceil(F.count("*") / size).alias(name))
    counts = tiles(near, TILE_POINTS, "_np").join(tiles(wide, TILE_BOXES, "_nb"), ["_c", "_d"])
    dealt = lambda side, own, n, other, m: side.join(counts, ["_c", "_d"]).withColumn(f"_t{own}", F.pmod(F.col(f"_{own}"), F.col(n))).withColumn(f"_t{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1))).drop("_np", "_nb", f"_{own}")
    inside = (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy"))
    keys = ["_c", "_d", "_tp", "_tb"]
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # tiles are small but their pairs are not: a number keeps adaptive execution from joining them
    return dealt(near, "p", "_np", "b", "_nb").repartition(spread, *keys).join(dealt(wide, "b", "_nb", "p", "_np"), keys).filter(inside).drop(*keys)


def leaf_keys(keys: DataFrame) -> DataFrame:
    """(doc, key) without keys that other keys of the document continue at a dot or bracket: every key's proper prefixes, anti-joined."""
    parts = F.filter(F.split("key", r"(?=[.\[])"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ""))
    prefixes = keys.filter(F.size(parts) > 1).select("doc", F.explode(above).alias("key")).distinct()
    return keys.join(prefixes, ["doc", "key"], "left_anti")


def members(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of left whose key right holds, and the others; a NULL key is held by nothing."""
    held = right.select(key)
    return left.join(held, key, "left_semi"), left.join(held, key, "left_anti")


def candidates(readings: DataFrame, kind: Column | None = None) -> DataFrame:
    """(doc_id, key, best, missing, distinct_values, agreed) of N readings (doc_id, key, reading, raw, confidence).

    best has the highest confidence, then the lowest reading. missing lists the readings without a value. Readings agree
    when every pair of them means the same, as same_value() says for `kind` (text by default); NULL for fewer than two.
    """
    given = readings.withColumn("_kind", kind if kind is not None else F.lit("string")).withColumn("_some", ~values.blank(F.col("raw")))
    texts = F.array_sort(F.collect_set(F.when(F.col("_some"), F.col("raw"))))
    first = F.max_by("raw", F.when(F.col("_some"), F.struct("confidence", -F.col("reading"))))
    one = given.groupBy("doc_id", "key").agg(first.alias("best"), F.array_sort(F.collect_list(F.when(~F.col("_some"), F.col("reading")))).alias("missing"), texts.alias("_t"), F.count_if("_some").alias("_n"), F.first("_kind").alias("_kind"))
    pairs = F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice("_t", i + 2, F.size("_t")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    same = one.select("doc_id", "key", F.explode(F.when(F.size("_t") > 1, pairs)).alias("p"), "_kind").select("doc_id", "key", evidence.same_value(F.col("p.a"), F.col("p.b"), F.col("_kind")).alias("s"))
    judged = same.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.bool_and("s").alias("_s"))
    joined = one.join(judged, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    agreed = F.when(F.col("_n") > 1, F.when(F.size("_t") < 2, True).otherwise(F.col("_s")))
    return joined.select("doc_id", "key", "best", "missing", F.size("_t").cast("long").alias("distinct_values"), agreed.alias("agreed"))
