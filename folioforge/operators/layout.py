"""Page geometry: reading order, medians, regions, table grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = 64  # rows of a page that count as one line when words are ordered
GRID_CELLS = 1 << 20


def reading_order(words: DataFrame, height: float, tie: str) -> DataFrame:
    """Adds order, from 1 on each page: by band of the top edge, then the left edge, then `tie`."""
    band = F.floor(F.col("miny") / (height / BANDS))
    return words.withColumn("order", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(band, "minx", tie)))


def upper_median(height: Column, default: float = 10.0) -> Column:
    """The upper median of positive heights (not interpolated), `default` without any."""
    sorted_ = F.array_sort(F.collect_list(F.when(height > 0, height.cast("double"))))
    return F.coalesce(F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int")), F.lit(default))


def regions(words: DataFrame) -> DataFrame:
    """The box around every line of every page."""
    return words.groupBy("doc_id", "page", "line").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def to_points(px: Column, dpi: float) -> Column:
    return px * 72.0 / dpi


def covered(cells: DataFrame) -> DataFrame:
    """Every grid place that a cell covers; a span of 0 is 1."""
    span = lambda c: F.greatest(F.col(c), F.lit(1))
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + span("row_span") - 1)).alias("r")
    return cells.select("*", rows).select("*", F.explode(F.sequence(F.col("col"), F.col("col") + span("col_span") - 1)).alias("c"))


def check_tables(cells: DataFrame) -> DataFrame:
    """(table_id, problem) of tables with negative places, confidences outside 0 to 1, grids that are too large, or overlapping cells."""
    bad = F.when((F.col("row") < 0) | (F.col("col") < 0), "negative place").when(F.col("page") < 1, "page before 1").when((F.col("conf") < 0) | (F.col("conf") > 1), "confidence outside 0 to 1")
    single = cells.select("table_id", bad.alias("problem")).filter("problem is not null")
    large = cells.groupBy("table_id").agg(((F.max(F.col("row") + F.greatest("row_span", F.lit(1)))) * F.max(F.col("col") + F.greatest("col_span", F.lit(1)))).alias("n")).filter(F.col("n") > GRID_CELLS).select("table_id", F.lit("grid too large").alias("problem"))
    sound = cells.join(large.select("table_id"), "table_id", "left_anti").filter("row >= 0 and col >= 0")
    twice = covered(sound).groupBy("table_id", "r", "c").count().filter("count > 1").select("table_id", F.lit("cells overlap").alias("problem"))
    return single.unionByName(large).unionByName(twice).distinct()


def markdown(cells: DataFrame, columns: int = 256, rows: int = 1024) -> DataFrame:
    """(table_id, markdown): the grid of first cells by place, pipes escaped, a rule below row 0 if it has headers."""
    kept = cells.filter((F.col("row") < rows) & (F.col("col") < columns))
    shown = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), r"\|", r"\\|")
    place = F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "t")))
    first = kept.groupBy("table_id", "row", "col").agg(F.min_by(shown, "seq").alias("t"), F.bool_or(F.col("kind") == "header").alias("header"))
    grid = first.groupBy("table_id").agg(place.alias("m"), F.max("row").alias("h"), F.max("col").alias("w"), F.bool_or(F.col("header") & (F.col("row") == 0)).alias("headed"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("w")), lambda c: F.coalesce(F.try_element_at(F.col("m"), F.struct(r.alias("row"), c.alias("col"))), F.lit(""))), " | "), F.lit(" |"))
    lines = F.transform(F.sequence(F.lit(0), F.col("h")), line)
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("w")), lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    out = F.when(F.col("headed"), F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines)))).otherwise(lines)
    return grid.select("table_id", F.array_join(out, "\n").alias("markdown"))
