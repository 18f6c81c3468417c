"""Plans and results that keep work in proportion to the rows."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import evidence, mapping, normalise
from folioforge.plans import evaluation, joins, queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("word", ["word", "größer", "中文", "-"])
def test_unchanged_words_are_one_unit(word):
    assert mapping.canonical_units(word) == [(word, 0, len(word))]


def test_joined_lines_lose_only_the_hyphen():
    rows = [("Zeich-", 0), ("nung", 1), ("Ober-", 2), ("Amt", 3), ("\u00e9-", 4), ("o", 5), ("so\u00ad", 6), ("Da", 7)]
    boxes = [mapping.Box(i, t, 10.0, 20.0 * n, 60.0, 20.0 * n + 10, n, 1.0) for i, (t, n) in enumerate(rows)]
    made = mapping.normalise([(1, 612.0, 792.0, boxes)])
    assert made["text"] == "[page 1]\nZeichnung\nOber-Amt\n\u00e9o\nsoDa" and all(mapping.tiles(made))


def test_flatten_reads_its_table_once(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1.50, {"c": null, "d": []}, "x"], "e": {}}, "f": true}'), (2, "[1]"), (3, "{"), (4, "{}"), (5, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}')], "doc long, expected string")
    got = evaluation.flatten(df)
    assert plan(got).count("Generate explode") <= 7
    want = {(1, "a.b[0]", "number", "1.5"), (1, "a.b[1].d", "array", "[]"), (1, "a.b[2]", "string", "x"), (1, "a.e", "object", "{}"), (1, "f", "bool", "true"), (5, "a.b.c.d.e.f", "object", '{"g":1}')}
    assert {tuple(r) for r in got.select("doc", "key", "type", "text").collect()} == want and got.count() == len(want)


def test_crowded_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE_POINTS", 20)
    monkeypatch.setattr(joins, "TILE_BOXES", 7)
    r = random.Random(3)
    points = [(i, float(r.randrange(40)), r.choice([5.0, 99.5, 100.0, -3.25])) for i in range(300)] + [(300, None, 1.0)]
    boxes = [(i, float(x), -4.0, x + r.choice([0.0, 3.0, 25.0]), r.choice([5.0, 120.0])) for i, x in enumerate(r.choices(range(40), k=60))] + [(60, 9.0, 0.0, 3.0, 9.0), (61, None, 0.0, 3.0, 9.0)]
    p = spark.createDataFrame(points + points[:2], "p long, x double, y double")
    b = spark.createDataFrame(boxes, "b long, minx double, miny double, maxx double, maxy double")
    want = sorted((k, n) for k, x, y in points + points[:2] for n, a, c, d, e in boxes if None not in (x, a) and a <= x <= d and c <= y <= e)
    assert sorted(tuple(q) for q in joins.points_in_boxes(p, b, 100.0).select("p", "b").collect()) == want and len(want) > 500


def test_folds_are_worked_out_once(spark):
    meta = spark.createDataFrame([(1, "k", "x"), (2, "k", "You MUST  respond  with")], "doc_id long, meta_key string, value string")
    found = normalise.instruction_findings(meta)
    assert plan(found).count("translate(") == 1 and [q.doc_id for q in found.collect()] == [2]


def test_canonical_is_worked_out_once(spark, sf):
    assert plan(queries.norm_canonical(spark, sf)).count("translate(") == 1
    assert len(text._RARE) < 600  # ranges; single characters are tested one after the other


def test_words_are_dealt_once(spark, sf):
    assert exchanges(queries.norm_lines(spark, sf)) == 1 and exchanges(queries.gnd_hit(spark, sf)) == 1


def test_hits_of_own_segments(spark):
    segments = [(0, 4, 0, 4, 1, 0, 0, 1.0, 2.0, 3.0, 4.0, True)]
    df = spark.createDataFrame([(7, 1, 4, segments, [(1, 0, 0, 5)]), (None, 1, 4, segments, [(1, 0, 0, 5)])], f"doc_id long, at int, size int, segments array<{mapping.SEGMENT}>, pages array<struct<page:int,marker_start:int,body_start:int,end:int>>")
    own = evidence.hits(df)
    joined = evidence.hits(df.select("doc_id", "at", "size"), df)
    assert sorted(map(str, own.collect())) == sorted(map(str, joined.select(own.columns).collect()))


def test_rules_are_worked_out_once(spark, sf):
    assert "Filter (size(" not in plan(queries.val_rules(spark, sf))
