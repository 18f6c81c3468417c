"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from folioforge.operators import providers
from folioforge.plans import queries

SMALL = "/root/testdata/sf0.001"
QUICK = ["gnd_literal", "norm_canonical", "gnd_fields", "score_answers", "explain_field", "join_anti_semi", "agree_pairs", "events_window", "events_outages", "otel_metrics", "otel_spans", "acquire_route", "acquire_pages", "acquire_unread", "acquire_second", "acquire_usage", "ev_flatten", "ev_equal", "ev_excluded", "conv_bool_int", "val_rules", "cmp_readings", "conv_number", "date_parse", "fmt_phone", "fmt_email", "asm_walk", "xf_rules", "xf_sum", "asm_cross_field", "gnd_hit", "ev_report", "ev_calibration", "ev_risk", "ev_compare", "ev_leaf_keys", "ocr_reading_order", "norm_regions", "join_interval", "join_as_of", "join_spatial", "breaker_replay", "src_detect", "src_csv", "src_pdf", "finding_background", "norm_lines", "norm_map", "prompt_requests", "gnd_numbers", "scheme_types", "ev_observe"]


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_every_sql_has_its_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_breaker_states(spark):
    """The states of the registered query against one breaker per provider that is told every event in order."""
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    want = []
    now, failing = [0.0], [False]

    def call(request):
        if failing[0]:
            raise providers.ProviderError("timeout")

    breakers = {}
    rows = queries.table(spark, SMALL, "events").selectExpr("event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS at", "event_id").collect()
    for r in sorted(rows, key=lambda r: r.at):
        b = breakers.setdefault(r.event_type, providers.Breaker(call, 5, 1800.0, lambda: now[0]))
        now[0], failing[0], before = r.at / 1e6, r.event_id * 7919 % 100 < 70, b.opened
        try:
            b(None)
        except providers.ProviderError:
            pass
        if b.opened != before:
            want.append((r.event_type, r.at, "closed" if b.opened is None else "open"))
    got = [tuple(r) for r in queries.breaker_states(spark, SMALL).collect()]
    assert len({r.at for r in rows}) == len(rows) and sorted(got) == sorted(want) and {s for _, _, s in got} == {"open", "closed"}
