"""Decontamination and URL rules on edge cases, and the pipeline against a brute-force version."""

import re

import numpy as np
import pytest

from folioforge.llm import decontaminate, queries, quality, urls


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text):
    """Of an item: runs of five words, or the whole."""
    w = words_of(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def runs(text):
    """Of a document: runs of one to five words."""
    w = words_of(text)
    return {" ".join(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}


def test_leaks(spark):
    rng = np.random.default_rng(0)
    words = [f"v{i}" for i in range(300)]
    items = [" ".join(rng.choice(words, n)) for n in (1, 3, 5, 9, 20, 40, 40, 60)]
    docs = []
    for k, t in enumerate(items):
        w = t.split()
        for spoil in (0, 1, 2, 5):
            u = list(w)
            for x in rng.choice(len(u), min(spoil, len(u)), replace=False):
                u[x] = "zz"
            docs.append(" ".join([*rng.choice(words, 30 * k), *u, *rng.choice(words, 200)]))
    docs += ["", None, items[0].upper(), items[3] + " " + items[4], "x " * 5000 + items[2], "some words before alpha beta gamma and some after"]
    items.append("alpha beta gamma")
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(docs)] + [(0, docs[0], "p"), (None, items[3], "p")], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, None, 1), (91, "", 1), (None, "a b", 1)], "item_id long, text string, q int")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.find_leaks(df, tests).collect()}
    want = {}
    for i, d in enumerate(docs):
        for k, t in enumerate(items):
            q, n = shingles(t), len(shingles(t) & runs(d))
            if n >= 0.8 * len(q) - 1e-9:
                want[i, k] = (len(q), n)
    assert got == want and len(want) > 8
    assert decontaminate.find_leaks(df.limit(0), tests).count() == 0 and decontaminate.find_leaks(df, tests.limit(0)).count() == 0


def test_urls(spark):
    rows = ["http://a.Example.COM/en/77?x", "example.com/en/7", None, "", "https://example.com", "ftp://x.net/de/8#a/", "http://com/en/", "http://notexample.com/en/7", "http://example.net/de/81", "x://", "http://a.org?/es/", "http://b.org/es/a/b", "http://a.example.com/en/6"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] + [(None, rows[0], "h"), (0, rows[0], "h")], "page_id long, url string, host string")
    got = urls.judge_urls(pages, spark.sql(queries.RULES)).collect()
    rule = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows) + 2 and rule[None] == rule[0] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert rule[1] == rule[2] == ("", "", None, "allow") and rule[5] == ("x.net", "/de/8", "net/de/", "block") and rule[6][2:] == ("com/en/", "block")
    assert rule[7][2:] == ("com/en/", "block") and rule[8][2:] == ("example.net/de/8", "block") and rule[10] == ("a.org", "", None, "allow")
    assert rule[11][2:] == ("org/es/", "block") and rule[12][2:] == ("com/en/", "block")
    assert urls.judge_urls(pages.limit(0), spark.sql(queries.RULES)).count() == 0
    none = spark.sql(queries.RULES).limit(0)
    assert {r.verdict for r in urls.judge_urls(pages, none).collect()} == {"allow"}


def test_pipeline(spark, sf, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_ids import WORDS, plain
    from test_linking import closure, plain_shingles

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append(docs)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(s.columns == columns for s in steps[:-1])
    first = spark.read.parquet(f"{sf}/documents.parquet")
    predicted = {r.doc_id for r in quality.classify(first, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    good = {r.doc_id: r.text for r in steps[0].collect()}
    assert set(good) == predicted
    ids = sorted(good)
    sets = [plain_shingles(good[i]) for i in ids]
    alike = lambda x, y: x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)
    label = closure(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if alike(sets[a], sets[b])])
    single = {ids[k]: good[ids[k]] for k in range(len(ids)) if label[k] == k}
    assert {r.doc_id: r.text for r in steps[1].collect()} == single
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: t for i, t in single.items() if not any(len(q & runs(t)) >= 0.8 * len(q) - 1e-9 for q in items if q)}
    assert {r.doc_id for r in steps[2].collect()} == set(clean)
    redacted = {r.doc_id: r for r in steps[3].collect()}
    known = r'(?:(token = ")|(password=))[0-9a-f]{16,}|AKIA[A-Z0-9]{16}'
    assert set(redacted) == set(clean) and all(r.n_chars == len(r.text) for r in redacted.values())
    for i, t in clean.items():
        assert not re.search(known, redacted[i].text)
        if not re.search(r"[A-Za-z0-9+/_\-]{16,}", t) or not re.search(r"\d", t):
            assert redacted[i].text == t
    tokens = {i: 0 for i in redacted}
    for r in steps[4].collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(plain(WORDS, r.text)) + 1 for i, r in redacted.items()}


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Null ids and texts, repeated rows, one id for several texts, very long texts, clashing columns and empty tables, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").first().text
    long = " ".join(f"w{k * k % 9973}" for k in range(40_000))
    rows = [(None, item, "en", "a", 1), (None, "one two three four five six", "en", "a", None), (1, None, None, None, None), (2, "", "en", "a", 0), (7, long, "en", "a", 5), (7, long, "en", "a", 5), (9, long + " end", "en", "a", 5), (7, "quite another text of some more words", "en", "a", 5), (3, item + " and more", "en", "a", 5), (4, "token = \"0123456789abcdef0123456789abcdef\" x", "en", "a", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, i int, digest string, item_id int"
    docs = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_duplicates"](spark, docs, sf)
    assert once.columns == docs.columns
    kept = sorted(((r.doc_id, (r.text or "")[:20]) for r in once.collect()), key=str)
    assert kept == sorted([(None, item[:20]), (None, "one two three four f"), (1, ""), (7, long[:20]), (7, "quite another text o"), (3, item[:20]), (4, "token = \"0123456789a")] if len(item.split()) < 9 else [(1, ""), (3, item[:20]), (None, "one two three four f"), (7, long[:20]), (7, "quite another text o"), (4, "token = \"0123456789a")], key=str)
    clean = stages["decontamination"](spark, docs, sf).collect()
    assert len(clean) == 8 and not any(item in (r.text or "") for r in clean)
    redacted = stages["secrets"](spark, docs, sf).collect()
    assert len(redacted) == 10 and any(r.text == 'token = "[SECRET]" x' and r.n_chars == 20 for r in redacted)
    assert stages["packing"](spark, docs, sf).groupBy().sum("length").first()[0] > 2 * 40_000
    assert {r.doc_id for r in stages["packing"](spark, docs, sf).collect()} == {None, 1, 2, 7, 9, 3, 4}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
