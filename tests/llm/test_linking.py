"""Embedding and SimHash near-duplicates against brute force."""

import numpy as np
import pytest

from folioforge.llm import embeddings, simhash
from folioforge.llm.shared import connected_components


def closure(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure(500, pairs)
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1] or x in got}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(vectors):
    ids = sorted(vectors)
    ok = {i for i in ids if vectors[i] and all(x is not None and np.isfinite(x) for x in vectors[i]) and any(vectors[i])}
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in ok}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label = closure(max(ids) + 1, pairs)
    return {i: (sum(i in p for p in pairs), label[i]) for i in ids}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    vectors = {i: (base[i % 12] + 0.08 * rng.standard_normal(16)).tolist() for i in range(150)}
    vectors |= {150 + i: vectors[3] for i in range(20)}
    vectors |= {200: None, 201: [0.0] * 16, 202: [float("nan")] * 16, 203: [None] + [1.0] * 15, 204: [], 205: [1.0, 2.0], 206: [2.0, 4.0], 207: [float("inf")] * 16}
    rows = [(i, v, 0, "x") for i, v in vectors.items()] + [(5, vectors[5], 0, "x"), (None, vectors[5], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, window=32).collect()}
    assert got == brute(vectors)


def test_embeddings_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute({r.vec_id: list(map(float, r.embedding)) for r in df.collect()})


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint_matches_spark_hash(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert simhash.fingerprint("A b\tc  D") == row.h & (1 << 64) - 1


@pytest.mark.parametrize("rows", [8192, 8])
def test_simhash(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(15):
        t = list(rng.choice(words, 300))
        for _ in range(6):
            u = list(t)
            u[int(rng.integers(300))] = "edit"
            texts.append(" ".join(u))
    texts += ["", None, "   ", "One two", "one TWO", "é" * 10, texts[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    label = closure(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == {i: (f"{f:016x}", label[i]) for i, f in enumerate(fps)}


def test_bk_trees_find_all_within_radius():
    from folioforge.llm.linking import BKForest

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for b in base]))
    groups = (np.arange(fps.size) % 3).astype(np.int64)
    q, m, d = BKForest(groups, fps[:, None]).within(groups, fps[:, None], 4)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (groups[:, None] == groups[None])
    assert (np.bitwise_count(fps[q] ^ fps[m]) == d).all()
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_cheapest_forest():
    from folioforge.llm.linking import spanning_edges

    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    cost = rng.integers(0, 5, i.size)
    got = spanning_edges(i, j, cost, 40)
    up, total, count = list(range(40)), 0, 0
    for k in np.lexsort((j, i, cost)).tolist():  # Kruskal
        a, b = int(i[k]), int(j[k])
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            total, count = total + int(cost[k]), count + 1
    assert got.size == count and cost[got].sum() == total
    assert closure(40, zip(i[got].tolist(), j[got].tolist(), strict=True)) == closure(40, zip(i.tolist(), j.tolist(), strict=True))


def plain_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("rows", [8192, 8])
def test_similar_texts(spark, monkeypatch, rows):
    """Edited copies against brute force: no pair that is alike stays apart, no group holds a text unlike all others."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (12, 40, 200, 200, 700):
        t = list(rng.choice(words, size))
        for edits in (0, 0, 1, 1, 2, 3, 8):
            u = list(t)
            for at in rng.integers(0, size, edits * size // 150 + (edits > 0)):
                u[int(at)] = "edit"
            texts.append(" ".join(u))
    texts += ["", None, "  ", "One two", "one TWO", "é" * 10, texts[0].upper(), "same line again " * 40 + "a b c d e f g h", "same line again " * 40 + "k l m n o p q r s t u v w x y z"]
    ids = [None if k % 11 == 5 else int(v) for k, v in enumerate(rng.permutation(len(texts)))]
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(texts)), strict=True)) + [(ids[0], texts[0], 0)], "doc_id long, text string, n int")
    kept = simhash.one_of_each(docs).collect()
    sets = [plain_shingles(t) for t in texts]
    alike = lambda a, b: sets[a] == sets[b] == set() or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    label = closure(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b)])
    groups = {}
    for k, g in enumerate(label):
        groups.setdefault(g, []).append((ids[k] is None, ids[k] or 0, k))
    assert len(kept) == len(groups)
    assert {r.n for r in kept if r.doc_id is not None} == {min(g)[2] for g in groups.values() if not min(g)[0]}
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_similar_texts_of_families(spark, monkeypatch):
    """Families around the threshold, where the nearest fingerprints are often not those of similar sets: every link counts, also without any proposed pair."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for size in rng.integers(14, 60, 25).tolist():
        base = list(rng.choice(words, size))
        for _ in range(12):
            u = list(base)
            for at in rng.integers(0, size, int(rng.integers(0, 4))):
                u[int(at) if rng.random() < 0.3 else int(at) % 3 - (int(at) % 2) * 3] = str(rng.choice(words))
            texts.append(" ".join(u + ["a line that many of the texts end with"] * (len(texts) % 2)))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [plain_shingles(t) for t in texts]
    label = closure(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    firsts = {k for k, g in enumerate(label) if k == g}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == firsts
    monkeypatch.setattr(simhash, "_shard_links", lambda prints, *_: prints.selectExpr("rep as a", "rep as b").limit(0))
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == firsts


def test_texts_of_shared_lines_give_few_pairs(spark, monkeypatch):
    """Texts that share many of their lines, and so shingles of their prefixes: only what may be similar is proposed, and no link is lost."""
    rng = np.random.default_rng(8)
    lines = [" ".join(rng.choice([f"w{i}" for i in range(500)], 12)) for _ in range(20)]
    texts = [" ".join(lines[k] for k in np.sort(rng.choice(20, 12, replace=False))) for _ in range(150)]
    texts += [t + f" and {k} more" for k, t in enumerate(texts[:20])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [plain_shingles(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    share = sum(bool(sets[a] & sets[b]) for a in range(len(texts)) for b in range(a))
    label, proposed = closure(len(texts), alike), []
    whole = simhash._prefix_pairs

    def counted(*given):
        out = whole(*given)
        proposed.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_prefix_pairs", counted)
    monkeypatch.setattr(simhash, "_shard_links", lambda prints, *_: prints.selectExpr("rep as a", "rep as b").limit(0))
    for few in (20, 0):
        monkeypatch.setattr(simhash, "FEW", few)
        assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {k for k, g in enumerate(label) if k == g}
    assert len(alike) <= proposed[0] == proposed[1] < share / 10, (len(alike), proposed, share)


def test_hot_keys_and_samples(spark):
    from folioforge.llm.shared import lowest, salted_join
    from pyspark.sql import functions as F

    left = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert sorted(salted_join(left, right, "k", "n", 5000).select("k", "id", "m").collect()) == sorted(left.join(right, "k").select("k", "id", "m").collect())
    rows = left.select(F.xxhash64("id").alias("h"), "id", "k")
    assert sorted(lowest(rows, 40, ["h", "id"]).collect()) == sorted(rows.orderBy("h", "id").limit(40).collect())
    by = lowest(rows, 10, ["h", "id"], by="k").collect()
    want = [r for k in {r.k for r in rows.collect()} for r in rows.filter(F.col("k") == k).orderBy("h", "id").limit(10).collect()]
    assert sorted(by) == sorted(want)
    assert lowest(rows.limit(0), 5, ["h", "id"]).count() == 0
