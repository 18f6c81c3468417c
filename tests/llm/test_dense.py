"""Embedding links inside a dense cone, on a table far larger than the window, against brute force."""

import numpy as np
import pytest

from folioforge.llm import embeddings


def cone_table(n, pairs, cosine=0.9, dim=64, seed=8):
    """Unit vectors, a third of them in a cone of that pairwise cosine, and the places of isolated pairs at cosine 0.955 in it."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(dim))
    x = unit(rng.standard_normal((n, dim)))
    hot = n // 3
    side = rng.standard_normal((hot, dim))
    side = unit(side - (side @ centre)[:, None] * centre)
    x[:hot] = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * side
    first = np.arange(0, 2 * pairs, 2)
    other = rng.standard_normal((pairs, dim))
    other = unit(other - (other * x[first]).sum(axis=1, keepdims=True) * x[first])
    x[first + 1] = 0.955 * x[first] + np.sqrt(1 - 0.955**2) * other
    return x, first


def test_plan():
    assert embeddings._plan(500, 2048, 0.95) == (1, 0)
    for total in (50_000, 400_000, 60_000_000):
        passes, bits = embeddings._plan(total, 2048, 0.95)
        assert 4 * total / 2**bits <= 2048 and (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** passes <= embeddings.MISSED


@pytest.mark.parametrize("tile", [4096, 500])
def test_dense_cone(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "DENSE_TILE", tile, raising=False)
    x, first = cone_table(6000, 300)
    order = np.random.default_rng(9).permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, window=16).collect()}
    near = x @ x.T >= 0.95
    want = near.sum(axis=1) - 1
    held = want.sum() - sum(abs(got[i] - int(want[i])) for i in range(len(x)))
    assert want[first].min() >= 1 and all(got[i] <= want[i] for i in range(len(x)))
    assert held >= 0.99 * want.sum()


def test_nothing_below_the_threshold(spark):
    a = np.zeros(8)
    a[0] = 1.0
    rows = [(0, a.tolist())]
    for k, cosine in enumerate((0.95 - 2e-13, 0.95 + 2e-13, 0.95 - 1e-7, 0.95 + 1e-7)):
        v = np.zeros(8)
        v[0], v[k + 1] = cosine, np.sqrt(1 - cosine * cosine)
        rows.append((k + 1, v.tolist()))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 2, 1: 0, 2: 1, 3: 0, 4: 1}


def test_partitions_shorter_than_the_window(spark, monkeypatch):
    """Few rows over many partitions: neighbours lie several partitions away."""
    x, _ = cone_table(400, 60, dim=16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    given = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *cols: given(self, 37, *cols))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, window=100).collect()}
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert sum(got[i] for i in got) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)
