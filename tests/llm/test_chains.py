"""Long chains of links in random order against union-find: within one task, and through op1 and op7."""

import numpy as np
import pytest
from test_linking import brute, closure

from folioforge.llm import embeddings, simhash
from folioforge.llm.linking import spanning_labels
from folioforge.llm.shared import connected_components


def test_path_of_four():
    assert spanning_labels(np.array([0, 2, 3]), np.array([2, 3, 1]), 4).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("n", [4, 8, 60, 500])
def test_spanning_labels(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        path = rng.permutation(n)
        links = np.stack([path[1:], path[:-1]], axis=1)
        links = rng.permutation(np.delete(links, int(rng.integers(n - 1)), axis=0))
        assert spanning_labels(links[:, 0], links[:, 1], n).tolist() == closure(n, links.tolist())


def test_simhash_chains(spark):
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(8):  # groups whose copies drift by 4 bits from one of the last copies
        group = [int(rng.integers(0, 2**63))]
        while len(group) < 300:
            bits = rng.choice(64, 4, replace=False)
            group.append(group[-int(rng.integers(1, min(3, len(group)) + 1))] ^ sum(1 << int(b) for b in bits))
        fps += group
    fps = np.unique(np.array(fps, np.uint64))
    fps = fps[rng.permutation(fps.size)]
    prints = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(simhash.links(prints)).collect()}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1)).tolist()
    assert [got.get(i, i) for i in range(fps.size)] == closure(fps.size, near)


def test_embedding_chains(spark):
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(4):  # each vector has cosine 0.96 with the one before
        x = rng.standard_normal(48)
        x /= np.linalg.norm(x)
        for _ in range(60):
            vectors.append(x)
            y = rng.standard_normal(48)
            y -= (y @ x) * x
            x = 0.96 * x + np.sqrt(1 - 0.96**2) * y / np.linalg.norm(y)
    table = {int(i): v.tolist() for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)}
    df = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(table)
