"""Small decision trees on the driver, for bounded training samples, and their Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_points(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Per feature, up to `most` quantiles that split its values; rounded so that they print and compare alike everywhere."""
    points = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, most + 2)[1:-1]))
        points.append(np.array([float(f"{v:.6g}") for v in q[q < column.max()]]) if column.size else np.empty(0))
    return points


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, rng: np.random.Generator, tried: int) -> dict:
    """A regression tree by squared error: {value} at leaves, else {feature, cut, low, high, value}; low is x <= cut."""
    total = weight.sum()
    node = {"value": float((target * weight).sum() / total) if total else 0.0}
    if depth == 0 or len(target) < 2 * least:
        return node
    best, gain = None, 1e-9
    mean_all = node["value"]
    for f in rng.permutation(x.shape[1])[:tried]:
        points = cuts[f]
        if not points.size:
            continue
        slot = np.searchsorted(points, x[:, f], "left")  # x <= points[slot]
        w = np.bincount(slot, weight, points.size + 1).cumsum()[:-1]
        s = np.bincount(slot, weight * target, points.size + 1).cumsum()[:-1]
        n = np.bincount(slot, minlength=points.size + 1).cumsum()[:-1]
        ok = (n >= least) & (len(target) - n >= least) & (w > 0) & (total - w > 0)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(ok, (s / w - mean_all) ** 2 * w + ((mean_all * total - s) / (total - w) - mean_all) ** 2 * (total - w), -1)
        k = int(score.argmax())
        if score[k] > gain * (1 + 1e-12):
            best, gain = (int(f), float(points[k])), score[k]
    if best is None:
        return node
    f, cut = best
    low = x[:, f] <= cut
    node |= {"feature": f, "cut": cut}
    node["low"] = grow(x[low], target[low], weight[low], cuts, depth - 1, least, rng, tried)
    node["high"] = grow(x[~low], target[~low], weight[~low], cuts, depth - 1, least, rng, tried)
    return node


def predict(tree: dict, x: np.ndarray) -> np.ndarray:
    if "feature" not in tree:
        return np.full(len(x), tree["value"])
    low = x[:, tree["feature"]] <= tree["cut"]
    out = np.empty(len(x))
    out[low], out[~low] = predict(tree["low"], x[low]), predict(tree["high"], x[~low])
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int, seed: int) -> list[dict]:
    """Random forest: each tree from a bootstrap sample, a random subset of features at every node."""
    rng = np.random.default_rng(seed)
    cuts, tried = cut_points(x), max(1, int(np.ceil(np.sqrt(x.shape[1])) + 1))
    rows = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return [grow(x[r], y[r], np.ones(len(r)), cuts, depth, least, rng, tried) for r in rows]


def tree_column(tree: dict, features: list[Column]) -> Column:
    if "feature" not in tree:
        return F.lit(tree["value"])
    return F.when(features[tree["feature"]] <= F.lit(tree["cut"]), tree_column(tree["low"], features)).otherwise(tree_column(tree["high"], features))


def rules_of(tree: dict, path: tuple = ()) -> list[tuple]:
    """Every path from the root as a conjunction of (feature, is_low, cut)."""
    found = [path] if path else []
    if "feature" in tree:
        found += rules_of(tree["low"], (*path, (tree["feature"], True, tree["cut"])))
        found += rules_of(tree["high"], (*path, (tree["feature"], False, tree["cut"])))
    return found
