"""Vectorised helpers for tasks that link rows: spanning labels and BK-trees over 64-bit fingerprints."""

from __future__ import annotations

import numpy as np


def spanning_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For links i-j among 0..n-1, the smallest index of each one's component."""
    labels = np.arange(n)
    while i.size:
        a, b = labels[i], labels[j]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)  # roots are lowered, so that what hangs below them follows
        np.minimum.at(labels, b, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
        open_ = labels[i] != labels[j]
        i, j = i[open_], j[open_]
    return labels


def spanning_edges(i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """Places of the links of a cheapest spanning forest, by Boruvka's rounds; of equal cost the lower (i, j) first."""
    place = np.lexsort((j, i, cost))
    i, j = i[place], j[place]
    labels, chosen = np.arange(n), [np.empty(0, np.int64)]
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return np.concatenate(chosen)
        i, j, a, b, place = i[open_], j[open_], a[open_], b[open_], place[open_]
        first = np.full(n, a.size)
        np.minimum.at(first, a, np.arange(a.size))
        np.minimum.at(first, b, np.arange(a.size))
        pick = np.unique(first[first < a.size])
        chosen.append(place[pick])
        labels = spanning_labels(a[pick], b[pick], n)[labels]


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    if x.shape[1] == 1:
        return np.bitwise_count(x[:, 0] ^ y[:, 0]).astype(np.int64)
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class BKForest:
    """One BK-tree per group: a node's children are keyed by their Hamming distance to it."""

    def __init__(self, groups: np.ndarray, prints: np.ndarray):
        """groups: 0..G-1 per fingerprint; prints: rows of uint64 words. Trees are built a level at a time for all groups at once."""
        self.prints, self.span = prints, 64 * prints.shape[1]
        count = int(groups.max()) + 1 if groups.size else 0
        self.root = np.full(count, -1, np.int64)
        present, first = np.unique(groups, return_index=True)
        self.root[present] = first
        rest = np.setdiff1d(np.arange(groups.size), first, assume_unique=True)
        at = self.root[groups[rest]]
        keys, children = [], []
        while rest.size:
            key = at * (self.span + 1) + hamming(prints[rest], prints[at])
            unique, first, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(unique)
            children.append(rest[first])
            at = rest[first][back]
            stay = np.ones(rest.size, bool)
            stay[first] = False
            rest, at = rest[stay], at[stay]
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.children = (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def within(self, groups: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, distance) of pairs at distance radius or less; follows only edges whose key is within radius of the distance to the parent."""
        query = np.arange(groups.size)
        inside = groups < self.root.size
        query = query[inside]
        node = self.root[groups[query]]
        query, node = query[node >= 0], node[node >= 0]
        out_q, out_n, out_d = [], [], []
        while query.size:
            d = hamming(prints[query], self.prints[node])
            hit = d <= radius
            out_q.append(query[hit])
            out_n.append(node[hit])
            out_d.append(d[hit])
            low = np.searchsorted(self.keys, node * (self.span + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, node * (self.span + 1) + np.minimum(d + radius, self.span), "right")
            n = high - low
            starts = np.cumsum(n) - n
            slot = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(low, n)
            query, node = np.repeat(query, n), self.children[slot]
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *out_q]), np.concatenate([empty, *out_n]), np.concatenate([empty, *out_d])
