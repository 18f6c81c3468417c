"""Exact forward and backward recursions over many sequences at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEPS = 256  # tokens of a piece; longer sequences are joined from the transfer matrices of their pieces
EVERY = 8  # steps between scalings


@dataclass
class Chains:
    loglik: np.ndarray  # natural logarithm, per sequence
    gamma: np.ndarray | None = None  # state posteriors, per token
    moves: np.ndarray | None = None  # expected transitions, states x states
    starts: np.ndarray | None = None  # expected first states


def run(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, *, posteriors: bool = False, steps: int = STEPS) -> Chains:
    """emit: tokens x states, positive, sequences one after another; lengths: tokens of each, 1 or more.

    Vectors are scaled to sum 1 every few steps and the logarithms of the scales are added up, so long sequences
    neither underflow nor lose exactness. Sequences longer than `steps` are cut into pieces; a piece's transfer
    matrix links the vectors at its ends, so all pieces advance together.
    """
    states, count = emit.shape[1], lengths.size
    loglik = np.zeros(count)
    gamma = np.empty_like(emit) if posteriors else None
    moves, starts = np.zeros((states, states)), np.zeros(states)
    if not count:
        return Chains(loglik, gamma, moves, starts)
    first_token = np.cumsum(lengths) - lengths
    per = -(-lengths // steps)
    owner = np.repeat(np.arange(count), per)
    nth = np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)
    begin = first_token[owner] + nth * steps
    size = np.minimum(lengths[owner] - nth * steps, steps)
    order = np.argsort(-size, kind="stable")
    owner, nth, begin, size = owner[order], nth[order], begin[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # pieces longer than t come first
    place = np.empty(owner.size, np.int64)
    place[np.lexsort((nth, owner))] = np.arange(owner.size)
    where = np.empty(owner.size, np.int64)
    where[place] = np.arange(owner.size)  # piece k of sequence s is row where[first_piece[s] + k]
    first_piece = np.cumsum(per) - per

    enter = np.empty((owner.size, states))
    enter[nth == 0] = start
    leave = np.ones((owner.size, states))
    long_ = per > 1
    if long_.any():
        rows = np.flatnonzero(long_[owner])
        t0 = nth[rows] == 0
        p = np.where(t0[:, None, None], np.eye(states), move) * emit[begin[rows]][:, None, :]
        log = np.zeros(rows.size)
        for t in range(1, int(size[rows[0]])):
            m = int((size[rows] > t).sum())
            q = (p[:m].reshape(-1, states) @ move).reshape(m, states, states) * emit[begin[rows[:m]] + t][:, None, :]
            if t % EVERY == 0:
                top = q.reshape(m, -1) @ np.ones(states * states)
                q /= top[:, None, None]
                log[:m] += np.log(top)
            p[:m] = q
        at = np.full(owner.size, -1)
        at[rows] = np.arange(rows.size)
        seq = np.flatnonzero(long_)
        a = np.repeat(start[None], seq.size, 0)
        for k in range(int(per[seq].max())):
            live = per[seq] > k
            seq, a = seq[live], a[live]
            piece = where[first_piece[seq] + k]
            enter[piece] = a
            a = np.einsum("si,sij->sj", a, p[at[piece]])
            total = a.sum(axis=1)
            a = a / total[:, None]
            loglik[seq] += np.log(total) + log[at[piece]]
        if posteriors:
            seq = np.flatnonzero(long_)
            for k in range(int(per[seq].max()) - 1, 0, -1):
                live = seq[per[seq] > k]
                piece, before = where[first_piece[live] + k], where[first_piece[live] + k - 1]
                b = np.einsum("sij,sj->si", p[at[piece]], leave[piece])
                leave[before] = b / b.sum(axis=1, keepdims=True)
    short = ~long_[owner]
    if not posteriors and not short.any():
        return Chains(loglik, gamma, moves, starts)
    if not posteriors:
        keep = np.flatnonzero(short)
        owner, begin, size, enter, nth = owner[keep], begin[keep], size[keep], enter[keep], nth[keep]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")
        short = short[keep]
    alpha = np.empty_like(emit) if posteriors else None
    a, log, one = enter.copy(), np.zeros(owner.size), np.ones(states)
    for t in range(int(size[0])):
        m = int(active[t])
        prior = np.where((nth[:m] == 0)[:, None], a[:m], a[:m] @ move) if t == 0 else a[:m] @ move
        x = prior * emit[begin[:m] + t]
        if t % EVERY == 0:
            total = x @ one
            x /= total[:, None]
            log[:m] += np.log(total)
        a[:m] = x
        if posteriors:
            alpha[begin[:m] + t] = x
    loglik[owner[short]] += log[short] + np.log(a[short] @ one)
    if not posteriors:
        return Chains(loglik, gamma, moves, starts)
    b = leave
    for t in range(int(size[0]) - 1, -1, -1):
        m = int(active[t])
        token = begin[:m] + t
        g = alpha[token] * b[:m]
        g /= (g @ one)[:, None]
        gamma[token] = g
        v = emit[token] * b[:m]
        if t == 0:
            opening = nth[:m] == 0
            starts += g[opening].sum(axis=0)
            v, prior = v[~opening], enter[:m][~opening]
        else:
            prior = alpha[token - 1]
        if len(v):
            z = ((prior @ move) * v) @ one
            moves += move * ((prior / z[:, None]).T @ v)
        if t:
            nb = v @ move.T
            if t % EVERY == 0:
                nb /= (nb @ one)[:, None]
            b[:m] = nb
    return Chains(loglik, gamma, moves, starts)
