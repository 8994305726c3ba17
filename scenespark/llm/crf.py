"""A linear-chain conditional random field over sparse word features, in numpy.

A token's potentials come from its own features and, with ``context``, from those of the words before
and after it in its chain.

Training is by gradient ascent on the log-likelihood of labelled sequences; inference is exact
forward-backward. Many chains are processed at once: the tokens of all chains lie behind each
other, a chain's first token restarts the recursion, and the recursion over the whole line is split
into blocks whose transfer matrices are multiplied first, so that one long text costs no more than
many short ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


def marginals(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label probabilities [n, k] of each token, and the summed transition posteriors [k, k].

    emit: log-potentials [n, k]; first: whether a token starts a chain; start [k] and trans [k, k]
    are log-potentials too."""
    n, k = emit.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    blocks = max(1, int(np.sqrt(n) * 3))
    size = -(-n // blocks)
    blocks = -(-n // size)
    pad = blocks * size - n
    e = np.exp(emit - emit.max(1, keepdims=True))
    if pad:
        e = np.concatenate([e, np.full((pad, k), 1.0)])
        first = np.concatenate([first, np.ones(pad, bool)])
    s, t = np.exp(start - start.max()), np.exp(trans - trans.max())
    e = np.ascontiguousarray(e.reshape(blocks, size, k).transpose(1, 0, 2))  # [size, blocks, k]
    head = np.ascontiguousarray(first.reshape(blocks, size).T)
    head[0, 0] = True
    se = s * e  # potentials where a chain starts
    some = head.any(1)
    # transfer matrix of each block
    m = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(size):
        step = (m.reshape(-1, k) @ t).reshape(blocks, k, k) * e[i][:, None, :]
        if some[i]:
            h = head[i]
            step[h] = m[h].sum(2)[:, :, None] * se[i][h][:, None, :]
        step /= step.max((1, 2), keepdims=True) + 1e-300
        m = step
    # what enters each block from the left and from the right
    left, right = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1.0 / k)
    for b in range(blocks):
        left[b] = v
        v = v @ m[b]
        v = v / (v.sum() + 1e-300)
    v = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        right[b] = v
        v = m[b] @ v
        v = v / (v.max() + 1e-300)
    # within the blocks
    alpha = np.empty((size, blocks, k))
    before = np.empty((size, blocks, k))
    v = left
    for i in range(size):
        before[i] = v
        nxt = (v @ t) * e[i]
        if some[i]:
            nxt = np.where(head[i][:, None], se[i], nxt)
        v = nxt / (nxt.sum(1, keepdims=True) + 1e-300)
        alpha[i] = v
    post = np.empty((size, blocks, k))
    pairs = np.zeros((k, k))
    v = right
    for i in range(size - 1, -1, -1):
        p = alpha[i] * v
        post[i] = p / (p.sum(1, keepdims=True) + 1e-300)
        ev = e[i] * v
        inner = before[i][:, :, None] * t * ev[:, None, :]
        total = inner.sum((1, 2), keepdims=True) + 1e-300
        live = ~head[i]
        pairs += (inner / total)[live].sum(0)
        back = ev @ t.T
        if some[i]:
            back = np.where(head[i][:, None], (se[i] * v).sum(1, keepdims=True), back)
        v = back / (back.max(1, keepdims=True) + 1e-300)
    return post.transpose(1, 0, 2).reshape(-1, k)[:n], pairs


class Chain:
    """A trained model: weights of features, start and transition potentials. Pickles small.

    With k labels, a feature has k weights for its own token or, with context, 3k: for its own token, the
    one after it and the one before it."""

    def __init__(self, labels: list, index: dict[str, int], weights: np.ndarray, start: np.ndarray, trans: np.ndarray):
        self.labels, self.index, self.weights, self.start, self.trans = labels, index, weights, start, trans

    def emissions(self, words: list[str], features: Callable[[str], Iterable[str]]) -> np.ndarray:
        """Log-potentials of each word, [len(words), k or 3k]; features that training did not see count nothing."""
        get, flat, ends = self.index.get, [], []
        for w in words:
            flat += [i for i in map(get, features(w)) if i is not None]
            ends.append(len(flat))
        sums = np.zeros((len(flat) + 1, self.weights.shape[1]))
        if flat:
            np.cumsum(self.weights[np.array(flat)], axis=0, out=sums[1:])
        ends = np.array(ends)
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def in_context(rows: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Potentials [n, k] of tokens from those of their words [n, k or 3k]: what the words before and after them say is added."""
    if rows.shape[1] == k:
        return rows
    out = rows[:, :k].copy()
    inside = ~first[1:, None]
    out[1:] += np.where(inside, rows[:-1, k : 2 * k], 0)
    out[:-1] += np.where(inside, rows[1:, 2 * k :], 0)
    return out


class Memory:
    """Potentials of the words met so far, by row; bounded."""

    def __init__(self, model: Chain, features: Callable[[str], Iterable[str]], limit: int = 250_000):
        self.model, self.features, self.limit = model, features, limit
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, model.weights.shape[1]), np.float32)

    def look_up(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """Log-potentials [len(words), k] of a batch's tokens; first: whether a token starts a chain."""
        rows = self.rows
        new = [w for w in set(words) if w not in rows]
        if len(rows) + len(new) > self.limit:
            rows.clear()
            new = list(set(words))
        if new:
            at, need = len(rows), len(rows) + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table[:at], np.zeros((need, self.table.shape[1]), np.float32)])
            self.table[at:need] = self.model.emissions(new, self.features)
            rows.update(zip(new, range(at, need), strict=True))
        found = self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].astype(np.float64)
        return in_context(found, first, len(self.model.labels))


def train(words: list[str], gold: np.ndarray, first: np.ndarray, labels: list, features: Callable[[str], Iterable[str]], least: int = 2, steps: int = 40, rate: float = 0.3, l2: float = 1e-6, weight: np.ndarray | None = None, context: bool = False) -> Chain:
    """Fits a chain to tokens whose labels (numbers into ``labels``) are known.

    least: a feature must occur in so many different words. weight: of each label's tokens."""
    k = len(labels)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    by_word = [list(features(w)) for w in seen]
    counts: dict[str, int] = {}
    for fs in by_word:
        for f in fs:
            counts[f] = counts.get(f, 0) + 1
    often = np.bincount(ids, minlength=len(seen)) if len(words) else np.zeros(0, int)
    index: dict[str, int] = {}
    feats, owner = [], []
    for w, fs in enumerate(by_word):
        for f in fs:
            if counts[f] >= least or often[w] >= least * 2:
                feats.append(index.setdefault(f, len(index)))
                owner.append(w)
    feats_a, owner_a = np.array(feats, np.int64), np.array(owner, np.int64)
    nf, nw, n = max(1, len(index)), len(seen), max(1, len(words))
    wide = 3 * k if context else k
    w_, start, trans = np.zeros((nf, wide)), np.zeros(k), np.zeros((k, k))
    inner = np.flatnonzero(~first[1:]) if len(words) else np.zeros(0, np.int64)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w_, start, trans)]
    truth = np.zeros((len(words), k))
    if len(words):
        truth[np.arange(len(words)), gold] = 1
    seen_first = truth[first].sum(0) if len(words) else np.zeros(k)
    seen_pairs = np.zeros((k, k))
    if len(words) > 1:
        np.add.at(seen_pairs, (gold[inner], gold[inner + 1]), 1)
    scale = np.maximum(1.0, np.bincount(feats_a, weights=often[owner_a], minlength=nf))[:, None] if len(feats) else np.ones((nf, 1))
    for step in range(1, steps + 1):
        word_scores = np.stack([np.bincount(owner_a, weights=w_[feats_a, j], minlength=nw) for j in range(wide)], 1) if len(feats) else np.zeros((nw, wide))
        post, pairs = marginals(in_context(word_scores[ids], first, k), first, start, trans) if len(words) else (truth, seen_pairs)
        rest = truth - post
        if weight is not None:
            rest = rest * weight[gold][:, None]
        views = [(ids, rest)] + ([(ids[inner], rest[inner + 1]), (ids[inner + 1], rest[inner])] if context else [])
        by_w = np.stack([np.bincount(at, weights=part[:, j], minlength=nw) for at, part in views for j in range(k)], 1) if len(words) else np.zeros((nw, wide))
        g = np.stack([np.bincount(feats_a, weights=by_w[owner_a, j], minlength=nf) for j in range(wide)], 1) if len(feats) else np.zeros((nf, wide))
        g = g / np.sqrt(scale * n) - l2 * w_
        gs = (seen_first - (post[first].sum(0) if len(words) else 0)) / n
        gt = (seen_pairs - pairs) / n
        for x, grad, (m1, m2) in zip((w_, start, trans), (g, gs, gt), state, strict=True):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Chain(labels, index, w_.astype(np.float32), start, trans)
