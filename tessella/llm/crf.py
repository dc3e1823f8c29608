"""A linear-chain conditional random field with two labels, in NumPy.

The log-odds of label 1 at a position are ``features @ weights``; ``trans`` is
the 2x2 matrix of transition scores. Sequences lie one after another in flat
arrays; all of them advance together, one position a step, with messages kept
as ratios of label 1 to label 0.
"""

from __future__ import annotations

import numpy as np

_BOUND = 30.0
_BLOCK = 32


class Chain:
    """Sequences of given lengths, laid out in blocks so that long ones need few steps.

    Each block's transfer matrices are multiplied first (all blocks at once),
    the products carry messages from block to block, and then all blocks are
    gone through at once again.
    """

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.n = int(lengths.sum())
        blocks = -(-lengths // _BLOCK)
        self.firsts = np.cumsum(blocks) - blocks
        self.total = int(blocks.sum())
        order = np.argsort(-blocks, kind="stable")
        self.by_size, self.sizes = self.firsts[order], blocks[order]
        self.most = int(blocks.max()) if len(blocks) else 0
        self.active = np.searchsorted(-self.sizes, -np.arange(self.most), "left")
        row = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(self.n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.slot = (inside % _BLOCK) * self.total + self.firsts[row] + inside // _BLOCK
        self.first_slots = self.firsts[lengths > 0]
        self.begins = (np.cumsum(lengths) - lengths)[lengths > 0]

    def marginals(self, odds: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """P(label 1) of each position; with ``pairs`` also the summed 2x2 pair expectations."""
        if not self.n:
            return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
        a = np.exp(trans)
        e = np.ones(_BLOCK * self.total)
        e[self.slot] = np.exp(np.clip(odds, -_BOUND, _BOUND))
        used = np.zeros(_BLOCK * self.total, bool)
        used[self.slot] = True
        e, used = e.reshape(_BLOCK, -1), used.reshape(_BLOCK, -1)
        # The transfer into a position: transition then emission; the first of a sequence has no transition, padding no effect.
        plain = ~used
        plain[0, self.first_slots] = True
        t00, t01 = np.where(plain, 1.0, a[0, 0]), np.where(plain, 0.0, a[0, 1])
        t10, t11 = np.where(plain, 0.0, a[1, 0]), np.where(plain, 1.0, a[1, 1])
        p00, p01, p10, p11 = np.ones(self.total), np.zeros(self.total), np.zeros(self.total), np.ones(self.total)
        for k in range(_BLOCK):
            p00, p01 = p00 * t00[k] + p01 * t10[k], (p00 * t01[k] + p01 * t11[k]) * e[k]
            p10, p11 = p10 * t00[k] + p11 * t10[k], (p10 * t01[k] + p11 * t11[k]) * e[k]
            if k % 4 == 3:
                norm = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
                p00, p01, p10, p11 = p00 / norm, p01 / norm, p10 / norm, p11 / norm
        # Ratios of label 1 to 0 that come into each block from the left and from the right.
        left, right = np.ones(self.total), np.ones(self.total)
        for b in range(1, self.most):
            at = self.by_size[:self.active[b]] + b
            r = left[at - 1]
            left[at] = (p01[at - 1] + r * p11[at - 1]) / (p00[at - 1] + r * p10[at - 1])
        for b in range(self.most - 2, -1, -1):
            at = self.by_size[:self.active[b + 1]] + b
            r = right[at + 1]
            right[at] = (p10[at + 1] + p11[at + 1] * r) / (p00[at + 1] + p01[at + 1] * r)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        r = left
        for k in range(_BLOCK):
            r = alpha[k] = e[k] * (t01[k] + r * t11[k]) / (t00[k] + r * t10[k])
        r = right
        for k in range(_BLOCK - 1, -1, -1):
            beta[k] = r
            x = e[k] * r
            r = (t10[k] + t11[k] * x) / (t00[k] + t01[k] * x)
        alpha, beta, e = alpha.ravel()[self.slot], beta.ravel()[self.slot], e.ravel()[self.slot]
        both = alpha * beta
        p = both / (1 + both)
        if not pairs:
            return p
        inner = np.ones(self.n, bool)
        inner[self.begins] = False
        at = np.flatnonzero(inner)
        lead, follow = alpha[at - 1], e[at] * beta[at]
        joint = np.stack([np.full(len(at), a[0, 0]), a[0, 1] * follow, a[1, 0] * lead, a[1, 1] * lead * follow])
        return p, (joint / joint.sum(0)).sum(1).reshape(2, 2)


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores by Adam on the conditional log-likelihood (per position, with an L2 penalty)."""
    chain = Chain(lengths)
    n = max(1, len(labels))
    y = labels.astype(float)
    inner = np.ones(len(labels), bool)
    inner[(np.cumsum(lengths) - lengths)[np.asarray(lengths) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(labels[at - 1].astype(int) * 2 + labels[at].astype(int), minlength=4).reshape(2, 2)
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pair = chain.marginals(features @ w, trans, True)
        grad = np.concatenate([features.T @ (p - y) / n, (pair - seen).ravel() / n]) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 300, rate: float = 0.2, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression by Adam; ``weight`` counts rows more or less than once."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(y)) if weight is None else weight
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, rounds + 1):
        grad = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -_BOUND, _BOUND))) - y)) / max(1, weight.sum()) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -_BOUND, _BOUND)))
