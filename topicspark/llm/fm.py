"""Factorization machine over hashed features: logistic loss, AdaGrad, scores in linear time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

D_BITS, FACTORS = 18, 8
#: Standard errors a ratio that tells only beside another feature must lie from 0.
Z = 4.0


@dataclass
class Sparse:
    """Rows of binary features: ``index[first[i]:first[i+1]]`` are those of row i, each worth 1 / sqrt(their number)."""

    index: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.first)[rows]
        first = np.concatenate(([0], np.cumsum(n)))
        out = np.empty(first[-1], dtype=self.index.dtype)
        # some rows at a time, so that no array of places is as long as all indices
        for a in range(0, len(rows), 512):
            part = slice(a, min(a + 512, len(rows)))
            begin, end = first[part.start], first[part.stop]
            at = np.arange(begin, end) + np.repeat(self.first[:-1][rows[part]] - first[part], n[part])
            out[begin:end] = self.index[at]
        return Sparse(out, first)

    def blocks(self, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, end row, indices) of runs of rows, so that no array over all indices is made."""
        for at in range(0, len(self), rows):
            to = min(at + rows, len(self))
            yield at, to, self.index[self.first[at] : self.first[to]]

    def only(self, used: np.ndarray) -> Sparse:
        """Without the features that aren't marked."""
        parts, n = [np.zeros(0, self.index.dtype)], [np.zeros(1, np.int64)]
        for at, to, index in self.blocks():
            keep = used[index]
            upto = np.concatenate(([0], np.cumsum(keep)))
            n.append(np.diff(upto[self.first[at : to + 1] - self.first[at]]))
            parts.append(index[keep])
        return Sparse(np.concatenate(parts), np.cumsum(np.concatenate(n)))

    def counts(self, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How many rows of label 1, and how many rows, have each feature."""
        ones, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for at, to, index in self.blocks():
            every += np.bincount(index, minlength=size)
            ones += np.bincount(index[np.repeat(y[at:to] == 1, np.diff(self.first[at : to + 1]))], minlength=size)
        return ones, every


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    used: np.ndarray

    def score(self, x: Sparse) -> np.ndarray:
        """Log odds: bias + sum of w x + half of the sum over factors of (sum of v x) squared - sum of (v x) squared.

        Features that aren't used don't count in a row's scale either, so a long text doesn't drown what tells."""
        x = x.only(self.used)
        scale = 1 / np.sqrt(np.maximum(np.diff(x.first), 1))
        linear = sums(self.linear[x.index][:, None], x.first)[:, 0] * scale
        v = self.factors[x.index]
        # x is the same for all features of a row, so it can be left out of the sums
        pair = sums(v, x.first) ** 2 - sums(v * v, x.first)
        return self.bias + linear + 0.5 * pair.sum(axis=1) * scale**2


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows first[i]..first[i+1] of ``values``; empty ranges are 0."""
    out = np.zeros((len(first) - 1, values.shape[1]), dtype=np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=np.float64)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def gains(x: Sparse, y: np.ndarray, size: int, least: int) -> np.ndarray:
    """Smoothed log ratio of each feature's rate among the ones to that among the zeros; 0 for features in fewer than
    ``least`` rows."""
    ones, every = x.counts(y, size)
    a, b = (ones + 0.5) / (y.sum() + 1), (every - ones + 0.5) / (len(y) - y.sum() + 1)
    return np.where(every >= least, np.log(a / b), 0).astype(np.float32)


def select(x: Sparse, y: np.ndarray, size: int, least: int, weakest: float) -> np.ndarray:
    """The log ratios (gains) of the features to use, 0 for the others.

    Used are features whose own ratio is ``weakest`` or more, and those that only tell together with such a one: whose
    ratio among the rows that have one is as large, and Z standard errors from 0.
    """
    gain = gains(x, y, size, least)
    strong = np.abs(gain) >= weakest
    gain = np.where(strong, gain, 0).astype(np.float32)
    rows = np.flatnonzero(np.diff(x.only(gain != 0).first))
    if weakest and len(rows) and 0 < y[rows].sum() < len(rows):
        part = x.take(rows)
        ones, every = part.counts(y[rows], size)
        error = np.sqrt(1 / (ones + 0.5) + 1 / (every - ones + 0.5))
        with_one = gains(part, y[rows], size, least)
        more = (gain == 0) & (np.abs(with_one) >= np.maximum(weakest, Z * error))
        gain[more] = with_one[more]
    return gain


def train(
    x: Sparse, y: np.ndarray, epochs: int = 4, factors: int = FACTORS, size: int = 1 << D_BITS, rate: float = 0.3,
    decay: float = 1e-4, least: int = 4, weakest: float = 0.0, batch: int = 128, seed: int = 7,
) -> Machine:
    """Fit to labels 0 and 1, both labels weighing the same. Weights are learnt as multiples of the features' log ratios
    (gains), so that rare features can't be learnt by heart. Features in fewer than ``least`` rows, or that tell less
    than ``weakest`` (see select), aren't used.
    Without rows the machine says 0; with rows of one label only, it says that label."""
    linear, v = np.zeros(size, dtype=np.float32), np.zeros((size, factors), dtype=np.float32)
    none = np.zeros(size, dtype=bool)
    if not len(x):
        return Machine(0.0, linear, v, none)
    if not 0 < y.sum() < len(y):
        return Machine(4.0 if y.sum() else -4.0, linear, v, none)
    rng = np.random.default_rng(seed)
    gain = select(x, y, size, least, weakest)
    used = gain != 0
    x = x.only(used)
    linear[used] = 1
    v[used] = rng.normal(0, 0.03, (int(used.sum()), factors))
    weight = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    bias, g_linear, g_v, g_bias = 0.0, np.full(size, 1e-4, dtype=np.float32), np.full((size, factors), 1e-4, dtype=np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            b = x.take(part)
            row = b.row()
            own = v[b.index] * gain[b.index][:, None]
            scale = 1 / np.sqrt(np.maximum(np.diff(b.first), 1))
            total = sums(own, b.first)
            flat = sums((linear[b.index] * gain[b.index])[:, None], b.first)[:, 0] * scale
            z = bias + flat + 0.5 * (total**2 - sums(own * own, b.first)).sum(axis=1) * scale**2
            error = (sigmoid(z) - y[part]) * weight[part] / len(part)
            seen, inverse = np.unique(b.index, return_inverse=True)
            up = gain[seen]
            d_linear = np.bincount(inverse, weights=(error * scale)[row], minlength=len(seen)) * up + decay * (linear[seen] - 1)
            d_pair = (error * scale**2)[row][:, None] * (total[row] - own)
            d_v = np.stack([np.bincount(inverse, weights=d_pair[:, f], minlength=len(seen)) for f in range(factors)], axis=1)
            d_v = d_v * up[:, None] + decay * v[seen]
            g_linear[seen] += d_linear**2
            g_v[seen] += d_v**2
            linear[seen] -= (rate * d_linear / np.sqrt(g_linear[seen])).astype(np.float32)
            v[seen] -= (0.2 * rate * d_v / np.sqrt(g_v[seen])).astype(np.float32)
            d_bias = float(error.sum())
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)
    return Machine(bias, linear * gain, v * gain[:, None], used)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    _, rank, n = np.unique(score, return_inverse=True, return_counts=True)
    mean = np.cumsum(n) - (n - 1) / 2
    ones = y == 1
    a, b = ones.sum(), (~ones).sum()
    return float((mean[rank[ones]].sum() - a * (a + 1) / 2) / (a * b)) if a and b else float("nan")
