"""A causal self-attention model over ids, trained in numpy.

Inputs have a row of an embedding each; one layer of attention, with a learnt bias for each distance, and one hidden
layer read the inputs up to a place, and a softmax over the `head` most frequent ids and one
class for all others says what comes next. Within that class ids have their shares of the corpus' counts.
A window is `CONTEXT` inputs and `STRIDE` more whose outputs are scored; windows overlap by CONTEXT,
so that each id is scored once and sees from 1 to CONTEXT + STRIDE inputs, itself not among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTEXT, STRIDE = 16, 32
WINDOW = CONTEXT + STRIDE
#: Windows whose products are taken at once: always so many, filled up, so that a text's score doesn't depend on
#: which others are in a batch.
TOGETHER = 64
RATE, BATCH, SEED = 0.08, 32, 11

_AHEAD = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_DISTANCE = np.abs(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None])


@dataclass
class Shape:
    inputs: int
    head: int
    size: int = 16
    hidden: int = 16

    def parts(self) -> list[tuple[int, ...]]:
        d, m = self.size, self.hidden
        return [(self.inputs, d), (d, 3 * d), (WINDOW,), (d, d), (d, m), (m,), (m, d), (d, self.head + 1), (self.head + 1,)]

    def cut(self, flat: np.ndarray) -> list[np.ndarray]:
        """The parameters as views of one vector."""
        out, at = [], 0
        for shape in self.parts():
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def length(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts())

    def start(self, shares: np.ndarray) -> np.ndarray:
        """Small random weights; the output's bias is the logarithm of the classes' shares."""
        rng = np.random.default_rng(SEED)
        flat = rng.normal(0, 1, self.length()).astype(np.float32)
        for p, scale in zip(self.cut(flat), (0.3, 0.25, 0.0, 0.25, 0.25, 0.0, 0.18, 0.25, 0.0), strict=True):
            p *= scale
        self.cut(flat)[-1][:] = np.log(shares)
        return flat


def _attended(e: np.ndarray, p: list[np.ndarray], queries: slice) -> tuple[np.ndarray, ...]:
    """Attention of the places `queries` of windows e (n x WINDOW x d) to all places before and at them."""
    d = e.shape[2]
    q, k, v = np.split((e.reshape(-1, d) @ p[1]).reshape(*e.shape[:2], 3 * d), 3, 2)
    mask = (_AHEAD + p[2][_DISTANCE])[queries]
    a = np.matmul(q[:, queries], k.transpose(0, 2, 1)) * np.float32(d**-0.5) + mask
    a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(2, keepdims=True)
    return q, k, v, a, np.matmul(a, v)


def steps(flat: np.ndarray, state: np.ndarray, shape: Shape, inputs: np.ndarray, targets: np.ndarray, passes: int) -> float:
    """Adagrad over windows (n x WINDOW inputs, and the class that follows each, -1 for none), in place; the last
    pass' mean loss."""
    p, grad = shape.cut(flat), np.zeros_like(flat)
    g = shape.cut(grad)
    d = shape.size
    rng, mean = np.random.default_rng(SEED), 0.0
    for _ in range(passes):
        order, total = rng.permutation(len(inputs)), 0.0
        for at in range(0, len(order), BATCH):
            x, y = inputs[order[at : at + BATCH]], targets[order[at : at + BATCH]]
            lo = int((y >= 0).any(0).argmax())  # places before the first target are read only
            y = y[:, lo:].reshape(-1)
            known = np.flatnonzero(y >= 0)
            if not len(known):
                continue
            grad[:] = 0
            e = p[0][x]
            q, k, v, a, o = _attended(e, p, slice(lo, WINDOW))
            h = e[:, lo:].reshape(-1, d) + o.reshape(-1, d) @ p[3]
            z = np.maximum(h @ p[4] + p[5], 0)
            h2 = h + z @ p[6]
            logits = h2 @ p[7] + p[8]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            total -= float(np.log(logits[known, y[known]] + 1e-30).sum())
            logits[known, y[known]] -= 1
            logits[y < 0] = 0
            logits /= len(known)
            g[7][:] = h2.T @ logits
            g[8][:] = logits.sum(0)
            dh2 = logits @ p[7].T
            g[6][:] = z.T @ dh2
            dz = (dh2 @ p[6].T) * (z > 0)
            g[4][:] = h.T @ dz
            g[5][:] = dz.sum(0)
            dh = dh2 + dz @ p[4].T
            g[3][:] = o.reshape(-1, d).T @ dh
            do = (dh @ p[3].T).reshape(o.shape)
            da = np.matmul(do, v.transpose(0, 2, 1))
            dv = np.matmul(a.transpose(0, 2, 1), do)
            ds = a * (da - (da * a).sum(2, keepdims=True))
            g[2][:] = np.bincount(_DISTANCE[lo:].reshape(-1), ds.sum(0).reshape(-1), WINDOW)
            ds *= np.float32(d**-0.5)
            dq = np.zeros_like(v)
            dq[:, lo:] = np.matmul(ds, k)
            dqkv = np.concatenate([dq, np.matmul(ds.transpose(0, 2, 1), q[:, lo:]), dv], 2).reshape(-1, 3 * d)
            g[1][:] = e.reshape(-1, d).T @ dqkv
            de = dqkv @ p[1].T
            de.reshape(e.shape)[:, lo:] += dh.reshape(o.shape)
            flat_x = x.reshape(-1)
            by = np.argsort(flat_x, kind="stable")
            first = np.flatnonzero(np.diff(flat_x[by], prepend=-1))
            g[0][flat_x[by][first]] = np.add.reduceat(de[by], first)
            state += grad * grad
            flat -= np.float32(RATE) * grad / np.sqrt(state)
        mean = total / max(1, int((targets >= 0).sum()))
    return mean


class Scorer:
    """Log-probabilities of classes by a trained vector. Its arrays are made once, as fresh ones cost more than their products."""

    def __init__(self, flat: np.ndarray, shape: Shape) -> None:
        p, d, n = shape.cut(flat), shape.size, TOGETHER
        qkv = p[0] @ p[1]
        #: Of each input, in one row: query, key, value as the output reads it, embedding.
        self.rows = np.concatenate([qkv[:, :d] * np.float32(d**-0.5), qkv[:, d : 2 * d], qkv[:, 2 * d :] @ p[3], p[0]], 1)
        self.mask = (_AHEAD + p[2][_DISTANCE])[CONTEXT:]
        self.hidden, self.out = (np.concatenate([w, b[None]]) for w, b in ((p[4], p[5]), (p[7], p[8])))  # a bias is one more input
        self.back, self.ones, self.d = np.ascontiguousarray(p[6]), np.ones(max(WINDOW, shape.head + 1), np.float32), d
        empty = lambda *x: np.empty(x, np.float32)
        self.seen, self.a, self.v = empty(n * WINDOW, 4 * d), empty(n, STRIDE, WINDOW), empty(n, STRIDE, d)
        # products are taken window by window: in one of all windows, last digits depend on the place
        self.h, self.z, self.logits = np.ones((n, STRIDE, d + 1), np.float32), empty(n, STRIDE, shape.hidden), empty(n, STRIDE, shape.head + 1)
        self.at = np.arange(n * STRIDE) * (shape.head + 1)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms for windows x (n x WINDOW) of the classes y (n x STRIDE) after their last STRIDE places."""
        out = np.empty(y.shape, np.float32)
        d = self.d
        for lo in range(0, len(x), TOGETHER):
            xs, ys = x[lo : lo + TOGETHER], y[lo : lo + TOGETHER].reshape(-1)
            n = len(xs)
            if n < TOGETHER:
                xs = np.concatenate([xs, np.zeros((TOGETHER - n, WINDOW), xs.dtype)])
            np.take(self.rows, xs.reshape(-1), 0, self.seen, "clip")
            seen = self.seen.reshape(TOGETHER, WINDOW, 4 * d)
            np.matmul(seen[:, CONTEXT:, :d], np.ascontiguousarray(seen[:, :, d : 2 * d].transpose(0, 2, 1)), self.a)
            self.a += self.mask
            np.exp(self.a, self.a)  # scores are small: embeddings are
            np.matmul(self.a, seen[:, :, 2 * d : 3 * d], self.v)
            self.v /= (self.a @ self.ones[:WINDOW])[:, :, None]
            h = self.h[:, :, :d]
            np.add(self.v, seen[:, CONTEXT:, 3 * d :], h)
            np.matmul(self.h, self.hidden, self.z)
            np.maximum(self.z, 0, self.z)
            h += self.z @ self.back
            np.matmul(self.h, self.out, self.logits)
            told = np.take(self.logits.reshape(-1), self.at[: len(ys)] + ys)
            np.exp(self.logits, self.logits)
            out[lo : lo + n] = (told - np.log((self.logits @ self.ones[: self.logits.shape[2]]).reshape(-1)[: len(ys)])).reshape(n, STRIDE)
        return out
