"""A small gated recurrent language model in numpy, with a class-factored softmax."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN, SPAN, LANES = 16, 32, 512  # units; steps of a truncated window; texts scored side by side
LEARNT_LANES = 256  # stretches of a sequence learnt side by side


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Gru:
    """Word ids count from 0; id i is word i % width of class i // width.  ``end`` also stands before a text."""

    width: int
    end: int
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, counts: np.ndarray, width: int, end: int, seed: int = 5) -> Gru:
        """Starts as the unigram model of ``counts``; all else small and random."""
        r, h = np.random.default_rng(seed), HIDDEN
        n = len(counts) // width
        share = (counts.astype(np.float64) + 0.5).reshape(n, width)
        draw = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        p = {
            "x": draw(len(counts), 3 * h), "u": draw(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "c": draw(h, n) * 0.1, "cb": np.log(share.sum(1) / share.sum()).astype(np.float32),
            "w": draw(n, h, width) * 0.1, "wb": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        }
        return cls(width, end, p)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at, p = 0, {}
        for k, v in self.p.items():
            p[k] = np.asarray(flat[at : at + v.size], np.float32).reshape(v.shape).copy()
            at += v.size
        return Gru(self.width, self.end, p)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        g, n = self.p["x"][x] + self.p["b"], HIDDEN
        hu = h @ self.p["u"]
        zr = _sigmoid(g[:, : 2 * n] + hu[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(g[:, 2 * n :] + r * hu[:, 2 * n :])
        return c + z * (h - c), (x, h, z, r, c, hu[:, 2 * n :])

    def log_chances(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log chance (natural) of word y after state h; with ``grads`` also adds gradients of its negative sum."""
        p, kind, word = self.p, y // self.width, y % self.width
        logit = h @ p["c"] + p["cb"]
        logit -= logit.max(1, keepdims=True)
        e = np.exp(logit)
        total = e.sum(1, keepdims=True)
        rows = np.arange(len(y))
        out = logit[rows, kind] - np.log(total[:, 0])
        dh = None
        if grads is not None:
            d = e / total
            d[rows, kind] -= 1
            grads["c"] += h.T @ d
            grads["cb"] += d.sum(0)
            dh = d @ p["c"].T
        order = np.argsort(kind, kind="stable")
        cut = np.searchsorted(kind[order], np.arange(len(p["cb"]) + 1))
        for k in range(len(p["cb"])):
            at = order[cut[k] : cut[k + 1]]
            if not len(at):
                continue
            logit = h[at] @ p["w"][k] + p["wb"][k]
            logit -= logit.max(1, keepdims=True)
            e = np.exp(logit)
            total = e.sum(1, keepdims=True)
            here = np.arange(len(at))
            out[at] += logit[here, word[at]] - np.log(total[:, 0])
            if grads is not None:
                d = e / total
                d[here, word[at]] -= 1
                grads["w"][k] += h[at].T @ d
                grads["wb"][k] += d.sum(0)
                dh[at] += d @ p["w"][k].T
        return out, dh

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log chance of each whole text (ids, its end included), the state carried from window to window."""
        out = np.zeros(len(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes: list[list[int]] = [[] for _ in range(min(LANES, len(texts)))]
        load = [(0, i) for i in range(len(lanes))]
        for i in np.argsort(-sizes, kind="stable").tolist():
            if sizes[i]:
                n, lane = heapq.heappop(load)
                lanes[lane].append(i)
                heapq.heappush(load, (n + int(sizes[i]), lane))
        lanes = sorted((x for x in lanes if x), key=lambda x: -sizes[x].sum())
        if not lanes:
            return out
        length = np.array([sizes[x].sum() for x in lanes])
        ids, doc, begins = (np.zeros((len(lanes), length[0]), t) for t in (np.int32, np.int32, bool))
        for i, lane in enumerate(lanes):
            ids[i, : length[i]] = np.concatenate([texts[j] for j in lane])
            doc[i, : length[i]] = np.repeat(lane, sizes[lane])
            begins[i, np.cumsum(sizes[lane]) - sizes[lane]] = True
        before = np.concatenate((np.full((len(lanes), 1), self.end, np.int32), ids[:, :-1]), 1)
        before[begins] = self.end
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        keep = ~begins
        for a in range(0, int(length[0]), SPAN):
            active = int(np.searchsorted(-length, -a))  # lanes come in order of length
            window = slice(a, a + SPAN)
            states, h = self._states(before[:active, window].T, keep[:active, window].T, h[:active])
            here = (np.arange(a, a + states.shape[0])[:, None] < length[None, :active]).ravel()
            chance, _ = self.log_chances(states.reshape(-1, HIDDEN)[here], ids[:active, window].T.ravel()[here])
            out += np.bincount(doc[:active, window].T.ravel()[here], chance, len(texts))
        return out

    def _states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the words x (step by lane), of which those not to ``keep`` begin a text; and the last."""
        n, u = HIDDEN, self.p["u"]
        fed = self.p["x"][x] + self.p["b"]
        keep = keep[:, :, None].astype(h.dtype)
        states = np.empty((*x.shape, n), fed.dtype)
        for t in range(len(x)):
            h = h * keep[t]
            through = h @ u
            gates = fed[t, :, : 2 * n]
            gates += through[:, : 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            c = through[:, 2 * n :]
            c *= gates[:, n:]
            c += fed[t, :, 2 * n :]
            np.tanh(c, out=c)
            h -= c
            h *= gates[:, :n]
            h = np.add(h, c, out=states[t])
        return states, h

    def learn(self, sequence: np.ndarray, rate: float) -> int:
        """Adam over texts in a row, each with its end, by truncated backpropagation; returns the number of steps.

        The sequence is cut into stretches that are learnt side by side.  Windows of ``SPAN`` words follow each other with the
        state carried from one to the next, and begin afresh after an end; only the gradient is cut between them.
        """
        n = len(sequence)
        if not n:
            return 0
        lanes = min(LEARNT_LANES, -(-n // SPAN))
        length = -(-n // lanes)
        y = np.full(lanes * length, -1, np.int64)
        y[:n] = sequence
        x = np.full(lanes * length, self.end, np.int64)
        x[1:n] = sequence[: n - 1]
        x, y = x.reshape(lanes, length), y.reshape(lanes, length)
        flat = self.flat()
        at, views = 0, {}
        for k, v in self.p.items():  # all weights, and all gradients, lie in one array
            views[k] = (at, at + v.size, v.shape)
            at += v.size
        self.p = {k: flat[a:b].reshape(shape) for k, (a, b, shape) in views.items()}
        grad, m, v, done = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), 0
        grads = {k: grad[a:b].reshape(shape) for k, (a, b, shape) in views.items()}
        h = np.zeros((lanes, HIDDEN), np.float32)
        for a in range(0, length, SPAN):
            grad[:] = 0
            h, size = self._window(x[:, a : a + SPAN], y[:, a : a + SPAN], h, grads)
            if not size:
                continue
            done += 1
            grad *= np.float32(1 / size)
            m += np.float32(0.1) * (grad - m)
            np.multiply(grad, grad, out=grad)
            v += np.float32(0.01) * (grad - v)
            step = rate * (1 - a / length) * np.sqrt(1 - 0.99**done) / (1 - 0.9**done)
            flat -= np.float32(step) * m / (np.sqrt(v) + np.float32(1e-7))
        return done

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, grads: dict) -> tuple[np.ndarray, int]:
        """The state after a window, and the number of words in it; adds the gradients of the words' negative log chances.

        Words of -1 in ``y`` are not there.
        """
        p, n, (lanes, steps) = self.p, HIDDEN, x.shape
        fed = p["x"][x.T] + p["b"]
        keep = (x.T != self.end)[:, :, None].astype(h.dtype)  # a text begins with no state
        shape = (steps, lanes, n)
        before, z, r, c, hu = (np.empty(shape, fed.dtype) for _ in range(5))
        states = np.empty(shape, fed.dtype)
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            through = before[t] @ p["u"]
            gates = _sigmoid(fed[t, :, : 2 * n] + through[:, : 2 * n])
            z[t], r[t], hu[t] = gates[:, :n], gates[:, n:], through[:, 2 * n :]
            np.tanh(fed[t, :, 2 * n :] + r[t] * hu[t], out=c[t])
            h = np.add(c[t], z[t] * (before[t] - c[t]), out=states[t])
        words, there = y.T.ravel(), np.flatnonzero(y.T.ravel() >= 0)
        dh_all = np.zeros((steps * lanes, n), fed.dtype)
        dh_all[there] = self.log_chances(states.reshape(-1, n)[there], words[there], grads)[1]
        dh_all = dh_all.reshape(shape)
        to_c, to_z, to_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), hu * r * (1 - r)
        gate, inner = np.empty((steps, lanes, 3 * n), fed.dtype), np.empty((steps, lanes, 3 * n), fed.dtype)
        carry, back = np.zeros_like(h), p["u"].T.copy()
        for t in range(steps - 1, -1, -1):
            dh = dh_all[t] + carry
            dc = dh * to_c[t]
            g, i = gate[t], inner[t]
            np.multiply(dh, to_z[t], out=g[:, :n])
            np.multiply(dc, to_r[t], out=g[:, n : 2 * n])
            g[:, 2 * n :] = dc
            i[:, : 2 * n] = g[:, : 2 * n]
            np.multiply(dc, r[t], out=i[:, 2 * n :])
            carry = (dh * z[t] + i @ back) * keep[t]
        flat = gate.reshape(-1, 3 * n)
        grads["b"] += flat.sum(0)
        grads["u"] += before.reshape(-1, n).T @ inner.reshape(-1, 3 * n)
        ids = x.T.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        grads["x"][ids[first]] += np.add.reduceat(flat[order], first, axis=0)
        return h, len(there)
