"""A gated recurrent language model in numpy with a class-factored softmax.

Symbols are numbered by frequency: 0 ends a document, 1 stands for all words outside the vocabulary. ``CLASS`` neighbouring
numbers make a class; the probability of a symbol is that of its class times that of the symbol within the class.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

HIDDEN = 16
CLASS = 64
END, UNKNOWN = 0, 1
#: Documents side by side: more of them where there is much to learn from.
LEAST_LANES, LANES, WINDOW = 32, 256, 16
_CHUNK = 60_000  # tokens whose output probabilities are made at a time


@dataclass
class Weights:
    inputs: np.ndarray  # symbol by gates (update, reset, candidate)
    recurrent: np.ndarray  # state by gates
    to_class: np.ndarray
    class_bias: np.ndarray
    to_symbol: np.ndarray  # class by state by place in it
    symbol_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pack(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in self.arrays())

    def unpack(self, data: bytes) -> Weights:
        """Weights of this one's shapes from ``data``."""
        flat, at, out = np.frombuffer(data, dtype="<f4"), 0, []
        for a in self.arrays():
            out.append(flat[at: at + a.size].reshape(a.shape).copy())
            at += a.size
        return Weights(*out)


def initial(counts: np.ndarray, seed: int = 5) -> Weights:
    """Small random weights, and biases that give the symbols' shares of ``counts``."""
    rng = np.random.default_rng(seed)
    n_class = -(-len(counts) // CLASS)
    padded = np.zeros(n_class * CLASS)
    padded[: len(counts)] = counts + 0.1
    within = padded.reshape(n_class, CLASS)

    def small(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)

    with np.errstate(divide="ignore"):
        symbol_bias = np.log(within / within.sum(axis=1, keepdims=True))
    return Weights(
        small(n_class * CLASS, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, n_class),
        np.log(within.sum(axis=1) / padded.sum()).astype(np.float32), np.zeros((n_class, HIDDEN, CLASS), np.float32),
        np.maximum(symbol_bias, -80).astype(np.float32))


def _step(w: Weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    g, u = w.inputs[x], h @ w.recurrent
    gates = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    m = np.tanh(g[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
    return m + z * (h - m), z, r, m, u[:, 2 * HIDDEN:]


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of ``states``; above 60 they count as 60, so that sums stay finite."""
    x = states @ weights
    x += bias
    # States lie between -1 and 1, which bounds the logits; seldom is there anything to cut.
    if (np.abs(weights).sum(axis=0) + bias).max() > 60:
        np.minimum(x, 60, out=x)
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]
    return x


def _log_share(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at ``chosen``."""
    picked = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(logits.shape[1], dtype=logits.dtype))


def log_probabilities(w: Weights, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the symbols ``y`` after ``states``."""
    kind, place = y // CLASS, y % CLASS
    out = _log_share(_logits(states, w.to_class, w.class_bias), kind)
    order = np.argsort(kind.astype(np.int16), kind="stable")  # so that a class's rows are neighbours
    states, place, within = states[order], place[order], np.empty_like(out)
    ends = np.cumsum(np.bincount(kind, minlength=len(w.class_bias)))
    begin = 0
    for c, end in enumerate(ends.tolist()):
        if begin < end:
            within[begin:end] = _log_share(_logits(states[begin:end], w.to_symbol[c], w.symbol_bias[c]), place[begin:end])
        begin = end
    out[order] += within
    return out


def score(w: Weights, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-likelihoods of whole documents: ``symbols`` has them one after the other, each with its end.

    Documents advance side by side, the longest first; each keeps its own state from its first symbol to its end.
    """
    total = np.zeros(len(lengths))
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    x = np.zeros(len(lengths), dtype=np.int64)
    h = np.zeros((len(lengths), HIDDEN), dtype=np.float32)
    states, targets, owners, waiting = [], [], [], 0
    for t in range(int(sorted_lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-sorted_lengths, -t, side="left"))
        h = _step(w, x[:n], h[:n])[0]
        x = symbols[begins[:n] + t].astype(np.int64)
        states.append(h)
        targets.append(x)
        owners.append(n)
        waiting += n
        if waiting >= _CHUNK or t + 1 == sorted_lengths[0]:
            p = log_probabilities(w, np.concatenate(states), np.concatenate(targets))
            lane = np.concatenate([np.arange(n) for n in owners])
            total[: owners[0]] += np.bincount(lane, weights=p, minlength=owners[0])
            states, targets, owners, waiting = [], [], [], 0
    out = np.zeros(len(lengths))
    out[order] = total
    return out


class Trainer:
    """Truncated backpropagation through windows of ``WINDOW`` steps; states carry on into the next window."""

    def __init__(self, weights: Weights, rate: float = 0.25):
        self.w, self.rate = weights, rate
        self.square = [np.full(a.shape, 0.05, dtype=np.float32) for a in weights.arrays()]

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """One update from steps by lanes of symbols before (``x``) and after (``y``); returns the last state.

        ``real`` tells which cells hold symbols, where not all do.
        """
        w, steps, kept, outs = self.w, len(x), [], []
        goes_on = (x != END).astype(np.float32)[:, :, None]
        for t in range(steps):
            h = h * goes_on[t]  # a document begins
            new, z, r, m, un = _step(w, x[t], h)
            kept.append((h, z, r, m, un))
            outs.append(new)
            h = new
        grads = [np.zeros_like(a) for a in w.arrays()[1:]]
        states, cells = np.concatenate(outs), slice(None) if real is None else np.flatnonzero(real)
        d_out = np.zeros_like(states)
        d_out[cells] = self._outputs(states[cells], y.reshape(-1)[cells], grads)
        d_out = d_out.reshape(steps, -1, HIDDEN)
        d_h = np.zeros_like(h)
        d_in = np.empty((steps, x.shape[1], 3 * HIDDEN), dtype=np.float32)
        back = w.recurrent.T.copy()
        for t in reversed(range(steps)):
            before, z, r, m, un = kept[t]
            d = d_out[t] + d_h
            d_m = d * (1 - z) * (1 - m * m)
            d_in[t, :, :HIDDEN] = d * (before - m) * z * (1 - z)
            d_in[t, :, HIDDEN: 2 * HIDDEN] = d_m * un * r * (1 - r)
            d_in[t, :, 2 * HIDDEN:] = d_m * r
            grads[0] += before.T @ d_in[t]
            d_h = (d * z + d_in[t] @ back) * goes_on[t]
            d_in[t, :, 2 * HIDDEN:] = d_m
        for a, g, s in zip(w.arrays()[1:], grads, self.square[1:], strict=True):
            self._update(a, g, s)
        # Rows of the inputs that this window has: gradients of one symbol are neighbours once they are sorted.
        symbol = x.reshape(-1)
        order = np.argsort(symbol.astype(np.int16), kind="stable")
        rows, begin = np.unique(symbol[order], return_index=True)
        own, square = w.inputs[rows], self.square[0][rows]
        self._update(own, np.add.reduceat(d_in.reshape(-1, 3 * HIDDEN)[order], begin, axis=0), square)
        w.inputs[rows], self.square[0][rows] = own, square
        return h

    def _update(self, a: np.ndarray, g: np.ndarray, square: np.ndarray) -> None:
        np.clip(g, -5, 5, out=g)
        square += g * g
        g /= np.sqrt(square)
        g *= self.rate
        a -= g

    def _outputs(self, states: np.ndarray, y: np.ndarray, grads: list[np.ndarray]) -> np.ndarray:
        """Gradients of the states; those of the output weights are added to ``grads`` (all weights but the inputs)."""
        w, scale = self.w, np.float32(1 / max(1, len(y)) ** 0.5)
        order = np.argsort(y.astype(np.int16), kind="stable")  # so that a class's rows are neighbours
        states, y = states[order], y[order]
        kind, place = y // CLASS, y % CLASS
        p = _softmax(_logits(states, w.to_class, w.class_bias))
        p[np.arange(len(y)), kind] -= 1
        p *= scale
        grads[1] += states.T @ p
        grads[2] += p.sum(axis=0)
        d = p @ w.to_class.T
        ends = np.cumsum(np.bincount(kind, minlength=len(w.class_bias)))
        begin = 0
        for c, end in enumerate(ends.tolist()):
            if begin < end:
                mine = states[begin:end]
                q = _softmax(_logits(mine, w.to_symbol[c], w.symbol_bias[c]))
                q[np.arange(end - begin), place[begin:end]] -= 1
                q *= scale
                grads[3][c] = mine.T @ q
                grads[4][c] = q.sum(axis=0)
                d[begin:end] += q @ w.to_symbol[c].T
            begin = end
        out = np.empty_like(d)
        out[order] = d
        return out


def train(weights: Weights, symbols: np.ndarray, least_updates: int = 30) -> Weights:
    """Learn from all of ``symbols``, documents one after the other each with its end, once or until ``least_updates``."""
    if not len(symbols):
        return weights
    lanes = max(1, min(LANES, max(LEAST_LANES, len(symbols) // (64 * WINDOW)), len(symbols) // WINDOW))
    steps = -(-len(symbols) // lanes)
    y = np.full(lanes * steps, END, dtype=np.int64)
    y[: len(symbols)] = symbols
    real = (np.arange(lanes * steps) < len(symbols)).reshape(lanes, steps).T
    y = y.reshape(lanes, steps).T
    x = np.concatenate([np.full((1, lanes), END), y[:-1]])
    trainer, done = Trainer(weights), 0
    while done == 0 or done < least_updates:
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for t in range(0, steps, WINDOW):
            some = real[t: t + WINDOW]
            h = trainer.window(x[t: t + WINDOW], y[t: t + WINDOW], h, None if some.all() else some)
            done += 1
    return weights
