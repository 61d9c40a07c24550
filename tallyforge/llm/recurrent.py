"""A gated recurrent language model in numpy: training by truncated backpropagation, class-factored softmax, scoring with the state carried on.

Symbols are numbers: 0 ends a text, then come the frequent words, then groups of the others. Each symbol belongs to an output class:
frequent ones share the probability in classes of about equal mass, each group is a class of its own. The probability of a
symbol is its class's, given the state, times its own within the class, given the state. The state before a text's first symbol is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Size of the state, symbols of a window (gradients end at its start), windows of a training stretch, and stretches trained together.
HIDDEN, WINDOW, WINDOWS, STREAMS = 16, 16, 8, 32
#: Texts that are scored together, and states whose outputs are computed at once.
SLOTS, BLOCK = 768, 1024
RATE, CLIP = 0.08, 1.0


class Classes:
    """Output classes of ``words`` symbols, in the order of their counts, and of ``groups`` symbols behind them, one class each."""

    def __init__(self, counts: Sequence[float], groups: int, classes: int):
        mass = np.cumsum(np.sqrt(np.asarray(counts, np.float64) + 0.1))
        share = np.minimum((mass - mass[0]) / max(mass[-1], 1e-9) * classes, classes - 1).astype(np.int64)
        _, of = np.unique(share, return_inverse=True)  # no class is empty
        self.first = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        self.shared = len(self.first) - 1
        self.of = np.append(of, self.shared + np.arange(groups))
        self.count = self.shared + groups


def initial(classes: Classes, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random inputs and recurrences; outputs that give every symbol its share of the counts, whatever the state."""
    g = np.random.default_rng(seed)
    n = np.asarray(counts, np.float64) + 0.1
    mass = np.bincount(classes.of, n, classes.count)
    words = classes.first[-1]
    p = {
        "input": g.normal(0, 0.4, (len(n), 3 * hidden)), "recurrent": g.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)),
        "class": np.zeros((hidden, classes.count)), "class_bias": np.log(mass / mass.sum()), "word": np.zeros((hidden, words)), "word_bias": np.log(n / mass[classes.of])[:words],
    }
    p["input"][:, :hidden] += 1.0  # the state is kept rather than replaced at first
    return {k: v.astype(np.float32) for k, v in p.items()}


def step(h: np.ndarray, a: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what the way back needs."""
    k = h.shape[1]
    b = h @ u
    gates = a[:, : 2 * k] + b[:, : 2 * k]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    z, r = gates[:, :k], gates[:, k:]
    n = r * b[:, 2 * k :]
    n += a[:, 2 * k :]
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, z, r, n, b[:, 2 * k :]


def by_gate(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The inputs and the recurrence in three parts, so that what a step reads and writes of a gate is one block."""
    k = len(p["recurrent"])
    return [np.ascontiguousarray(p[name].reshape(-1, 3, k).transpose(1, 0, 2)) for name in ("input", "recurrent")]


def inputs_of(inputs: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The inputs of symbols (positions x streams), by position and gate."""
    parts, size, k = inputs.shape
    return inputs.reshape(-1, k).take(symbols[:, None, :] + (np.arange(parts) * size)[:, None], axis=0)


def advance(h: np.ndarray, a: np.ndarray, u: np.ndarray, b: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """step() by gate, into given arrays; the first two parts of the inputs become the gates."""
    np.matmul(h, u, out=b)
    gates = a[:2]
    gates += b[:2]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    np.multiply(gates[1], b[2], out=n)
    n += a[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= gates[0]
    out += n


def log_softmax_of(logits: np.ndarray, at: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of one column a row, and the rows' sums of exponentials, by which logits are overwritten. ``small``: no logit can overflow."""
    rows, ones = np.arange(len(at)), np.ones(logits.shape[1], logits.dtype)
    if not small and len(at) and max(float(logits.max()), -float(logits.min())) > 60:
        logits -= logits.max(1, keepdims=True)
    own = logits[rows, at]
    np.exp(logits, out=logits)
    sums = logits @ ones
    return own - np.log(sums), sums


class Outputs:
    """The output weights with their biases as a last row, by class; and whether no state can make a logit overflow."""

    def __init__(self, p: dict[str, np.ndarray], classes: Classes):
        self.classes, self.of = classes, classes.of.astype(np.int16)
        whole = lambda w, b: np.ascontiguousarray(np.vstack([p[w], p[b][None, :]]))
        self.top, word = whole("class", "class_bias"), whole("word", "word_bias")
        self.inner = [np.ascontiguousarray(word[:, a:b]) for a, b in zip(classes.first[:-1], classes.first[1:], strict=True)]
        # a state's components are between -1 and 1
        self.small = bool(max(np.abs(self.top).sum(0).max(), *(np.abs(w).sum(0).max() for w in self.inner)) < 60)

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities given the states, which have a last column of ones."""
        of = self.of[target]
        order = np.argsort(of, kind="stable")
        h, of, at = h[order], of[order], target[order]
        logs = np.empty(len(h))
        for a in range(0, len(h), BLOCK):
            logs[a : a + BLOCK] = log_softmax_of(h[a : a + BLOCK] @ self.top, of[a : a + BLOCK], self.small)[0]
        ends = np.searchsorted(of, np.arange(self.classes.shared + 1))
        for k, weights in enumerate(self.inner):
            a, b = ends[k], ends[k + 1]
            if b > a and weights.shape[1] > 1:
                logs[a:b] += log_softmax_of(h[a:b] @ weights, at[a:b] - self.classes.first[k], self.small)[0]
        out = np.empty(len(logs))
        out[order] = logs
        return out


def log_probabilities(p: dict[str, np.ndarray], classes: Classes, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    outputs = Outputs(p, classes)
    outputs.small &= bool(np.abs(h).max(initial=0) <= 1)
    return outputs.log_probabilities(np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1), np.asarray(target))


def gradients(p: dict[str, np.ndarray], classes: Classes, symbols: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Of a window (streams x positions): the negative log-likelihood, its gradients, and the state behind it. The state before it is given and gets no gradient."""
    kind, k = h.dtype, h.shape[1]
    rows, length = symbols.shape
    (inputs, u), whole = by_gate(p), bool(mask.all())
    # positions first, so that each step reads and writes one block
    symbols, on = np.ascontiguousarray(symbols.T), np.ascontiguousarray(mask.T)[:, :, None]
    a = inputs_of(inputs, symbols)
    states, b, n = np.empty((length + 1, rows, k), kind), np.empty((length, 3, rows, k), kind), np.empty((length, rows, k), kind)
    states[0] = h
    for t in range(length):
        advance(states[t], a[t], u, b[t], n[t], states[t + 1])
        if not whole:
            np.copyto(states[t + 1], states[t], where=~on[t])
    before, z, r = states[:-1], a[:, 0], a[:, 1]
    # by symbol, and so by class: a class's symbols follow each other
    valid = np.flatnonzero(on)
    target = symbols.reshape(-1)[valid]
    order = np.argsort(target.astype(np.int32), kind="stable")
    valid, target = valid[order], target[order]
    x, of = before.reshape(-1, k)[valid], classes.of[target]
    grads = {name: np.zeros_like(v) for name, v in p.items()}
    dx = np.zeros_like(x)
    loss, ones = 0.0, np.ones(len(target), kind)
    # a state's components are between -1 and 1
    bound = max(1.0, float(np.abs(h).max(initial=0)))
    small = all(float((np.abs(p[w]).sum(0) * bound + np.abs(p[w + "_bias"])).max(initial=0)) < 60 for w in ("class", "word"))

    def output(first: int, last: int, at: np.ndarray, name: str, columns: slice) -> float:
        weight, own = p[name][:, columns], x[first:last]
        d = own @ weight
        d += p[name + "_bias"][columns]
        log, sums = log_softmax_of(d, at, small)
        d *= (1 / sums)[:, None]
        d[np.arange(len(at)), at] -= 1
        grads[name][:, columns] += own.T @ d
        grads[name + "_bias"][columns] += ones[first:last] @ d
        dx[first:last] += d @ weight.T
        return -float(log.sum())

    for first in range(0, len(target), BLOCK):
        last = min(first + BLOCK, len(target))
        loss += output(first, last, of[first:last], "class", slice(None))
    ends = np.searchsorted(of, np.arange(classes.shared + 1)).tolist()
    for c in range(classes.shared):
        first, last = int(classes.first[c]), int(classes.first[c + 1])
        if ends[c + 1] > ends[c] and last - first > 1:
            loss += output(ends[c], ends[c + 1], target[ends[c] : ends[c + 1]] - first, "word", slice(first, last))
    direct = np.zeros((length * rows, k), kind)
    direct[valid] = dx
    direct = direct.reshape(length, rows, k)
    kept = 1 - z
    to_z = before - n
    to_z *= z
    to_z *= kept
    to_n = 1 - n * n
    to_n *= kept
    to_r = 1 - r
    to_r *= r
    to_r *= b[:, 2]
    db, dn, back, through = np.empty_like(b), np.empty_like(n), np.ascontiguousarray(u.transpose(0, 2, 1)), np.empty_like(b[0])
    dh = np.zeros_like(h)
    for t in range(length - 1, -1, -1):
        own = dh if whole else np.where(on[t], dh, 0)
        d = db[t]
        np.multiply(own, to_n[t], out=dn[t])
        np.multiply(own, to_z[t], out=d[0])
        np.multiply(dn[t], to_r[t], out=d[1])
        np.multiply(dn[t], r[t], out=d[2])
        left = own * z[t]
        for part in np.matmul(d, back, out=through):
            left += part
        dh = left if whole else np.where(on[t], left, dh)
        dh += direct[t]
    for i in range(3):
        grads["recurrent"][:, i * k : (i + 1) * k] += before.reshape(-1, k).T @ db[:, i].reshape(-1, k)
    db[:, 2] = dn
    if len(target):
        starts = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        at = valid // rows * (3 * rows) + valid % rows
        own = db.reshape(-1, k).take(at[:, None] + np.arange(3) * rows, axis=0).reshape(-1, 3 * k)
        grads["input"][target[starts]] = np.add.reduceat(own, starts, axis=0)
    return loss, grads, states[-1]


def train(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], classes: Classes, stretches: list[np.ndarray], streams: int = STREAMS, rate: float = RATE) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], int]:
    """One pass over stretches of symbols, in their order, from given weights and sums of squared gradients; what these are then, and the symbols read."""
    p, seen = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in seen.items()}
    read = 0
    hidden = len(p["recurrent"])
    for first in range(0, len(stretches), streams):
        # long ones first: those that have ended are left out of the windows that follow
        own = sorted(stretches[first : first + streams], key=len, reverse=True)
        sizes = np.array([len(s) for s in own])
        block = np.zeros((len(own), int(sizes[0])), np.int64)
        for i, s in enumerate(own):
            block[i, : len(s)] = s
        h = np.zeros((len(own), hidden), np.float32)
        for start in range(0, block.shape[1], WINDOW):
            going = int((sizes > start).sum())
            symbols = block[:going, start : start + WINDOW]
            mask = np.arange(start, start + symbols.shape[1]) < sizes[:going, None]
            _, grads, h = gradients(p, classes, symbols, mask, h[:going])
            n = int(mask.sum())
            read += n
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / n
            scale = np.float32(min(1.0, CLIP / max(norm, 1e-9)) / n)
            for k, g in grads.items():
                g *= scale
                square = g * g
                seen[k] += square
                np.sqrt(seen[k], out=square)
                g /= square
                g *= np.float32(rate)
                p[k] -= g
    return p, seen, read


def fresh_squares(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.full_like(v, 1e-6) for k, v in p.items()}


def scores(p: dict[str, np.ndarray], classes: Classes, texts: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The natural log-likelihood of each whole text (its symbols). Windows of many texts go together; a text's state goes on from window to window."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    starts = np.cumsum(sizes) - sizes
    queue = np.argsort(-sizes, kind="stable")  # long ones first, so that few are left at the end
    hidden, outputs = len(p["recurrent"]), Outputs(p, classes)
    taken = min(slots, len(texts))
    text, at = queue[:taken].copy(), np.zeros(taken, np.int64)
    h = np.zeros((taken, hidden), np.float32)
    inputs, u = by_gate(p)
    while len(text):
        # where few texts are left, more symbols of each go at once
        left = np.minimum(sizes[text] - at, max(WINDOW, WINDOW * slots // len(text)))
        width = int(left.max()) if len(left) else 0
        if width:
            where = (starts[text] + at)[:, None] + np.minimum(np.arange(width), np.maximum(left - 1, 0)[:, None])
            mask = np.arange(width)[None, :] < left[:, None]
            symbols = flat[np.minimum(where, len(flat) - 1)]
            symbols, mask = np.ascontiguousarray(symbols.T), np.ascontiguousarray(mask.T)
            before = np.ones((width, len(text), hidden + 1), np.float32)
            b, n, a = np.empty((3, len(text), hidden), np.float32), np.empty_like(h), inputs_of(inputs, symbols)
            for t in range(width):
                before[t, :, :hidden] = h
                # states behind a text's end within the window are not used again
                after = np.empty_like(h)
                advance(h, a[t], u, b, n, after)
                h = after
            logs = outputs.log_probabilities(before[mask], symbols[mask])
            out += np.bincount(text[np.nonzero(mask)[1]], logs, len(texts))
            at += left
        done = np.flatnonzero(at >= sizes[text])
        more = queue[taken : taken + len(done)]
        taken += len(more)
        text[done[: len(more)]], at[done[: len(more)]], h[done[: len(more)]] = more, 0, 0
        if len(more) < len(done):
            keep = np.ones(len(text), bool)
            keep[done[len(more) :]] = False
            text, at, h = text[keep], at[keep], h[keep]
    return out
