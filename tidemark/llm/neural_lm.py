"""A gated recurrent language model over word numbers, in numpy: truncated backpropagation, class-factored softmax.

Number 0 ends a text and also starts it, 1 stands for every word outside the model's vocabulary, and word k of the
vocabulary (by frequency) is 2 + k. Classes 0 and 1 hold those two alone; class 2 + j holds words j * CLASS_WORDS and
on. The probability of a token is that of its class times that of the token in its class. States are carried from
window to window through a whole text and start at zero with each text.
"""

from __future__ import annotations

import numpy as np

HIDDEN, CLASSES, CLASS_WORDS = 16, 32, 64
VOCABULARY = CLASSES * CLASS_WORDS
LANES, STEPS, RATE = 256, 16, 0.01
END, OTHER = 0, 1
NEVER = -1e9


def initial_weights(counts: np.ndarray, n_end: float, n_other: float, seed: int = 11) -> dict[str, np.ndarray]:
    """Random weights whose biases already give the counts' frequencies. counts: of the vocabulary's words, most frequent first."""
    random, d = np.random.default_rng(seed), HIDDEN
    slots = np.zeros(VOCABULARY)
    slots[: len(counts)] = counts
    slots = slots.reshape(CLASSES, CLASS_WORDS)
    with np.errstate(divide="ignore"):
        of_word = np.where(slots > 0, np.log(slots), NEVER)
        sums = slots.sum(1)
        of_class = np.concatenate([np.log([n_end + 1, n_other + 1]), np.where(sums > 0, np.log(sums), NEVER)])
    w = {
        "e": random.normal(0, 0.3, (3 * d, VOCABULARY + 2)).T,
        "u": random.normal(0, d**-0.5, (3 * d, d)),
        "b": np.zeros((d, 1)),
        "k": random.normal(0, 0.1, (CLASSES + 2, d)),
        "kb": of_class[:, None],
        "v": random.normal(0, 0.1, (CLASSES, CLASS_WORDS, d)),
        "vb": of_word[:, :, None],
    }
    return {name: np.ascontiguousarray(x, np.float32) for name, x in w.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _advance(w: dict[str, np.ndarray], h: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next state, with the gates (update, reset), the inner candidate and the candidate that led to it. inputs: the vectors of the tokens before, one a column; they are overwritten."""
    d = HIDDEN
    c = w["u"] @ h
    gates = inputs[: 2 * d]
    gates += c[: 2 * d]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    inner = c[2 * d :]
    inner += w["b"]
    n = gates[d:] * inner
    n += inputs[2 * d :]
    np.tanh(n, out=n)
    new = h - n
    new *= gates[:d]
    new += n
    return new, gates, inner, n


def _vectors(w: dict[str, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """The vectors of tokens (..., lane) as columns (..., 3 * hidden, lane)."""
    return np.ascontiguousarray(np.swapaxes(np.take(w["e"], tokens, axis=0), -1, -2))


def _step(w: dict[str, np.ndarray], h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_advance` after the tokens ``before``."""
    return _advance(w, h, _vectors(w, before))


class _Words:
    """The targets that are words, sorted by class: their places, numbers in the class, and where each class begins and ends among them."""

    def __init__(self, targets: np.ndarray):
        places = np.flatnonzero(targets > OTHER)
        words = targets[places].astype(np.int64) - 2
        classes = (words // CLASS_WORDS).astype(np.uint16)
        order = np.argsort(classes, kind="stable")
        classes = classes[order]
        cuts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1], True]).tolist() if len(classes) else [0]
        self.places, self.words = places[order], words[order] % CLASS_WORDS
        self.parts = [(int(classes[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def scores(self, w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
        """Of each target (column) all words of its class (row). h: their states (hidden, target)."""
        out = np.empty((CLASS_WORDS, len(self.words)), h.dtype)
        for k, part in self.parts:
            np.add(w["v"][k] @ h[:, part], w["vb"][k], out=out[:, part])
        return out


def _class_of(targets: np.ndarray) -> np.ndarray:
    return np.where(targets > OTHER, 2 + (targets.astype(np.int64) - 2) // CLASS_WORDS, targets)


def _softmax(scores: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of scores, which become probabilities times a sum: the log probability of the wanted row, and the sum."""
    scores -= scores.max(0)
    picked = scores[wanted, np.arange(len(wanted))]
    np.exp(scores, out=scores)
    sums = scores.sum(0)
    return picked - np.log(sums), sums


def _errors(scores: np.ndarray, wanted: np.ndarray, scale: np.ndarray) -> float:
    """The scaled loss of the wanted rows; scores become its gradient by them."""
    logs, sums = _softmax(scores, wanted)
    scores *= scale / sums
    scores[wanted, np.arange(len(wanted))] -= scale
    return -float((logs * scale).sum())


def _class_scores(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    out = w["k"] @ h
    out += w["kb"]
    return out


def log_probabilities(w: dict[str, np.ndarray], h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probabilities of targets from their states (hidden, token)."""
    out = _softmax(_class_scores(w, h), _class_of(targets))[0]
    of = _Words(targets)
    out[of.places] += _softmax(of.scores(w, h[:, of.places]), of.words)[0]
    return out


def gradients(w: dict[str, np.ndarray], h: np.ndarray, before: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss of a window (step, lane), its gradients by backpropagation through the window, and the states after it."""
    (steps, lanes), d = targets.shape, HIDDEN
    going = (before != END).astype(np.float32)  # a text starts from zero
    gates = _vectors(w, before)
    starts, inners, news, states = (np.empty((steps, d, lanes), np.float32) for _ in range(4))
    for t in range(steps):
        np.multiply(h, going[t], out=starts[t])
        h, _, inners[t], news[t] = _advance(w, starts[t], gates[t])
        states[t] = h
    at = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(d, -1)
    flat_targets, scale = targets.ravel(), (weight / max(1e-9, weight.sum())).ravel().astype(np.float32)
    error = _class_scores(w, at)
    loss = _errors(error, _class_of(flat_targets), scale)
    g = {"k": error @ at.T, "kb": error.sum(1, keepdims=True), "v": np.zeros_like(w["v"]), "vb": np.zeros_like(w["vb"]), "u": np.zeros_like(w["u"])}
    back = w["k"].T @ error
    of = _Words(flat_targets)
    mine = at[:, of.places]
    error = of.scores(w, mine)
    loss += _errors(error, of.words, scale[of.places])
    for k, part in of.parts:
        own = error[:, part]
        g["v"][k], g["vb"][k] = own @ mine[:, part].T, own.sum(1, keepdims=True)
        mine[:, part] = w["v"][k].T @ own
    back[:, of.places] += mine
    back = back.reshape(d, steps, lanes)
    # What each step multiplies the gradient of its state with, for all steps at once.
    z, r = gates[:, :d], gates[:, d : 2 * d]
    to_z, to_n, to_r = (starts - news) * z * (1 - z), (1 - z) * (1 - news * news), inners * r * (1 - r)
    inputs, reset, carry = np.empty((steps, 3 * d, lanes), np.float32), np.empty((3 * d, lanes), np.float32), np.zeros((d, lanes), np.float32)
    for t in reversed(range(steps)):
        carry += back[:, t]
        inner = inputs[t]
        np.multiply(carry, to_z[t], out=inner[:d])
        dn = np.multiply(carry, to_n[t], out=inner[2 * d :])
        np.multiply(dn, to_r[t], out=inner[d : 2 * d])
        reset[: 2 * d] = inner[: 2 * d]
        np.multiply(dn, r[t], out=reset[2 * d :])
        g["u"] += reset @ starts[t].T
        carry *= z[t]
        carry += w["u"].T @ reset
        carry *= going[t]
    g["b"] = np.einsum("tdl,tdl->d", inputs[:, 2 * d :], r)[:, None]
    rows = inputs.transpose(0, 2, 1).reshape(-1, 3 * d)
    seen = before.ravel().astype(np.uint16)
    order = np.argsort(seen, kind="stable")
    names, firsts = np.unique(seen[order], return_index=True)
    g["e"] = np.zeros_like(w["e"])
    g["e"][names] = np.add.reduceat(rows[order], firsts, axis=0)
    return loss, g, h


class Trainer:
    """Passes over streams of texts with root-mean-square scaled steps; the weights are changed in place."""

    def __init__(self, w: dict[str, np.ndarray], rate: float = RATE):
        self.w, self.rate, self.n = w, rate, 0
        self.second = {k: np.zeros_like(x) for k, x in w.items()}

    def learn(self, stream: np.ndarray) -> float:
        """stream: texts as numbers, each with its END, one after the other. Each token is learned from once; the mean loss."""
        lanes = min(LANES, max(1, len(stream) // STEPS))
        length = -(-len(stream) // lanes)
        length += -length % STEPS
        targets = np.zeros(lanes * length, np.int64)
        targets[: len(stream)] = stream
        weight = (np.arange(lanes * length) < len(stream)).astype(np.float32)
        before = np.r_[END, targets[:-1]]
        targets, before, weight = (x.reshape(lanes, length).T for x in (targets, before, weight))
        h, total = np.zeros((HIDDEN, lanes), np.float32), 0.0
        for t in range(0, length, STEPS):
            part = slice(t, t + STEPS)
            tokens = float(weight[part].sum())
            if not tokens:
                break
            loss, g, h = gradients(self.w, h, np.ascontiguousarray(before[part]), np.ascontiguousarray(targets[part]), np.ascontiguousarray(weight[part]))
            total += loss * tokens
            self.n += 1
            for k, x in self.w.items():
                self.second[k] += 0.02 * (g[k] * g[k] - self.second[k])
                x -= self.rate * g[k] / (np.sqrt(self.second[k] / (1 - 0.98**self.n)) + 1e-5)
        return total / max(1, len(stream))


def score(w: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = 2048, flush: int = 32768) -> np.ndarray:
    """The natural log probability of each text (numbers with END at the end). Lanes run side by side, the longest first; each carries its state from its text's start to its end."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order, out = np.argsort(-sizes, kind="stable"), np.zeros(len(texts))
    for first in range(0, len(texts), lanes):
        mine = order[first : first + lanes]
        stream = np.concatenate([texts[k] for k in mine]).astype(np.int64)
        starts = np.r_[0, np.cumsum(sizes[mine])[:-1]]
        still = np.searchsorted(-sizes[mine], -np.arange(sizes[mine[0]]), side="left")  # lanes longer than t
        h, before = np.zeros((HIDDEN, len(mine)), np.float32), np.full(len(mine), END)
        states, wanted, lane = [], [], []
        held = 0
        for t, n in enumerate(still.tolist()):
            h = _step(w, h[:, :n], before[:n])[0]
            before = stream[starts[:n] + t]
            states.append(h)
            wanted.append(before)
            lane.append(n)
            held += n
            if held >= flush or t + 1 == len(still):
                found = log_probabilities(w, np.concatenate(states, axis=1), np.concatenate(wanted))
                of = np.concatenate([mine[:k] for k in lane])
                out += np.bincount(of, found.astype(np.float64), len(texts))
                states, wanted, lane, held = [], [], [], 0
    return out
