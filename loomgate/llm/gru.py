"""A gated recurrent network over token numbers, in numpy: training by truncated backpropagation, scoring.

The output softmax is factored: first the class of a token, then the token within its class. A class
is a stretch of CLASS numbers. Documents are laid one after the other into lanes that advance
together; the state is carried over windows and set back only where a document starts. For training, lanes are
equal cuts of all documents in a row, so a document may go on in the next lane, with a new state there. Memory is
in proportion to the tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np

HIDDEN, CLASS = 32, 64
LANES, WINDOW = 512, 32
#: Training steps that little text is dealt into at least.
STEPS = 100
TRAIN_LANES, TRAIN_WINDOW, RATE, CLIP = 256, 16, 0.12, 1.0


@dataclass
class Weights:
    into: np.ndarray  # (tokens, 3 x hidden): what a token adds to update gate, reset gate and candidate
    over: np.ndarray  # (hidden, 3 x hidden): the same for the state
    classes: np.ndarray  # (hidden, classes)
    class_bias: np.ndarray
    words: np.ndarray  # (tokens, hidden)
    word_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float32)

    def like(self, flat: np.ndarray) -> Weights:
        at, out = 0, []
        for f in fields(self):
            own = getattr(self, f.name)
            out.append(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return Weights(*out)


def start(counts: np.ndarray, seed: int = 3) -> Weights:
    """Weights for len(counts) tokens, a multiple of CLASS; the biases are the unigram model of counts."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    p = (counts + 0.5) / (counts + 0.5).sum()
    by_class = p.reshape(-1, CLASS).sum(1)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Weights(small(n, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, n // CLASS) * 0.1, np.log(by_class).astype(np.float32), small(n, HIDDEN) * 0.1, np.log(p / np.repeat(by_class, CLASS)).astype(np.float32))


class Lanes:
    """Documents laid one after the other into lanes that advance together, the longest lane first.

    All arrays are as long as the documents together: token and input (the token before it, first at the start of a
    document), fresh (a document starts here) and place (of the token among those of all docs in a row)."""

    def __init__(self, docs: list[np.ndarray], lanes: int, first: int):
        sizes = np.array([len(d) for d in docs], np.int64)
        lanes = max(1, min(lanes, len(docs)))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            held[k].append(d)
            heapq.heappush(heap, (size + int(sizes[d]), k))
        held.sort(key=lambda own: -sum(int(sizes[d]) for d in own))
        self.size = np.array([sum(int(sizes[d]) for d in own) for own in held], np.int64)
        self.start = np.cumsum(self.size) - self.size
        order = [d for own in held for d in own]
        before = np.cumsum(sizes) - sizes
        self.token, self.input, self.fresh = stream([docs[d] for d in order], first)
        self.place = np.repeat(before[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(self.token)) if order else np.zeros(0, np.int64)

    def windows(self, tokens: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index, real), each (steps, lanes that go on): about tokens at once, but at least `least` steps; real is false behind a lane's end."""
        at, end = 0, int(self.size.max(initial=0))
        while at < end:
            n = int((self.size > at).sum())
            steps = np.arange(at, min(end, at + max(least, tokens // n)))[:, None]
            real = steps < self.size[:n]
            yield self.start[:n] + np.where(real, steps, 0), real
            at += len(steps)


def stream(docs: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, input, fresh) of docs in a row."""
    token = np.concatenate([np.zeros(0, np.int32), *docs])
    sizes = np.array([len(d) for d in docs if len(d)], np.int64)
    starts = np.cumsum(sizes) - sizes
    before, fresh = np.empty_like(token), np.zeros(len(token), bool)
    before[1:] = token[:-1]
    before[starts], fresh[starts] = first, True
    return token, before, fresh


def _cell(w: Weights, inputs: np.ndarray, h: np.ndarray, state: np.ndarray, gates: np.ndarray, cand: np.ndarray, un: np.ndarray) -> None:
    """One step from states h (lanes, hidden) by inputs (lanes): fills in the next state, twice the gates, the candidate, and the
    state's part of the candidate. A gate is half of one plus the hyperbolic tangent of its score, which is the logistic function of twice
    the score."""
    a, u = np.take(w.into, inputs, axis=0), h @ w.over
    np.add(a[:, : 2 * HIDDEN], u[:, : 2 * HIDDEN], out=gates)
    np.tanh(gates, out=gates)
    gates += 1
    un[:] = u[:, 2 * HIDDEN :]
    np.multiply(gates[:, HIDDEN:], un, out=cand)
    cand += a[:, 2 * HIDDEN :]
    np.tanh(cand, out=cand)
    np.subtract(h, cand, out=state)
    state *= 0.5
    state *= gates[:, :HIDDEN]
    state += cand


def _summed(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows that begin at starts: short ones side by side, long ones one by one."""
    sizes = np.diff(np.append(starts, len(rows)))
    out = rows[starts]
    for k in range(1, 8):
        at = np.flatnonzero((sizes > k) & (sizes <= 8))
        out[at] += rows[starts[at] + k]
    for i in np.flatnonzero(sizes > 8).tolist():
        out[i] = rows[starts[i] : starts[i] + sizes[i]].sum(0)
    return out


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exponentials of all scores stay in the range of floats: states lie within one, so weights (one row a score) and bias bound the scores."""
    return bool((np.abs(weights).sum(1) + np.abs(bias)).max() < 80)


def _exp(score: np.ndarray, bounded: bool) -> np.ndarray:
    """exp of score in place, up to a factor for each row."""
    if not bounded:
        score -= score.max(1, keepdims=True)
    return np.exp(score, out=score)


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """(order by class, for each class that occurs the slices of the order and of the class's tokens)."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    ends = np.searchsorted(group[order], np.arange(classes + 1)).tolist()
    return order, [(slice(ends[c], ends[c + 1]), slice(c * CLASS, (c + 1) * CLASS)) for c in range(classes) if ends[c] < ends[c + 1]]


def _in_class(w: Weights, states: np.ndarray, parts: list[tuple[slice, slice]]) -> np.ndarray:
    """Of each state, ordered by class, the exponentials of the scores of its class's tokens."""
    p = np.empty((len(states), CLASS), states.dtype)
    for at, s in parts:
        np.matmul(states[at], w.words[s].T, out=p[at])
        p[at] += w.word_bias[s]
    return _exp(p, _bounded(w.words, w.word_bias))


def log_probabilities(w: Weights, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target (n) after each state (n, hidden)."""
    order, parts = _by_class(target // CLASS, w.classes.shape[1])
    states, target, rows = states[order], target[order], np.arange(len(target))
    p = _exp(states @ w.classes + w.class_bias, _bounded(w.classes.T, w.class_bias))
    q = _in_class(w, states, parts)
    out = np.empty(len(target), states.dtype)
    out[order] = np.log(np.maximum(1e-30, p[rows, target // CLASS] / p.sum(1))) + np.log(np.maximum(1e-30, q[rows, target % CLASS] / q.sum(1)))
    return out


def score(w: Weights, docs: list[np.ndarray], first: int) -> np.ndarray:
    """Natural log-probability of each token of docs (token numbers), in a row; first is what stands before a document."""
    lanes = Lanes(docs, LANES, first)
    out = np.zeros(len(lanes.token), np.float32)
    h = np.zeros((len(lanes.size), HIDDEN), np.float32)
    for index, real in lanes.windows(LANES * WINDOW, WINDOW):
        inputs, fresh = lanes.input[index], lanes.fresh[index]
        h = h[: index.shape[1]]
        states, resets = np.empty((*index.shape, HIDDEN), np.float32), fresh.any(1).tolist()
        gates, cand, un = (np.empty((len(h), k * HIDDEN), np.float32) for k in (2, 1, 1))
        for t in range(len(index)):
            if resets[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            _cell(w, inputs[t], h, states[t], gates, cand, un)
            h = states[t]
        at = index[real]
        out[lanes.place[at]] = log_probabilities(w, states[real], lanes.token[at])
    return out


class Trainer:
    """Adagrad on windows of TRAIN_WINDOW steps of TRAIN_LANES lanes."""

    def __init__(self, w: Weights):
        self.w = w
        self.sums = Weights(*[np.full(getattr(w, f.name).shape, 1e-4, np.float32) for f in fields(w)])

    def _step(self, name: str, grad: np.ndarray, rows=slice(None), rate: float = RATE) -> None:
        sums = getattr(self.sums, name)
        step = grad * grad
        step += sums[rows]
        sums[rows] = step
        np.sqrt(step, out=step)
        np.divide(grad, step, out=step)
        step *= grad.dtype.type(rate)
        getattr(self.w, name)[rows] -= step

    def gradients(self, h: np.ndarray, inputs: np.ndarray, target: np.ndarray, real: np.ndarray, fresh: np.ndarray):
        """(loss sum, gradients, those of words and word_bias, (inputs, those of into), h): inputs, target, real and fresh are (steps, lanes)."""
        w, (steps, lanes) = self.w, target.shape
        before, states, un, cand = np.empty((4, steps, lanes, HIDDEN), np.result_type(h, w.over))
        gates, resets = np.empty((steps, lanes, 2 * HIDDEN), before.dtype), fresh.any(1).tolist()
        for t in range(steps):
            before[t] = np.where(fresh[t][:, None], 0, h) if resets[t] else h
            _cell(w, inputs[t], before[t], states[t], gates[t], cand[t], un[t])
            h = states[t]
        at_all = np.flatnonzero(real)
        order, parts = _by_class(target.ravel()[at_all] // CLASS, w.classes.shape[1])
        order = at_all[order]
        own, goal, rows = states.reshape(-1, HIDDEN)[order], target.ravel()[order], np.arange(len(order))
        scale = 1 / max(1, len(goal))

        def errors(p: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, float]:
            """(scale times the gradient of the scores whose exponentials are p, the loss)."""
            total = p.sum(1)
            loss = -float(np.log(np.maximum(1e-30, p[rows, goal] / total)).sum())
            p *= (scale / total)[:, None].astype(p.dtype)
            p[rows, goal] -= p.dtype.type(scale)
            return p, loss

        p, loss = errors(_exp(own @ w.classes + w.class_bias, _bounded(w.classes.T, w.class_bias)), goal // CLASS)
        q, more = errors(_in_class(w, own, parts), goal % CLASS)
        grads = {"classes": own.T @ p, "class_bias": p.sum(0)}
        d_words, d_bias, d_own = np.zeros_like(w.words), np.zeros_like(w.word_bias), p @ w.classes.T
        for at, s in parts:
            d_words[s], d_bias[s] = q[at].T @ own[at], q[at].sum(0)
            d_own[at] += q[at] @ w.words[s]
        d_states = np.zeros_like(states)
        d_states.reshape(-1, HIDDEN)[order] = d_own
        # side by side: candidate through the reset gate, update gate, reset gate, candidate
        d = np.empty((steps, lanes, 4 * HIDDEN), before.dtype)
        back = np.concatenate([w.over[:, 2 * HIDDEN :], w.over[:, : 2 * HIDDEN]], 1).T.copy()
        dh = np.zeros((lanes, HIDDEN), before.dtype)
        keep, slope, some = (np.empty_like(dh) for _ in range(3))
        for t in range(steps - 1, -1, -1):
            z2, r2, c = gates[t, :, :HIDDEN], gates[t, :, HIDDEN:], cand[t]  # twice the gates
            dh += d_states[t]
            np.multiply(z2, 0.5, out=keep)
            np.multiply(dh, keep, out=some)  # what goes on to the state before
            d_cand = np.subtract(dh, some, out=d[t, :, 3 * HIDDEN :])
            np.multiply(c, c, out=slope)
            np.subtract(1, slope, out=slope)
            d_cand *= slope
            d_z = np.subtract(2, z2, out=d[t, :, HIDDEN : 2 * HIDDEN])
            d_z *= some
            d_z *= np.subtract(before[t], c, out=slope)
            d_r = np.subtract(2, r2, out=d[t, :, 2 * HIDDEN : 3 * HIDDEN])
            d_through = np.multiply(d_cand, r2, out=d[t, :, :HIDDEN])
            d_r *= d_through
            d_r *= un[t]
            dh = d[t, :, : 3 * HIDDEN] @ back
            dh += some
            if resets[t]:
                dh[fresh[t]] = 0
        d = d.reshape(-1, 4 * HIDDEN)
        d_over = before.reshape(-1, HIDDEN).T @ d[:, : 3 * HIDDEN]
        grads["over"] = np.concatenate([d_over[:, HIDDEN:], d_over[:, :HIDDEN]], 1)
        ids = inputs.ravel()
        by = np.argsort(ids.astype(np.uint16), kind="stable")
        ids, starts = np.unique(ids[by], return_index=True)
        return loss + more, grads, (d_words, d_bias), (ids, _summed(np.take(d, by, axis=0)[:, HIDDEN:], starts)), h

    def learn(self, docs: list[np.ndarray], first: int) -> tuple[float, int]:
        """(summed loss, tokens) of one pass over docs, whose tokens in a row are cut into lanes of equal length."""
        token, before, fresh = stream(docs, first)
        lanes = max(1, min(TRAIN_LANES, len(token) // (STEPS * TRAIN_WINDOW)))  # few documents: narrow steps rather than few
        steps = -(-len(token) // lanes)
        lay = lambda x: np.ascontiguousarray(np.concatenate([x, np.zeros(lanes * steps - len(x), x.dtype)]).reshape(lanes, steps).T)
        target, inputs, fresh, real = lay(token), lay(before), lay(fresh), lay(np.ones(len(token), bool))
        h, total = np.zeros((lanes, HIDDEN), np.float32), 0.0
        for t in range(0, steps, TRAIN_WINDOW):
            s = slice(t, t + TRAIN_WINDOW)
            loss, grads, (d_words, d_bias), (rows, d_into), h = self.gradients(h, inputs[s], target[s], real[s], fresh[s])
            norm = np.sqrt(sum(float((g * g).sum()) for g in [*grads.values(), d_into]))
            cut = np.float32(min(1.0, CLIP / max(norm, 1e-9)))
            for name, g in grads.items():
                self._step(name, g * cut)
            self._step("words", d_words * cut)
            self._step("word_bias", d_bias * cut)
            self._step("into", d_into * cut, rows)
            total += loss
        return total, len(token)
