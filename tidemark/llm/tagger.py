"""A character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans, and decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Kinds of personal data, as the contract lists them.
KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
#: Characters with a class of their own; others share one for digits, lower case, upper case, controls, or the rest.
OWN = " \n@.+-()_%:=\"'/,"
PAD, DIGIT, LOWER, UPPER, CONTROL, REST = range(6)
CLASSES = 6 + len(OWN)
_TABLE = np.full(128, REST, dtype=np.uint8)
_TABLE[:32] = CONTROL
_TABLE[ord("0") : ord("9") + 1] = DIGIT
_TABLE[ord("a") : ord("z") + 1] = LOWER
_TABLE[ord("A") : ord("Z") + 1] = UPPER
for _i, _c in enumerate(OWN):
    _TABLE[ord(_c)] = 6 + _i


def classes(text: str) -> np.ndarray:
    """The class of each code point; letters beyond ASCII count as lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], LOWER).astype(np.uint8)


def first_tag(kind: int) -> int:
    return 1 + 2 * kind


def allowed() -> np.ndarray:
    """Transitions that may be: a further character only after its own kind. Last row: at the start."""
    ok = np.ones((TAGS + 1, TAGS), dtype=bool)
    for k in range(len(KINDS)):
        ok[:, first_tag(k) + 1] = False
        ok[first_tag(k), first_tag(k) + 1] = ok[first_tag(k) + 1, first_tag(k) + 1] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name: input (2 directions, classes, 4 hidden), recurrent (2, hidden, 4 hidden), emit, bias, moves."""

    weights: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def fresh(cls, hidden: int = 16, seed: int = 9) -> Tagger:
        rng = np.random.default_rng(seed)
        weights = {"in": rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)), "re": rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden))}
        weights["in"][:, :, hidden : 2 * hidden] += 1.0  # forget gates start open
        weights["emit"] = rng.normal(0, hidden**-0.5, (2 * hidden, TAGS))
        weights["bias"] = np.zeros(TAGS)
        weights["moves"] = np.zeros((TAGS + 1, TAGS))
        return cls(weights, hidden)

    def _run(self, x: np.ndarray) -> list[tuple]:
        """States of both directions over x (time, batch): step t is the forward one at t and the backward one at t from the end; each has gates, cell, its tanh, output."""
        table, recurrent, n = self.weights["in"], self.weights["re"], self.hidden
        both, side = np.stack([x, x[::-1]]), np.arange(2)[:, None]
        h = c = np.zeros((2, x.shape[1], n), dtype=table.dtype)
        steps = []
        for t in range(len(x)):
            z = table[side, both[:, t]] + h @ recurrent
            gates = _sigmoid(z[..., : 3 * n])  # input, forget, output
            new = np.tanh(z[..., 3 * n :])
            before = c
            c = gates[..., n : 2 * n] * c + gates[..., :n] * new
            squeezed = np.tanh(c)
            previous, h = h, gates[..., 2 * n :] * squeezed
            steps.append((gates, new, before, squeezed, previous, h))
        return steps

    def _back(self, x: np.ndarray, steps: list[tuple], dh_out: np.ndarray, grads: dict) -> None:
        """Add the gradients of both directions; dh_out (time, 2, batch, hidden) in the order of the steps."""
        recurrent, n = self.weights["re"], self.hidden
        turned = recurrent.transpose(0, 2, 1)
        dh = dc = np.zeros((2, x.shape[1], n), dtype=recurrent.dtype)
        slopes = []
        for t in range(len(steps) - 1, -1, -1):
            gates, new, before, squeezed, _, _ = steps[t]
            dh = dh + dh_out[t]
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            dc = dc + dh * o * (1 - squeezed**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squeezed * o * (1 - o), dc * i * (1 - new**2)], axis=2)
            slopes.append(dz)
            dh, dc = dz @ turned, dc * f
        dz = np.stack(slopes[::-1]).transpose(1, 0, 2, 3).reshape(2, -1, 4 * n)
        hot = np.eye(CLASSES, dtype=recurrent.dtype)[np.stack([x, x[::-1]]).reshape(2, -1)]
        previous = np.stack([s[4] for s in steps]).transpose(1, 0, 2, 3).reshape(2, -1, n)
        grads["in"] += hot.transpose(0, 2, 1) @ dz
        grads["re"] += previous.transpose(0, 2, 1) @ dz

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """Scores (time, batch, tags), with the steps and states behind them."""
        steps = self._run(x)
        out = np.stack([s[-1] for s in steps])
        states = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return states @ self.weights["emit"] + self.weights["bias"], steps, states

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the batch and its gradients; x and y are (time, batch)."""
        scores, lstm, states = self.emissions(x)
        moves = np.where(allowed(), self.weights["moves"], -1e4).astype(scores.dtype)
        steps, batch, _ = scores.shape
        # forward and backward sums have one form: the backward ones take the scores from the end and the moves turned round
        both, turn = np.stack([scores, scores[::-1]], axis=1), np.stack([moves[:-1], moves[:-1].T])[:, None]
        sums = np.empty_like(both)
        sums[0] = both[0]
        sums[0, 0] += moves[-1]
        for t in range(1, steps):
            sums[t] = both[t] + _logsum(sums[t - 1][..., None] + turn, 2)
        alpha, ahead = sums[:, 0], sums[::-1, 1]
        total = _logsum(alpha[-1], 1)
        marginal = np.exp(alpha + ahead - scores - total[None, :, None])
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        rows = np.arange(batch)
        before = np.concatenate([np.full((1, batch), TAGS), y[:-1]])
        gold = np.take_along_axis(scores, y[..., None], axis=2)[..., 0].sum(axis=0) + moves[before, y].sum(axis=0)
        pair = np.exp(alpha[:-1, :, :, None] + moves[:-1] + ahead[1:, :, None, :] - total[None, :, None, None])
        grads["moves"][:-1] = pair.sum(axis=(0, 1))
        grads["moves"][-1] = marginal[0].sum(axis=0)
        np.add.at(grads["moves"], (before, y), -1.0)
        d = marginal
        d[np.arange(steps)[:, None], rows[None], y] -= 1.0
        grads["emit"] = np.tensordot(states, d, axes=((0, 1), (0, 1)))
        grads["bias"] = d.sum(axis=(0, 1))
        dh = d @ self.weights["emit"].T
        self._back(x, lstm, np.stack([dh[:, :, : self.hidden], dh[::-1, :, self.hidden :]], axis=1), grads)
        return float((total - gold).mean()), {k: v / batch for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.02, seed: int = 9) -> list[float]:
        """Adam over shuffled batches of windows x, y (windows, time); the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                loss, grads = self.gradients(x[own].T, y[own].T.astype(np.int64))
                step += 1
                total += loss * len(own)
                size = sum(float((g**2).sum()) for g in grads.values()) ** 0.5
                scale = min(1.0, 50.0 / max(size, 1e-9))
                pace = rate * (1 - (epoch + at / len(x)) / epochs) + 1e-4
                for k, g in grads.items():
                    g = g * scale
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g**2
                    self.weights[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def single(self) -> Tagger:
        """The same in single precision, for decoding."""
        return Tagger({k: v.astype(np.float32) for k, v in self.weights.items()}, self.hidden)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (windows, time) of windows x (windows, time) by the Viterbi recursion."""
        x = x.T
        scores = self.emissions(x)[0]
        moves = np.where(allowed(), self.weights["moves"], -1e4).astype(scores.dtype)
        best = scores[0] + moves[-1]
        came = np.zeros(scores.shape, dtype=np.int8)
        for t in range(1, len(x)):
            paths = best[:, :, None] + moves[None, :-1]
            came[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[t]
        tags = np.empty(x.shape, dtype=np.int8)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(x.shape[1])
        for t in range(len(x) - 1, 0, -1):
            tags[t - 1] = came[t, rows, tags[t]]
        return tags.T
