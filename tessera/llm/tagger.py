"""A character-level bidirectional LSTM with CRF transitions, in array operations.

Characters are reduced to a few classes, so the input layer is a table. Training
minimises the CRF's negative log-likelihood with back-propagation through time and
Adam; decoding is Viterbi over whole batches of windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_GROUPS = [
    "0123456789", "@", ".", "-", "+", "(", ")", " ", "\t\n\v\f\r", "abcdef", "ghijklmnopqrstuvwxyz",
    "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "_", "%", "\"'", "=", ":", ",", "/", "[]{}", "#*&$!|",
]
PAD, OTHER, BEYOND = 0, len(_GROUPS) + 1, len(_GROUPS) + 2
CLASSES = len(_GROUPS) + 3
_TABLE = np.full(128, OTHER, np.uint8)
for _k, _group in enumerate(_GROUPS):
    _TABLE[[ord(c) for c in _group]] = _k + 1


def class_ids(text: str) -> np.ndarray:
    """Class of every character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], BEYOND).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Parameters: input tables and recurrent weights per direction, output layer, transitions."""

    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: int, hidden: int, rng: np.random.Generator) -> Tagger:
        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        p = {}
        for side in ("ahead", "back"):
            p[f"{side}_in"] = normal(CLASSES, 4 * hidden, scale=0.3)
            p[f"{side}_in"][:, hidden : 2 * hidden] += 1  # remember at first
            p[f"{side}_rec"] = normal(hidden, 4 * hidden, scale=0.3 / np.sqrt(hidden))
        p["out"] = normal(2 * hidden, tags, scale=0.3)
        p["bias"] = np.zeros(tags, np.float32)
        p["moves"] = normal(tags, tags, scale=0.05)
        p["first"] = np.zeros(tags, np.float32)
        return cls(p)

    def _run(self, side: str, ids: np.ndarray):
        """States of one direction over ``ids`` (windows, time), and what going back needs."""
        table, rec = self.params[f"{side}_in"], self.params[f"{side}_rec"]
        n, time = ids.shape
        hidden = rec.shape[0]
        h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        states, kept = np.zeros((time, n, hidden), np.float32), []
        for t in range(time):
            z = table[ids[:, t]] + h @ rec
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before, last = c, h
            c = f * c + i * g
            squeezed = np.tanh(c)
            h = o * squeezed
            states[t] = h
            kept.append((i, f, o, g, before, squeezed, last))
        return states, kept

    def _states(self, ids: np.ndarray):
        ahead, kept_a = self._run("ahead", ids)
        back, kept_b = self._run("back", ids[:, ::-1])
        return np.concatenate([ahead, back[::-1]], axis=2), kept_a, kept_b

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (time, windows, tags)."""
        return self._states(ids)[0] @ self.params["out"] + self.params["bias"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (windows, time) and the scores behind them (windows, time, tags)."""
        scores = self.emissions(ids)
        moves = self.params["moves"]
        best = scores[0] + self.params["first"]
        came = np.zeros((len(scores), *best.shape), np.int8)
        for t in range(1, len(scores)):
            ways = best[:, :, None] + moves
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        path = np.zeros((ids.shape[0], len(scores)), np.int8)
        path[:, -1] = best.argmax(axis=1)
        every = np.arange(ids.shape[0])
        for t in range(len(scores) - 1, 0, -1):
            path[:, t - 1] = came[t][every, path[:, t]]
        return path, scores.transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per window, and its slope by every parameter."""
        p = self.params
        states, kept_a, kept_b = self._states(ids)
        scores = states @ p["out"] + p["bias"]
        time, n, count = scores.shape
        one = np.eye(count, dtype=np.float32)[tags.T]
        ahead = np.zeros_like(scores)
        ahead[0] = scores[0] + p["first"]
        for t in range(1, time):
            ahead[t] = _lse(ahead[t - 1][:, :, None] + p["moves"], 1) + scores[t]
        back = np.zeros_like(scores)
        for t in range(time - 2, -1, -1):
            back[t] = _lse(p["moves"] + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        total = _lse(ahead[-1], 1)
        given = (one * scores).sum() + p["first"][tags[:, 0]].sum() + p["moves"][tags[:, :-1], tags[:, 1:]].sum()
        share = np.exp(ahead + back - total[:, None])
        d_scores = (share - one) / n
        d_moves = np.zeros_like(p["moves"])
        for t in range(1, time):
            pair = ahead[t - 1][:, :, None] + p["moves"] + (scores[t] + back[t])[:, None, :] - total[:, None, None]
            d_moves += np.exp(pair).sum(axis=0)
        np.subtract.at(d_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        slopes = {
            "moves": d_moves / n,
            "first": d_scores[0].sum(axis=0),
            "bias": d_scores.sum(axis=(0, 1)),
            "out": states.reshape(time * n, -1).T @ d_scores.reshape(time * n, -1),
        }
        d_states = d_scores @ p["out"].T
        hidden = p["ahead_rec"].shape[0]
        slopes |= self._back("ahead", ids, kept_a, d_states[:, :, :hidden])
        slopes |= self._back("back", ids[:, ::-1], kept_b, d_states[::-1, :, hidden:])
        return float((total.sum() - given) / n), slopes

    def _back(self, side: str, ids: np.ndarray, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        rec = self.params[f"{side}_rec"]
        n, time = ids.shape
        dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
        d_rec, d_gates = np.zeros_like(rec), np.zeros((time, n, rec.shape[1]), np.float32)
        for t in range(time - 1, -1, -1):
            i, f, o, g, before, squeezed, last = kept[t]
            dh = dh + d_states[t]
            dc = dc + dh * o * (1 - squeezed**2)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squeezed * o * (1 - o), dc * i * (1 - g**2)], axis=1
            )
            d_gates[t] = dz
            d_rec += last.T @ dz
            dh, dc = dz @ rec.T, dc * f
        one = np.eye(CLASSES, dtype=np.float32)[ids.T.reshape(-1)]
        return {f"{side}_in": one.T @ d_gates.reshape(time * n, -1), f"{side}_rec": d_rec}

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float, rng) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, sum_ = rng.permutation(len(ids)), 0.0
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                loss, slopes = self.gradients(ids[part], tags[part])
                sum_ += loss * len(part)
                step += 1
                size = np.sqrt(sum(float((s**2).sum()) for s in slopes.values()))
                now = rate * (1 - epoch / epochs * 0.8)
                for k, s in slopes.items():
                    s = s * min(1.0, 5 / (size + 1e-9))
                    mean[k] += 0.1 * (s - mean[k])
                    square[k] += 0.01 * (s * s - square[k])
                    self.params[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(sum_ / len(ids))
        return losses
