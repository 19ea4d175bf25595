"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
# O, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)

_CLASSES = {c: i + 1 for i, c in enumerate(string.ascii_lowercase + "A0 \n" + string.punctuation)}
CLASSES = len(_CLASSES) + 2
_TABLE = np.array([_CLASSES.get(chr(c), _CLASSES["A"] if 65 <= c <= 90 else _CLASSES["0"] if 48 <= c <= 57
                                else _CLASSES[" "]) for c in range(128)], dtype=np.int64)


def char_classes(text: str, width: int) -> np.ndarray:
    """Class of each code point, filled with zeros: letters, digits, marks, and one for the rest."""
    codes = np.frombuffer(text[:width].encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(width, dtype=np.int64)
    out[:len(codes)] = np.where(codes < 128, _TABLE[np.minimum(codes, 127)], CLASSES - 1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Tagger:
    """Parameters by name; one set of recurrent weights for either direction."""

    p: dict[str, np.ndarray]
    hidden: int

    @staticmethod
    def fresh(hidden: int, seed: int) -> Tagger:
        source = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p[f"x{way}"] = source.normal(0, 0.3, (CLASSES, 4 * hidden))
            p[f"h{way}"] = source.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p[f"b{way}"] = np.zeros(4 * hidden)
            p[f"b{way}"][hidden:2 * hidden] = 1.0  # remember at first
        p["e"] = source.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, LABELS))
        p["eb"] = np.zeros(LABELS)
        p["t"] = np.zeros((LABELS, LABELS))
        for b in range(1, LABELS, 2):  # inside only after its begin or itself
            p["t"][:, b + 1] = -4.0
            p["t"][[b, b + 1], b + 1] = 1.0
        return Tagger({k: v.astype(np.float32) for k, v in p.items()}, hidden)

    def _run(self, cls: np.ndarray, way: str, keep: bool):
        n, h = cls.shape[1], self.hidden
        x = self.p[f"x{way}"][cls] + self.p[f"b{way}"]
        weights = self.p[f"h{way}"]
        state = np.zeros((n, h), dtype=np.float32)
        cell = np.zeros((n, h), dtype=np.float32)
        out = np.empty((len(cls), n, h), dtype=np.float32)
        kept = []
        steps = range(len(cls)) if way == "f" else range(len(cls) - 1, -1, -1)
        for t in steps:
            z = x[t] + state @ weights
            gates = _sigmoid(z[:, :3 * h])
            g = np.tanh(z[:, 3 * h:])
            before = cell
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * g
            wide = np.tanh(cell)
            if keep:
                kept.append((t, state, before, gates, g, wide))
            state = gates[:, 2 * h:] * wide
            out[t] = state
        return out, kept

    def emissions(self, cls: np.ndarray) -> np.ndarray:
        """(step, window, label) scores of classes (step, window)."""
        both = np.concatenate([self._run(cls, "f", False)[0], self._run(cls, "b", False)[0]], axis=2)
        return both @ self.p["e"] + self.p["eb"]

    def _chain(self, scores: np.ndarray):
        """Scaled forward and backward messages of the CRF."""
        steps, n, _ = scores.shape
        power = np.exp(self.p["t"])
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        ahead = np.empty_like(local)
        back = np.empty_like(local)
        a = local[0] / local[0].sum(axis=1, keepdims=True)
        ahead[0] = a
        for t in range(1, steps):
            a = (a @ power) * local[t]
            a /= a.sum(axis=1, keepdims=True)
            ahead[t] = a
        b = np.ones((n, LABELS), dtype=local.dtype)
        back[-1] = b
        for t in range(steps - 2, -1, -1):
            b = (local[t + 1] * b) @ power.T
            b /= b.sum(axis=1, keepdims=True)
            back[t] = b
        return power, local, ahead, back

    def decode(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels and the marginal probability of each, (window, step)."""
        scores = self.emissions(cls)
        steps, n, _ = scores.shape
        _, _, ahead, back = self._chain(scores)
        share = ahead * back
        share /= share.sum(axis=2, keepdims=True)
        best = scores[0]
        came = np.zeros((steps, n, LABELS), dtype=np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + self.p["t"][None]
            came[t] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[t]
        path = np.zeros((steps, n), dtype=np.int64)
        path[-1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t, rows, path[t]]
        return path.T, np.take_along_axis(share, path[:, :, None], 2)[:, :, 0].T

    def gradient(self, cls: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log-likelihood; both arguments are (step, window)."""
        p, h = self.p, self.hidden
        fwd, kept_f = self._run(cls, "f", True)
        bwd, kept_b = self._run(cls, "b", True)
        both = np.concatenate([fwd, bwd], axis=2)
        scores = both @ p["e"] + p["eb"]
        power, local, ahead, back = self._chain(scores)
        steps, n, _ = scores.shape
        share = ahead * back
        share /= share.sum(axis=2, keepdims=True)
        d_scores = share.copy()
        np.put_along_axis(d_scores, labels[:, :, None], np.take_along_axis(share, labels[:, :, None], 2) - 1, 2)
        d_scores /= n
        d_t = np.zeros_like(p["t"])
        right = local[1:] * back[1:]
        norm = np.einsum("tni,ij,tnj->tn", ahead[:-1], power, right)
        d_t += np.einsum("tni,tnj->ij", ahead[:-1] / norm[:, :, None], right) * power
        np.add.at(d_t, (labels[:-1].ravel(), labels[1:].ravel()), -1)
        grads = {"t": d_t / n, "e": np.einsum("tni,tnj->ij", both, d_scores), "eb": d_scores.sum(axis=(0, 1))}
        d_both = d_scores @ p["e"].T
        for way, kept, part in (("f", kept_f, d_both[:, :, :h]), ("b", kept_b, d_both[:, :, h:])):
            d_x = np.zeros_like(p[f"x{way}"])
            d_h = np.zeros_like(p[f"h{way}"])
            d_b = np.zeros_like(p[f"b{way}"])
            d_state = np.zeros((n, h), dtype=np.float32)
            d_cell = np.zeros((n, h), dtype=np.float32)
            for t, state, before, gates, g, wide in reversed(kept):
                i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                d_state = d_state + part[t]
                d_cell = d_cell + d_state * o * (1 - wide * wide)
                dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f),
                                     d_state * wide * o * (1 - o), d_cell * i * (1 - g * g)], axis=1)
                np.add.at(d_x, cls[t], dz)
                d_h += state.T @ dz
                d_b += dz.sum(axis=0)
                d_state = dz @ p[f"h{way}"].T
                d_cell = d_cell * f
            grads |= {f"x{way}": d_x, f"h{way}": d_h, f"b{way}": d_b}
        return grads


def train(cls: np.ndarray, labels: np.ndarray, hidden: int = 16, epochs: int = 10, batch: int = 48,
          rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam on windows (window, step); the order of the windows is drawn from ``seed``."""
    model = Tagger.fresh(hidden, seed)
    source = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    total = epochs * -(-len(cls) // batch)
    for _ in range(epochs):
        order = source.permutation(len(cls))
        for lo in range(0, len(cls), batch):
            pick = order[lo:lo + batch]
            grads = model.gradient(cls[pick].T, labels[pick].T)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= (now * (first[k] / (1 - 0.9 ** step))
                               / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return model
