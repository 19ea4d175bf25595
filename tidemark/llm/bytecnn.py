"""A byte convolutional network in numpy: several filter widths, max pooling, softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
SPAN = max(WIDTHS)
# Windows that are convolved at a time.
BATCH = 128


@dataclass
class ByteNetwork:
    """Embedded bytes, filters of several widths in one matrix, and a softmax over labels."""

    labels: list[str]
    embedding: np.ndarray  # (256, EMBEDDED); byte 0 stands for no byte and is zero
    filters: np.ndarray  # (SPAN * EMBEDDED, len(WIDTHS) * FILTERS); rows beyond a width are zero
    bias: np.ndarray
    output: np.ndarray
    shift: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, SPAN * EMBEDDED): the embedded bytes from every place on."""
        padded = np.zeros((len(windows), WINDOW + SPAN - 1), dtype=np.uint8)
        padded[:, :WINDOW] = windows
        embedded = self.embedding[padded]
        step = embedded.strides
        view = np.lib.stride_tricks.as_strided(
            embedded, (len(windows), WINDOW, SPAN * EMBEDDED), (step[0], step[1], step[2]))
        return np.ascontiguousarray(view)

    def _pooled(self, windows: np.ndarray) -> np.ndarray:
        columns = self._columns(windows).reshape(-1, SPAN * EMBEDDED)
        return (columns @ self.filters).reshape(len(windows), WINDOW, -1).max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, labels) of a byte matrix with WINDOW columns."""
        out = np.empty((len(windows), len(self.labels)), dtype=np.float32)
        for lo in range(0, len(windows), BATCH):
            pooled = np.maximum(self._pooled(windows[lo:lo + BATCH]) + self.bias, 0)
            out[lo:lo + BATCH] = softmax(pooled @ self.output + self.shift)
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All consecutive windows of a text's bytes; the last one is filled up with zeros."""
    count = -(-len(data) // WINDOW)
    out = np.zeros(count * WINDOW, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(count, WINDOW)


def letter_bytes(windows: np.ndarray) -> np.ndarray:
    """How many bytes of each window belong to letters, or may."""
    low = windows | 0x20
    return (((low >= 0x61) & (low <= 0x7A)) | (windows >= 0x80)).sum(axis=1)


def _mask() -> np.ndarray:
    """Ones where a filter reaches."""
    mask = np.zeros((SPAN * EMBEDDED, len(WIDTHS) * FILTERS), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width * EMBEDDED, i * FILTERS:(i + 1) * FILTERS] = 1
    return mask


def gradients(net: ByteNetwork, batch: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted cross entropy, by embedding, filters, bias, output and shift."""
    n, count = len(batch), net.filters.shape[1]
    columns = net._columns(batch)
    every = (columns.reshape(-1, SPAN * EMBEDDED) @ net.filters).reshape(n, WINDOW, count)
    place = every.argmax(axis=1)
    pooled = np.take_along_axis(every, place[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(pooled, 0)
    error = softmax(hidden @ net.output + net.shift)
    error[np.arange(n), target] -= 1
    error *= weight[:, None].astype(np.float32)
    back = (error @ net.output.T) * (pooled > 0)
    # The gradient of a maximum flows to the place where it stands.
    at = columns[np.arange(n)[:, None], place]  # (n, count, SPAN * EMBEDDED)
    to_filters = np.einsum("nf,nfk->kf", back, at) * _mask()
    to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(n, count, SPAN, EMBEDDED)
    padded = np.zeros((n, WINDOW + SPAN - 1), dtype=np.int64)
    padded[:, :WINDOW] = batch
    met = padded[np.arange(n)[:, None, None], place[:, :, None] + np.arange(SPAN)]
    spots = (met[..., None] * EMBEDDED + np.arange(EMBEDDED)).ravel()
    to_embedding = np.bincount(spots, weights=to_bytes.ravel(), minlength=256 * EMBEDDED).reshape(256, EMBEDDED)
    to_embedding[0] = 0
    return [to_embedding, to_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def train(windows: np.ndarray, target: np.ndarray, weight: np.ndarray, labels: list[str],
          epochs: int = 8, seed: int = 7) -> ByteNetwork:
    """Fit by Adam on the weighted cross entropy. Equal inputs give equal networks."""
    source = np.random.default_rng(seed)
    mask = _mask()
    count = mask.shape[1]

    def drawn(*shape: int) -> np.ndarray:
        return source.standard_normal(shape).astype(np.float32)

    net = ByteNetwork(labels, drawn(256, EMBEDDED) * 0.5, drawn(SPAN * EMBEDDED, count) * 0.2 * mask,
                      np.zeros(count, np.float32), drawn(count, len(labels)) * 0.1, np.zeros(len(labels), np.float32))
    net.embedding[0] = 0
    params = [net.embedding, net.filters, net.bias, net.output, net.shift]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    steps = max(1, epochs * -(-len(windows) // BATCH))
    step = 0
    for _ in range(epochs):
        order = source.permutation(len(windows))
        for lo in range(0, len(windows), BATCH):
            step += 1
            some = order[lo:lo + BATCH]
            slopes = gradients(net, windows[some], target[some], weight[some] / weight[some].sum())
            rate = 0.01 * (1 - 0.9 * step / steps)
            for p, g, a, b in zip(params, slopes, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net
