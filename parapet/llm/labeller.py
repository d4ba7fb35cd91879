"""A bidirectional LSTM in numpy that labels every block of a page with its whole context."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from parapet.llm.blocks import Block
from parapet.llm.shingles import word_hashes

PATH_SLOTS, WORD_SLOTS, EXTRA = 192, 48, 8
INPUTS = PATH_SLOTS + WORD_SLOTS + EXTRA
HIDDEN = 12


def _slot(text: str, slots: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % slots


def features(pages: list[list[Block]], memory: dict) -> list[np.ndarray]:
    """Per page one row for each block: hashed tag path, shares of hashed words of the whole block, and a few measures.

    ``memory`` keeps the slots of paths.
    """
    every = [block for page in pages for block in page]
    out = np.zeros((len(every), INPUTS), np.float32)
    if len(memory) > 50_000:
        memory.clear()
    for i, block in enumerate(every):
        path = memory.get(block.path)
        if path is None:
            path = memory[block.path] = sorted({_slot(t, PATH_SLOTS) for t in block.path})
        out[i, path] = 1
        n, text = len(block.text), block.text
        out[i, -6:-2] = min(1.0, block.link_chars / n), text[-1] in ".!?…", (text.count(",") + text.count(".")) / n * 10, text[0].isupper()
    hashes, ends = word_hashes([b.text.encode("utf-8", "surrogatepass") for b in every]) if every else (np.empty(0, np.uint64), np.empty(0, int))
    counts = np.diff(ends, prepend=0)
    owner, slot = np.repeat(np.arange(len(every)), counts), (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    words = np.bincount(owner * WORD_SLOTS + slot, minlength=len(every) * WORD_SLOTS).reshape(len(every), WORD_SLOTS)
    out[:, PATH_SLOTS:PATH_SLOTS + WORD_SLOTS] = words / np.maximum(counts, 1)[:, None]
    out[:, -8], out[:, -7] = np.log1p([len(b.text) for b in every]) / 8, np.log1p(counts) / 6
    edges = np.cumsum([len(p) for p in pages])
    parts = np.split(out, edges[:-1]) if pages else []
    for part in parts:
        if len(part):
            part[0, -2] = part[-1, -1] = 1
    return parts


@dataclass
class Weights:
    """Of both directions: inputs and state to the gates (input, forget, output, candidate), and the output layer."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(seed: int) -> "Weights":
        rng = np.random.default_rng(seed)
        wx = [rng.normal(0, 0.15, (INPUTS, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        wh = [rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        b = [np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32) for _ in range(2)]
        return Weights(wx, wh, b, rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse; x is (page, block, ...), padding stays at the end."""
    index = np.arange(x.shape[1])[None, :].repeat(len(x), 0)
    index = np.where(index < lengths[:, None], lengths[:, None] - 1 - index, index)
    return np.take_along_axis(x, index.reshape(index.shape + (1,) * (x.ndim - 2)), 1)


def _run(gates_x: np.ndarray, wh: np.ndarray, keep: bool):
    """States (page, block, HIDDEN) of one direction, and what its gradient needs."""
    pages, steps, h = gates_x.shape[0], gates_x.shape[1], HIDDEN
    state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
    states, memory = np.empty((pages, steps, h), np.float32), []
    for t in range(steps):
        z = gates_x[:, t] + state @ wh
        gates, fresh = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
        before, old = cell, state
        cell = gates[:, h:2 * h] * cell + gates[:, :h] * fresh
        active = np.tanh(cell)
        state = gates[:, 2 * h:] * active
        states[:, t] = state
        if keep:
            memory.append((gates, fresh, before, active, old))
    return states, memory


def forward(w: Weights, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    turned = _turned(x, lengths)
    ahead, m0 = _run(x @ w.wx[0] + w.b[0], w.wh[0], keep)
    back, m1 = _run(turned @ w.wx[1] + w.b[1], w.wh[1], keep)
    both = np.concatenate((ahead, _turned(back, lengths)), axis=2)
    return _sigmoid(both @ w.out + w.bias[0]), (both, turned, m0, m1)


def _through(grad: np.ndarray, memory: list, x: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of wx, wh and b of one direction from those of its states."""
    h, pages = HIDDEN, len(grad)
    d_gates = np.empty((pages, len(memory), 4 * h), np.float32)
    d_state, d_cell, d_wh = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32), np.zeros_like(wh)
    for t in reversed(range(len(memory))):
        gates, fresh, before, active, old = memory[t]
        i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
        d = grad[:, t] + d_state
        d_cell = d_cell + d * o * (1 - active * active)
        z = np.concatenate((d_cell * fresh * i * (1 - i), d_cell * before * f * (1 - f), d * active * o * (1 - o), d_cell * i * (1 - fresh * fresh)), axis=1)
        d_gates[:, t] = z
        d_wh += old.T @ z
        d_state, d_cell = z @ wh.T, d_cell * f
    return np.tensordot(x, d_gates, ([0, 1], [0, 1])), d_wh, d_gates.sum(axis=(0, 1))


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), INPUTS), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)] = p
    return x, lengths


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, size: int = 24, rate: float = 0.02, seed: int = 5) -> Weights:
    """Adam on the mean log loss of the labelled blocks; a label is 1, 0, or NaN for none."""
    w, rng = Weights.fresh(seed), np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in w.parts()], [np.zeros_like(p) for p in w.parts()], 0
    for _ in range(epochs if pages else 0):
        order = rng.permutation(len(pages))
        for start in range(0, len(order), size):
            chosen = order[start:start + size]
            x, lengths = _batch([pages[i] for i in chosen])
            y = np.full(x.shape[:2], np.nan, np.float32)
            for row, i in enumerate(chosen):
                y[row, :len(labels[i])] = labels[i]
            p, (both, turned, m0, m1) = forward(w, x, lengths, keep=True)
            known = ~np.isnan(y)
            d = np.where(known, p - np.nan_to_num(y), 0).astype(np.float32) / max(1, known.sum())
            d_both = d[:, :, None] * w.out
            g0 = _through(d_both[:, :, :HIDDEN], m0, x, w.wh[0])
            g1 = _through(_turned(d_both[:, :, HIDDEN:], lengths), m1, turned, w.wh[1])
            grads = [g0[0], g1[0], g0[1], g1[1], g0[2], g1[2], np.tensordot(d, both, ([0, 1], [0, 1])), d.sum(keepdims=True).reshape(1)]
            step += 1
            for part, grad, m, v in zip(w.parts(), grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def label(w: Weights, pages: list[list[Block]], memory: dict, cells: int = 1 << 14) -> list[np.ndarray]:
    """The chance of each block to be main text, pages of like length together, ``cells`` blocks at a time."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        part = []
        while order and (not part or len(pages[order[0]]) * (len(part) + 1) <= cells):
            part.append(order.pop(0))
        x, lengths = _batch(features([pages[i] for i in part], memory))
        found, _ = forward(w, x, lengths)
        for row, i in enumerate(part):
            out[i] = found[row, :lengths[row]]
    return out
