"""Character tagger in numpy: a bidirectional LSTM whose emissions feed a linear-chain CRF, trained by back-propagation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from busloom.llm.common import sigmoid

#: Printable ASCII each for itself, then: pad, other letters, blanks, everything else.
PAD, LETTER, BLANK, ELSE = 95, 96, 97, 98
SYMBOLS = 99


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(code > 191, LETTER, ELSE)
    out[(code >= 32) & (code < 127)] = code[(code >= 32) & (code < 127)] - 32
    out[np.isin(code, (9, 10, 11, 12, 13))] = BLANK
    return out


@dataclass
class Tagger:
    """Both directions side by side: axis 0 of gates, back and out."""

    gates: np.ndarray  # 2, SYMBOLS, 4h: input and bias of each symbol
    back: np.ndarray  # 2, h, 4h
    out: np.ndarray  # 2, h, tags
    bias: np.ndarray  # tags
    step: np.ndarray  # tags, tags: from, to
    first: np.ndarray  # tags

    def names(self):
        return ("gates", "back", "out", "bias", "step", "first")


def start(hidden: int, tags: int, rng) -> Tagger:
    gates = rng.normal(0, 0.2, (2, SYMBOLS, 4 * hidden))
    gates[:, :, hidden : 2 * hidden] += 1  # cells begin by remembering
    return Tagger(gates, rng.normal(0, 0.6 / np.sqrt(hidden), (2, hidden, 4 * hidden)), rng.normal(0, 0.3, (2, hidden, tags)), np.zeros(tags), np.zeros((tags, tags)), np.zeros(tags))


def run(m: Tagger, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (2, rows, length, h) of both directions for symbols x (rows, length); the second is in reading order again."""
    n, t = x.shape
    h = m.back.shape[1]
    both = np.stack([x, x[:, ::-1]])
    state, cell, out = np.zeros((2, n, h)), np.zeros((2, n, h)), np.empty((2, n, t, h))
    way = np.arange(2)[:, None]
    for k in range(t):
        z = m.gates[way, both[:, :, k]] + state @ m.back
        i, f, o = (sigmoid(z[..., j * h : (j + 1) * h]) for j in range(3))
        g = np.tanh(z[..., 3 * h :])
        before, kept = cell, state
        cell = f * cell + i * g
        squashed = np.tanh(cell)
        state = o * squashed
        out[:, :, k] = state
        if trace is not None:
            trace.append((i, f, o, g, before, squashed, kept))
    out[1] = out[1][:, ::-1]
    return out


def emissions(m: Tagger, x: np.ndarray) -> np.ndarray:
    s = run(m, x)
    return s[0] @ m.out[0] + s[1] @ m.out[1] + m.bias


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def gradients(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of tags y and its gradients."""
    n, t = x.shape
    h = m.back.shape[1]
    trace: list = []
    s = run(m, x, trace)
    e = s[0] @ m.out[0] + s[1] @ m.out[1] + m.bias
    # forward and backward sums of the chain
    fore = np.empty_like(e)
    fore[:, 0] = m.first + e[:, 0]
    for k in range(1, t):
        fore[:, k] = e[:, k] + log_sum(fore[:, k - 1, :, None] + m.step, 1)
    rear = np.zeros_like(e)
    for k in range(t - 2, -1, -1):
        rear[:, k] = log_sum(m.step + (e[:, k + 1] + rear[:, k + 1])[:, None, :], 2)
    total = log_sum(fore[:, -1], 1)
    tags = m.bias.size
    true = np.eye(tags)[y]
    rows = np.arange(n)[:, None]
    gold = m.first[y[:, 0]] + e[rows, np.arange(t), y].sum(1) + m.step[y[:, :-1], y[:, 1:]].sum(1)
    de = (np.exp(fore + rear - total[:, None, None]) - true) / n
    pair = np.exp(fore[:, :-1, :, None] + m.step + (e + rear)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
    np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    grad = {"step": pair / n, "first": de[:, 0].sum(0), "bias": de.sum((0, 1)), "out": np.stack([np.tensordot(s[d], de, ((0, 1), (0, 1))) for d in range(2)])}
    ds = np.stack([de @ m.out[0].T, (de @ m.out[1].T)[:, ::-1]])
    both = np.stack([x, x[:, ::-1]])
    d_gates, d_back = np.zeros_like(m.gates), np.zeros_like(m.back)
    d_state, d_cell = np.zeros((2, n, h)), np.zeros((2, n, h))
    onto = np.eye(SYMBOLS)
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, squashed, kept = trace[k]
        d_state = d_state + ds[:, :, k]
        d_cell = d_cell + d_state * o * (1 - squashed**2)
        dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - g**2)], axis=2)
        d_back += kept.transpose(0, 2, 1) @ dz
        d_gates += onto[both[:, :, k]].transpose(0, 2, 1) @ dz
        d_state, d_cell = dz @ m.back.transpose(0, 2, 1), d_cell * f
    return float((total - gold).mean()), grad | {"gates": d_gates, "back": d_back}


def train(x: np.ndarray, y: np.ndarray, tags: int, hidden: int = 24, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Adam on batches drawn from the rows of x (symbols) and y (tags); the rate falls to a tenth."""
    rng = np.random.default_rng(seed)
    m = start(hidden, tags, rng)
    mean, square = ({k: np.zeros_like(getattr(m, k)) for k in m.names()} for _ in range(2))
    for n in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, grad = gradients(m, x[pick], y[pick])
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g**2
            now = rate * (1 - 0.9 * n / steps)
            getattr(m, k)[...] -= now * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-8)
    return m


def best_path(m: Tagger, e: np.ndarray) -> np.ndarray:
    """Most likely tags for the emissions (length, tags) of one stretch."""
    t = len(e)
    score, came = m.first + e[0], np.empty((t, m.bias.size), np.int64)
    for k in range(1, t):
        options = score[:, None] + m.step
        came[k] = options.argmax(0)
        score = options.max(0) + e[k]
    path = np.empty(t, np.int64)
    path[-1] = score.argmax()
    for k in range(t - 1, 0, -1):
        path[k - 1] = came[k, path[k]]
    return path
