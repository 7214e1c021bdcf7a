"""Linear-chain conditional random field with two tags in numpy: training by forward-backward, marginals of long token rows.

A token's score is the sum of its features' weights (difference of tag 1 to tag 0); features are hashed to TABLE places. The
chain adds a score for each change or stay of the tag.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from busloom.llm.common import sigmoid

TABLE = 1 << 18
#: Tokens of a row that are stepped through side by side with others.
CHUNK = 256


@dataclass
class Chain:
    weights: np.ndarray  # TABLE: of tag 1 against tag 0
    step: np.ndarray  # 2, 2: from, to
    first: np.ndarray  # 2


def emissions(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Score of tag 1 for features (..., places); place 0 of the table is no feature."""
    return weights[features].sum(-1)


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward(m: Chain, e: np.ndarray) -> np.ndarray:
    """Log sums (rows, length, 2) over all tag rows that end at a token with a tag."""
    out = np.empty((*e.shape, 2))
    out[:, 0, 0], out[:, 0, 1] = m.first[0], m.first[1] + e[:, 0]
    for k in range(1, e.shape[1]):
        before = out[:, k - 1]
        for tag in (0, 1):
            out[:, k, tag] = log_add(before[:, 0] + m.step[0, tag], before[:, 1] + m.step[1, tag])
        out[:, k, 1] += e[:, k]
    return out


def backward(m: Chain, e: np.ndarray) -> np.ndarray:
    """Log sums (rows, length, 2) over all tag rows that follow a token with a tag."""
    out = np.zeros((*e.shape, 2))
    for k in range(e.shape[1] - 2, -1, -1):
        zero, one = out[:, k + 1, 0], out[:, k + 1, 1] + e[:, k + 1]
        for tag in (0, 1):
            out[:, k, tag] = log_add(m.step[tag, 0] + zero, m.step[tag, 1] + one)
    return out


def gradients(m: Chain, features: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags y (rows, length), and its slopes for emissions, steps and first tags."""
    n = len(y)
    e = emissions(m.weights, features)
    fore, rear = forward(m, e), backward(m, e)
    total = log_add(fore[:, -1, 0], fore[:, -1, 1])
    one = np.exp(fore[..., 1] + rear[..., 1] - total[:, None])
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            after = rear[:, 1:, b] + (e[:, 1:] if b else 0)
            pair[a, b] = np.exp(fore[:, :-1, a] + m.step[a, b] + after - total[:, None]).sum() - ((y[:, :-1] == a) & (y[:, 1:] == b)).sum()
    gold = m.first[y[:, 0]] + (e * y).sum(1) + m.step[y[:, :-1], y[:, 1:]].sum(1)
    start = np.array([(1 - one[:, 0]).sum() - (y[:, 0] == 0).sum(), one[:, 0].sum() - (y[:, 0] == 1).sum()])
    return float((total - gold).mean()), (one - y) / n, pair / n, start / n


def train(features: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 128, rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> Chain:
    """Slopes scaled by their squares so far (Adagrad), on batches drawn from the rows."""
    rng = np.random.default_rng(seed)
    m = Chain(np.zeros(TABLE), np.zeros((2, 2)), np.zeros(2))
    seen, seen_step, seen_first = np.full(TABLE, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(steps):
        pick = rng.integers(0, len(y), min(batch, len(y)))
        f = features[pick]
        _, de, pair, start = gradients(m, f, y[pick])
        places, back = np.unique(f, return_inverse=True)
        g = np.bincount(back.ravel(), weights=np.repeat(de[..., None], f.shape[-1], axis=-1).ravel(), minlength=len(places)) + decay * m.weights[places]
        g[places == 0] = 0
        seen[places] += g**2
        m.weights[places] -= rate * g / np.sqrt(seen[places])
        for value, slope, square in ((m.step, pair + decay * m.step, seen_step), (m.first, start + decay * m.first, seen_first)):
            square += slope**2
            value -= rate * slope / np.sqrt(square)
    return m


def memory_of(step: np.ndarray) -> int:
    """Tokens after which the start of a chain moves a marginal by less than 1e-9 (contraction of the ratio of the two sums)."""
    gap = abs(step[0, 0] + step[1, 1] - step[0, 1] - step[1, 0])
    hold = np.tanh(gap / 4)
    return 1 if hold < 1e-9 else int(np.ceil(np.log(1e-9) / np.log(min(hold, 0.999)))) + 1


def ratios(e: np.ndarray, starts: np.ndarray, step: np.ndarray, first: float, emit_later: bool) -> np.ndarray:
    """Log ratio of the sums of tag 1 and tag 0 along flat tokens; a chain begins where starts is true.

    All chunks of CHUNK tokens are stepped through side by side, each from so many tokens before it that its start doesn't matter.
    """
    n, run_in = len(e), memory_of(step)
    chunks = -(-n // CHUNK)
    out = np.empty(chunks * CHUNK)
    at = np.arange(chunks) * CHUNK - run_in
    r = np.zeros(chunks)
    for k in range(run_in + CHUNK):
        here = at + k
        inside = np.clip(here, 0, n - 1)
        came = r + (e[inside - 1] if emit_later else 0)
        r = np.logaddexp(step[0, 1], step[1, 1] + came) - np.logaddexp(step[0, 0], step[1, 0] + came)
        r = np.where(starts[inside] | (here <= 0), first, r)
        if not emit_later:
            r = r + e[inside]
        if k >= run_in:
            out[k - run_in :: CHUNK] = r
    return out[:n]


def marginals(m: Chain, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chance of tag 1 for each of the flat tokens of many chains with emissions e."""
    if not len(e):
        return np.empty(0)
    fore = ratios(e, starts, m.step, m.first[1] - m.first[0], False)
    ends = np.concatenate([starts[1:], [True]])[::-1]
    rear = ratios(e[::-1], ends, m.step.T, 0.0, True)[::-1]
    return sigmoid(fore + rear)
