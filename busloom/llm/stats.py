"""Counts of a text that quality rules and models read. Each is a whole-text count, computed in one pass per text."""

from __future__ import annotations

from collections import Counter

import numpy as np

from busloom.llm.common import SPACE, utf8

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".!?"
OTHER = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in SYMBOLS + ".!?,")

#: Long counts, in the order of `counts`.
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_bytes", "n_lines", "n_upper", "n_digits", "n_stops",
    "n_commas", "n_bangs", "n_pipes", "n_other", "n_distinct", "longest_word", "longest_line", "n_short_words",
)


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def counts(text: str) -> tuple[int, ...]:
    raw = utf8(text)
    words = raw.split()  # on ASCII white space only
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    distinct = set(words)
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACE),
        left(SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated(words),
        len(text),
        len(raw),
        len(lines),
        left(UPPER),
        left(DIGITS),
        left(STOPS),
        raw.count(b","),
        raw.count(b"!"),
        raw.count(b"|"),
        left(OTHER),
        len(distinct),
        max(map(len, distinct), default=0),
        max(map(len, lines), default=0),
        sum(len(w) < 4 for w in words),
    )


def shares(n: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Names and a matrix of size-free statistics; a text without words gets zeros and its own flag."""
    f = {k: np.asarray(v, dtype=np.float64) for k, v in n.items()}
    words, chars, raw, lines = (np.maximum(f[k], 1) for k in ("n_words", "n_chars", "n_bytes", "n_lines"))
    out = {
        "log_words": np.log1p(f["n_words"]),
        "word_length": f["word_chars"] / words,
        "symbols": f["n_symbols"] / words,
        "dup_lines": f["n_dup_lines"] / lines,
        "repeats": f["n_repeat_words"] / words,
        "line_words": np.log1p(f["n_words"] / lines),
        "upper": f["n_upper"] / chars,
        "digits": f["n_digits"] / chars,
        "stops": f["n_stops"] / words,
        "commas": f["n_commas"] / words,
        "bangs": f["n_bangs"] / words,
        "pipes": f["n_pipes"] / words,
        "other": f["n_other"] / words,
        "variety": f["n_distinct"] / words,
        "guiraud": f["n_distinct"] / np.sqrt(words),
        "longest_word": np.log1p(f["longest_word"]),
        "longest_line": f["longest_line"] / raw,
        "short_words": f["n_short_words"] / words,
        "empty": (f["n_words"] == 0).astype(float),
    }
    return list(out), np.stack(list(out.values()), axis=1)
