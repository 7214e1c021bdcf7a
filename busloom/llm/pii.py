"""Personal data: fixed patterns, and what a character tagger finds beside them.

The patterns give the base spans; they also label the rows the tagger is trained on (`tagger`, a bidirectional LSTM with CRF
transitions). Every stretch of a text within CONTEXT characters of a digit or an @ is read, for no kind of span is without one.
A stretch is cut into overlapping windows; the emissions of a character are averaged over its windows, weighted by its
distance from their borders, and one best path is sought over the whole stretch, so windows can't disagree. Spans of the tagger
are kept if they pass the kind's own check and touch no base span: base spans stay as they are.

Trained on at most SAMPLE_ROWS windows without failed matches, and on recombinations of their labelled spans.

Defined cases: null and empty texts have no spans; a text of any length is read window by window; repeated rows have equal
spans; without any base span in the input nothing is trained and nothing added; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from busloom.llm import tagger
from busloom.llm.common import bounded_sample, keep, over_texts, rewrite_texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, CONTEXT = 64, 32, 24
SAMPLE_ROWS, RECOMBINED = 3000, 1500
TRIGGER = re.compile(r"[0-9@]")

#: Fixed patterns of the base spans. The look-behinds change no match; they keep long runs of digits linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches of local part, @, domain: from each @ back over its local part, so in linear time."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in LOCALS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = max(at + 1, end)


def passes(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    n = digits_of(s)
    return 14 <= len(n) <= 19 and luhn(n) if kind == "card" else 10 <= len(n) <= 15


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every match, before its check."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if TRIGGER.search(text):
        for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            if k != 3 or "+" in text:
                out += [(*m.span(), k) for m in pattern.finditer(text)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted((a, b, k) for a, b, k in candidates(text) if passes(KINDS[k], text[a:b]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Every part of the text within CONTEXT of a trigger, apart from each other."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(size: int) -> list[int]:
    return list(range(0, max(1, size - WINDOW + STRIDE), STRIDE))


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside; of kind k: 1 + 2k at the first character, 2 + 2k after it."""
    y = np.zeros(size, np.int64)
    for a, b, k in spans:
        y[max(a, 0) : b] = 2 + 2 * k
        if a >= 0:
            y[a] = 1 + 2 * k
    return y


def labelled_windows(text: str) -> list[tuple[str, str]]:
    """(window, tags as digits) for windows whose matches all pass: a failed match is no lesson. Of nested matches the longest counts."""
    if not TRIGGER.search(text):
        return []
    found = candidates(text)
    good = [x for x in found if passes(KINDS[x[2]], text[x[0] : x[1]])]
    bad = [x for x in found if x not in good and x[1] - x[0] > 3 and not any(g[0] <= x[0] and x[1] <= g[1] for g in good)]
    good = [x for x in good if not any(g[0] <= x[0] and x[1] <= g[1] and g != x and g[1] - g[0] > x[1] - x[0] for g in good)]
    out = []
    for a, b in stretches(text):
        for s in window_starts(b - a):
            lo, hi = a + s, min(a + s + WINDOW, b)
            if not any(x[0] < hi and x[1] > lo for x in bad):
                out.append((text[lo:hi], "".join(map(str, tags_of(hi - lo, [(x[0] - lo, min(x[1], hi) - lo, x[2]) for x in good if x[0] < hi and x[1] > lo])))))
    return out


def rows_of(windows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((len(windows), WINDOW), tagger.PAD), np.zeros((len(windows), WINDOW), np.int64)
    for n, (w, t) in enumerate(windows):
        x[n, : len(w)] = tagger.symbols(w)
        y[n, : len(t)] = np.frombuffer(t.encode(), np.uint8) - 48
    return x, y


def recombined(windows: list[tuple[str, str]], count: int, rng) -> list[tuple[str, str]]:
    """Labelled spans set next to each other and into other windows' plain text: what stands around a span is no sign of it."""
    spans, plain = [], []
    for w, t in windows:
        for m in re.finditer(r"1(?:2*)|3(?:4*)|5(?:6*)|7(?:8*)", t):
            if 0 < m.start() and m.end() < len(t):
                spans.append((w[m.start() : m.end()], m[0]))
        plain += [w[a:b] for a, b in (m.span() for m in re.finditer("0{6,}", t))]
    if not spans or not plain:
        return []
    out = []
    for _ in range(count):
        w, t = plain[rng.integers(len(plain))][-int(rng.integers(0, 16)) or 99 :], ""
        w, t = w[-16:], "0" * len(w[-16:])
        for _ in range(int(rng.integers(1, 4))):
            s, g = spans[rng.integers(len(spans))]
            gap = (" ", " ", ", ", "; ", "\n", " / ")[rng.integers(6)]
            w, t = w + gap + s, t + "0" * len(gap) + g
        tail = plain[rng.integers(len(plain))][:20]
        w, t = w + " " + tail, t + "0" * (len(tail) + 1)
        out.append((w[:WINDOW], t[:WINDOW]))
    return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = 300) -> tagger.Tagger | None:
    """A tagger trained on a bounded sample of different windows; None if none of them holds a span."""
    made = over_texts(docs.select("text"), lambda texts: {"w": [[{"window": w, "tags": t} for w, t in labelled_windows(x)] for x in texts]}, "w array<struct<window:string,tags:string>>", ())
    seen = bounded_sample(keep(made.select(F.explode("w").alias("w")).groupBy("w.window").agg(F.min("w.tags").alias("tags"))), "window", sample_rows)
    windows = list(zip(seen["window"], seen["tags"]))
    if not any(set(t) - {"0"} for _, t in windows):
        return None
    windows += recombined(windows, RECOMBINED, np.random.default_rng(3))
    return tagger.train(*rows_of(windows), tags=1 + 2 * len(KINDS), steps=steps)


def tagged(model: tagger.Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text."""
    parts = [(n, a, b) for n, x in enumerate(texts) for a, b in stretches(x)]
    at = [(p, s) for p, (_, a, b) in enumerate(parts) for s in window_starts(b - a)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    near = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW))[:, None].astype(float)
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(0, len(at), 2048):
        chunk = at[k : k + 2048]
        x = np.full((len(chunk), WINDOW), tagger.PAD)
        for row, (p, s) in enumerate(chunk):
            n, a, b = parts[p]
            piece = texts[n][a + s : min(a + s + WINDOW, b)]
            x[row, : len(piece)] = tagger.symbols(piece)
        e = tagger.emissions(model, x)
        for row, (p, s) in enumerate(chunk):
            size = parts[p][2] - parts[p][1]
            total, weight = sums.setdefault(p, (np.zeros((size, model.bias.size)), np.zeros((size, 1))))
            m = min(WINDOW, size - s)
            total[s : s + m] += e[row, :m] * near[:m]
            weight[s : s + m] += near[:m]
    for p, (total, weight) in sums.items():
        n, a, _ = parts[p]
        path = tagger.best_path(model, total / weight)
        start = 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] == 0 or path[i] % 2 or (path[i] - 1) // 2 != (path[i - 1] - 1) // 2:
                if path[i - 1]:
                    out[n].append((a + start, a + i, int(path[i - 1] - 1) // 2))
                start = i
    return out


def checked(text: str, span: tuple[int, int, int]) -> tuple[int, int, int] | None:
    """The span without blanks and marks at its ends, if it is whole and passes its kind's check."""
    a, b, k = span
    while a < b and not (text[a].isalnum() or text[a] == "+" and k == 3):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    s = text[a:b]
    whole = (a == 0 or not text[a - 1].isdigit()) and (b == len(text) or not text[b].isdigit())
    if k == 0:
        good = "@" in s[1:-1] and "." in s[s.find("@") :] and not re.search(r"\s", s)
    elif k == 1:
        good = whole and bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and passes("ip", s)
    else:
        good = whole and bool(re.fullmatch(r"[+0-9][0-9 ().-]*", s)) and passes(KINDS[k], s)
    return (a, b, k) if good else None


def find(model: tagger.Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, in order."""
    base = [base_spans(x) for x in texts]
    more = tagged(model, texts) if model is not None else [[] for _ in texts]
    out = []
    for x, own, new in zip(texts, base, more):
        added = [s for s in (checked(x, n) for n in new) if s and not any(s[0] < b and a < s[1] for a, b, _ in own)]
        out.append((own, sorted(own + added)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def apply(docs: DataFrame, model: tagger.Tagger | None) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans."""

    def run(texts):
        found = find(model, texts)
        counts = {f"n_{kind}": [sum(s[2] == k for s in own) for own, _ in found] for k, kind in enumerate(KINDS)}
        return counts | {"base_sha256": [hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found], "spans": [written(all_) for _, all_ in found]}

    return over_texts(docs, run, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: tagger.Tagger | None, text: str = "text") -> DataFrame:
    """All columns, personal data masked; null texts stay null."""
    return rewrite_texts(docs, lambda texts: [masked(x, s) for x, (_, s) in zip(texts, find(model, texts))], text)
