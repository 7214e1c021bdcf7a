"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from busloom.llm import variants

SCHEMA = "doc_id long, text string, word string, n int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    out = Counter()
    for i, x, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (x or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    form = {}
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        rows[w] = (n, len(near), form[w], counts[form[w]] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows[w] += (root,)
    return rows


def found(spark, rows):
    got = variants.apply(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("rare,held", [(30, 400_000), (3, 50)])
def test_against_all_pairs(spark, monkeypatch, rare, held):
    monkeypatch.setattr(variants, "RARE", rare)
    monkeypatch.setattr(variants, "HELD", held)
    rng = random.Random(rare)
    parts = ["an", "the", "ing", "ou", "é", "ñ", "tion", "er", "a", "ÿ", "st"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(150)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "ababababa", "bababab", "z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 149]
    rows = []
    for d in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k:], w[:k] + rng.choice("aeé") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, rng.choice([" ", "-", "\n", "1"]).join(words), "w", 1))
    rows += [(None, rows[0][1], "w", 1), (7, None, "w", 1), (8, "", "w", 1), rows[1], (9, "ÜnderŁx ×÷ab12", None, None)]
    want = plain(plain_counts(rows))
    got = found(spark, rows)
    assert got == want and len(want) > 500 and sum(r[1] for r in want.values()) > 1000


def test_no_rows(spark):
    assert found(spark, []) == {} == found(spark, [(1, None, "x", 1), (2, "one two three", "x", 1)])


def test_bound_holds_for_every_edit():
    """Grams left after any edit, at their places, are never fewer than the bound; nor is it ever below 1."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") if rng.random() < 0.7 else rng.choice("abcde") for _ in range(rng.randint(5, 12)))
    for _ in range(120):
        w = word()
        k = rng.randrange(len(w))
        for v in (w[:k] + "c" + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[: k + 1] + w[k + 2 :]):
            if v == w or len(v) < 5 or not one_edit(w, v):
                continue
            b = min(len(w), len(v))
            pool = [code for x in {w, v, *(word() for _ in range(6))} for _, code in variants.by_length([x])]
            many = np.concatenate([g.ravel() for code in pool for g in variants.grams(code, variants.limit(b)).values()])
            g, n = np.unique(many, return_counts=True)
            known = (g[n > 1], n[n > 1])
            sets, bounds = [], []
            for x in (w, v):
                (_, code), = variants.by_length([x])
                size, best, taken = variants.decompose(code, variants.limit(b), known)
                bounds.append(int(variants.bound(size, taken, variants.limit(b))[0]))
                sets.append({(int(best[0, p]), p) for p in np.flatnonzero(taken[0])})
            shorter, longer = sets if len(w) <= len(v) else sets[::-1]
            shared = sum(1 for g_, p in shorter if (g_, p) in longer or (len(w) != len(v) and (g_, p + 1) in longer))
            assert min(bounds) >= 1 and shared >= max(bounds)


def test_crc_of_runs():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    first = np.sort(rng.integers(0, 4800, 60))
    last = first + rng.integers(0, 190, 60)
    state = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    want = [zlib.crc32(data[i:j].tobytes(), int(s)) for i, j, s in zip(first, last, state)]
    assert variants.crcs(data, first, last, state).tolist() == want
