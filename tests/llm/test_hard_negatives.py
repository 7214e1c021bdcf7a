"""Hard negatives against all pairs, and packed products against plain ones."""

import math
import random

import numpy as np
import pytest

from busloom.llm import kronecker

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, id string, rank string"


def plain(rows):
    """The contract over all pairs of rows (vec_id, vector, label)."""
    good = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        row = (y, [math.floor(256 * x) for x in v])
        good[i] = min(good.get(i, row), row)
    out = []
    for i, (y, v) in good.items():
        if i % 50:
            continue
        score = {j: sum(a * b for a, b in zip(v, w)) for j, (_, w) in good.items()}
        order = lambda ids: sorted(ids, key=lambda j: (-score[j], j))
        for p in order(j for j in good if j != i and good[j][0] == y)[:5]:
            fits = [j for j in order(good) if good[j][0] != y and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            out += [(i, p, k + 1, j, score[p], score[j]) for k, j in enumerate(fits[:3])]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, kronecker.mine(df).collect()))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(kronecker, "BLOCK", 4)
    monkeypatch.setattr(kronecker, "SLICE", 16)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.25, 0.5, rng.gauss(0.3, 0.4)]) for _ in range(6)], rng.randrange(3)) for i in range(0, 600, 2)]
    rows += [(700 + k, rows[25][1], k % 3) for k in range(40)]  # copies of an anchor's vector under all labels
    rows += [(None, [1.0] * 6, 1), (801, None, 1), (802, [1.0, None], 1), (803, [float("nan")] * 6, 1), (804, [float("inf")], 0), (805, [1.0] * 6, None)]
    rows += [(850, [0.5, 0.25], 1), (851, [], 0), (0, rows[0][1], rows[0][2]), (2, [0.1] * 6, 0), (900, [0.0] * 6, 1), (-50, [0.4] * 6, 2)]
    assert found(spark, rows) == plain(rows) and len(plain(rows)) > 50


def test_no_rows(spark):
    assert found(spark, []) == [] == found(spark, [(1, [1.0], 0), (None, None, None)])


@pytest.mark.parametrize("largest", [3, 200, 1 << 20, 1 << 31, 1 << 51])
def test_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, b = (rng.integers(-largest, largest, (n, 9), endpoint=True) for n in (5, 37))
    exact = np.clip(a.astype(object) @ b.T.astype(object), -kronecker.LONG, kronecker.LONG - 1)
    assert (kronecker.products(a, b) == exact.astype(np.int64)).all()
