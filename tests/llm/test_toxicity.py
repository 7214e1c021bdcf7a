"""The chain against sums over all tag rows, and the detector on documents with planted words."""

import itertools
import random
import zlib

import numpy as np
import pytest

from busloom.llm import crf, toxicity

SCHEMA = "doc_id long, text string, label int, score string"


def by_all_rows(m, e):
    """Marginals of tag 1 from every tag row."""
    total, one = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        s = m.first[y[0]] + sum(m.step[a, b] for a, b in zip(y, y[1:])) + sum(x for x, t in zip(e, y) if t)
        total += np.exp(s)
        one += np.exp(s) * np.array(y)
    return one / total


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_sums_over_all_tag_rows(seed):
    rng = np.random.default_rng(seed)
    m = crf.Chain(np.zeros(4), rng.normal(0, 1.5, (2, 2)), rng.normal(0, 1, 2))
    rows = [rng.normal(0, 2, n) for n in (1, 7, 10, 2)]
    starts = np.concatenate([[True] + [False] * (len(r) - 1) for r in rows])
    assert np.allclose(crf.marginals(m, np.concatenate(rows), starts), np.concatenate([by_all_rows(m, r) for r in rows]))


def test_long_chain_equals_plain_recursion():
    rng = np.random.default_rng(1)
    m = crf.Chain(np.zeros(4), np.array([[1.5, -1.0], [-1.0, 2.0]]), np.array([0.3, -0.2]))
    e = rng.normal(0, 1.5, 3001)
    fore, rear = crf.forward(m, e[None]), crf.backward(m, e[None])
    both = (fore + rear)[0]
    assert np.allclose(crf.marginals(m, e, np.arange(3001) == 0), 1 / (1 + np.exp(both[:, 0] - both[:, 1])), atol=1e-8)


def test_slopes_by_differences():
    rng = np.random.default_rng(2)
    f, y = rng.integers(1, 9, (3, 5, 2)), rng.integers(0, 2, (3, 5))
    m = crf.Chain(np.concatenate([rng.normal(0, 1, 9), np.zeros(crf.TABLE - 9)]), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))
    _, de, pair, start = crf.gradients(m, f, y)
    loss = lambda: crf.gradients(m, f, y)[0]
    for value, slope, at in ((m.step, pair, (0, 1)), (m.step, pair, (1, 1)), (m.first, start, (1,)), (m.weights, np.bincount(f.ravel(), np.repeat(de.ravel(), 2), 9), (4,))):
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def planted(n=900, seed=5):
    """Documents of made-up words; every ninth holds three insults, of which some share a beginning with a harmless word."""
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["vexilar"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 90))]
        if i % 9 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Grumpf", "blorkish", "vexilo", "vexilum"]))
        rows.append((i, " ".join(words), i % 4, "x"))
        labels.append((i, 1, int(i % 9 == 0)))
    return rows, labels


def test_planted_words_are_found(spark):
    rows, labels = planted()
    rows += [(5001, None, 1, "x"), (5002, "", 1, "x"), (5003, "12 34 !", 1, "x"), (None, rows[0][1], 1, "x"), (5004, "grumpf", 1, "x"), (5005, "dul " * 60_000 + "Grumpf blorkish", 1, "x"), rows[18]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    known = spark.createDataFrame(labels + [(7777, None, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.apply(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    text = {r[0]: r[1] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 9 == 0) for r in held]) > 0.97
    shown = {text[r.doc_id][s.start : s.end].lower() for r in got if r.doc_id in text and text[r.doc_id] for s in r.spans}
    assert {"grumpf", "blorkish", "vexilo", "vexilum"} <= shown and len(shown) < 30
    by = {r.doc_id: r for r in got}
    assert by[5001].score == by[5002].score == by[5003].score and by[5001].predicted == 0
    assert {by[5005].spans[-1].end} == {len(text[5005])} and by[None].score == by[0].score
    # labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.apply(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", 0, "x")], SCHEMA)
    assert [(r.score, r.predicted) for r in toxicity.apply(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.apply(docs.where("false"), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0
