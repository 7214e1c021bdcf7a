"""Quality classifier by pairwise ranking in the manner of Bradley and Terry.

Of two documents, the one labelled 1 is preferred over the one labelled 0. The chance of that preference is the logistic
function of the difference of their scores, and a score is linear in the features, so the weights come from logistic loss
on feature differences. The threshold is a quantile of the scores of the labelled rows: the one at the share of rows
labelled 0 (in bins of 0.001). Scores are mapped to 0..1 so that this cut falls on DECISION.

Learned from labels of rows that are not held out (`common.held_out`): weights from a bounded sample (SAMPLE_ROWS rows,
PAIRS pairs), the cut from all of them. Inputs of a score are counts of the text alone.

Defined cases: null and empty texts score as a text without words; repeated rows score alike; null ids are scored and
never learned from; without both labels every score is 0.5; texts with equal counts tie and get one verdict; very long
texts are counted whole; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from busloom.llm import calibrate, stats
from busloom.llm.common import bounded_sample, filter_texts, held_out, keep, sigmoid
from busloom.llm.quality_rules import rule_counts

#: Labelled rows and pairs that the weights are learned from.
SAMPLE_ROWS, PAIRS = 8192, 60_000
#: Scores from here on are predicted 1.
DECISION = 0.3
L2, STEPS = 1e-3, 60


@dataclass
class Ranker:
    middle: np.ndarray
    width: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def features(self, x: np.ndarray) -> np.ndarray:
        """Scaled statistics and how far they lie beyond the usual range on either side."""
        z = np.clip((x - self.middle) / self.width, -6, 6)
        return np.concatenate([z, np.maximum(z - self.high, 0), np.maximum(self.low - z, 0)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (self.raw(x) - self.cut) + np.log(DECISION / (1 - DECISION)))


def matrix(counted) -> np.ndarray:
    return stats.shares({n: np.asarray(counted[n]) for n in stats.NAMES})[1]


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Ranker:
    """Weights by Newton steps on the logistic loss of feature differences, preferred minus other."""
    good, bad = x[y == 1], x[y == 0]
    low, middle, high = np.percentile(good, [5, 50, 95], axis=0)
    width = np.maximum((high - low) / 3, 1e-3 * np.maximum(np.abs(middle), 1))
    model = Ranker(middle, width, (low - middle) / width, (high - middle) / width, np.zeros(3 * x.shape[1]))
    rng = np.random.default_rng(seed)
    a, b = model.features(good), model.features(bad)
    d = a[rng.integers(0, len(a), pairs)] - b[rng.integers(0, len(b), pairs)]
    w = model.weights
    for _ in range(STEPS):
        p = sigmoid(d @ w)
        slope = d.T @ (p - 1) / pairs + L2 * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / pairs + L2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    raw_good, raw_bad = model.raw(good), model.raw(bad)
    model.slope = 4 / max(np.std(np.concatenate([raw_good, raw_bad])), 1e-6)
    model.cut = float(np.median(raw_good) + np.median(raw_bad)) / 2
    return model


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text: a narrow table, so that no text is shuffled to its label."""
    return keep(rule_counts(docs))


def fit(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Ranker | None:
    """None when a label is missing."""
    measured = measured.where(F.col("doc_id").isNotNull() & ~held_out()).join(calibrate.clean_labels(labels), "doc_id")
    seen = bounded_sample(measured, "doc_id", sample_rows)
    if seen["label"].nunique() < 2:
        return None
    model = learn(matrix(seen), seen["label"].to_numpy(), pairs)
    hist = calibrate.label_histogram(scored(measured, model), "score")
    cut = float(np.clip(calibrate.quantile_cut(hist), 1e-6, 1 - 1e-6))
    # that score becomes DECISION
    model.cut += (np.log(cut / (1 - cut)) - np.log(DECISION / (1 - DECISION))) / model.slope
    return model


def scores(model: Ranker | None, texts: list[str]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.score(matrix(dict(zip(stats.NAMES, np.array([stats.counts(x) for x in texts], dtype=np.int64).T))))


def scored(measured: DataFrame, model: Ranker | None) -> DataFrame:
    """The counts with a score for every row."""

    def run(batches):
        for part in batches:
            x = matrix({n: part.column(n).to_numpy(zero_copy_only=False) for n in stats.NAMES})
            s = np.full(len(x), 0.5) if model is None else model.score(x)
            yield part.append_column("score", pa.array(s, type=pa.float64()))

    return measured.mapInArrow(run, StructType([*measured.schema.fields, StructField("score", DoubleType())]))


def apply(measured: DataFrame, model: Ranker | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return scored(measured, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    return filter_texts(docs, lambda texts: scores(model, texts) >= DECISION)
