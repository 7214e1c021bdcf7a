"""Thresholds from labelled rows: a histogram per label leaves Spark, never the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Width of a histogram bin of scores between 0 and 1.
BIN = 0.001


def clean_labels(labels: DataFrame) -> DataFrame:
    """One row (doc_id, label) per labelled document: 0 if any of its rows says 0; other values and nulls are no label."""
    return (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
    )


def label_histogram(scored: DataFrame, score: str, label: str = "label") -> np.ndarray:
    """Rows (bin, label-0 rows, label-1 rows), at most 1 / BIN of them, by rising score in [0, 1]."""
    b = F.floor(F.col(score) / BIN).cast("int")
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(b.alias("b")).agg(
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("good")
    )
    return np.array(sorted((r.b, r.bad, r.good) for r in rows.collect()), dtype=np.float64).reshape(-1, 3)


def best_cut(hist: np.ndarray) -> float | None:
    """The score from which on rows count as good: the largest sum of the two hit rates; of equal cuts the middle of the first gap.

    None when a label is missing.
    """
    if not len(hist) or not hist[:, 1].sum() or not hist[:, 2].sum():
        return None
    edges = hist[:, 0]
    caught = np.concatenate([[0], np.cumsum(hist[:, 1])]) / hist[:, 1].sum()
    lost = np.concatenate([[0], np.cumsum(hist[:, 2])]) / hist[:, 2].sum()
    k = int(np.argmax(caught - lost))
    if k == 0:
        return 0.0
    upper = edges[k] if k < len(edges) else edges[k - 1] + 1
    return float((edges[k - 1] + 1 + upper) / 2 * BIN)


def quantile_cut(hist: np.ndarray) -> float | None:
    """The quantile of the scores at the share of rows labelled 0: as many rows lie below it as there are rows labelled 0, to a bin.

    In a gap between scores, the middle of it. None when a label is missing.
    """
    if not len(hist) or not hist[:, 1].sum() or not hist[:, 2].sum():
        return None
    edges, below = hist[:, 0], np.cumsum(hist[:, 1:].sum(axis=1))
    k = int(np.argmin(np.abs(np.concatenate([[0], below]) - hist[:, 1].sum())))
    if k == 0:
        return float(edges[0] * BIN)
    upper = edges[k] if k < len(edges) else edges[k - 1] + 1
    return float((edges[k - 1] + 1 + upper) / 2 * BIN)
