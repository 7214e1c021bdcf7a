"""Quality rules whose thresholds nobody sets by hand: an isolation forest on rule statistics.

Counts of every whole text are taken once. A forest grown on a bounded sample of labelled rows (SAMPLE_ROWS) gives each
document an anomaly score from the path lengths over random splits; the cut between usual and anomalous is the one that
best parts the two labels over *all* labelled rows.

Defined cases: null and empty texts have zero counts, fail the base rule and are not kept; documents with a null id are
scored as others; repeated ids give one row per row; without both labels no cut exists and the base rule alone decides;
other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from busloom.llm import calibrate, forest, stats
from busloom.llm.common import bounded_sample, keep, over_texts

#: Labelled rows that the forest may be grown on.
SAMPLE_ROWS = 8192
TREES, SUBSAMPLE = 150, 256
#: Rows labelled 0 for each labelled 1 in the sample, at most.
RARE_SHARE = 0.05
#: The statistics that a rule would bound.
RULES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "stops", "bangs", "pipes", "variety", "short_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of `stats.NAMES` for every row."""

    def run(texts):
        return dict(zip(stats.NAMES, np.array([stats.counts(x) for x in texts], dtype=np.int64).T))

    return over_texts(docs, run, ", ".join(f"{n} long" for n in stats.NAMES))


def rule_matrix(counted: dict[str, np.ndarray]) -> np.ndarray:
    names, x = stats.shares(counted)
    return x[:, [names.index(n) for n in RULES]]


def with_anomaly(counted: DataFrame, grown: forest.Forest) -> DataFrame:
    def run(batches):
        for part in batches:
            x = rule_matrix({n: part.column(n).to_numpy(zero_copy_only=False) for n in stats.NAMES})
            yield part.append_column("anomaly", pa.array(grown.score(x)))

    return counted.mapInArrow(run, StructType([*counted.schema.fields, StructField("anomaly", DoubleType())]))


def apply(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES) -> DataFrame:
    """Every document with its rule counts, anomaly score and verdict."""
    counted = keep(rule_counts(docs))
    labelled = counted.join(calibrate.clean_labels(labels), "doc_id")
    seen = bounded_sample(labelled, "doc_id", sample_rows)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    if seen["label"].nunique() < 2:
        scored, usual = counted.withColumn("anomaly", F.lit(None).cast("double")), F.lit(True)
    else:
        good, bad = seen[seen["label"] == 1], seen[seen["label"] == 0]
        seen = pd.concat([good, bad.iloc[: max(1, int(RARE_SHARE * len(good)))]])  # a forest finds what is rare in its sample
        grown = forest.grow(rule_matrix({n: seen[n].to_numpy() for n in stats.NAMES}), trees, SUBSAMPLE)
        scored = with_anomaly(counted, grown)
        hist = calibrate.label_histogram(with_anomaly(labelled, grown).withColumn("usual", 1 - F.col("anomaly")), "usual")
        usual = 1 - F.col("anomaly") >= F.lit(calibrate.best_cut(hist))
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & usual)
