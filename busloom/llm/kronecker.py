"""Hard negatives by exact integer products, several candidates to one multiplication.

Components become integers floor(256 * x). Shifted by a bias they are not negative, so the components that several candidates have
at one place fit side by side in fields of one wide integer (Kronecker substitution). That integer times the anchor's shifted
component adds one product to every field; after the last component each field holds its candidate's whole product, and no field
can reach the next one, since its width fits the largest possible sum. Taking the biases' share off leaves exact scores. Fields
are packed in 64-bit words where two or more fit, in Python's long integers otherwise, so any finite component is exact.

  1. Anchors are the query set. They are taken in blocks of BLOCK anchors and BLOCK_CELLS components; a block goes to all tasks.
  2. Each task packs its candidates, slice by slice, and hands on its best rows of the anchor's label. A window joins the tasks.
  3. The bounds 50 p <= 100 s <= 95 p of each positive go out with the block again, and each task hands on its first rows within
     them. So what leaves a task is a few rows for an anchor, whatever the labels or copies of one vector are.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component take no part; of rows with one id the
one of smallest label, then smallest vector, stays; a vector that ends early has zeros behind; an empty vector scores 0. Equal scores go
by smaller id. Scores beyond a long become its nearest end in the result, ordered and bounded as such. No anchor, or no
table row at all: no rows. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from busloom.llm.common import keep

SCALE, CLASSES, SHIFTED, EVERY = 256, 10, 7, 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in 100 parts of the positive's: from, to.
FROM, TO = 50, 95
#: Anchors, and their components, in one block; candidates in one slice.
BLOCK, BLOCK_CELLS, SLICE = 2048, 4_000_000, 2048
LONG = 1 << 63


def integer_rows(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, with floor(256 * x) as doubles and their relabelling done."""
    x = F.col(vector).cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    of = F.col(label).cast("long")
    given = table.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fit)
    out = given.select(
        F.col(vec_id).cast("long").alias("id"),
        F.when(F.col(vec_id) % SHIFTED == 0, (of + 1) % CLASSES).otherwise(of).alias("label"),
        F.transform(x, whole).alias("v"),
    )
    twice = keep(out.groupBy("id").count().where("count > 1").select("id"))
    if twice.isEmpty():
        return out
    first = out.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
    return out.join(twice, "id", "left_anti").unionByName(first)


def whole(c: Column) -> Column:
    """floor(256 * c) as a double; floor() itself gives a long, beyond which doubles are whole anyway."""
    y = c * F.lit(float(SCALE))
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def grid(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of equal width with zeros behind; Python integers where a double's don't fit a word."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    if np.abs(out).max(initial=0) < 1 << 52:
        return out.astype(np.int64)
    return np.array([int(x) for x in out.ravel()], dtype=object).reshape(out.shape)


def field_bits(largest: int, places: int) -> int:
    """Bits that hold the sum of `places` products of two shifted components of at most `largest`."""
    return max(1, places * (2 * largest) ** 2).bit_length()


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (anchors, rows), exact, by packed fields."""
    places = anchors.shape[1]
    if not len(anchors) or not len(rows) or not places:
        return np.zeros((len(anchors), len(rows)), np.int64)
    bias = max(int(np.abs(anchors).max()), int(np.abs(rows).max()), 1)
    bits = field_bits(bias, places)
    long_words = 2 * bits > 64
    fields = 16 if long_words else 64 // bits
    kind = object if long_words else np.uint64
    up = lambda x: (x.astype(object) if long_words else x) + bias
    a, r = up(anchors).astype(kind), up(rows).astype(kind)
    spare = -len(r) % fields
    if spare:
        r = np.concatenate([r, np.zeros((spare, places), kind)])
    cells = r.reshape(-1, fields, places)
    packed = cells[:, 0].copy()
    for f in range(1, fields):
        packed |= cells[:, f] << (bits * f if long_words else np.uint64(bits * f))
    wide = a @ packed.T  # one product for `fields` candidates at each place
    mask = (1 << bits) - 1
    parts = [(wide >> (bits * f)) & mask for f in range(fields)] if long_words else [(wide >> np.uint64(bits * f)) & np.uint64(mask) for f in range(fields)]
    sums = np.stack(parts, axis=2).reshape(len(a), -1)[:, : len(rows)]
    if long_words:
        exact = sums - bias * anchors.astype(object).sum(1)[:, None] - bias * rows.astype(object).sum(1)[None, :] - places * bias * bias
        return np.clip(exact, -LONG, LONG - 1).astype(np.int64)
    return sums.astype(np.int64) - bias * anchors.sum(1)[:, None] - bias * rows.sum(1)[None, :] - places * bias * bias


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(object) if len(at) and scores[at].min() == -LONG else -scores[at]))][:k]


def candidate_slices(batches):
    """(ids, labels, vectors) of at most SLICE rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), [np.asarray(v.values, dtype=np.float64) for v in part.column("v")]


def scored_slices(block, batches):
    """(ids, labels, scores) of each slice against the block's anchors."""
    for ids, labels, vectors in candidate_slices(batches):
        width = max([len(v) for v in vectors] + [len(v) for v in block["vectors"]], default=0)
        yield ids, labels, products(grid(block["vectors"], width), grid(vectors, width))


class Best:
    """The first rows so far of each of several lists."""

    def __init__(self, lists: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * lists, [np.empty(0, np.int64)] * lists

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        pick = first_of(scores, ids, self.k)
        ids, scores = np.concatenate([self.ids[at], ids[pick]]), np.concatenate([self.scores[at], scores[pick]])
        pick = first_of(scores, ids, self.k)
        self.ids[at], self.scores[at] = ids[pick], scores[pick]

    def batch(self, names: tuple[str, str, str]) -> pa.RecordBatch:
        lists = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(lists), pa.array(flat(self.ids)), pa.array(flat(self.scores))], names=list(names))


def positives_of(rows: DataFrame, sent, k: int) -> DataFrame:
    """(anchor, id, score): of each anchor in the block its first k other rows of the same label; anchor is its place in the block."""

    def run(batches):
        block = sent.value
        best = Best(len(block["ids"]), k)
        for ids, labels, scores in scored_slices(block, batches):
            for name in np.unique(labels):
                at = np.flatnonzero(labels == name)
                for j in np.flatnonzero(block["labels"] == name):
                    use = at[ids[at] != block["ids"][j]]
                    best.add(j, ids[use], scores[j, use])
        yield best.batch(("anchor", "id", "score"))

    return top(rows.mapInArrow(run, "anchor long, id long, score long"), "anchor", k)


def negatives_of(rows: DataFrame, sent, k: int) -> DataFrame:
    """(pair, id, score): of each pair of anchor and positive in the block the first k rows of other labels within the pair's bounds."""

    def run(batches):
        block = sent.value
        best = Best(len(block["pair_anchor"]), k)
        for ids, labels, scores in scored_slices(block, batches):
            for p, (j, low, high) in enumerate(zip(block["pair_anchor"], block["low"], block["high"])):
                s = scores[j]
                at = np.flatnonzero((s >= low) & (s <= high))
                at = at[labels[at] != block["labels"][j]]
                best.add(p, ids[at], s[at])
        yield best.batch(("pair", "id", "score"))

    return top(rows.mapInArrow(run, "pair long, id long, score long"), "pair", k)


def top(found: DataFrame, key: str, k: int) -> DataFrame:
    """The first k of each key over all tasks, numbered from 1; a task hands on k rows of a key at most."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bounds(score: int) -> tuple[int, int]:
    """Smallest and largest s with FROM * score <= 100 * s <= TO * score."""
    return max(-LONG, -(-FROM * score // 100)), min(LONG - 1, TO * score // 100)


def anchor_blocks(rows: DataFrame, anchors: DataFrame):
    """Bounded blocks of the anchors, by id."""
    sizes = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    each = max(1, min(BLOCK, BLOCK_CELLS // max(1, sizes[1] or 1)))
    n_blocks = -(-sizes[0] // each)
    if n_blocks == 1:
        cuts = [None]
    else:
        edges = anchors.select(F.expr(f"percentile_approx(id, array({', '.join(str(k / n_blocks) for k in range(1, n_blocks))}), 100000)")).first()[0]
        cuts = sorted(set(edges))
    lows, highs = [None, *[c for c in cuts if c is not None]], [*[c for c in cuts if c is not None], None]
    for lo, hi in zip(lows, highs):
        part = anchors if lo is None else anchors.where(F.col("id") > lo)
        part = part if hi is None else part.where(F.col("id") <= hi)
        found = part.orderBy("id").collect()
        for at in range(0, len(found), each):
            yield found[at : at + each]


def mine(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by EVERY."""
    spark = table.sparkSession
    rows = keep(integer_rows(table, vec_id, vector, label))
    anchors = rows.where(F.col("id") % EVERY == 0)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if anchors.isEmpty():
        return out
    for found in anchor_blocks(rows, anchors):
        block = {"ids": np.array([r.id for r in found]), "labels": np.array([r.label for r in found]), "vectors": [np.array(r.v, dtype=np.float64) for r in found]}
        # few rows: an anchor's positives
        near = sorted(positives_of(rows, spark.sparkContext.broadcast(block), positives).collect(), key=lambda r: (r.anchor, r.rank))
        low, high = zip(*(bounds(r.score) for r in near)) if near else ((), ())
        block |= {"pair_anchor": [r.anchor for r in near], "low": low, "high": high}
        pairs = spark.createDataFrame([(p, int(block["ids"][r.anchor]), r.id, r.score) for p, r in enumerate(near)], "pair long, anchor_id long, positive_id long, positive_score long")
        hard = negatives_of(rows, spark.sparkContext.broadcast(block), negatives).select("pair", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        met = pairs.join(hard, "pair").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        out = out.unionByName(keep(met))
    return out
