"""Toxicity by a linear-chain CRF over words: marginals of toxic tags, offending spans, and a score for the document.

  1. Labelled tokens. Labels say which documents are toxic, so the tokens are labelled first: of a sample of labelled documents,
     a word or word beginning that shows up in far more toxic than clean ones (RATIO at least, ERRORS standard errors off) marks its
     tokens in toxic documents as toxic; every token of a clean document is clean, marked or not.
  2. A chain with two tags is trained on windows of those tokens by forward-backward. Features of a token are its word, its
     beginnings and its neighbours, so a beginning that clean documents use as well gets a weight in between.
  3. Every whole text is one chain. Marginals come from forward-backward over all its tokens; runs of tokens of at least SPAN are
     the offending spans. The sum of those from FAINT on, its share of the words and the largest go through a logistic function to the score.
  4. The score's cut is the one that parts best all labelled rows that are not held out; it is moved to DECISION.

Fitted from at most SAMPLE_ROWS documents of each label and WINDOWS windows; the cut sees all labelled rows. Held-out rows, language,
source and id are in none of it.

Defined cases: null and empty texts, and texts without a letter, have no token and score as such; a text of any length is one chain;
repeated rows and ties score alike; null ids are scored and never learned from; a document with several label rows is toxic if one says
so, other values are no label; without both labels every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from busloom.llm import calibrate, crf
from busloom.llm.common import bounded_sample, held_out, keep, over_texts, sigmoid, utf8

#: Documents of each label that tokens are labelled in, and windows of WIDTH tokens that the chain is trained on.
SAMPLE_ROWS, WINDOWS, WIDTH = 4096, 6000, 24
#: How much more common a marked beginning is in toxic documents; least number and share of the toxic documents it is in.
RATIO, ERRORS, LEAST_DOCS, LEAST_SHARE = 4.0, 1.75, 3, 0.01
BEGINNINGS = (4, 5, 6, 7)
SPAN, DECISION = 0.5, 0.5
#: Marginals below are background and count for nothing in a document; words that a short document is short of.
FAINT, SHORT = 0.1, 10
WORDS = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers the scores of.
REMEMBERED = 300_000


def terms(word: str) -> list[str]:
    """The word and its beginnings, each with its kind."""
    w = word.lower()
    return [f"={w}", *(f"{k}{w[:k]}" for k in BEGINNINGS if len(w) >= k)]


def place(feature: str) -> int:
    return zlib.crc32(utf8(feature)) % (crf.TABLE - 1) + 1


def own_places(word: str) -> list[int]:
    made = ["bias", *terms(word)]
    return [place(x) for x in made] + [0] * (len(BEGINNINGS) + 2 - len(made))


def features(words: list[str]) -> np.ndarray:
    """Places (tokens, 8): own ones, then the words to the left and right."""
    near = ["", *(w.lower() for w in words), ""]
    return np.array([own_places(w) + [place(f"<{near[k]}"), place(f">{near[k + 2]}")] for k, w in enumerate(words)])


def clean_labels(labels: DataFrame) -> DataFrame:
    """One row (doc_id, label) per labelled document: 1 if any of its rows says 1."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))


def sampled_texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` ids of each label that are not held out, by hash of the id."""
    known = clean_labels(labels).where(~held_out())
    ids = [(int(i), y) for y in (0, 1) for i in bounded_sample(known.where(F.col("label") == y), "doc_id", rows)["doc_id"]]
    ids = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").repartition(F.col("doc_id")))


def marked_terms(sample: DataFrame) -> set[str]:
    """Words and beginnings that toxic documents have far more often than clean ones."""

    def run(texts):
        return {"terms": [sorted({t for w in {w.lower() for w in WORDS.findall(x)} for t in terms(w)}) for x in texts]}

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    had = over_texts(sample, run, "terms array<string>", ("label",)).select("label", F.explode("terms").alias("term"))
    seen = had.groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    log_ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    # at most toxic / LEAST docs' worth of terms can be this common: the result is bounded by the sample
    found = seen.where((F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (log_ratio - ERRORS * error > float(np.log(RATIO))))
    return {r.term for r in found.select("term").collect()}


def windows(sample: DataFrame, marks: set[str]) -> DataFrame:
    """(words, tags) of WIDTH tokens: those with a marked token, and one other of each document."""
    sent = sample.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        known = sent.value
        for b in batches:
            made = [list(cut(WORDS.findall(x or ""), y, known)) for x, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist())]
            words, tags = [w for m in made for w, _ in m], [t for m in made for _, t in m]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32()))], names=["words", "tags"])

    return sample.select("text", "label").mapInArrow(run, "words array<string>, tags array<int>")


def cut(words: list[str], label: int, marks: set[str]) -> Iterator[tuple[list[str], list[int]]]:
    hit = np.array([not marks.isdisjoint(terms(w)) for w in words], bool)
    starts = range(0, len(words) - WIDTH + 1, WIDTH) if len(words) >= WIDTH else range(min(1, len(words)))
    plain = [s for s in starts if not hit[s : s + WIDTH].any()]
    for s in [s for s in starts if hit[s : s + WIDTH].any()] + plain[len(plain) // 2 :][:1]:
        part = words[s : s + WIDTH]
        tags = (hit[s : s + WIDTH] & (label == 1)).astype(int).tolist()
        spare = WIDTH - len(part)
        yield part + [""] * spare, tags + [0] * spare


@dataclass
class Detector:
    chain: crf.Chain
    weights: np.ndarray = None
    cut: float = 0.0

    def score(self, n: np.ndarray, mass: np.ndarray, peak: np.ndarray) -> np.ndarray:
        return sigmoid(summary(n, mass, peak) @ self.weights - self.cut)


def summary(n, mass, peak) -> np.ndarray:
    """What a document's marginals come to: their sum, their share and the largest."""
    share = mass / (n + SHORT)
    return np.stack([np.ones(len(n)), np.log1p(mass), np.log(share + 0.002), peak, np.minimum(share * 20, 2)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton steps on the logistic loss, both labels with equal weight."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for _ in range(60):
        p = sigmoid(x @ w)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (weight * (p - y)) + l2 * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scores(dict):
    """A word's part in the emissions of its own token and of its neighbours, remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[float, float, float]:
        w, low = self.weights, word.lower()
        made = (float(w[own_places(word)].sum()) if word else 0.0, float(w[place(f"<{low}")]), float(w[place(f">{low}")]))
        if len(self) < REMEMBERED:
            self[word] = made
        return made


def flat_marginals(chain: crf.Chain, known: Scores, token_rows: list[list[str]]) -> np.ndarray:
    """Marginals of all tokens of the texts, one text a chain."""
    sizes = np.array([len(r) for r in token_rows])
    if not sizes.sum():
        return np.empty(0)
    part = np.array([known[w] for r in token_rows for w in r])
    starts = np.zeros(len(part), bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    ends = np.concatenate([starts[1:], [True]])
    none = known[""]
    left = np.where(starts, none[1], np.concatenate([[0.0], part[:-1, 1]]))
    right = np.where(ends, none[2], np.concatenate([part[1:, 2], [0.0]]))
    return crf.marginals(chain, part[:, 0] + left + right, starts)


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens of at least SPAN: start and end in code points, largest marginal."""
    out: list[dict] = []
    before = -2
    for k, m in enumerate(WORDS.finditer(text)):
        if p[k] >= SPAN:
            if k == before + 1:
                out[-1] = {"start": out[-1]["start"], "end": m.end(), "chance": max(out[-1]["chance"], float(p[k]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "chance": float(p[k])})
            before = k
    return out


def tag(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """doc_id, n_words, mass, peak and the offending spans of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    memory: dict = {}

    def run(texts):
        m = sent.value
        known = memory.setdefault("known", Scores(m.weights))
        rows = [WORDS.findall(x) for x in texts]
        sizes = [len(r) for r in rows]
        each = np.split(flat_marginals(m, known, rows), np.cumsum(sizes)[:-1]) if rows else []
        return {
            "n_words": sizes,
            "mass": [float(p[p >= FAINT].sum()) for p in each],
            "peak": [float(p.max(initial=0)) for p in each],
            "spans": [spans_of(x, p) if p.max(initial=0) >= SPAN else [] for x, p in zip(texts, each)],
        }

    fields = "n_words long, mass double, peak double, spans array<struct<start:int,end:int,chance:double>>"
    return over_texts(docs.select("doc_id", "text"), run, fields)


def learn_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> crf.Chain | None:
    """None when a label is missing."""
    sample = sampled_texts(docs, labels, sample_rows)
    if sample.select("label").distinct().count() < 2:
        return None
    got = keep(windows(sample, marked_terms(sample)))
    hit = F.array_max("tags") == 1
    each = [bounded_sample(part.withColumn("key", F.concat_ws(" ", "words")), "key", WINDOWS // 2) for part in (got.where(hit), got.where(~hit))]
    words = [list(w) for part in each for w in part["words"]]
    tags = np.array([t for part in each for t in part["tags"]], dtype=np.int64).reshape(-1, WIDTH)
    if not len(words):
        return None
    return crf.train(np.stack([features(w) for w in words]), tags)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Detector | None, DataFrame]:
    """The detector, and the tagged documents, which are read again for the result."""
    chain = learn_chain(docs, labels, sample_rows)
    if chain is None:
        empty = F.array().cast("array<struct<start:int,end:int,chance:double>>")
        return None, docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("peak"), empty.alias("spans"))
    tagged = keep(tag(docs, chain))
    known = tagged.drop("spans").where(F.col("doc_id").isNotNull() & ~held_out()).join(clean_labels(labels), "doc_id")
    seen = bounded_sample(known, "doc_id", 2 * sample_rows)
    model = Detector(chain)
    model.weights = logistic(summary(*(seen[c].to_numpy(float) for c in ("n_words", "mass", "peak"))), seen["label"].to_numpy())
    best = calibrate.best_cut(calibrate.label_histogram(scored(known, model), "score"))
    if best is not None:
        best = float(np.clip(best, 1e-6, 1 - 1e-6))
        model.cut = float(np.log(best / (1 - best)) - np.log(DECISION / (1 - DECISION)))
    return model, tagged


def scored(tagged: DataFrame, model: Detector | None) -> DataFrame:
    """The tagged rows with a score."""

    def run(batches):
        for part in batches:
            n, mass, peak = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "mass", "peak"))
            s = np.zeros(len(n)) if model is None else model.score(n, mass, peak)
            yield part.append_column("score", pa.array(s, type=pa.float64()))

    return tagged.mapInArrow(run, StructType([*tagged.schema.fields, StructField("score", DoubleType())]))


def apply(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans for every row."""
    model, tagged = fit(docs, labels, sample_rows)
    return scored(tagged, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), "n_words", "spans")
