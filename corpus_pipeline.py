"""A training corpus from raw documents, stage by stage. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from busloom.llm import bpe, decontaminate, jaccard, pii, ranking
from busloom.session import checkpoint_dir

#: Near duplicates: shingles of five words, similarity of 80 in 100.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ranking.keep_good(docs, ranking.fit(ranking.measure(docs), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id."""
    return jaccard.keep_one(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars follows the text."""
    out = pii.mask(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids; columns of these names are replaced."""
    kept = tuple(c for c in docs.columns if c not in ("ids", "n_tokens"))
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), kept).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe_encoding", tokens),
]

#: Trained models and tokenizers can't be said in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
