"""Cleaning pipeline: quality, exact and near dedup, decontamination, tokens.

Every stage takes the documents its predecessor kept and returns those it keeps, with
the columns of documents; the last returns the encoded texts. ``run`` writes each stage
as Parquet in a shared folder, so a lost executor repeats one stage at most and a run
that died can be taken up again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import bpe, decontam, exact, minhash, quality
from voxelmill.operators import flow
from voxelmill.session import read_table, shared_folder

#: No SQL expresses the classifier, the sampling of near-duplicates or the merges; tests compare with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half, by a model fitted on the labelled ones.

    Null and empty texts have a score as well; repeated rows are scored alike; an empty
    table stays empty; all columns stay, whatever they are called.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    score = "score"
    while score in docs.columns:
        score += "_"
    return quality.with_score(docs, model, into=score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the smallest doc_id.

    A null text equals an empty one; of repeated rows one stays; a row without doc_id
    stays only if its whole group has none.
    """
    return exact.keep_first(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id.

    Texts without words and rows without doc_id stay.
    """
    return minhash.keep_one(docs, **minhash.COPIES)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly benchmark go.

    Null texts stay null; ``n_chars`` is counted anew; all columns stay.
    """
    cut = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the text decoded from them; a null text has none."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, id_cols=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_one_copy),
    ("near-duplicate removal", keep_one_near_copy),
    ("benchmark decontamination", cut_benchmark_passages),
    ("byte-level BPE", encode_texts),
]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages one after another, over all documents.

    With a ``folder`` in a shared store a rerun on the same tables begins at the first
    stage that was not done; the rows of ``documents``, ``labels`` and ``benchmark`` tell
    whether they are the same. Without one each run has a new folder, of which only the
    last stage's rows stay.
    """
    docs = read_table(spark, sf_dir, "documents")
    key = uuid.uuid4().hex if folder is None else "-".join(flow.fingerprint(read_table(spark, sf_dir, t)) for t in ("documents", "labels", "benchmark"))
    stages = [(name, lambda rows, stage=stage: stage(spark, rows, sf_dir)) for name, stage in STAGES]
    return flow.run_stages(docs, stages, folder or f"{shared_folder(spark)}/corpus", key)
