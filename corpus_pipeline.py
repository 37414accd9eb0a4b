"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, tokens.

Each stage reads what its predecessor kept, written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.llm import bpe, decontam, near, secret_scan, simhash, toxicity
from dieflow.llm.common import cut, fresh, table
from dieflow.llm.queries import tokenizer_path

#: A document goes if its score is at least this: over the reporting threshold, for the sake of clean documents.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under REJECT; the model learns from the labels of the documents given.  Null and empty texts stay."""
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    (name,) = fresh(docs, "toxicity")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) < REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more, the one with the smallest id; rows without an id stay.

    SimHash's covering tables propose the copies whose fingerprints are close;
    its fingerprints can't tell all similarities of 0.8, so near.groups() adds
    proposals by minimum hashes and whole sets decide about both (see near.py).
    """
    return simhash.representatives(docs, grouped=near.groups)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked in their texts and n_chars following."""
    return secret_scan.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids, for every document; null texts have none."""
    return bpe.digest_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", to_tokens),
]

#: Training, fingerprints and tokens have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
