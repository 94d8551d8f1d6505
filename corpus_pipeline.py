"""The corpus pipeline: five stages from documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from galegrid.llm.common import kept, read_documents
from galegrid.llm.exact_dedup import keep_first
from galegrid.llm.mixing import mixed_documents, quality_weight
from galegrid.llm.near_join import one_of_each
from galegrid.llm.packing import pack
from galegrid.llm.quality import fit, keep_good, score_of
from galegrid.llm.queries import VOCABULARY
from galegrid.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of docs, doesn't reject; all, if docs has no labels. Null and empty texts
    are scored as empty; equal rows stay or go together; an empty table gives no rows."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest doc_id (null last); of equal rows one. Null texts are
    empty; an empty table gives no rows."""
    return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the smallest doc_id (null last). Texts without words are no one's copies; an empty
    table gives no rows."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that the classifier scores higher are taken first.

    The classifier is trained as in the first stage, on the labels of all documents: those that are left here are nearly all of one
    label. Texts without words have nothing to take and go; repeated rows are taken each by itself; an empty table gives no rows.
    """
    weights = fit(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed_documents(docs, quality_weight(score_of(spark, weights)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence, place and ids. A null text is its end sign alone; repeated rows are packed each; an
    empty table gives no rows."""
    return pack(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    """stage, on workers that can import the package."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality", shipped(quality_stage)),
    ("exact_dedup", shipped(exact_stage)),
    ("ngram_join", shipped(near_stage)),
    ("mixing", shipped(mixing_stage)),
    ("packing", shipped(packing_stage)),
]

#: SQL can express neither training, minhashing nor byte-pair merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what a stage keeps is written and read again."""
    docs = read_documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = kept(docs)
    return docs
