"""A training corpus in five stages, each written and read again before the next.

Every stage stands null, empty and very long texts, repeated rows, empty tables and further columns of
any name, which it keeps; what becomes of the first few is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import bpe_encode, build_lexicon
from kinfold.llm.jaccard_join import one_of_each_group
from kinfold.llm.quality_rules import kept_documents
from kinfold.llm.source_mix import mixed_documents
from kinfold.llm.toxicity import fit_toxicity, score_toxicity
from kinfold.sources.shared import fresh_folder, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the quality rules go, and so do null and empty texts; repeated rows share their fate."""
    return kept_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the network learns from the labelled documents of the corpus.

    A null text scores as an empty one. Without labels of both kinds nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    params = fit_toxicity(docs, labels)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id"), F.col("text"))
    return score_toxicity(whole, params, keep=("doc",)).filter("predicted = 0").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays, once.

    Texts without words are copies of nothing, and rows without id stay.
    """
    return one_of_each_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sources' target weights; one may be there up to three times, and one without words never is."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, none for a null or empty text."""
    ids = bpe_encode(docs.select("doc_id", "source", "text"), lexicon=build_lexicon(docs))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near copies", near_copies), ("source mixture", mixture), ("token ids", encoding)]

#: Stages hold a trained network and exact BPE, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage stores on its way goes as soon as its result is written; of the results the last stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for k, (_, stage) in enumerate(STAGES):
            path = fresh_folder(spark, f"pipeline-{k}", lasting=k == len(STAGES) - 1)
            with scratch(spark, everything=True):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
