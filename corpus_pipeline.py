"""A corpus from documents to packed sequences: five stages, each a DataFrame that is written and read by the next.

Every stage takes an empty table to an empty one, keeps columns that it doesn't know, and reads no label, language or source
of a document but where it says so. doc_id may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm import language, minhash, mixing, packing, toxicity
from tideframe.llm.queries import CAPACITY, language_model, table, tokenizer_path, toxicity_model
from tideframe.llm.shared import scratch, shared_folder, text_batches


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance rejects go. Null and empty texts are not toxic; repeated rows go or stay alike."""
    return toxicity.reject_toxic(docs, "text", toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is more likely than not go, and so do null texts and those without a letter. Repeated
    rows go or stay alike."""
    return language.reject_unknown(docs, "text", language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that of the smallest doc_id. Null and
    empty texts have no copies; of rows with one doc_id and text, one stays."""
    return minhash.drop_near_duplicates(docs, "doc_id", "text", 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 in turn (null is a source, the last); a document that the mix takes more than once is there
    more than once. Null texts have no words and are taken as often as their whole source is."""
    return mixing.mixed_documents(docs, "source", "text", ["doc_id"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens. A null text is its end id alone; repeated rows are packed each."""
    out = packing.pack_documents(docs, "doc_id", "text", tokenizer_path(), CAPACITY)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _in_batches(stage: Stage) -> Stage:
    """The stage, with small batches of texts between Spark and Python."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _in_batches(f)) for name, f in (("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_copies), ("mixing", mix), ("packing", pack))]

ORACLE_SQL = None  # classifiers, the knapsack and packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
