"""Documents to training shards: language, near-duplicates, benchmark leaks, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

In all stages: rows with a null doc_id or text are judged like any other where a rule fits them and stay where none does, a null
text counts as empty, texts are taken whole, an empty table gives an empty result, and further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontamination, language_id, mixing, sharding, simhash_neardup
from dossier.llm.common import table
from dossier.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted stay; models are learned from all documents of the table.

    Texts without letters are no evidence against a document. Repeated rows are judged alike.
    """
    found = language_id.identify_documents(docs, table(spark, sf_dir, "documents"))
    rejected = found.where(~F.col("accepted")).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays. Groups link op3's fingerprints within four bits, which misses most near copies below a Jaccard of 0.95 (README).

    Empty and null texts are one group. Rows are told apart by doc_id: repeated rows of a kept doc_id all stay, and so do rows without one.
    """
    return simhash_neardup.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts and rows without a doc_id stay; passages without words are nowhere."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their rates; clean documents have a rate of one or more.

    Equal doc_ids draw alike, so repeated rows stay or go together; rows without a doc_id stay. Without labels all rates are equal.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it; repeated rows are documents of their own."""
    return sharding.assign(docs)


STAGES = [
    ("language", known_language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture), ("shards", shards),
]

#: The stages learn models and follow links over many rounds, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
