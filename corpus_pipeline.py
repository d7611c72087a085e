"""A corpus pipeline over ``documents``: toxic documents go, one document of each near-duplicate
group stays, sources are mixed to target weights, and what is taken is packed into sequences.

Rows are documents of their own: repeated ones are judged alike, and of equal texts one stays behind the second stage. Null and
empty texts are not toxic, have no near duplicates (of rows without words one stays for each id), count no words in the mix, and are
packed as their end id alone. Rows without an id are judged by their texts like others; null sources are a source of their own. Columns beside those
of ``documents`` go along up to the mix, whatever their names. An empty table gives an empty result with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.llm import common, mixing, ngram_join, packing, toxicity
from rowledger.llm.queries import read, vocabulary


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier chain, trained on the labels, does not find toxic."""
    labels, categories = toxicity.graded(read(spark, sf_dir, "labels"))
    return toxicity.reject(docs, toxicity.train(docs, labels, categories))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links of 0.8 on five-word shingles connect, that with the smallest id;
    of rows without words one stays for each id, and all that have no id."""
    return ngram_join.representatives(docs, 80, 100, 5)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2, 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", packed_sequences),
]

#: The classifier, the join and the genetic packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.discard(before)  # the next stage is stored
        before = docs
    return docs
