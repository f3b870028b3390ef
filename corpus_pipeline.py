"""A corpus pipeline of five operators: quality, near duplicates, benchmark decontamination, mix and token ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, mixing, neardup, quality, tokens
from loomgraph.llm.common import materialise, table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled documents given, doesn't reject.

    Null texts count as empty ones; repeated rows all stay or go; null ids aren't learned from; other columns stay, whatever they
    are called; no documents give none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Texts without five words in a row are like no other; rows that share the smallest id, and rows without one, all stay; no
    documents give none.
    """
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold half or more of a benchmark item.

    Null and empty texts hold none, null and empty items are in none; repeated rows all stay or go; without items all stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the order of files and of rows in them is the next stage's order.

    A null source is a source of its own; repeated rows stay; rows of a source that equal one another may change places.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus written as token ids in the order of the mix and read back: doc_id, start, n_tokens, ids_crc32, shard, block, indexed.

    The order is that of docs' files; docs that doesn't come from files is taken in the order of its ids.
    """
    name = F.col("_metadata.file_name")
    order = [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("int"), name, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        order = None
    return tokens.encoded(spark, docs, order)


STAGES = [
    ("quality_classifier", drop_bad),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing_sources", mix_sources),
    ("token_id_output", token_ids),
]

#: Trained scores and approximate search can't be said in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
