"""Stages keep columns that are called as their own, languages that are rare are learned, and empty shards shift no start."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import language, mixing, quality, tokens
from loomgraph.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_clashing_columns(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source", F.lit(5).alias("score"), F.lit("p").alias("predicted"), F.lit("q").alias("slot"), F.col("doc_id").alias("position"), F.lit(None).cast("string").alias("block"))
    good = quality.keep_good(docs, table(spark, SF, "labels"))
    assert good.columns == docs.columns and good.filter("score = 5 and predicted = 'p'").count() == good.count() > 0
    order = mixing.mixed(docs)
    assert order.columns == docs.columns and sorted(r.position for r in order.collect()) == sorted(r.doc_id for r in docs.collect())


def test_rare_languages_are_learned(spark):
    goal = language.LANDMARKS + language.TRAIN
    many = spark.range(40 * goal).select(F.col("id").alias("doc_id"), F.lit("the common words of a language").alias("text"), F.lit("aa").alias("lang"))
    few = spark.range(1000000, 1000040).select(F.col("id").alias("doc_id"), F.lit("zyx wvu tsr qpo").alias("text"), F.lit("zz").alias("lang"))
    model = language.train(many.unionByName(few))
    assert model.langs == ["aa", "zz"]
    out = language.identify(few.select("doc_id", "text"), model)
    assert {r.lang_pred for r in out.collect()} == {"zz"}


def test_starts_skip_shards_that_do_not_exist(spark, tmp_path):
    """Shards far apart, as they are where one key has many rows: each begins where all before it end."""
    shards = [0, 1, 5000, 5001, 70000]
    rows = [(s, 0, [10 * i], [3 + i], 1, 3 + i, bytes(np.arange(3 + i, dtype="<u4"))) for i, s in enumerate(shards)]
    path = str(tmp_path / "corpus")
    spark.createDataFrame(rows, "shard int, block int, doc_ids array<long>, lengths array<long>, n_docs long, n_ids long, raw binary").write.parquet(f"{path}/payload")
    spark.createDataFrame([(s, 3 + i, 1) for i, s in enumerate(shards)], "shard int, n_ids long, n_docs long").write.parquet(f"{path}/shards")
    got = {r.doc_id: (r.start, r.n_tokens) for r in tokens.read_corpus(spark, path).collect()}
    assert got == {10 * i: (sum(3 + j for j in range(i)), 3 + i) for i in range(len(shards))}
