"""The pipeline against a plain version of its stages, on the smallest tables."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomgraph.llm import quality
from loomgraph.llm.common import table

from test_ops import SF, brute_classes, brute_tiles, reference_ids


def plain(spark):
    d = table(spark, SF, "documents")
    model = quality.train(d, table(spark, SF, "labels"))
    good = {r.doc_id: r.text for r in quality.score(d, model).filter("score >= 0.7").collect()}
    classes = brute_classes(sorted(good.items()))
    one = {i: t for i, t in good.items() if classes[i][0] == i}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]

    def leaks(text):
        w = words(text)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return any(any(tuple(x[k : k + 5]) in grams for k in range(len(x) - 4)) and brute_tiles(x, w, 5) >= 0.5 * len(x) for x in items)

    return {i: t for i, t in one.items() if not leaks(t)}


def test_run_is_what_the_plain_version_says(spark):
    out = cp.run(spark, SF).orderBy("start").collect()
    want = plain(spark)
    assert sorted(r.doc_id for r in out) == sorted(want)
    start = 0
    for r in out:
        ids = reference_ids(want[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32, r.indexed) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    # the mix decides the order: not that of the ids
    assert [r.doc_id for r in out] != sorted(want)


def test_stages_keep_the_columns_and_bear_empty_tables(spark):
    empty = table(spark, SF, "documents").limit(0)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == empty.columns, name
    assert cp.token_ids(spark, empty, SF).count() == 0


def test_stages_bear_nulls_and_repeats(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f g", None, None, None), (3, "one two three four five six seven", "en", None, 30)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    assert cp.drop_copies(spark, docs, SF).count() == 5
    assert cp.drop_benchmark(spark, docs, SF).count() == 5
    assert cp.mix_sources(spark, docs, SF).count() == 5
    assert cp.token_ids(spark, docs, SF).agg(F.sum("n_tokens")).first()[0] == sum(len(reference_ids(r[1])) for r in rows)
    assert cp.drop_bad(spark, docs, SF).count() <= 5
