"""Line dedup against a plain version, on the tables and on odd rows, with small and large joins."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, least_documents=2, least_chars=10):
    """[(id, text)] to [(id, kept, lines, dropped)]: each row is a document, null ids come last."""

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    held = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(i)
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for x in lines:
            ids = held.get(key(x), [])
            first = min((j for j in ids if j is not None), default=None)
            if len(ids) < least_documents or first is None or i == first:
                kept.append(x)
        out.append((i, text if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_plain_version(spark):
    rng = random.Random(7)
    pool = ["Éclair au chocolat", "  A common LINE here\t", "a common line HERE", "short", "", "naïve İstanbul line", "\x0bten chars!\x0c", "nine char", "x " * 6, " " + "x " * 6]
    rows = [(i, "\n".join(rng.choice([*pool, f"line of document {i} only"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(None, pool[1]), (None, "of nobody's own\nof nobody's own"), (3, None), (4, ""), (5, "\n\n"), (8, pool[1]), (8, pool[1]), (-1, "\n".join(pool))]
    rows += [(100, "\n".join([pool[1]] * 20000 + ["last line of it"])), (101, "one long line " * 20000), (102, "one long line " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("old")).withColumn("h", F.lit(1))
    for n in (2, 3):
        for most in (1 << 20, 0):
            out = linededup.dedup_lines(df, least_documents=n, broadcast_bytes=most)
            assert out.columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
            assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str) == plain(rows, n)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.llm.common.HOT", 4)
    rows = [(i, f"the line that all have\nshared by two {i // 2}\nown line of {i}") for i in range(40)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=0)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str) == plain(rows)
