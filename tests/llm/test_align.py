"""Alignment of two tokenizers against a plain two-pointer walk, and the fast encoder against the file's own library."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """([(id, bytes)], [(id, bytes)]) of a text, empty where one of them isn't the text."""
    letters = align.byte_letters()
    t, sp = libraries
    if not text:
        return [], []
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        s = sp.id_to_piece(i)
        b.append((i, bytes([int(s[3:5], 16)]) if sp.is_byte(i) else s.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain(libraries, rows):
    made = []
    for key, text in rows:
        a, b = tokens(libraries, text)
        i = j = at_a = at_b = 0
        groups, links, now = [], [], ([], [])
        while i < len(a) and j < len(b):
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            links.append((a[i][0], b[j][0]))
            if end_a <= end_b:
                now[0].append(a[i][0])
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                now[1].append(b[j][0])
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(now)
                now = ([], [])
        made.append((key, len(a), len(b), groups, links))
    n = Counter(p for *_, links in made for p in set(links))
    top = {}
    for (x, _), k in n.items():
        top[x] = max(top.get(x, 0), k)
    out = []
    for key, n_a, n_b, groups, links in made:
        s = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n[p] == top[p[0]] for p in links)
        out.append((key, n_a, n_b, len(groups), len(links), best, sum(n[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = [None, "", " ", "  two  spaces ", "a▁b", "▁", "tab\tand\nline\r\n", "<|endoftext|> and <s> </s> <unk>", "naïve café Über 12½ \xa0x", "日本語 текст 👩‍👩‍👧", "\x00\x01zero", "é", "x" * 5000, "don't we'll I'VE", "﻿mark", "ﬁ ligature ①"]


def test_equals_plain_version(spark, libraries):
    rng = random.Random(3)
    words = "the of tion and ändern where l'été 1984 under-standing ... !! Zürich".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "nobody's"), (1, "again"), (1, "again"), (500, "long text of many words. " * 60000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    for size in (1 << 24, 100):
        got = align.aligned(df, A, B, block_bytes=size).drop("n_best_b").collect()
        assert sorted(map(tuple, got), key=str) == plain(libraries, rows)
    assert align.aligned(df.limit(0), A, B).count() == 0


def test_alignments_hold_tokens_and_links(spark, libraries):
    rows = [(i, t) for i, t in enumerate(ODD)]
    for r in align.alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect():
        a, b = tokens(libraries, rows[r.doc_id][1])
        assert (r.a, r.b) == ([i for i, _ in a], [i for i, _ in b])
        ends_a, ends_b = ([sum(len(x) for _, x in s[: k + 1]) for k in range(len(s))] for s in (a, b))
        assert r.group_ends == sorted(set(ends_a) & set(ends_b))
        over = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ends_a[i] - len(a[i][1]), ends_b[j] - len(b[j][1])) < min(ends_a[i], ends_b[j])]
        assert sorted(zip(r.link_a, r.link_b, strict=True)) == over


def test_fast_encoder_equals_the_file(libraries):
    side = align.ByteLevel(A)
    assert side.fast
    rng = random.Random(11)
    signs = [chr(c) for c in range(0x240)]
    cases = [f"a{c}b {c} {c}{c}1{c}\n{c}" for c in signs] + ["".join(rng.choices(signs + [" "] * 200 + list("aeiou" * 40), k=rng.randint(1, 80))) for _ in range(3000)]
    for text, ids in zip(cases, side.encode(cases, [True] * len(cases)), strict=True):
        assert ids.tolist() == libraries[0].encode(text, add_special_tokens=False).ids, text


def test_query_on_documents(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = align.op11_align(spark, d).drop("n_best_b").collect()
    assert sorted(map(tuple, got), key=str) == plain(libraries, rows)
