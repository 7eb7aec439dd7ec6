"""Alignment of two tokenizers against plain loops over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from finquery.llm.alignment import Aligner, alignment, components

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HOSTILE = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "the cat's <|endoftext|> <s> </s> <0x41>", "x▁y", "x ▁y", "été   no\u0085b a  b", "ﬁ ① \U0001f600 \U0001f468‍\U0001f469", "中文 字",
    "tab\t x\n y", "a　 b", "end​ start", "null\x00byte here", "don't 'll 're", " 's", "1234567890 12 3", "é café", "﻿bom", "a" * 3000, "ab " * 2000, "אב ال", "same same same", "same same same",
]


@pytest.fixture(scope="module")
def own() -> Aligner:
    return Aligner(A, B)


def plain(own: Aligner, text: str | None) -> tuple[list[int], list[int], list[tuple[list[int], list[int]]]]:
    """Ids of a whole text and its groups, by walking over the bytes."""
    if not text:
        return [], [], []
    a, b = own.first.encode(" " + text, add_special_tokens=False).ids, own.second.encode(text)
    if not b"".join(own.bytes_a[i] for i in a) == (" " + text).encode() == b"".join(own.bytes_b[i] for i in b):
        return [], [], []
    groups, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            ga.append(a[i])
            at_a, i = at_a + len(own.bytes_a[a[i]]), i + 1
        else:
            gb.append(b[j])
            at_b, j = at_b + len(own.bytes_b[b[j]]), j + 1
        if at_a == at_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


def expected(own: Aligner, rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    found = [(d, *plain(own, t)) for d, t in rows]
    counts = Counter((ga[-1], gb[-1]) for *_, groups in found for ga, gb in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for d, a, b, groups in found:
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        told = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def test_union_find():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (400, 390), (1000, 2500)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for x, y in zip(u, v, strict=True):
            lo, hi = sorted((label[x], label[y]))
            label = [lo if k == hi else k for k in label]
        assert components(n, u, v).tolist() == label


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_hostile_texts(spark, own):
    rng, marks = random.Random(3), [*"ab éß\n\t'1.,中▁", "the", " the", "  ", " ", "ing", "<s>", "<|endoftext|>"]
    rows = list(enumerate(HOSTILE + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]))
    rows += [(7, "the cat"), (7, "the cat"), (None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_a", "'x' AS chunk").repartition(3)
    docs, pairs = alignment(spark, df, A, B)
    assert sorted((tuple(r) for r in docs.select(*COLUMNS).collect()), key=str) == expected(own, rows)
    links = Counter((ga[-1], gb[-1]) for _, t in rows for ga, gb in plain(own, t)[2])
    assert {(r.first_id, r.second_id): r.n for r in pairs.collect()} == dict(links)


def test_pieces_are_remembered_right(own):
    """A second pass over known pieces, and over more of them than are remembered, gives the same."""
    texts = pa.array(["the cat sat", "on the mat " * 3 + "x", "y " + "z" * 100])
    first = own.align(texts)
    again = own.align(texts)
    assert first[2].text.take(pa.array(first[0])).to_pylist() == again[2].text.take(pa.array(again[0])).to_pylist()


def test_tables(spark, sf_dir, own):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs, _ = alignment(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), A, B)
    assert sorted((tuple(r) for r in docs.select(*COLUMNS).collect()), key=str) == expected(own, rows)


def test_empty_table(spark):
    docs, pairs = alignment(spark, spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.count() == 0 and pairs.count() == 0
    docs, _ = alignment(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)
    assert sorted(tuple(r) for r in docs.select(*COLUMNS).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
