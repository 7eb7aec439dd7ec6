"""Packing: validity of every placement, the linear program against what is known of it, the ids against the library."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from finquery.llm import packing as P

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check(pieces: list, ids: dict, size: int) -> tuple[int, int, int]:
    """All rules hold; padding, tokens and the number of pieces. ``ids``: of each document, by doc_id."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(docs) == set(ids)
    for d, found in docs.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids == np.array(ids[d][at : at + p.length], dtype="<u4").tobytes()
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += int(P.waste(np.array([at]), size)[0])
    assert sorted(sequences) == list(range(len(sequences)))
    return padding, sum(map(len, ids.values())), len(pieces)


def planned(histogram: dict[int, int], size: int) -> tuple[int, int]:
    """Padding and cuts of a plan, after a check that every item has just one place."""
    table = P.plan(histogram, size)
    length = np.repeat(np.array(list(histogram), dtype=np.int64), list(histogram.values()))
    rank = np.concatenate([np.arange(0), *(np.arange(c) for c in histogram.values())])
    per, where, off = table.place(length, rank)
    held, pieces = defaultdict(list), 0
    for n, k, w, o in zip(length.tolist(), per.tolist(), where.tolist(), off.tolist(), strict=True):
        if k:
            held[w].append((o, n))
            pieces += 1
        else:
            while n:
                number, opens, closes = (int(x[0]) for x in table.sequence_end(np.array([w])))
                took = min(n, closes - w)
                held[number].append((w - opens, took))
                w, n, pieces = w + took, n - took, pieces + 1
    assert sorted(held) == list(range(table.sequences))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return sum(int(P.waste(np.array([sum(n for _, n in p)]), size)[0]) for p in held.values()), pieces - len(length)


def test_plans():
    rng = random.Random(5)
    assert planned({}, 64) == (0, 0)
    assert planned({1000: 50, 1048: 50}, 2048) == (0, 0)  # pairs
    assert planned({1024: 7, 512: 3, 1: 2}, 2048) == (0, 0)  # powers of two alone
    padding, cuts = planned({1500: 1000}, 2048)  # nothing fits beside: end to end
    assert padding == 0 and cuts <= 1000
    for seed in range(6):
        rng = random.Random(seed)
        size = 256
        histogram = {n: rng.randrange(1, 400 if seed % 2 else 4) for n in rng.sample(range(1, size), rng.choice([3, 40, 200]))}
        padding, cuts = planned(histogram, size)
        tokens, items = sum(n * c for n, c in histogram.items()), sum(histogram.values())
        assert padding <= P.CUT_PRICE * items and (len(histogram) == 3 or padding <= 0.01 * tokens)
        if len(histogram) == 200 and seed % 2:
            assert padding <= 0.002 * tokens and cuts <= 0.1 * items


def test_knapsack_and_program_against_enumeration():
    size, lengths = 16, np.array([3, 5, 6, 7, 11])
    values = np.array([0.4, 1.1, 0.9, 1.6, 2.2])
    every = [c for k in range(1, 6) for c in combinations_with_replacement(range(5), k) if lengths[list(c)].sum() <= size]
    best, _ = P.best_totals(lengths, values, size)
    for total in range(1, size + 1):
        some = [values[list(c)].sum() for c in every if lengths[list(c)].sum() == total]
        assert best[total] == pytest.approx(max(some)) if some else best[total] == -np.inf
    # Optimal: no pattern of all prices below its dual value, and every item is taken once.
    program = P.Program(lengths, np.array([10, 7, 9, 4, 6]), size)
    program.solve()
    assert all(program.duals[list(c)].sum() <= P.waste(np.array([lengths[list(c)].sum()]), size)[0] + 1e-6 for c in every)
    assert (program.duals <= P.CUT_PRICE + 1e-6).all()
    taken = np.zeros(5)
    for column, x in zip(program.columns, program.x, strict=True):
        for k, a in column.items():
            taken[k] += a * x
    assert taken == pytest.approx([10, 7, 9, 4, 6])


def test_documents(spark):
    rng = random.Random(2)
    words = ["the", "cat", "Ünï", "x1,", "<|endoftext|>", "\n", "  "]
    texts = [None, "", " ", "the " * 9000, "cat " * 127] + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 200, 300]))) for _ in range(300)] + ["same text here"] * 150
    rows = list(enumerate(texts))
    library = Tokenizer.from_file(VOCABULARY)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS row", "3 AS rank").repartition(3)
    out = P.packed(spark, df, VOCABULARY, size=256)
    pieces = out.collect()
    padding, tokens, _ = check(pieces, ids, 256)
    assert padding <= 0.01 * tokens
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append(p)
    for s in P.sequences(out, 256, pad_id=7).collect():
        flat = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(held[s.sequence_id], key=lambda p: p.offset)])
        full = len(flat) if len(flat) & (len(flat) - 1) == 0 else 256
        assert s.n_tokens == len(flat) and np.frombuffer(s.ids, "<u4").tolist() == [*flat.tolist(), *[7] * (full - len(flat))]


def test_repeated_rows_nulls_and_empty_tables(spark):
    assert P.packed(spark, spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    got = P.packed(spark, spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, size=64).collect()
    assert sorted((str(p.doc_id), p.doc_tokens) for p in got) == [("1", 3), ("1", 3), ("2", 1), ("None", 2)]


def test_query(spark, sf_dir):
    from finquery.llm.queries import queries

    library = Tokenizer.from_file(VOCABULARY)
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in queries()["op12_packing"](spark, sf_dir).collect():
        assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], dtype="<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id])
        docs[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for places, whole in [(docs[d], len(x)) for d, x in want.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 2048
    padding = sum(int(P.waste(np.array([sum(n for _, n in s)]), 2048)[0]) for s in sequences.values())
    assert padding <= 0.005 * sum(map(len, want.values()))
