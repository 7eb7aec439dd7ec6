import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from brute import frame

from pyspark.sql import functions as F

from finquery.llm import license_rules as LR
from finquery.llm import mixing as MX
from finquery.llm import separator_scan as SS
from finquery.llm import token_output as TO
from finquery.llm.mixing import TARGETS, mixed_rates, realised
from finquery.llm.queries import oracle_sql, queries, tokenizer_path
from finquery.llm.template_decontam import decontaminated, leaks
from oracle import same

TEXTS = [(1, None), (2, ""), (3, "Hello, World! it's 12 o'clock"), (4, "É́cole ﬁn İstanbul ΣΑΣ ŉ x y   z"), (5, "w " * 20000), (7, "a" * 5000), (9, "<|endoftext|> quoted \"\" ' 's"), (8, "same"), (8, "same"), (11, "😀 漢字 ée.,; word.,;:!? A.b"), (12, "a <|endoftext|> b"), (13, "x<|startoftext|><|endoftext|>"), (14, "<| <|ENDOFTEXT|> <|endof text|>")]


def ids_of(text, ordinary=False):
    """``ordinary``: strings of special tokens are text, as in the flat files of op3."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = ordinary
    return t.encode(text or "", add_special_tokens=False).ids


def test_token_files_come_back(spark):
    got = sorted(TO.token_output(spark, frame(spark, TEXTS), tokenizer_path()).collect(), key=lambda r: (r["doc_id"], r["start"]))
    start = 0
    for r, (i, t) in zip(got, sorted(TEXTS, key=lambda x: x[0]), strict=True):
        ids = [*ids_of(t), 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert TO.token_output(spark, frame(spark, []), tokenizer_path()).count() == 0


def test_special_tokens_among_other_text():
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "Hello", "it's", " ", "\n", "É", "12", "...", "é", "≮|endoftext|>", "<"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1000)]
    ids, ends = TO.Encoder(tokenizer_path()).ids(pa.array(texts))
    for t, a, b in zip(texts, ends, ends[1:], strict=False):
        assert ids[a:b].tolist() == ids_of(t), t


def test_files_stand_in_the_order_of_their_numbers(spark):
    names = [f"file:///x/part-{n:05d}-0c1d-part-7.txt" for n in (7, 99_998, 99_999, 100_000, 100_001, 1_000_000)]
    rows = spark.createDataFrame([(name, 10 + k) for k, name in enumerate(names) for _ in range(2)], "path string, n_tokens long").withColumn("file", TO.file_number(F.col("path")))
    assert [tuple(r) for r in TO.starts_of(rows).orderBy("file").collect()] == [(7, 0), (99_998, 20), (99_999, 42), (100_000, 66), (100_001, 92), (1_000_000, 120)]


def test_ties_and_missing_ids(spark):
    rows = [(None, "no id"), (4, "a b c"), (4, "d e f"), (4, "g"), (-3, "first")]
    got = sorted(TO.token_output(spark, frame(spark, rows), tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -3, 4, 4, 4]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert {r["ids_crc32"] for r in got} == {zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes()) for _, t in rows}


def test_files_in_many_blocks(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(TO, "FILE_IDS", 20_000)
    monkeypatch.setattr(TO, "LEAST_IDS", 10_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = TO.token_output(spark, docs, tokenizer_path()).orderBy("doc_id").collect()
    assert len({r["file"] for r in got}) > 3
    start = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*ids_of(d["text"]), 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_control_coding(values):
    v = np.array(values, dtype=np.uint32)
    control, data = TO.control_encoded(v)
    assert len(control) == -(-len(v) // 4)
    assert (TO.control_decoded(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)) == v).all()


@pytest.mark.parametrize("block", [1 << 20, 50, 7])
def test_separator_scan_over_blocks(spark, block):
    rows = [x for x in TEXTS if x[0] != 5] + [(None, "no id"), (-5, "negative id")]
    got = SS.token_counts(spark, frame(spark, rows), tokenizer_path(), 49407, block).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, len(ids_of(t, True))) for i, t in rows)
    assert all(r["ended"] for r in got)


@pytest.mark.parametrize(("block", "ranges"), [(1, True), (2, True), (3, False), (5, True), (100, False)])
def test_plain_files_without_stamps(spark, tmp_path, block, ranges):
    files = {"part-0": [5, 9, 9, 5, 5, 9], "part-1": [9], "part-2": [], "part-3": [5, 5, 9, 5, 5, 5], "part-4": [5, 5]}
    for name, ids in files.items():
        np.array(ids, "<u4").tofile(tmp_path / name)
    got = sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in SS.separator_scan(spark, f"file://{tmp_path}", 9, "<u4", 0, block, ranges).collect())
    assert SS.ranged(f"file://{tmp_path}") and not SS.ranged("viewfs://store/x")
    want = []
    for name, ids in files.items():
        start = 0
        for n, e in enumerate([k for k, x in enumerate(ids) if x == 9]):
            want.append((name, n, start, e - start, True))
            start = e + 1
        if start < len(ids):
            want.append((name, ids.count(9), start, len(ids) - start, False))
    assert got == sorted(want)


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
LICENCES = [
    (1, None, "", "none"), (2, "", "", "none"), (3, "Prose.\nReleased under the MIT License.\nMore.", "MIT", "licensed"), (4, "Copyright (c) 2020 Jane Doe\n" + MIT, "MIT", "licensed"), (5, "Licensed under the Apache License, Version 2.0.", "Apache-2.0", "licensed"),
    (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "GPL-3.0,CC-BY-NC-4.0", "licensed"), (7, "Licensed under the Foo Licence 9.", "", "unknown"), (8, "He has a licensee.", "", "unknown"), (9, "Copyright 2021 by X", "", "unknown"), (10, "SPDX-License-Identifier: MIT", "MIT", "licensed"), (11, "x" * 300_000, "", "none"),
]


def test_licences(spark):
    got = {r["doc_id"]: (r["licences"], r["verdict"]) for r in LR.licences(frame(spark, [(i, t) for i, t, *_ in LICENCES])).collect()}
    assert got == {i: (a, b) for i, _, a, b in LICENCES}
    assert LR.licences(frame(spark, [])).count() == 0


def test_licences_on_documents(spark, sf_dir):
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "all-rights-reserved"}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries()["op2_licences"](spark, sf_dir).collect():
        want = {v for k, v in lines.items() if k in docs[r["doc_id"]].split("\n")}
        assert want <= set(r["licences"].split(",")), r


def test_rules_need_their_order():
    ids = ["bsd-source", "bsd-grant", "bsd-source", "copyright", "bsd-binary"]
    assert [LR.RULES[r][0] for _, r in LR.matched(ids)] == ["BSD-2-Clause"]
    assert LR.matched(["bsd-grant", *["copyright"] * 5, "bsd-source", "bsd-binary"]) == []


ITEM = "A train leaves the old station at 9 with Alice aboard and travels 120 km before it meets Bob who waits for 3 hours near the river bank and then walks home slowly"
OTHER = ITEM.replace("9", "7").replace("Alice", "Carla").replace("120", "88").replace("Bob", "Dave").replace("3 hours", "5 minutes")
MIXED = "One day Alice met Bob and then Alice saw Bob again while Alice told Bob about 5 cats and 5 dogs near the old mill"


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, MIXED, "x"), (3, None, "x"), (4, "two words", "x"), (5, "the short but literal item here", "x")], "item_id long, text string, h string")
    docs = [
        (1, "Before it all. " + ITEM + ". After it all.", {1}), (2, "Before. " + OTHER + " after", {1}), (3, MIXED.replace("Alice", "Eve"), {2}), (4, MIXED.replace("then Alice", "then Eve"), set()), (5, "nothing to see here at all in this long and clean document of words", set()), (6, None, set()), (7, "", set()),
        (8, "so the short but, *literal* item here too", {5}), (9, " ".join(ITEM.split()[:11]), set()), (10, (ITEM + " ") * 300, {1}),
    ]
    got: dict[int, set] = {}
    for r in leaks(spark, frame(spark, [(i, t) for i, t, _ in docs]), bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
        assert r["verbatim"] == (r["doc_id"] not in (2, 3))
    assert got == {i: x for i, _, x in docs if x}
    rows = decontaminated(spark, frame(spark, [(i, t) for i, t, _ in docs] + [(1, "again")]), bench).collect()
    assert len(rows) == len(docs) + 1 and sum(r["contaminated"] for r in rows) == 6
    assert decontaminated(spark, frame(spark, []), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminated(spark, frame(spark, [(1, ITEM)]), bench.limit(0)).collect())


def test_leaks_on_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i for i, t in docs.items() if any(x in t for x in items)}
    got = {r["doc_id"] for r in queries()["op6_decontaminated"](spark, sf_dir).collect() if r["contaminated"]}
    assert want <= got and len(got - want) <= 2


def corpus(n):
    rows, labels = [], []
    for k in range(n):
        kind = k % 10
        text = " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(40 + k % 30)) + (" awful nasty words" if kind == 9 else " ***" if kind == 8 else "")
        rows.append((k, text))
        if k % 2 or kind == 8:
            labels.append((k, 0 if kind == 8 else 1, 1 if kind == 9 else 0))
    return rows, labels


def test_rates_meet_targets_and_keep_clean_documents(spark):
    rows, labels = corpus(1000)
    r = mixed_rates(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().sort_values("doc_id")
    kind = r.doc_id % 10
    assert (r[kind == 9].p_toxic > 0.9).all() and (r[kind == 8].p_low > 0.9).all() and (r[kind < 8].p_clean > 0.9).all()
    for name, target in TARGETS.items():
        p = r[f"p_{name}"]
        assert (r.rate * r.n_tokens * p).sum() == pytest.approx(target * (r.n_tokens * p).sum(), rel=0.02)
    assert (r.rate >= 0).all() and (r[kind < 8].rate >= 1).all()


def test_rates_against_brute_force(spark):
    rows, labels = corpus(600)
    docs, told = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = MX.fitted(spark, docs, told)
    weights = {k % 2**64: (low, toxic) for k, low, toxic in zip(model.keys, model.low, model.toxic, strict=True) if k}
    got = mixed_rates(spark, docs, told).toPandas().sort_values("doc_id")
    p, n = [], []
    for _, text in rows:
        words = regex.sub(r"([^\p{L}\s]+)", r" \1 ", text.lower()).split()
        found = [weights.get(xxhash.xxh64_intdigest(w.encode(), 42), (0, 0)) for w in set(words)]
        e = np.exp([0, sum(a for a, _ in found) / MX.UNIT + model.prior[0], sum(b for _, b in found) / MX.UNIT + model.prior[1]])
        p.append(e / e.sum())
        n.append(len(words))
    p, n = np.array(p), np.array(n, float)
    assert np.allclose(got[["p_clean", "p_low", "p_toxic"]].to_numpy(), p, atol=1e-9) and (got.n_tokens == n).all()
    # Projected gradient on the rates themselves, in small steps.
    now = (n[:, None] * p).sum(axis=0)
    goal, rate = now * [TARGETS[d] for d in MX.DOMAINS], np.ones(len(n))
    for _ in range(5000):
        rate = np.maximum(0, rate - 0.2 * (p * (((rate * n) @ p - goal) / now)).sum(axis=1))
    assert np.allclose(got.rate, rate, atol=2e-3)


def test_targets_as_shares_of_the_output(spark):
    rows, labels = corpus(600)
    r = mixed_rates(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), shares={"clean": 0.9, "low": 0.08, "toxic": 0.02}, total=0.8).toPandas()
    out = [(r.rate * r.n_tokens * r[f"p_{d}"]).sum() for d in MX.DOMAINS]
    assert np.array(out) / sum(out) == pytest.approx([0.9, 0.08, 0.02], abs=0.002) and sum(out) == pytest.approx(0.8 * r.n_tokens.sum(), rel=0.002)


def test_targets_that_no_rates_meet_are_told(spark):
    docs, labels = frame(spark, [(k, "same words in all of them") for k in range(60)]), spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no rates meet"):
        mixed_rates(spark, docs, labels, targets={"clean": 2.0, "low": 0.5, "toxic": 1.0})


def test_every_feature_has_its_place():
    rng = random.Random(4)
    weights = [(rng.getrandbits(64) - 2**63, k + 1, -k) for k in range(MX.FEATURES)]
    model = MX.Model(weights, (0.0, 0.0))
    assert {(h, a, b) for h, a, b in zip(model.keys, model.low, model.toxic, strict=True) if h} == set(weights)


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixed_rates(spark, frame(spark, [(1, None), (2, ""), (3, "a b ***"), (3, "a b ***"), (4, "x " * 5000)]), none).collect()
    assert [r["n_tokens"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [0, 0, 3, 3, 5000]
    assert mixed_rates(spark, frame(spark, []), none).count() == 0
    docs = frame(spark, [(k, "t") for k in range(200)])
    rates = spark.createDataFrame([(k, [0.0, 1.0, 2.5, 0.5][k % 4]) for k in range(200)], "doc_id long, rate double")
    out = realised(docs, rates)
    assert out.columns == docs.columns
    counts = dict(out.groupBy("doc_id").count().collect())
    assert all(k % 4 != 0 for k in counts) and all(counts[k] == 1 for k in range(1, 200, 4)) and all(counts[k] in (2, 3) for k in range(2, 200, 4))


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    r = mixed_rates(spark, docs, train).join(held, "doc_id").toPandas()
    clean = r[(r.quality == 1) & (r.toxic == 0)]
    assert (clean.p_clean > 0.5).mean() > 0.9


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries()[name], oracle_sql()[name])


def test_contract_columns(spark, sf_dir):
    want = {"op1_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9_": "doc_id start n_tokens ids_crc32", "op10_": "doc_id n_email n_ip n_card n_phone base_sha256 spans"}
    for start, columns in want.items():
        name = next(n for n in queries() if n.startswith(start))
        df = queries()[name](spark, sf_dir)
        assert set(columns.split()) <= set(df.columns)
        assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = docs
    for name, stage in P.STAGES[:-1]:
        two = stage(spark, one, sf_dir)
        assert two.columns == docs.columns, name
        if name != "mixing to target weights":
            assert two.exceptAll(one).isEmpty(), name
        one = two
    ids = {r["doc_id"] for r in one.select("doc_id").collect()}
    last = P.STAGES[-1][1](spark, one, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == ids
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    toxic = [i for i, (_, t) in labels.items() if t == 1]
    assert sum(i in ids for i in toxic) <= 0.5 * len(toxic)
    whole = P.run(spark, sf_dir)
    assert {r["doc_id"] for r in whole.collect()} == ids


def test_stages_on_awkward_documents(spark, tmp_path):
    import corpus_pipeline as P

    prose = " ".join(f"w{k * k % 97}" for k in range(60))
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (4, prose), (None, prose + " end"), (5, "x" * 300_000), (6, " ".join(f"v{k}" for k in range(30_000)))]
    docs = frame(spark, rows)
    spark.createDataFrame([(1, "a question that no document holds at all here", "x")], "item_id long, text string, h string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted((r["doc_id"] or 0) for r in df.select("doc_id").collect())
    want = {"quality rules": None, "n-gram Jaccard join": [0, 1, 2, 3, 3, 5, 6], "benchmark decontamination": [0, 1, 2, 3, 3, 4, 5, 6]}
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.schema == docs.schema, name
        assert set(ids(got)) <= {0, 1, 2, 3, 4, 5, 6}
        if want.get(name):
            assert ids(got) == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert not {1, 2} & set(ids(P.quality(spark, docs, str(tmp_path))))
    last = P.tokens(spark, docs, str(tmp_path)).collect()
    assert len(last) == len(rows) and min(last, key=lambda r: r["start"])["doc_id"] is None
    assert P.tokens(spark, docs.limit(0), str(tmp_path)).count() == 0
