import random

import numpy as np
import pytest
from brute import base_counts, components, frame, judged, personal, repeats, shingles

from finquery.llm import fingerprint_index as FI
from finquery.llm import ngram_join as NJ
from finquery.llm.pii import personal_data, personal_data_digest
from finquery.llm.quality_mcd import chi_square, quality_rules
from finquery.llm.url_rules import RULES, rule_table, url_rules

VOCABULARY = [f"w{k}" for k in range(300)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


PASSAGE = prose(99, 60)
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a\x0b\x0cb\x1fc é ü 漢字 😀"), (7, "x " * 30000), (8, "same line\n" * 40), (9, "z" * 200_000)]
TEXTS = AWKWARD + [(10 + k, prose(k, 50 + 7 * k)) for k in range(12)] + [(40, prose(3, 71)), (41, prose(3, 71)), (42, PASSAGE + " " + prose(50, 40)), (43, prose(51, 40) + " " + PASSAGE), (44, PASSAGE.upper())] + [(60 + k, changed(prose(7, 400), k, k)) for k in range(9)]


def test_base_counts(spark):
    got = {r["doc_id"]: r for r in quality_rules(spark, frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        want = base_counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_outliers_go_and_clean_documents_stay(spark):
    rows = [(k, prose(k, 30 + k % 90).capitalize() + ".", "en" if k % 3 else None, "a" if k % 2 else "b") for k in range(900)]
    junk = [(1000 + k, " ".join(f"{w}***$$$" for w in prose(k, 60).split()), "en", "a") for k in range(25)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark, frame(spark, rows + junk)).collect()}
    assert all(got[k] for k, *_ in rows)
    assert not any(got[k] for k, *_ in junk)


def test_outliers_on_labelled_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = quality_rules(spark, docs).join(labels, "doc_id").where("not base_failed").toPandas()
    good, low = r[r.quality == 1], r[(r.quality == 0) & (r.n_words > 60)]
    assert good.kept.mean() > 0.97 and low.kept.mean() < 0.4


def test_quality_of_an_empty_table(spark):
    assert quality_rules(spark, frame(spark, [])).count() == 0


def test_chi_square():
    assert chi_square(0.5) == pytest.approx(5.348, abs=0.02) and chi_square(0.975) == pytest.approx(14.449, abs=0.05)


def removed(spark, texts, **options):
    return sorted(tuple(r) for r in FI.remove_repeats(spark, frame(spark, texts), **options).collect())


def test_repeats_against_brute_force(spark, monkeypatch):
    want = sorted(repeats(TEXTS))
    assert removed(spark, TEXTS) == want
    monkeypatch.setattr(FI, "CHUNK_BYTES", 500)
    assert removed(spark, TEXTS) == want
    assert removed(spark, TEXTS, width=3) == sorted(repeats(TEXTS, 3))


def test_repeated_rows_and_null_ids(spark):
    got = FI.remove_repeats(spark, frame(spark, [(5, PASSAGE), (5, PASSAGE), (9, PASSAGE), (None, "a b")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (5, 0), (5, 0), (9, 60)]
    assert FI.remove_repeats(spark, frame(spark, [])).count() == 0


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    index = FI.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=8, fanout=3)
    got = []
    for low, high in ((0, 12), (12, 20), (20, 42), (42, 99)):
        got += [tuple(r) for r in index.ingest(frame(spark, [x for x in TEXTS if low <= x[0] < high])).collect()]
    assert sorted(got) == sorted(repeats(TEXTS))
    assert len(index.generations) == 2  # three were compacted into one, and one came after


def batches(spark, index, cuts):
    for low, high in cuts:
        yield from (tuple(r) for r in index().ingest(frame(spark, [x for x in TEXTS if low <= x[0] < high])).collect())


def test_an_index_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    got = list(batches(spark, lambda: FI.FingerprintIndex(spark, path, buckets=8, fanout=3), ((0, 12), (12, 20), (20, 42), (42, 99))))
    assert sorted(got) == sorted(repeats(TEXTS))
    index = FI.FingerprintIndex(spark, path)
    assert (index.buckets, index.version, len(index.generations)) == (8, 4, 2)
    assert len(list(tmp_path.glob("index/generation-*"))) == 2 and len(list(tmp_path.glob("index/manifest-*"))) == 1
    with pytest.raises(ValueError, match="13 words"):
        FI.FingerprintIndex(spark, path, width=5)


def test_a_batch_that_fails_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    opened = lambda: FI.FingerprintIndex(spark, path, buckets=8, fanout=2)
    got = list(batches(spark, opened, ((0, 20),)))
    before = opened().generations
    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(FI.FingerprintIndex, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        list(batches(spark, opened, ((20, 99),)))
    assert opened().generations == before
    late = opened()
    got += list(batches(spark, opened, ((20, 99),)))
    assert sorted(got) == sorted(repeats(TEXTS))
    with pytest.raises(RuntimeError, match="meanwhile"):  # began from a manifest that is no longer the last
        late.ingest(frame(spark, [(200, PASSAGE)]))


def test_a_table_without_words_makes_an_empty_index(spark, tmp_path):
    index = FI.FingerprintIndex(spark, f"file://{tmp_path}/index")
    assert index.ingest(frame(spark, [])).count() == 0
    assert [r["n_removed"] for r in index.ingest(frame(spark, [(1, None), (2, "a b")])).collect()] == [0, 0]
    assert len(index.generations) == 2


def test_run_coding():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    checks, docs = keys >> np.uint64(40), np.arange(1000) - 2**62
    low, raw = FI.pack_run(keys, checks, docs)
    for a, b in zip(FI.unpack_run(1000, low, raw), (keys, checks, docs), strict=True):
        assert (a == b).all()
    k, c, least, place = FI.merged(np.array([5, 5, 5, 1], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([9, 3, 4, 8]))
    assert list(k) == [1, 5, 5] and list(c) == [1, 1, 2] and list(least) == [8, 4, 3] and list(place) == [1, 2, 1, 0]


def joined(spark, texts):
    return sorted(tuple(r) for r in NJ.jaccard_components(spark, frame(spark, texts)).collect())


def test_components_against_brute_force(spark, monkeypatch):
    chain = [(200 + k, " ".join(prose(77, 600).split()[4 * k : 500 + 4 * k])) for k in range(20)]
    texts = TEXTS + chain + [(300 + k, prose(3, 71)) for k in range(30)]
    want = components(texts)
    assert len({c for *_, c in want}) < len(texts) - 50
    assert joined(spark, texts) == want
    monkeypatch.setattr(NJ, "LEAF_SETS", 3)
    assert joined(spark, texts) == want


def test_a_large_group_of_near_copies(spark):
    base = prose(5, 300)
    texts = [(k, changed(base, k, k % 9)) for k in range(700)]
    assert joined(spark, texts) == components(texts)


def test_join_edges(spark):
    assert joined(spark, []) == []
    rows = NJ.jaccard_components(spark, frame(spark, [(4, "a b c d"), (4, "a b c d"), (9, "A B C D"), (None, "a b c d"), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows) == [(-1, 0, -1), (-1, 2, -1), (4, 2, 4), (4, 2, 4), (9, 2, 4)]


@pytest.mark.parametrize("percent", [90, 80, 70])
def test_signatures_lose_no_link(percent):
    """Any two sets above the threshold have a signature in common."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 85, 120, 300, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            cut = int(len(a) * (100 - percent) / 100)
            kinds = [a[: len(a) - cut], np.unique(np.concatenate([a, rng.integers(0, 2**64, len(a) * (100 - percent) // percent, dtype=np.uint64)])), np.unique(np.concatenate([a[: len(a) - len(a) * (100 - percent) // 200], rng.integers(0, 2**64, len(a) * (100 - percent) // 200, dtype=np.uint64)]))]
            for b in kinds:
                if len(b) and NJ.linked(a, b, percent):
                    assert set(NJ.signatures(a, percent)) & set(NJ.signatures(b, percent)), (n, len(b))


def test_tree_bound_is_no_underestimate():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 120, dtype=np.uint64)) for _ in range(2))
        assert np.minimum(NJ.counts_of(a), NJ.counts_of(b)).sum() >= len(np.intersect1d(a, b))
    assert len(shingles("a b")) == 1


PERSONAL = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f x@y a..b@c.d.e, @x.y q@-.-"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3"), (5, "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 5"), (6, "+1 (743) 555-3824 +12 +1234567890123456 +1..2 ++33 1 23 45 67 89."),
    (7, "é😀 mail: zoë.x@ex-ample.co.uk 漢 +49 30 1234567"), (8, "1 " * 40_000), (9, "a" * 100_000 + "@"), (10, "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433"), (11, "call 212-555-0101 now; and after many other words the code 212-555-0101"), (12, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 24be64439e3e49cf46b2d7c90f3602a3'), (13, "+" * 5000 + "1" * 14), (14, "a@b.c " * 600),
]


def test_personal_data_against_brute_force(spark):
    got = {r["doc_id"]: r for r in personal_data_digest(frame(spark, PERSONAL)).collect()}
    assert len(got) == len(PERSONAL)
    for i, t in PERSONAL:
        line, digest = personal(t)
        assert got[i]["base_sha256"] == digest, (i, line[:200], got[i]["spans"][:200])
        assert got[i]["n_email"] == line.count("email") and got[i]["n_ip"] == line.count("ip:") and got[i]["n_phone"] == line.count("phone")


def test_added_spans_and_scores(spark):
    got = {r["doc_id"]: [(s["kind"], round(s["score"], 2)) for s in r["spans"]] for r in personal_data(frame(spark, PERSONAL)).collect()}
    assert got[10] == [("iban", 0.95)]
    assert ("local_phone", 0.55) in got[11] and len(got[11]) == 1
    assert [k for k, _ in got[12]].count("secret") == 1
    assert personal_data(frame(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"ab{k}@c.de 1.2.3.{k % 300}" for k in range(40_000))
    r = personal_data_digest(frame(spark, [(1, text)])).collect()[0]
    assert r["base_sha256"] == personal(text)[1] and r["n_email"] == 40_000


def test_context_on_both_sides(spark):
    texts = ["555 123 4567 (mobile)", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff is the api_key", "call 555 123 4567, 555-123-4568, 555-123-4569 and then, far from any word, 555-123-4570", "555 123 4567 " + "x" * 40 + " phone"]
    got = {r["doc_id"]: [(s["kind"], s["s"]) for s in r["spans"]] for r in personal_data(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [("local_phone", 0)], 1: [("secret", 0)], 2: [("local_phone", 5), ("local_phone", 19), ("local_phone", 33)], 3: []}


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7?x", "http://a.example.com/en/8", "http://com/en/", "http://xcom/en/1", "http://b.example.net/de/81", "http://example.net/de/9#t", "ftp://x.org/es/1/2", "http://org?/es/", "http://www.example.com://x/en/7", "http://example.com/en/7" + "y" * 500, "a\nb://net/de/\n1", "http://.com/en/1", "http://com./en/1"]


def test_urls_against_brute_force(spark):
    rows = [(k, u, "h", 1, "o") for k, u in enumerate(URLS * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind int, rule string")
    for rules in (RULES, ()):
        table = rule_table(spark, rules) if rules else spark.createDataFrame([], "verdict string, host string, path string, rule string")
        got = {r["page_id"]: tuple(r)[1:] for r in url_rules(spark, pages, table).collect()}
        assert got == {k: judged(u, rules) for k, u, *_ in rows}
    assert url_rules(spark, pages.limit(0), rule_table(spark, RULES)).count() == 0


def test_nested_path_rules(spark):
    rules = (("block", "a.b/"), ("allow", "a.b/x"), ("block", "a.b/xy"), ("allow", "b/"), ("block", "c.a.b/x"))
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate((h, p) for h in ("a.b", "c.a.b", "b", "z.b", "ab") for p in ("", "/", "/x", "/xyz", "/y", "/xx"))], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules(spark, pages, rule_table(spark, rules)).collect()}
    assert got == {r["page_id"]: judged(r["url"], rules) for r in pages.collect()}
