import re

import pytest
from pyspark.sql import functions as F

from finquery import catalog
from finquery.operators import markdown, pages, recover
from finquery.shared import shared_folder
from finquery.sources import payload
from finquery.streaming import jobs


def test_payload_shapes(spark):
    answers = [
        (1, '```json\n{"candidates": [{"field_code": "ca", "value": 12, "evidence": {"raw_label": "CA", "column_role": "net"}}, {"field_code": "", "raw_value": "1"}, {"field_code": "RN"}]}\n```'),
        (2, '[{"field_code": "stocks", "raw_value": " 5,00 ", "confidence": 0, "label": "L"}]'), (3, 'Voici {"field_code": "CLIENTS", "raw_value": "7", "period": "n-1"} fin'), (4, "rien"), (5, None), (6, '{"candidates": 5}'),
    ]
    rows = {r["k"]: r for r in payload.payload_items(spark.createDataFrame(answers, "k int, answer string"), "answer", "k").collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["field_code"], rows[1]["raw_value"], rows[1]["raw_label"], rows[1]["column_role"], rows[1]["confidence"]) == ("CHIFFRE_AFFAIRES", "12", "CA", "NET_N", 0.7)
    assert (rows[2]["raw_value"], rows[2]["confidence"], rows[2]["source_excerpt"]) == ("5,00", 0.7, "L|5,00")
    assert rows[3]["period"] == "N_MINUS_1"


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    (tmp_path / "d.PDF").write_bytes(b"%PDF" + b"x" * 100)
    good, bad = payload.uploads(spark, str(tmp_path), most_bytes=50)
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["a.pdf"]
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()) == [("b.pdf", "magic"), ("c.txt", "name"), ("d.PDF", "size")]


def test_orientation(spark):
    rows = spark.createDataFrame([(0, [(0, 10.0), (90, 12.0)]), (0, [(0, 10.0), (90, 20.0)]), (90, [(0, 13.0), (90, 10.0)]), (90, [(0, 14.0), (90, 10.0)])], "declared int, s array<struct<angle:int,score:double>>")
    assert [r[0] for r in rows.select(payload.best_orientation(F.col("s"), F.col("declared"))).collect()] == [0, 90, 90, 0]


def test_connector_and_second_pass(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_number int")

    def connector(parts):
        for part in parts:
            yield part.assign(field_code=["CLIENTS" if p == 1 else "OTHER" for p in part["page_number"]])

    found = payload.connected(rows, connector, "doc_id long, page_number int, field_code string")
    assert [r["page_number"] for r in payload.without_key_codes(rows, found, ["CLIENTS"]).collect()] == [2]


def test_markdown_edges(spark):
    text = "bilan actif\n| L | Net | Net | X |\n|---|:---:|---|---|\n| A | 1 | 2 |\n| --- | 3 | 4 | 5 |\n|  | 3 | 4 | 5 |\n| B | | 7 | 8 | 9 |\nfin\n| seul |\n| x |"
    rows = markdown.table_rows(spark.createDataFrame([(1, 1, text), (1, 2, "| L | brut |\n| C | 3 |"), (2, 1, "")], "doc_id long, page_number int, content string"))
    got = {r["raw_label"]: r for r in rows.collect()}
    assert set(got) == {"A", "B", "C"}
    assert got["A"]["values"] == {"net_n": "2", "x": None} and got["B"]["values"] == {"net_n": "7", "x": "8"}
    assert got["C"]["section"] == "BILAN_ACTIF" and got["C"]["values"] == {"brut": "3"}


def test_table_fields(spark):
    from finquery.refdata import FIELD_WORDINGS

    wordings = spark.createDataFrame([(k, c, a) for k, (c, a) in enumerate((c, a) for c, aliases in FIELD_WORDINGS.items() for a in aliases)], "ord int, code string, alias string")
    text = "| Libellé | Net |\n|---|---|\n| Stocks | 5,00 |\n| Clients et comptes rattachés | 7,00 |\n| CLIENTS | 8,00 |\n| Divers | 1,00 |"
    got = {r["code"]: (r["status"], r["value"]) for r in markdown.table_fields(spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, content string"), wordings).collect()}
    assert got["STOCKS"][0] == "confirmed" and got["CLIENTS"] == ("conflicting", None) and len(got) == 2


def test_recovery(spark):
    texts = [(1, 1, "BILAN_PASSIF", "Dettes de financement (C) aucune ligne ici Provisions durables 12,00 TRESORERIE - PASSIF néant TOTAL III 5,00"), (1, 2, "CPC", "Achats revendus de marchandises 45 000,50 et la suite du compte des charges"), (1, 3, "CPC", "achats revendus 99,00 compte de produits et charges ventes de marchandises 7 000,00"), (1, 4, "CPC", "court")]
    have = spark.createDataFrame([(1, "CHIFFRE_AFFAIRES")], "doc_id long, field_code string")
    got = sorted((r["field_code"], r["page_number"], r["raw_value"]) for r in recover.recovered(spark.createDataFrame(texts, "doc_id long, page_number int, page_type string, native_text string"), have).collect())
    assert got == [("ACHATS_REVENDUS", 2, "45 000,50"), ("DETTES_FINANCIERES", 1, "0,00"), ("TRESORERIE_PASSIF", 1, "0,00")]


def test_page_types_follow_each_other(spark):
    texts = ["Identification du contribuable", "raison sociale et identifiant fiscal", "", "Bilan actif, immobilisations incorporelles", "stocks", "Détail des postes du CPC"]
    rows = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(texts)], "doc_id long, page_number int, native_text string")
    got = [r["page_type"] for r in pages.classified(rows).orderBy("page_number").collect()]
    assert got == ["IDENTIFICATION", "VIDE", "VIDE", "BILAN_ACTIF", "VIDE", "DETAIL_CPC"]


def test_jobs(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", 5), (1, 3, None, None)], "job int, n int, step string, page int")
    got = jobs.latest_state(rows, "job", F.col("n"), "step", "page").first()
    assert (got["last_step"], got["last_page"], got["n_events"]) == ("b", 5, 3)
    assert [r["n"] for r in jobs.until_terminal(rows, "job", F.col("step") == "b", "n").orderBy("n").collect()] == [1, 2]
    assert [r[0] for r in spark.createDataFrame([(None,), ("completed",), ("failed",), ("running",)], "s string").select(jobs.result_gate(F.col("s"))).collect()] == [404, 200, 422, 409]


def test_image_measures(spark):
    import numpy as np

    from finquery.sources import images

    page = np.full((120, 80), 255, np.uint8)
    page[::6, 5:75] = 0
    lines, blank = images.readability(page), np.full((60, 60), 250, np.uint8)
    assert lines > images.readability(np.rot90(page)) and images.is_blank(blank) and not images.is_blank(page)
    assert images.content_box(blank) == (0, 0, 60, 60) and images.content_box(page)[1] == 0
    rows = spark.createDataFrame([(1, 1, 80, 120, bytearray(page.tobytes())), (1, 2, 60, 60, bytearray(blank.tobytes())), (1, 3, 5, 5, None)], "doc_id long, page_number int, width int, height int, grey binary")
    got = {r["page_number"]: r for r in images.image_facts(rows).collect()}
    assert [got[k]["blank"] for k in (1, 2, 3)] == [False, True, True]
    assert payload_angle(spark, got[1]["scores"]) in (0, 180)
    parts = rows.where("page_number = 1").select(images.halves(F.col("width"), F.col("height")).alias("h"), images.page_layout(F.col("width"), F.col("height")).alias("p")).first()
    assert [(x["region"], x["top"], x["bottom"]) for x in parts["h"]] == [("top", 0, 100), ("bottom", 20, 120)]
    assert [(x["region"], x["top"], x["bottom"]) for x in parts["p"]] == [("full", 0, 120), ("top", 0, 70), ("bottom", 50, 120)]


def payload_angle(spark, scores):
    rows = spark.createDataFrame([(None, [(s["angle"], s["score"]) for s in scores])], "declared int, s array<struct<angle:int,score:double>>")
    return rows.select(payload.best_orientation(F.col("s"), F.col("declared"))).first()[0]


def test_pages_passes_and_settings(spark, monkeypatch):
    import pytest

    from finquery.config import Settings

    files = spark.createDataFrame([("a.pdf", bytearray(b"2")), ("b.pdf", bytearray(b"x"))], "path string, content binary")
    got = payload.exploded_pages(files, lambda content, most: [(k + 1, 0, f"page {k}") for k in range(int(content))], 1)
    assert sorted((r["path"], r["page_number"]) for r in got.collect() if r["page_number"]) == [("a.pdf", 1)]
    pages_in = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_number int")
    passes = [("full", lambda p: p.where("page_number = 1").withColumn("field_code", F.lit("CLIENTS"))), ("focused", lambda p: p.withColumn("field_code", F.lit("STOCKS")))]
    assert sorted((r["page_number"], r["strategy"]) for r in payload.fallback_chain(pages_in, passes, ["CLIENTS"]).collect()) == [(1, "full"), (2, "focused")]
    monkeypatch.setenv("FINQUERY_MAX_PAGES", "10")
    settings = Settings.from_environment()
    assert settings.pages_of(None, 99) == 10 and settings.pages_of(3, 2) == 2
    with pytest.raises(ValueError):
        settings.pages_of(11, 99)


def test_amounts_of_whole_tables(spark, sf_dir):
    pattern = re.compile(recover.ANY_AMOUNT)
    got = {(r["kind"], r["id"]): r["found"] for r in catalog.queries()["native_amounts_whole"](spark, sf_dir).collect()}
    for kind, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        for r in spark.read.parquet(f"{sf_dir}/{kind}.parquet").collect():
            found = None if r[column] is None else "|".join(m[1] for m in pattern.finditer(r[column]))
            assert got.pop((kind, r[key])) == found
    assert not got


def test_amounts_in_awkward_text(spark):
    texts = ["1 234,56 and -12,50", "x9,99y 1.000.000,00", "1234567,89", "12,345", "", None, "1 2,50"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["f"] for r in rows.select("k", recover.amounts_in(F.col("t")).alias("f")).collect()}
    assert got == {0: ["1 234,56", "-12,50"], 1: ["9,99", "1.000.000,00"], 2: ["1234567,89"], 3: [], 4: [], 5: None, 6: ["2,50"]}


def test_the_shared_folder_without_a_setting(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local[2]"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    assert shared_folder(Session()).startswith("file:///")
    monkeypatch.setattr(Context, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="share"):
        shared_folder(Session())


def walked(rows):
    """Page types one after the other, in plain Python, from the facts of each page."""
    out, previous = {}, {}
    for doc, number, n, kind, score, enough, detail, firm, goes, blank, asked, again in sorted(rows, key=lambda r: r[:2]):
        prev = previous.get(doc)
        lexical = None if n < 12 else "DETAIL_CPC" if detail else kind if enough else prev if prev in goes and score else kind if score else None
        picture = blank is False
        if lexical == "IDENTIFICATION" and number >= 2 and not firm:
            lexical = None
        if not picture and n < 12:
            got = "VIDE"
        elif lexical:
            got = lexical
        elif prev in goes:
            got = prev
        elif picture and asked:
            got = asked
            if asked == "IDENTIFICATION" and (number >= 2 or prev == "IDENTIFICATION") and not firm:
                got = {"BILAN_ACTIF": "BILAN_PASSIF", "BILAN_PASSIF": "CPC", "CPC": "DETAIL_CPC"}.get(prev, "BILAN_ACTIF") if again == "IDENTIFICATION" else again or asked
        elif n >= 30 and not detail and not (score and n >= 12):
            got = "AUTRE"
        else:
            got = "AUTRE" if picture else "VIDE"
        out[doc, number] = got
        if got not in ("VIDE", "AUTRE"):
            previous[doc] = got
    return out


def test_page_types_in_blocks_and_with_images(spark, monkeypatch):
    import random

    rng = random.Random(8)
    texts = ["", "stocks", "bilan actif immobilisations corporelles", "stocks et creances", "capitaux propres passif circulant", "compte de produits et charges produits d exploitation", "raison sociale identifiant fiscal", "identification du contribuable raison sociale", "rien de tout cela sur cette page ci non plus", "treize signes", "detail des postes du cpc", "resultat fiscal reintegrations", "total ii passif circulant fournisseurs"]
    kinds = [None, None, "IDENTIFICATION", "CPC", "BILAN_ACTIF", "AUTRE"]
    rows = [(d, k, rng.choice(texts), rng.choice([None, True, False, False]), rng.choice(kinds), rng.choice(kinds)) for d in range(40) for k in range(1, rng.choice([2, 5, 30]))]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, native_text string, image_blank boolean, asked_type string, asked_again string")
    facts = [(r.doc_id, r.page.page_number, r.page.n, r.page.type, r.page.score, r.page.enough, r.page.detail, r.page.firm, r.page.continues, r.page.image, r.page.asked, r.page.again) for r in pages.page_facts(df).collect()]
    want = walked(facts)
    assert len(set(want.values())) >= 7
    for block in (512, 4):
        monkeypatch.setattr(pages, "BLOCK", block)
        assert {(r.doc_id, r.page_number): r.page_type for r in pages.classified(df).collect()} == want


def test_ten_thousand_pages(spark):
    import time

    df = spark.range(10_000).selectExpr("1L AS doc_id", "CAST(id + 1 AS INT) AS page_number", "element_at(array('bilan actif immobilisations corporelles', 'stocks', 'stocks et creances'), int(id % 3) + 1) AS native_text")
    pages.classified(df.limit(10)).collect()
    began = time.perf_counter()
    assert pages.classified(df).groupBy("page_type").count().count() == 2
    assert time.perf_counter() - began < 60


def test_page_counters_and_recovery_counts(spark):
    attempts = spark.createDataFrame([(1, 1, 0, 5, False, None), (1, 2, 0, 7, False, "timeout"), (1, 3, 0, None, True, None), (1, 4, 2, 1, False, "first try")], "doc_id long, page_number int, n_rows int, latency_ms int, skipped boolean, error string")
    r = pages.page_counters(attempts).first()
    assert (r.n_processed, r.n_skipped, r.n_failed, r.latency_ms, r.warnings) == (2, 1, 1, 13, ["page 2: timeout"])
    shown = spark.createDataFrame([(1, 1, "CPC", "Achats revendus de marchandises 45 000,50 et la suite du compte des charges")], "doc_id long, page_number int, page_type string, native_text string")
    row = (1, "CLIENTS", "N", "Clients", "5,00")
    have = spark.createDataFrame([(*row, 1), (*row, 2)], "doc_id long, field_code string, period string, raw_label string, raw_value string, seq int")
    assert {r.n_recovered for r in recover.united(have, shown).collect()} == {0}  # one found, one fell together
    assert {r.n_recovered for r in recover.united(have.limit(1), shown).collect()} == {1}


def test_origins_by_normalised_label(spark):
    from finquery.operators import resolve

    have = spark.createDataFrame([(1, 1, "CLIENTS", "Clients", "5,00"), (1, 2, "RESULTAT_NET", "Résultat net", "7"), (1, 3, "CLIENTS", "clients", "5.00"), (1, 4, "STOCKS", None, "9")], "doc_id long, seq int, field_code string, raw_label string, raw_value string")
    asked = spark.createDataFrame([(1, "CLIENTS", "CLIENTS ", " 5,00"), (1, "OTHER", "clients", "5,00"), (1, "RESULTAT_NET_XIII", "resultat NET", "7"), (1, "STOCKS", "", "9"), (1, "STOCKS", "x", "9")], "doc_id long, field_code string, raw_label string, raw_value string")
    assert [r.origin for r in sorted(resolve.originals(asked, have).collect(), key=lambda r: ["CLIENTS", "OTHER", "RESULTAT_NET_XIII", "STOCKS"].index(r.field_code) * 10 + len(r.raw_label or ""))] == [3, 1, 4, None, 2]


def test_wordings_by_the_index_are_those_of_the_full_comparison(spark):
    import random

    rng, words = random.Random(5), ["ca", "stock", "total", "de", "des", "a", "b", "resultat", "net", "ii", "i", "dettes", "é"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    labels = spark.createDataFrame([(phrase(),) for _ in range(250)] + [("",), (None,), ("zzz",)], "label string")
    wordings = spark.createDataFrame([(k, f"c{k}", phrase()[: rng.choice([1, 2, 3, 8, 99])]) for k in range(300)] + [(300, "none", "")], "ord int, code string, alias string")
    full = sorted(map(str, markdown.best_wording(labels, "label", wordings).collect()))
    assert sorted(map(str, markdown.best_wording(labels, "label", wordings, most=10).collect())) == full


def test_attempts_feed_the_page_counters(spark):
    from finquery.sources import connector

    def call(row, attempt):
        if row["page_number"] == 2:
            raise connector.Failed(f"away {attempt}")
        if row["page_number"] == 3:
            raise connector.Truncated("cut")
        return "" if attempt == 1 else "{}"

    rows = connector.attempted(spark.createDataFrame([(1, k) for k in (1, 2, 3)], "doc_id long, page_number int"), call, "doc_id", "page_number", attempts=3, wait=lambda k: 0)
    got = sorted((r.page_number, r.attempt, r.answer, r.error, r.last) for r in rows.collect())
    assert got == [(1, 1, None, "empty answer", False), (1, 2, "{}", None, True), (2, 1, None, "away 1", False), (2, 2, None, "away 2", False), (2, 3, None, "away 3", True), (3, 1, None, "cut", True)]
    assert {r.page_number for r in connector.answered(rows).collect()} == {1} and {(r.page_number, r.attempt) for r in connector.quarantined(rows).collect()} == {(2, 3), (3, 1)}
    counted = pages.page_counters(rows.select("doc_id", "page_number", F.when(F.col("answer").isNotNull(), 1).otherwise(0).alias("n_rows"), "latency_ms", F.lit(False).alias("skipped"), F.when(F.col("last"), F.col("error")).alias("error"))).first()
    assert (counted.n_processed, counted.n_failed, counted.warnings) == (1, 2, ["page 2: away 3", "page 3: cut"]) and counted.latency_ms is not None
    assert [connector.back_off(k) for k in (1, 2, 3, 9)] == [2, 4, 6, 6]


def test_recovery_leaves_out_what_any_label_names(spark, sf_dir):
    rows = catalog.queries()["recover_anti_join_whole"](spark, sf_dir).collect()
    docs, labels = ({r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()} for t in ("documents", "labels"))
    got = {r["doc_id"] for r in rows if r["field_code"] == "CHIFFRE_AFFAIRES"}
    assert got == {i for i in docs if i % 4 == 0 and not (i in labels and labels[i]["quality"] == 1)}
    assert any(i >= 100 and i % 4 == 0 and r["quality"] == 1 for i, r in labels.items())


def test_amounts_that_share_what_parts_them_stand_in_both_dialects(spark, tmp_path):
    import duckdb

    texts = ["1.23 4.56", "1.23.45.67", "1.234.56", "x12.345 9.99\n8.88", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id int, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.found for r in catalog.queries()["native_amount_extract"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(con.sql(catalog.oracle_sql()["native_amount_extract"]).fetchall()) == got == dict(enumerate(["1.23|4.56", "1.23|45.67", "234.56", "9.99|8.88", "", None]))


def test_the_index_of_wordings_is_never_broadcast(spark, capsys):
    labels = spark.createDataFrame([("blue box",), ("old tin box",), (None,)], "label string")
    wordings = spark.createDataFrame([(k, f"c{k}", ("blue", "tin box", "x")[k % 3]) for k in range(60)], "ord int, code string, alias string")
    found = markdown.best_wording(labels, "label", wordings, most=0)
    assert {(r.label, r.code) for r in found.collect()} == {("blue box", "c0"), ("old tin box", "c1"), (None, None)}
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_recovery_folds_a_text_once(spark, capsys):
    rows = spark.createDataFrame([(1, 1, "CPC", "Achats revendus de marchandises 45 000,50 et la suite du compte des charges")], "doc_id long, page_number int, page_type string, native_text string")
    have = spark.createDataFrame([(2, "CLIENTS")], "doc_id long, field_code string")
    recover.recovered(rows, have).explain()
    plan = capsys.readouterr().out
    assert 0 < plan.count("translate(") <= 2  # once in each of the two branches, which read the pages apart


def test_texts_are_read_once_for_recovery(spark, sf_dir):
    """What is found on a page is not sought a second time for the operating result, nor for the results."""
    pages_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), F.lit("CPC").alias("page_type"), F.col("text").alias("native_text"))
    have = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.lit("CHIFFRE_AFFAIRES").alias("field_code"))
    plan = recover.recovered(pages_, have)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and len([line for line in plan.splitlines() if "Relation" in line and "text#" in line]) == 1


def test_operating_results_come_from_every_page(spark):
    text = "12 300,00 iii. resultat d'exploitation (i-ii) du compte de produits et charges"
    sold = "compte de produits et charges ventes de marchandises 7 000,00 puis la suite"
    rows = spark.createDataFrame([(1, 1, "CPC", text), (1, 2, "CPC", text), (1, 3, "CPC", sold), (1, 4, "CPC", sold), (2, 1, "CPC", sold)], "doc_id long, page_number int, page_type string, native_text string")
    have = spark.createDataFrame([(1, "RESULTAT_EXPLOITATION"), (2, "CHIFFRE_AFFAIRES"), (2, "CHIFFRE_AFFAIRES")], "doc_id long, field_code string")
    got = sorted((r.doc_id, r.field_code, r.page_number) for r in recover.recovered(rows, have).collect())
    assert got == [(1, "CHIFFRE_AFFAIRES", 3), (1, "RESULTAT_EXPLOITATION", 1), (1, "RESULTAT_EXPLOITATION", 2)]


def test_white_space_is_squeezed_as_before(spark):
    from finquery.functions.text import fold_ascii, fold_keep_marks

    texts = [" a  b\tc\n", "é è   x", "a\u0085b", "--", " \t ", "a - b_c", "\x0b\x1cz\r\ny", "　　", "a​b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("p")
    old = lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    from finquery.functions.text import plain_letters

    rows = df.withColumn("p", F.lower(plain_letters(F.col("t"))))
    for r in rows.select(fold_keep_marks(F.col("t")).alias("a"), old(plain).alias("b"), fold_ascii(F.col("t")).alias("c"), old(F.regexp_replace(plain, r"[^a-z0-9\s]+", " ")).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
