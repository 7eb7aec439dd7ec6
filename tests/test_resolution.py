from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finquery.operators.candidates import prepared, repair
from finquery.operators.derive import derived
from finquery.operators.eligibility import labelled, priority, rejection_reasons
from finquery.operators.resolve import picked, ranked, resolved_fields
from finquery.plans.lifecycle import document_results, resolved_documents

SCHEMA = "doc_id long, seq int, field_code string, raw_value string, period string, nature string, confidence double, page_number int, page_type string, raw_label string, column_name string, column_role string, source_excerpt string, warnings array<string>"


def row(seq, code, value, page_type, label, role, nature="DETAIL", period="N", confidence=0.9, page=1, doc=1, heading=None, warnings=()):
    return (doc, seq, code, value, period, nature, confidence, page, page_type, label, heading, role, "", list(warnings))


BASE = [
    row(1, "TOTAL_ACTIF", "1 000,00", "BILAN_ACTIF", "TOTAL GENERAL I+II+III", "NET_N", "GRAND_TOTAL"),
    row(2, "TOTAL_PASSIF", "1 000,50", "BILAN_PASSIF", "TOTAL I+II+III", "EXERCICE_N", "GRAND_TOTAL"),
    row(3, "CLIENTS", "250,00", "BILAN_ACTIF", "Clients et comptes rattachés", "NET_N"),
    row(4, "CHIFFRE_AFFAIRES", "5 000,00", "CPC", "Chiffre d'affaires", "TOTAL_EXERCICE_N"),
    row(5, "RESULTAT_NET", "120,00", "CPC", "XIII Résultat net", "TOTAL_EXERCICE_N"),
    row(6, "RESULTAT_NET", "120,50", "CPC", "XVI Résultat net", "TOTAL_EXERCICE_N"),
    row(7, "DETTES_FINANCIERES", "300,00", "BILAN_PASSIF", "Total dettes de financement", "EXERCICE_N"),
    row(8, "TRESORERIE_ACTIF", "40,00", "BILAN_ACTIF", "Total trésorerie actif", "NET_N"),
    row(9, "TRESORERIE_PASSIF", "15,00", "BILAN_PASSIF", "Total III trésorerie passif", "EXERCICE_N"),
    row(10, "CHIFFRE_AFFAIRES", "4 000,00", "CPC", "Chiffre d'affaires", "EXERCICE_N1", period="N_MINUS_1"),
]


def outputs(spark, rows, doc=1):
    got = document_results(spark.createDataFrame(rows, SCHEMA)).where(F.col("doc_id") == doc).first()
    return {o["code"]: o for o in got["outputs"]}, {c["code"]: c for c in got["controls"]}, got["completeness"]


def test_a_document_from_end_to_end(spark):
    out, controls, complete = outputs(spark, BASE)
    assert len(out) == 20
    assert out["TOTAL_BILAN"]["value"] == Decimal("1000") and out["TOTAL_BILAN"]["status"] == "confirmed"
    assert out["RESULTAT_NET"]["value"] == Decimal("120")
    assert out["TYPE_RESULTAT"]["note"] == "Bénéficiaire" and out["TYPE_RESULTAT"]["value"] is None and out["TYPE_RESULTAT"]["confidence"] == pytest.approx(0.95)
    assert out["DETTES_BANCAIRES_MLT"]["value"] == Decimal("300") and out["DETTES_BANCAIRES_MLT"]["status"] == "derived"
    assert out["ACHATS_REVENDUS"]["status"] == "missing"
    assert controls["bilan_equilibre"]["status"] == "passed" and controls["tresorerie_nette"]["status"] == "passed"
    assert complete == pytest.approx(100 * 8 / 20)


def test_unbalanced_totals_conflict_and_fall(spark):
    rows = [r for r in BASE if r[1] != 2] + [row(2, "TOTAL_PASSIF", "1 200,00", "BILAN_PASSIF", "TOTAL I+II+III", "EXERCICE_N", "GRAND_TOTAL")]
    out, controls, _ = outputs(spark, rows)
    assert controls["bilan_equilibre"]["status"] == "failed"
    assert out["TOTAL_BILAN"]["status"] == "conflicting" and out["TOTAL_BILAN"]["value"] is None


def test_ties_with_other_amounts_conflict_and_lower_rows_do_not(spark):
    rows = spark.createDataFrame([*BASE, row(11, "CLIENTS", "260,00", "BILAN_ACTIF", "Clients et comptes rattachés (net)", "NET_N"), row(12, "CLIENTS", "270,00", "BILAN_ACTIF", "Clients", "NET_N", doc=2), row(13, "CLIENTS", "280,00", "BILAN_ACTIF", "Clients et comptes rattachés", "NET_N", doc=2)], SCHEMA)
    got = {(r["doc_id"], r["key"]): r for r in picked(ranked(prepared(rows)), "doc_id", "key").collect()}
    assert got[1, "CLIENTS"]["status"] == "conflicting" and got[1, "CLIENTS"]["value"] is None
    assert got[2, "CLIENTS"]["value"] == Decimal("280") and got[2, "CLIENTS"]["n_ranked"] == 2
    assert got[1, "CHIFFRE_AFFAIRES_N1"]["value"] == Decimal("4000")


def test_shifted_rows_need_review(spark):
    rows = spark.createDataFrame([row(1, "STOCKS", "5,00", "BILAN_ACTIF", "Stocks", "NET_N", warnings=["suspected_row_shift: 1"])], SCHEMA)
    got = picked(ranked(prepared(rows)), "doc_id", "key").first()
    assert (got["status"], got["value"]) == ("ambiguous", None)


def test_repair_restores_labels_roles_and_natures(spark):
    rows = spark.createDataFrame([
        row(1, "FONDS_PROPRES", "12,00", "BILAN_PASSIF", "12,00", "UNKNOWN"), row(2, "CHARGES_FINANCIERES", "0,00", "CPC", "0,00", "MONTANT_N"), row(3, "CHIFFRE_AFFAIRES", "7,00", "CPC", "Achats revendus", "TOTAL_EXERCICE_N"),
        row(4, "TOTAL_ACTIF", "9,00", "BILAN_ACTIF", "Total II", "NET_N"), row(5, "ACHATS_REVENDUS", "1,00", "CPC", "Achats de marchandises", "TOTAL_EXERCICE_N"), row(6, "RESULTAT_NET", "1,00", "CPC", "Résultat courant", "TOTAL_EXERCICE_N"),
    ], SCHEMA)
    got = {r["seq"]: r for r in repair(rows).collect()}
    assert (got[1]["raw_label"], got[1]["column_role"], got[1]["nature"]) == ("TOTAL DES CAPITAUX PROPRES", "EXERCICE_N", "SECTION_TOTAL")
    assert got[2]["raw_label"] == "0,00" and got[2]["column_role"] == "TOTAL_EXERCICE_N"
    assert got[3]["field_code"] == "ACHATS_REVENDUS" and got[5]["field_code"] == "UNKNOWN" and got[6]["field_code"] == "RESULTAT_COURANT"
    assert got[4]["nature"] == "DETAIL"
    assert got[1]["source_excerpt"] == "TOTAL DES CAPITAUX PROPRES|12,00"


REASONS = [
    ("STOCKS", "BILAN_ACTIF", "Variation de stocks", "NET_N", "N", {"E10"}), ("CLIENTS", "BILAN_ACTIF", "Clients créditeurs", "NET_N", "N", {"E11"}), ("FOURNISSEURS", "BILAN_PASSIF", "Fournisseurs", "EXERCICE_N", "N", set()), ("DETTES_FINANCIERES", "BILAN_PASSIF", "Écart de conversion", "EXERCICE_N", "N", {"E13"}),
    ("DETTES_FINANCIERES", "BILAN_PASSIF", "Dettes", "EXERCICE_N1", "N_MINUS_1", {"E3"}), ("TOTAL_ACTIF", "BILAN_ACTIF", "Total bilan", "NET_N", "N", {"E9"}), ("CHIFFRE_AFFAIRES", "CPC", "Achats", "TOTAL_EXERCICE_N", "N", {"E16"}), ("RESULTAT_NET", "CPC", "Résultat courant", "TOTAL_EXERCICE_N", "N", {"E21"}),
    ("ENCOURS_LEASING", "DETAIL_CPC", "Redevance", "EXERCICE_N", "N", {"E2", "E23"}), ("REPORT_DEFICITAIRE", "RESULTAT_FISCAL", "Report", "EXERCICE_N", "N", {"E22"}), ("DEDUCTIONS", "RESULTAT_FISCAL", "Déductions fiscales", "EXERCICE_N", "N", set()), ("RESULTAT_FISCAL", "RESULTAT_FISCAL", "Résultat net XI", "EXERCICE_N", "N", {"E20"}),
    ("CHARGES_INTERETS", "CPC", "Autres charges financières", "BRUT", "N", {"E7", "E15"}), ("ACHATS_REVENDUS", "CPC", "Achats", "TOTAL_EXERCICE_N", "N", {"E18"}), ("RESULTAT_EXPLOITATION", "CPC", "Produits d'exploitation", "TOTAL_EXERCICE_N", "N", {"E19"}), ("REDEVANCES_CREDIT_BAIL", "DETAIL_CPC", "Encours", "EXERCICE_N", "N", {"E24"}),
]


def test_rejection_reasons(spark):
    rows = spark.createDataFrame([(k, c, s, "GRAND_TOTAL", label, role, p) for k, (c, s, label, role, p, _) in enumerate(REASONS)], "k int, field_code string, section string, nature string, raw_label string, column_role string, period string")
    for r in labelled(rows).withColumn("got", rejection_reasons()).collect():
        assert set(r["got"]) == REASONS[r["k"]][5], REASONS[r["k"]]


def test_points(spark):
    rows = spark.createDataFrame([
        ("CLIENTS", "BILAN_ACTIF", "N", "NET_N", "DETAIL", "Clients et comptes rattachés", "1", 0.5, 1), ("CHARGES_FINANCIERES", "CPC", "N", "TOTAL_EXERCICE_N", "DETAIL", "12", "0,00", 0.5, 4), ("ACHATS_REVENDUS", "CPC", "N", "TOTAL_EXERCICE_N", "SECTION_TOTAL", "Achats revendus", "5", 1.0, 30),
        ("RESULTAT_NET", "BILAN_PASSIF", "N", "EXERCICE_N", "DETAIL", "Résultat net", "5", 0.0, 1), ("RESULTAT_NET_XVI", "CPC", "N", "TOTAL_EXERCICE_N", "OTHER", "XVI", "5", 0.0, 1),
    ], "field_code string, section string, period string, column_role string, nature string, raw_label string, raw_value string, confidence double, page_number int")
    got = [r[0] for r in labelled(rows).select(priority()).collect()]
    assert got == [100 + 10 + 100 + 80 + 60 + 50, 100 + 10 + 80 + 60 - 120 - 80 - 2, 300 + 20 + 80 + 60 + 50 + 80 - 10, 100 + 100 + 80 + 60 - 20, 0 + 100 + 80 + 60 + 50 + 30]


def test_order_and_partitions_change_nothing(spark):
    rows = [*BASE, *((2, *r[1:]) for r in BASE[::-1] if r[1] != 5), *((3, *r[1:]) for r in BASE if r[1] > 4)]
    text = lambda df: sorted((r["doc_id"], str(r["outputs"]), str(r["controls"])) for r in df.collect())
    whole = text(document_results(spark.createDataFrame(rows, SCHEMA)))
    dealt = text(document_results(spark.createDataFrame(rows, SCHEMA).repartition(7, F.rand(3))))
    alone = sorted(x for d in (1, 2, 3) for x in text(document_results(spark.createDataFrame([r for r in rows if r[0] == d], SCHEMA))))
    assert whole == dealt == alone


def test_derivations_follow_their_order(spark):
    wide = resolved_documents(spark.createDataFrame([
        row(1, "RESULTAT_COURANT", "100,00", "CPC", "Résultat courant", "TOTAL_EXERCICE_N"), row(2, "PRODUITS_NON_COURANTS", "30,00", "CPC", "Produits non courants", "TOTAL_EXERCICE_N"), row(3, "CHARGES_NON_COURANTES", "10,00", "CPC", "Charges non courantes", "TOTAL_EXERCICE_N"),
        row(4, "IMPOT_SUR_RESULTATS", "20,00", "CPC", "Impôt", "TOTAL_EXERCICE_N"), row(5, "RESULTAT_NON_COURANT", "99,00", "CPC", "Résultat non courant", "TOTAL_EXERCICE_N"), row(6, "DOTATIONS_AMORTISSEMENTS", "5,00", "CPC", "Dotations", "TOTAL_EXERCICE_N"),
    ], SCHEMA)).first()
    assert wide["RESULTAT_NON_COURANT"]["value"] == Decimal("20") and wide["RESULTAT_NON_COURANT"]["status"] == "derived"
    assert wide["RESULTAT_AVANT_IMPOT"]["value"] == Decimal("120") and wide["RESULTAT_NET"]["value"] == Decimal("100") and wide["CAF"]["value"] == Decimal("105")


def test_operating_result_prefers_the_first_named_page(spark):
    rows = spark.createDataFrame([row(1, "RESULTAT_EXPLOITATION", "50,00", "CPC", "Résultat d'exploitation", "TOTAL_EXERCICE_N", page=3), row(2, "RESULTAT_EXPLOITATION", "70,00", "CPC", "Résultat d'exploitation", "TOTAL_EXERCICE_N", page=2), row(3, "CHIFFRE_AFFAIRES", "60,00", "CPC", "Chiffre d'affaires", "TOTAL_EXERCICE_N"), row(4, "RESULTAT_EXPLOITATION", "40,00", "CPC", "Résultat d'exploitation", "TOTAL_EXERCICE_N", page=2)], SCHEMA)
    got = resolved_fields(prepared(rows)).first()["RESULTAT_EXPLOITATION"]
    assert got["value"] == Decimal("40")


def test_empty_tables_pass(spark):
    assert document_results(spark.createDataFrame([], SCHEMA)).count() == 0
    assert derived(resolved_fields(prepared(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_dataset_last_writers_missing_and_derived(spark):
    from finquery.operators import dataset
    from finquery.operators.resolve import FIELDS, FV

    kind = f"doc_id long, {', '.join(f'{c} {FV}' for c in FIELDS)}"
    value = lambda x, seq, status="confirmed", *w: (None if x is None else Decimal(x), status, 0.9, [seq], list(w))
    row = {c: None for c in FIELDS}
    rows = [
        (1, row | {"AUTRES_CHARGES_EXTERNES": value("5", 9), "AUTRES_CHARGES_EXTERNES_DETAIL": value("7", 3), "CLIENTS": value(None, 4, "conflicting", "w"), "TRESORERIE_ACTIF": value("10", 1), "TRESORERIE_PASSIF": value("4", 2)}),
        (2, row | {"AUTRES_CHARGES_EXTERNES": value("5", 2), "AUTRES_CHARGES_EXTERNES_DETAIL": value("7", 3), "CHARGES_INTERETS": value("1", 1), "ACHATS_TOTAL": value("8", 1)}), (3, row),
    ]
    wide = spark.createDataFrame([(d, *(x[c] for c in FIELDS)) for d, x in rows], kind)
    got = {r.doc_id: r for r in dataset.dataset(dataset.long_form(wide), wide).collect()}
    assert got[1].autres_charges_externes.value == 5 and got[2].autres_charges_externes.value == 7  # the later candidate's
    assert got[1].tresorerie_nette.value == 6 and got[1].tresorerie_nette.status == "derived" and got[1].tresorerie_nette.sources == [1, 2]
    assert got[1].warnings == ["CLIENTS conflicting.", "w"] and got[2].warnings == []
    assert got[2].frais_financiers.value == 1 and got[2].achats.value == 8 and got[2].caisse is None
    long = dataset.attributes(spark.createDataFrame(list(got.values()), dataset.dataset(dataset.long_form(wide), wide).schema)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in long} == {1: 36, 2: 36, 3: 35}
    told = dataset.document_warnings(wide, recovered=spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, n_recovered long"), fields=wide.select("doc_id").withColumn("warnings", F.array(F.lit("x"))))
    assert {r.doc_id: r.warnings for r in told.collect()} == {1: ["recovered from native text: +2", "x"], 2: ["x"], 3: ["x"]}


def test_filters_do_not_repeat_the_controls(spark, sf_dir, capsys):
    from finquery import catalog

    catalog.queries()["controls_eight"](spark, sf_dir).explain()
    lines = [line for line in capsys.readouterr().out.splitlines() if "Filter" in line]
    assert not [line for line in lines if "not_testable" in line or "case when" in line.lower()]


def test_lines_are_numbered_before_their_texts_are_made(spark, sf_dir):
    """What the numbering shuffles and sorts holds no text that is made of it."""
    from finquery.plans.synthetic import candidates

    for dense in (False, True):
        plan = candidates(spark, sf_dir, dense=dense)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Window") :]
        assert "raw_label" in plan and "raw_label" not in below and "raw_value" not in below
