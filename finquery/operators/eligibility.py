"""Which candidates may stand for a field, and in which order they are preferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.columns import with_computed
from finquery.functions.text import contains_any, fold_keep_marks, normalize_ocr_label


def names_revenue(label: Column) -> Column:
    """A normalised label that names revenue or sales, and no purchases."""
    has = lambda w: F.contains(label, F.lit(w))
    return ~has("achat") & ((has("chiffre") & has("affaires")) | has("ventes de biens et services") | has("ventes de services") | has("ventes de marchandises"))


def is_total_general(nature: Column, label: Column) -> Column:
    """Of a nature and a normalised label."""
    return (nature == "GRAND_TOTAL") & label.rlike(R.TOTAL_GENERAL)


def labelled(rows: DataFrame) -> DataFrame:
    """With ``label``, the normalised label, as a column of its own: rules test it dozens of times."""
    return rows if "label" in rows.columns else with_computed(rows, {"label": normalize_ocr_label(F.col("raw_label"))})


def rejection_reasons() -> Column:
    """The rules that a row breaks, by number, over ``field_code, section, period, nature, column_role, label``; a period that is not kept is the only reason then."""
    code, section, period, role = (F.col(c) for c in ("field_code", "section", "period", "column_role"))
    label = F.col("label")
    has = lambda w: F.contains(label, F.lit(w))
    net = code.isin(R.NET_RESULT)
    listed = F.lit(False)
    for name, codes in R.SECTION_CODES.items():
        listed = listed | ((section == name) & code.isin(codes))
    wrong_role = {name: (section == name) & (period == "N") & code.isin(codes) & (role != wanted) for name, (wanted, codes) in R.ROLE_OF.items()}
    broken = {
        "E1": code == "UNKNOWN", "E2": ~listed, "E4": (period == "N_MINUS_1") & (role != "EXERCICE_N1"), "E5": wrong_role["BILAN_ACTIF"], "E6": wrong_role["BILAN_PASSIF"], "E7": wrong_role["CPC"],
        "E8": code.isin(R.NET_RESULT[1:]) & ((section != "CPC") | (role != "TOTAL_EXERCICE_N") | (period != "N")), "E9": code.isin("TOTAL_ACTIF", "TOTAL_PASSIF", "TOTAL_BILAN") & ~is_total_general(F.col("nature"), label),
        "E10": (code == "STOCKS") & ((section != "BILAN_ACTIF") | has("variation")),
        "E11": (code == "CLIENTS") & ((section != "BILAN_ACTIF") | has("crediteur") | (~has("clients et comptes rattaches") & (label != "clients"))),
        "E12": (code == "FOURNISSEURS") & ((section != "BILAN_PASSIF") | has("debiteur") | (~has("fournisseurs et comptes rattaches") & (label != "fournisseurs"))),
        "E13": (code == "DETTES_FINANCIERES") & ((section != "BILAN_PASSIF") | contains_any(label, ["augmentation des dettes", "diminution des dettes", "ecart de conversion"])),
        "E14": net & (~section.isin("BILAN_PASSIF", "CPC") | has("instance d affectation") | has("instance daffectation")), "E15": (code == "CHARGES_INTERETS") & ((section != "CPC") | has("autres charges financieres")),
        "E16": (code == "CHIFFRE_AFFAIRES") & ((section != "CPC") | ~names_revenue(label)), "E17": (code == "DEDUCTIONS") & ~has("deduct"), "E18": (code == "ACHATS_REVENDUS") & (~section.isin("CPC", "DETAIL_CPC") | ~has("revendu")),
        "E19": (code == "RESULTAT_EXPLOITATION") & ((section != "CPC") | (~has("resultat d exploitation") & ~has("resultat dexploitation"))),
        "E20": (code == "RESULTAT_FISCAL") & ((section != "RESULTAT_FISCAL") | (has("resultat net") & (contains_any(label, ["xi", "xv"]) | (~has("resultat fiscal") & ~has("resultat net fiscal"))))),
        "E21": net & has("resultat courant") & ~has("resultat net"), "E22": (code == "REPORT_DEFICITAIRE") & ~has("deficit"), "E23": (code == "ENCOURS_LEASING") & has("redevance"), "E24": (code == "REDEVANCES_CREDIT_BAIL") & has("encours") & ~has("redevance"),
    }
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in broken.items())))
    kept_period = (period == "N") | ((period == "N_MINUS_1") & code.isin(R.TWO_YEAR_CODES))
    return F.when(F.coalesce(kept_period, F.lit(False)), reasons).otherwise(F.array(F.lit("E3")))


def priority() -> Column:
    """Points of a row; the terms are added in a fixed order, so that equal rows have equal sums."""
    code, section, period, role = (F.col(c) for c in ("field_code", "section", "period", "column_role"))
    label = F.col("label")
    has = lambda w: F.contains(label, F.lit(w))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), F.lit(n)).otherwise(F.lit(0.0))
    expected = F.lit(False)
    for name, codes in R.EXPECTED_SECTIONS.items():
        expected = expected | ((section == name) & code.isin(codes))
    hinted = F.lit(False)
    for name, words in R.LABEL_HINTS.items():
        hinted = hinted | ((code == name) & contains_any(label, words))
    late_page = F.least(F.col("page_number").cast("double"), F.lit(20.0)) * 0.5
    net = code.isin(R.NET_RESULT) & (section == "CPC")
    zero = fold_keep_marks(F.col("raw_value")).isin("0", "0 00", "0.00", "0,00") | normalize_ocr_label(F.col("raw_value")).isin("0", "0 00")
    out = F.coalesce(F.create_map(*(F.lit(x) for pair in R.NATURE_POINTS.items() for x in pair))[F.col("nature")], F.lit(0.0)) + F.col("confidence") * 20.0
    terms = [
        points(expected, 100.0), points(period.isin("N", "N_MINUS_1"), 80.0), points((role.isin("NET_N", "EXERCICE_N", "TOTAL_EXERCICE_N") & (period == "N")) | ((role == "EXERCICE_N1") & (period == "N_MINUS_1")), 60.0), points(hinted, 50.0),
        points((code == "CHIFFRE_AFFAIRES") & has("chiffre d affaires"), 40.0), points((code == "CHIFFRE_AFFAIRES") & has("ventes de marchandises") & ~has("chiffre"), -40.0), points(net & (has("xiii") | has("xvi")), 50.0), points(net, 30.0), points((code == "RESULTAT_NET") & (section == "BILAN_PASSIF"), -20.0),
        points((code == "CHARGES_FINANCIERES") & ~has("charges") & zero, -120.0), points((code == "CHARGES_FINANCIERES") & F.replace(label, F.lit(" "), F.lit("")).rlike("^[0-9]+$"), -80.0), F.when(code == "CHARGES_FINANCIERES", -late_page).otherwise(0.0),
        F.when(code == "ACHATS_REVENDUS", F.when(has("revendu"), 80.0).otherwise(-100.0)).otherwise(0.0), F.when(code == "ACHATS_REVENDUS", -late_page).otherwise(0.0),
    ]
    for term in terms:
        out = out + term
    return out
