"""Fields that the native text of a page still shows when no candidate names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquery.functions.amounts import parse_decimal_amount
from finquery.functions.columns import with_computed
from finquery.functions.text import fold_keep_marks
from finquery.operators.candidates import dedupe_candidates

GROUPED = r"-?[0-9]{1,3}(?:[ .][0-9]{3})*[,.][0-9]{2}"
ANY_AMOUNT = rf"(?<![0-9])({GROUPED}|-?[0-9]+[,.][0-9]{{2}})(?![0-9])"


def amounts_in(text: Column) -> Column:
    """All amounts with two decimals that no digit touches, in order."""
    return F.regexp_extract_all(text, F.lit(ANY_AMOUNT), 1)


def amount_after(text: Column, anchor: str) -> Column:
    """The first amount after an anchor's first place."""
    place = F.locate(anchor, text)
    return F.when(place > 0, F.try_element_at(amounts_in(F.substr(text, place)), F.lit(1)))


def amount_before(text: Column, anchor: str) -> Column:
    """The amount before an anchor, or the one before that if two stand there."""
    return F.nullif(F.regexp_extract(text, rf"({GROUPED})\s*(?:[0-9]{{1,3}}(?:[ .][0-9]{{3}})*[,.][0-9]{{2}}\s*)?{anchor}", 1), F.lit(""))


def empty_between(text: Column, begin: str, end: str, reach: int = 400) -> Column:
    """Whether a section that begins holds no amount up to its end, or within reach where no end follows."""
    after = F.regexp_extract(text, rf"(?s){begin}(.*)$", 1)
    part = F.coalesce(F.nullif(F.regexp_extract(after, rf"(?s)^(.*?)(?:{end})", 1), F.lit("")), F.when(after.rlike(rf"^(?:{end})"), F.lit("")), F.substring(after, 1, reach))
    return text.rlike(begin) & ~part.rlike(ANY_AMOUNT)


def sales(text: Column) -> Column:
    shown = F.contains(text, F.lit("compte de produits")) | F.contains(text, F.lit("chiffres d affaires")) | F.contains(text, F.lit("ventes de marchandises"))
    goods, named = amount_after(text, "ventes de marchandises"), F.coalesce(amount_after(text, "chiffres d affaires"), amount_after(text, "chiffre d affaires"))
    return F.when(shown, F.coalesce(goods, named))


def purchases(text: Column) -> Column:
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, rf"achats revendus[^\n]{{0,40}}?({GROUPED})", 1), F.lit("")), F.regexp_extract(text, rf"(?s)achats revendus.{{0,60}}?({GROUPED})", 1)), F.lit(""))


def united(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates with those that `recovered` adds, the first of equal ones each, and ``n_recovered``: how many more a document has than it had rows before (equal ones counted each, so that rows which fall together are set against those that are found).

    Recovered rows come after all others of their document.
    """
    found = recovered(pages, candidates)
    before = candidates.groupBy("doc_id").agg(F.max("seq").alias("_last"), F.count("*").alias("_before"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "field_code"))  # a handful a page
    added = found.join(before.select("doc_id", "_last"), "doc_id", "left").withColumns({"seq": (F.coalesce("_last", F.lit(0)) + place).cast("int"), "period": F.lit("N"), "recovered": F.lit(True)}).drop("_last")
    whole = dedupe_candidates(candidates.withColumn("recovered", F.lit(False)).unionByName(added, allowMissingColumns=True))
    after = F.count("*").over(Window.partitionBy("doc_id"))
    return whole.join(before.select("doc_id", "_before"), "doc_id", "left").withColumn("n_recovered", F.greatest(after - F.coalesce("_before", F.lit(0)), F.lit(0))).drop("_before")


def recovered(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate rows from ``pages`` (``doc_id, page_number, page_type, native_text``) for codes that ``candidates`` lack; the first page that shows a code gives it.

    The operating result is taken from every page that shows it, present or not.
    """
    text, page = F.col("text"), F.coalesce("page_type", F.lit(""))
    has = lambda w: F.contains(text, F.lit(w))
    income, debts = page.isin("CPC", "") | has("compte de produits"), page.isin("BILAN_PASSIF", "")
    cash = F.regexp_extract(text, r"(?s)tresorerie\s*-?\s*passif(.{0,160}?)total iii", 0)
    made = {
        "CHIFFRE_AFFAIRES": (F.when(income, sales(text)), "CPC", "Chiffres d'affaires", "TOTAL_EXERCICE_N", "DETAIL", 0.75),
        "RESULTAT_EXPLOITATION": (F.when(page.isin("CPC", "") | has("resultat d exploitation (i-ii)"), amount_before(text, r"iii\.?\s*resultat\s*d[' ]?exploitation")), "CPC", "III. RESULTAT D'EXPLOITATION (I-II)", "TOTAL_EXERCICE_N", "SECTION_TOTAL", 0.85),
        "DETTES_FINANCIERES": (F.when((debts | has("dettes de financement")) & has("dettes de financement") & empty_between(text, r"dettes de financement\s*\(?\s*c\s*\)?", r"provisions durables|total i\s*\(|ecarts de conversion"), "0,00"), "BILAN_PASSIF", "DETTES DE FINANCEMENT (C)", "EXERCICE_N", "SECTION_TOTAL", 0.8),
        "TRESORERIE_PASSIF": (F.when((debts | has("tresorerie")) & (cash != "") & ~cash.rlike(ANY_AMOUNT), "0,00"), "BILAN_PASSIF", "TOTAL III TRESORERIE-PASSIF", "EXERCICE_N", "SECTION_TOTAL", 0.8),
        "ACHATS_REVENDUS": (F.when(has("achats revendus"), purchases(text)), "CPC", "Achats revendus de marchandises", "TOTAL_EXERCICE_N", "DETAIL", 0.75),
    }
    # A text is folded once, each amount is sought once, and only then are rows made of what is found.
    long_enough = pages.where(F.length(F.trim("native_text")) >= 40).select("doc_id", "page_number", "page_type", "native_text")
    sought = with_computed(with_computed(long_enough, {"text": fold_keep_marks(F.col("native_text"))}), {f"_{c}": x[0] for c, x in made.items()})
    row = lambda code, x: F.struct(F.lit(code).alias("field_code"), F.col(f"_{code}").alias("raw_value"), *(F.lit(v).alias(n) for n, v in zip(("page_type", "raw_label", "column_role", "nature", "confidence"), x[1:], strict=True)))
    found = sought.select("doc_id", "page_number", F.explode(F.array(*(row(c, x) for c, x in made.items()))).alias("r")).select("doc_id", "page_number", "r.*").where("raw_value is not null")
    shown = found.where(parse_decimal_amount(F.col("raw_value")).isNotNull())
    # One pass over the pages: what is found is marked where a candidate has its code.
    have = candidates.select("doc_id", "field_code").distinct().withColumn("_have", F.lit(True))
    place = F.row_number().over(Window.partitionBy("doc_id", "field_code").orderBy("page_number"))  # a handful a page
    every = F.col("field_code") == "RESULTAT_EXPLOITATION"
    missing = shown.join(have, ["doc_id", "field_code"], "left").where(F.col("_have").isNull() | every).withColumn("_place", place)
    return missing.where(every | (F.col("_place") == 1)).drop("_have", "_place")
