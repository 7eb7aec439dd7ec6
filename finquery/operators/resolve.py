"""From ranked candidates to one value for each field of a document.

Values are structs ``value, status, confidence, sources, warnings``: ``sources``
are the ``seq`` numbers of the candidates that a value rests on, with which
`provenance` finds label, page and excerpt again. All of a document's fields
are picked with one shuffle by (document, key); the field algebra is narrow, on
one wide row a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.amounts import AMOUNT, amounts_agree, parse_decimal_amount, tolerance
from finquery.functions.columns import with_computed
from finquery.functions.text import normalize_label, normalize_ocr_label
from finquery.operators.eligibility import labelled, names_revenue, priority, rejection_reasons

TIE_BAND = 5.0
FV = f"struct<value:{AMOUNT},status:string,confidence:double,sources:array<int>,warnings:array<string>>"
F_NAMES = ("value", "status", "confidence", "sources", "warnings")
SECTION_PARTS = ["ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "TRESORERIE_ACTIF"]
FIELDS = sorted({c for codes in R.SECTION_CODES.values() for c in codes} | set(R.PREVIOUS_YEAR_KEY.values()) | {"ENCOURS_LEASING", "ACHATS_TOTAL", "TRESORERIE_NETTE", "FDR", "BFDR"})


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def fv(value: Column, status: Column | str, confidence: Column | None = None, sources: Column | None = None, warnings: Column | None = None) -> Column:
    return F.struct(value.cast(AMOUNT).alias("value"), (F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"), (none("int") if sources is None else sources).alias("sources"), (none("string") if warnings is None else warnings).alias("warnings")).cast(FV)


def resting(value: Column, status: Column | str, *fields: Column, warning: str | None = None) -> Column:
    """A value that rests on other fields: the greatest of their confidences, all of their sources in order, and a warning."""
    sources = F.concat(*(F.coalesce(f["sources"], none("int")) for f in fields))
    sure = fields[0]["confidence"] if len(fields) == 1 else F.greatest(*(f["confidence"] for f in fields))
    return fv(value, status, sure, sources, None if warning is None else F.array(F.lit(warning)))


def warned(field: Column, warning: str) -> Column:
    return fv(field["value"], field["status"], field["confidence"], field["sources"], F.array_append(F.coalesce(field["warnings"], none("string")), F.lit(warning)))


def without_value(status: str, *fields: Column, warning: str | None = None) -> Column:
    return resting(F.lit(None), status, *fields, warning=warning) if fields else fv(F.lit(None), status)


def usable(field: Column) -> Column:
    return F.coalesce(field["status"].isin("confirmed", "derived") & field["value"].isNotNull(), F.lit(False))


def ranked(candidates: DataFrame) -> DataFrame:
    """Eligible rows with an amount: ``amount, priority``."""
    return with_computed(labelled(candidates).where(F.size(rejection_reasons()) == 0), {"amount": parse_decimal_amount(F.col("raw_value")), "priority": priority()}).where("amount is not null")


def picked(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key: ``value, status, confidence, n_ranked, best, sources, warnings``.

    The best row has the most points, then the lowest ``seq``. Rows within the
    tie band of it conflict if their amounts differ at all. A best row that is
    marked as shifted settles clients, suppliers and stocks for no value.
    """
    top = F.max("priority").over(Window.partitionBy(*keys))
    tied = rows.withColumn("_tied", F.abs(F.col("priority") - top) <= TIE_BAND)
    first = F.struct(-F.col("priority"), F.col("seq"))
    best = tied.groupBy(*keys).agg(
        F.min_by(F.struct("amount", "confidence", F.col("seq").cast("int").alias("seq"), F.exists("warnings", lambda w: F.contains(w, F.lit("suspected_row_shift"))).alias("shifted"), F.col("field_code").isin("CLIENTS", "FOURNISSEURS", "STOCKS").alias("strict")), first).alias("b"),
        F.min(F.when(F.col("_tied"), F.col("amount"))).alias("low"), F.max(F.when(F.col("_tied"), F.col("amount"))).alias("high"), F.max(F.when(F.col("_tied"), F.col("confidence"))).alias("tied_confidence"), F.array_sort(F.collect_set(F.when(F.col("_tied"), F.col("seq").cast("int")))).alias("tied_sources"), F.count("*").alias("n_ranked"),
    )
    status = F.when(F.col("b.shifted") & F.col("b.strict"), "ambiguous").when(F.col("low") != F.col("high"), "conflicting").otherwise("confirmed")
    return best.select(*keys, F.when(status == "confirmed", F.col("b.amount")).alias("value"), status.alias("status"), F.when(status == "conflicting", F.col("tied_confidence")).otherwise(F.col("b.confidence")).alias("confidence"), "n_ranked", fv(F.col("b.amount"), "confirmed", F.col("b.confidence"), F.array("b.seq")).alias("best"), F.when(status == "conflicting", F.col("tied_sources")).otherwise(F.array("b.seq")).alias("sources"), F.when(status == "ambiguous", F.array(F.lit("row_shift"))).when(status == "conflicting", F.array(F.lit("tied_rows_differ"))).otherwise(none("string")).alias("warnings"))


def preferred(rows: DataFrame) -> DataFrame:
    """Narrower choices for some fields: rows that a test prefers, or all where none passes (sales: none then)."""
    rows, label = labelled(rows), F.col("label")
    raw = F.when(F.col("key") == "CHARGES_FINANCIERES", normalize_ocr_label(F.col("raw_value")))  # asked of no other key
    has = lambda w: F.contains(label, F.lit(w))
    key = F.col("key")
    revenue = names_revenue(label)
    better = (
        F.when(key == "STOCKS", F.col("nature") == "SECTION_TOTAL").when(key == "DETTES_FINANCIERES", F.col("nature").isin("SECTION_TOTAL", "SUBTOTAL", "GRAND_TOTAL") | has("total") | F.startswith(label, F.lit("dettes de financement")))
        .when(key == "CHIFFRE_AFFAIRES", revenue & has("chiffre") & has("affaires")).when(key == "CHARGES_FINANCIERES", ~(raw.isin("0", "0 00") & ~has("charges") & ~has("total v"))).otherwise(F.lit(True))
    )
    must = F.when(key == "CHIFFRE_AFFAIRES", revenue).when(key == "ACHATS_REVENDUS", has("revendu")).when(key == "TOTAL_ACTIF", F.col("section") == "BILAN_ACTIF").otherwise(F.lit(True))
    kept = rows.where(must).withColumn("_better", F.coalesce(better, F.lit(False)))
    return kept.withColumn("_any", F.max("_better").over(Window.partitionBy("doc_id", "key"))).where(F.col("_better") | ~F.col("_any")).drop("_better", "_any")


def operating_result_rows(rows: DataFrame) -> DataFrame:
    """Rows of other keys as they are; of the operating result those that fit the document's revenue and current result, by wording, first page and nearness."""
    rows = labelled(rows)
    label, own = F.col("label"), F.col("key") == "RESULTAT_EXPLOITATION"
    every = Window.partitionBy("doc_id")
    least = lambda test, value: F.min(F.when(own & test, value)).over(every)
    # The first row, in order, with an amount for the current year.
    first = lambda test: F.min(F.when(test & (F.col("period") == "N") & F.col("_amount").isNotNull(), F.struct("seq", F.col("_amount")))).over(every)["_amount"]
    asked = F.col("key").isin("RESULTAT_EXPLOITATION", "CHIFFRE_AFFAIRES", "RESULTAT_COURANT")
    rows = with_computed(rows, {"_amount": F.when(asked, parse_decimal_amount(F.col("raw_value")))}).withColumns({"_ca": first((F.col("key") == "CHIFFRE_AFFAIRES") & names_revenue(label)), "_rc": first(F.col("key") == "RESULTAT_COURANT")})
    fits = F.col("_amount").isNotNull() & ~F.contains(label, F.lit("produits d exploitation")) & F.coalesce(F.col("_amount") <= F.col("_ca"), F.lit(True)) & F.coalesce((F.col("_rc") == 0) | (F.abs(F.col("_amount") - F.col("_rc")) <= F.abs("_rc") * F.lit("2.5").cast("decimal(2,1)") + 10000), F.lit(True))
    known = F.col("_ca").isNotNull() | F.col("_rc").isNotNull()
    rows = rows.withColumn("_fits", fits).withColumn("_some", F.coalesce(F.max(own & F.col("_fits")).over(every), F.lit(False))).where(~own | F.col("_fits") | (~F.col("_some") & ~known))
    named = F.contains(label, F.lit("resultat d exploitation")) | F.contains(label, F.lit("resultat dexploitation"))
    sixth = label.rlike(r"\bvi\b") | F.contains("raw_label", F.lit("+/-"))
    rows = rows.withColumn("_rank", F.when(named, 1).when(sixth, 2).otherwise(3)).withColumn("_best", least(F.lit(True), F.col("_rank"))).where(~own | (F.col("_rank") == F.col("_best")))
    rows = rows.withColumn("_page", least(F.lit(True), F.col("page_number"))).where(~own | (F.col("_best") != 1) | (F.col("page_number") == F.col("_page")))
    rows = rows.withColumn("_gap", F.abs(F.col("_amount") - F.col("_rc"))).withColumn("_least", least(F.lit(True), F.col("_gap")))
    near = F.col("_least").isNull() | (F.col("_least") > F.abs("_rc") * F.lit("1.5").cast("decimal(2,1)") + 5000) | (F.col("_gap") <= F.col("_least") + 1)
    return rows.where(~own | near).drop(*(c for c in rows.columns if c.startswith("_")))


def resolved_fields(candidates: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``doc_id`` and one struct column a field, from `candidates.prepared` rows, before any derivation.

    ``documents``: all documents that get a row, those of the candidates if not
    given. The rows are read once: a field's pick needs its document's rows
    together, and they already are.
    """
    rows = ranked(preferred(operating_result_rows(candidates)))
    line = F.contains("label", F.lit("resultat net")) & (F.col("period") == "N") & (F.col("key") == "RESULTAT_NET")
    # Net results of the balance sheet and of the income statement are kept apart; each is its best row alone.
    source = F.when(line & (F.col("section") == "CPC") & (F.col("column_role") == "TOTAL_EXERCICE_N"), "NET_CPC").when(line & (F.col("section") == "BILAN_PASSIF"), "NET_BILAN").when(F.col("key") != "RESULTAT_NET", F.col("key"))
    chosen = picked(rows.withColumn("source", source).where("source is not null"), "doc_id", "source")
    names = [*(c for c in FIELDS if c not in R.NET_RESULT), *R.NET_RESULT[1:], "NET_CPC", "NET_BILAN"]
    f = F.when(F.col("source").isin(*R.NET_RESULT, "NET_CPC", "NET_BILAN"), F.col("best")).otherwise(F.struct(*F_NAMES).cast(FV))
    wide = chosen.withColumn("f", f).groupBy("doc_id").agg(*(F.max_by("f", F.when(F.col("source") == c, 1)).alias(c) for c in names))
    wide = (candidates if documents is None else documents).select("doc_id").distinct().join(wide, "doc_id", "left")
    return balance_total(net_result(wide))


def net_result(wide: DataFrame) -> DataFrame:
    """The net result from the two lines of the income statement, its summary line and the balance sheet, by agreement and precedence."""
    a, b, c, d = (F.col(x) for x in ("RESULTAT_NET_XIII", "RESULTAT_NET_XVI", "NET_CPC", "NET_BILAN"))
    two = a.isNotNull() & b.isNotNull()
    agreed, both = resting(a["value"], "confirmed", a, b), c.isNotNull() & d.isNotNull()
    out = (
        F.when(two & amounts_agree(a["value"], b["value"]), F.when(d.isNotNull() & ~amounts_agree(a["value"], d["value"]), warned(agreed, "balance_sheet_differs")).otherwise(agreed))
        .when(two & d.isNotNull(), warned(d, "income_statement_lines_differ")).when(two, without_value("conflicting", a, b, warning="income_statement_lines_differ"))
        .when(both & ~amounts_agree(c["value"], d["value"]), warned(d, "income_statement_differs")).when(both, resting(c["value"], "confirmed", c, d)).otherwise(F.coalesce(c, d))
    )
    return wide.withColumn("RESULTAT_NET", out)


def section_total(wide_row: list[Column]) -> Column:
    """A sum whose parts must all be usable."""
    total = reduce(lambda a, b: a + b, [x["value"] for x in wide_row])
    return F.when(reduce(lambda a, b: a & b, map(usable, wide_row)), resting(total, "derived", *wide_row))


def balance_total(wide: DataFrame) -> DataFrame:
    """Total assets (else the sum of its sections) against total liabilities."""
    parts = section_total([F.col(c) for c in SECTION_PARTS])
    wide = wide.withColumn("TOTAL_ACTIF", F.when(usable(F.col("TOTAL_ACTIF")), F.col("TOTAL_ACTIF")).otherwise(F.coalesce(parts, "TOTAL_ACTIF")))
    return wide.withColumn("TOTAL_BILAN", reconciled(F.col("TOTAL_ACTIF"), F.col("TOTAL_PASSIF")))


def reconciled(a: Column, b: Column) -> Column:
    """Two views of one total: confirmed if they agree, conflicting if not, derived from one alone, else missing."""
    both = usable(a) & usable(b)
    agree = both & (F.abs(a["value"] - b["value"]) <= tolerance(a["value"]))
    return F.when(agree, resting(a["value"], "confirmed", a, b)).when(both, without_value("conflicting", a, b, warning="totals_differ")).when(usable(a), resting(a["value"], "derived", a)).when(usable(b), resting(b["value"], "derived", b)).otherwise(without_value("missing"))


def provenance(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """``doc_id, code, place, seq, field_code, page_number, raw_label, raw_value, column_role, confidence``: the candidates that each value (``doc_id, code, sources``) rests on, in order."""
    asked = values.select("doc_id", "code", F.posexplode("sources").alias("place", "seq"))
    shown = candidates.select("doc_id", F.col("seq").cast("int").alias("seq"), "field_code", "page_number", "raw_label", "raw_value", "column_role", "confidence")
    return asked.join(shown, ["doc_id", "seq"]).select("doc_id", "code", "place", "seq", *shown.columns[2:])


def originals(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """``asked`` (``doc_id, field_code, raw_label, raw_value``) with ``origin``, the ``seq`` of the candidate that it was: by code, label and value the last row; else by label and value the first.

    Labels and values are compared as they normalise, and the two lines of the net result under its one code; null counts as empty.
    """
    keys = ["doc_id", "_label", "_value"]
    folded = {"_label": normalize_label(F.col("raw_label")), "_value": normalize_label(F.col("raw_value"))}
    rows = with_computed(candidates, folded).select("doc_id", F.col("field_code").alias("_code"), "seq", *folded)
    exact = rows.groupBy("_code", *keys).agg(F.max("seq").alias("_exact"))
    wide = rows.groupBy(*keys).agg(F.min("seq").alias("_wide"))
    code = F.when(F.col("field_code").isin("RESULTAT_NET_XIII", "RESULTAT_NET_XVI"), "RESULTAT_NET").otherwise(F.col("field_code"))
    found = with_computed(asked, folded | {"_code": code}).join(exact, ["_code", *keys], "left").join(wide, keys, "left")
    return found.withColumn("origin", F.coalesce("_exact", "_wide")).drop("_exact", "_wide", "_code", "_label", "_value")
