"""Candidate facts: coercion, repair, deduplication, conversion to sections, periods and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.amounts import parse_decimal_amount
from finquery.functions.columns import with_computed
from finquery.functions.text import contains_any, fold_ascii, is_ascii, misread, normalize_label, normalize_ocr_label, without_thought_mark


def mapped(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A value's entry in a fixed table, else the default, else the value itself."""
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[value]
    return F.coalesce(found, value if default is None else default)


def upper_name(value: Column) -> Column:
    return F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit("_"))


def coerce_code(value: Column) -> Column:
    return mapped(F.upper(F.trim(value)), R.CODE_ALIASES)


def coerce_period(value: Column) -> Column:
    return mapped(F.coalesce(upper_name(value), F.lit("N")), R.PERIOD_ALIASES, F.lit("N"))


def coerce_role(value: Column) -> Column:
    role = mapped(F.coalesce(upper_name(value), F.lit("UNKNOWN")), R.ROLE_ALIASES)
    return F.when(role.isin(R.ROLES), role).otherwise("UNKNOWN")


def coerce_nature(value: Column) -> Column:
    nature = F.upper(F.trim(value))
    return F.when(nature.isin(R.NATURES), nature).otherwise("DETAIL")


def coerce_confidence(value: Column) -> Column:
    """Absent and zero both mean the usual confidence."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, 0.7).otherwise(value)


def allowed_only(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates whose (page_type, field_code) the allow-list holds; page types that it does not name pass."""
    named = allowed.select("page_type").distinct()
    listed = candidates.join(allowed, ["page_type", "field_code"], "left_semi")
    return listed.unionByName(candidates.join(named, "page_type", "left_anti"))


def split_valid(candidates: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the rules of a batch, and the rest (quarantine)."""
    ok = F.coalesce(valid, F.lit(False))
    return candidates.where(ok), candidates.where(~ok)


def first_wins(rows: DataFrame, keys: list[Column], *order: str) -> DataFrame:
    """The first row of each key in the given order. Rows are reduced before they are shuffled, so a key may hold any number of them."""
    return rows.groupBy(*(k.alias(f"_k{n}") for n, k in enumerate(keys))).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """The first of the rows that agree in document, code, period, label and value once marks (and so signs) are gone."""
    label = normalize_label(F.col("raw_label"))
    if "_text" in candidates.columns:  # with misreadings put right, where there are any
        label = F.when(misread(F.col("raw_label")), label).otherwise(F.col("_text"))
    return first_wins(candidates, [F.col("doc_id"), F.col("field_code"), F.col("period"), label, normalize_label(F.col("raw_value"))], "seq")


def capped(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates within the number that an answer for their page may hold, by page and order, and the rest (quarantine)."""
    most = F.create_map(*(F.lit(x) for kv in R.MOST_ROWS.items() for x in kv))[F.col("page_type")]
    numbered = candidates.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "page_number", "page_type").orderBy("seq")))
    within = F.coalesce(F.col("_k") <= most, F.lit(True))
    return numbered.where(within).drop("_k"), numbered.where(~within).drop("_k")


def is_amount(folded: Column, value: Column) -> Column:
    """Of a normalised label."""
    number = r"^[\s.]*-?[0-9]{1,3}(?:[.\s][0-9]{3})*(?:[,.][0-9]{1,2})?\s*$"
    # Of a value without letters, as most are, no letter comes; it need not be normalised then.
    same = F.when(value.rlike(r"^[0-9 .,()+-]*$") & folded.rlike("[a-z]"), F.lit(False)).otherwise(folded == normalize_ocr_label(value))
    return (folded == "") | same | folded.rlike(number)


def remapped_code(code: Column, text: Column) -> Column:
    """Codes that the folded label contradicts."""
    has = lambda w: F.contains(text, F.lit(w))
    return (
        F.when((code == "CHIFFRE_AFFAIRES") & has("achat") & ~has("affaires") & has("revendu"), "ACHATS_REVENDUS")
        .when((code == "CHIFFRE_AFFAIRES") & has("achat") & ~has("affaires") & has("consom"), "ACHATS_CONSOMMES")
        .when((code == "ACHATS_REVENDUS") & has("achat") & ~has("revendu") & ~has("consom"), "UNKNOWN")
        .when((code == "RESULTAT_NET") & has("resultat courant"), "RESULTAT_COURANT").otherwise(code)
    )


def noted(condition: Column, warning: Column) -> Column:
    return F.when(condition, F.array(warning)).otherwise(F.array().cast("array<string>"))


def repair(candidates: DataFrame) -> DataFrame:
    """Codes, roles, labels and natures put right from what the row itself says; every change leaves a warning, in order."""
    return repaired(candidates).drop("_text")


def repaired(candidates: DataFrame) -> DataFrame:
    """`repair` with ``_text``, the normalised label."""
    was = F.col("field_code")
    # A label is normalised once, and again only where it is changed. Of ASCII letters, digits and single spaces nothing folds.
    read = with_computed(candidates.withColumn("_was", F.col("raw_label")), {"_norm": normalize_ocr_label(F.col("raw_label"))})
    norm = F.col("_norm")
    rows = with_computed(read, {"_text": F.when(is_ascii(norm) & ~F.contains(norm, F.lit("_")), norm).otherwise(fold_ascii(norm)), "_shaped": is_amount(norm, F.col("raw_value"))})
    rows = rows.withColumn("_code", remapped_code(was, F.col("_text"))).withColumn("warnings", F.concat("warnings", noted(F.col("_code") != was, F.concat(F.lit("code "), was, F.lit(" -> "), "_code")))).withColumn("field_code", F.col("_code"))

    role = F.coalesce("column_role", F.lit("UNKNOWN"))
    usual = F.when(F.col("period") == "N_MINUS_1", F.lit("EXERCICE_N1")).otherwise(mapped(F.col("page_type"), R.DEFAULT_ROLE, F.lit(None).cast("string")))
    vague = role.isin("UNKNOWN", "MONTANT_N", "IDENTITY_VALUE", "") & usual.isNotNull()
    rows = rows.withColumn("_role", F.when(vague, usual).otherwise(role)).withColumn("warnings", F.concat("warnings", noted(F.col("_role") != role, F.concat(F.lit("role -> "), "_role")))).withColumn("column_role", F.col("_role"))

    shaped = F.col("_shaped")
    bare_zero = F.when(shaped & F.col("field_code").isin("CHARGES_FINANCIERES", "CHARGES_INTERETS", "FRAIS_FINANCIERS"), F.coalesce(parse_decimal_amount(F.col("raw_value")) == 0, F.lit(False))).otherwise(F.lit(False))
    usual_label = mapped(F.col("field_code"), R.CANONICAL_LABEL, F.lit(None).cast("string"))
    rows = rows.withColumn("_label", F.when(shaped & ~bare_zero, F.coalesce(usual_label, "raw_label")).otherwise(F.col("raw_label")))
    rows = rows.withColumn("warnings", F.concat("warnings", noted(shaped & ~bare_zero & usual_label.isNotNull(), F.lit("label restored")))).withColumn("raw_label", F.substring("_label", 1, 180))

    rows, text = with_computed(rows, {"_text": F.when(F.col("raw_label").eqNullSafe(F.col("_was")), norm).otherwise(normalize_ocr_label(F.col("raw_label")))}), F.col("_text")
    part = text.rlike(r"\btotal\s+(i|ii|iii)\b") & ~text.rlike(R.TOTAL_GENERAL)
    grand = F.col("field_code").isin("TOTAL_ACTIF", "TOTAL_PASSIF") & ~part
    section = F.col("field_code").isin(R.SECTION_TOTAL_CODES) & (F.col("nature") == "DETAIL")
    rows = rows.withColumn("_nature", F.when(grand, "GRAND_TOTAL").when(section, "SECTION_TOTAL").otherwise(F.col("nature"))).withColumn("warnings", F.concat("warnings", noted(F.col("_nature") != F.col("nature"), F.concat(F.lit("nature -> "), "_nature")))).withColumn("nature", F.col("_nature"))
    empty = F.trim(F.coalesce("source_excerpt", F.lit(""))).isin("", "ligne|montant")
    return rows.withColumn("source_excerpt", F.substring(F.when(empty, F.concat_ws("|", "raw_label", "raw_value")).otherwise(F.col("source_excerpt")), 1, 240)).drop("_code", "_role", "_label", "_nature", "_shaped", "_norm", "_was")


def to_section(candidates: DataFrame) -> DataFrame:
    """Rows of pages that resolve, with ``section``, a role of the narrower set and the year's key codes."""
    page, code = F.col("page_type"), F.col("field_code")
    kept = candidates.where(~page.isin("AUTRE", "VIDE") & ((page != "ESG") | code.isin(R.KEPT_FROM_ESG)))
    role = F.col("column_role")
    return kept.withColumns({
        "section": F.when(page == "ESG", "CPC").when(page.isin("IDENTIFICATION", *R.SECTION_CODES), page).otherwise("AUTRE"),
        "field_code": F.when(code.isin("RESULTAT_COMPTABLE", "RESULTAT_NET_ESG"), "RESULTAT_NET").when(code.isin("TOTAL_ACTIF", "TOTAL_PASSIF") & (F.col("period") == "N_MINUS_1"), "TOTAL_BILAN").otherwise(code),
        "column_role": F.when(role.isin("MONTANT_N", "IDENTITY_VALUE"), "EXERCICE_N").when(role == "MONTANT_N1", "EXERCICE_N1").otherwise(role),
    })


def role_from_heading(candidates: DataFrame) -> DataFrame:
    """Roles that the column's heading states, by section. The first rule that fits decides."""
    candidates = with_computed(candidates, {"_heading": normalize_ocr_label(F.col("column_name"))})
    name, section = F.col("_heading"), F.col("section")
    has = lambda w: F.contains(name, F.lit(w))
    role = (
        F.when((section == "CPC") & contains_any(name, R.CURRENT_TOTAL_HEADINGS), "TOTAL_EXERCICE_N").when((section == "CPC") & (has("exercice precedent") | (name == "4")), "EXERCICE_N1")
        .when((section == "BILAN_ACTIF") & has("net") & ~has("precedent"), "NET_N").when((section == "BILAN_ACTIF") & has("precedent"), "EXERCICE_N1").when((section == "BILAN_ACTIF") & has("brut"), "BRUT")
        .when(section.isin("BILAN_PASSIF", "DETAIL_CPC") & has("precedent"), "EXERCICE_N1").when(section.isin("BILAN_PASSIF", "DETAIL_CPC") & has("exercice"), "EXERCICE_N")
        .when((section == "DETAIL_CPC") & (has("totaux") | has("3 1 2")), "EXERCICE_N")
    )
    return candidates.withColumn("column_role", F.coalesce(role, "column_role")).drop("_heading")


def period_from_role(candidates: DataFrame) -> DataFrame:
    role = F.col("column_role")
    return candidates.withColumn("period", F.when(role == "EXERCICE_N1", "N_MINUS_1").when(role.isin("NET_N", "EXERCICE_N", "TOTAL_EXERCICE_N"), "N").otherwise(F.col("period")))


def keyed(candidates: DataFrame) -> DataFrame:
    """``label``, normalised, and ``key``: the code, for the previous year its own name, and net results of the income statement by their line."""
    known = "_text" in candidates.columns
    candidates = candidates.drop("label").withColumnRenamed("_text", "label") if known else with_computed(candidates, {"label": normalize_ocr_label(F.col("raw_label"))})
    code, label = F.col("field_code"), F.col("label")
    net = (code == "RESULTAT_NET") & (F.col("period") == "N") & (F.col("section") == "CPC")
    key = F.when(F.col("period") == "N_MINUS_1", mapped(code, R.PREVIOUS_YEAR_KEY)).when(net & F.contains(label, F.lit("xiii")), "RESULTAT_NET_XIII").when(net & F.contains(label, F.lit("xvi")), "RESULTAT_NET_XVI").otherwise(code)
    return candidates.where(code != "UNKNOWN").withColumn("key", key)


def prepared(candidates: DataFrame) -> DataFrame:
    """From raw candidates to rows that can be ranked.

    One shuffle by document, which duplicates, picks and fields then share; a
    document's rows are few, as its pages and the rows of a page are.
    """
    clean = candidates.repartition("doc_id").withColumns({c: without_thought_mark(F.col(c)) for c in ("raw_value", "raw_label", "source_excerpt")})
    return keyed(period_from_role(role_from_heading(to_section(dedupe_candidates(repaired(clean))))))
