"""Candidate rows made from order lines, by the same rule in both dialects: integers, fixed lists and text only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: code, page type, role for the current year, label. Fixed values.
CODES = [
    ("TOTAL_ACTIF", "BILAN_ACTIF", "NET_N", "Total général I+II+III"), ("ACTIFS_IMMOBILISES", "BILAN_ACTIF", "NET_N", "Total I"), ("ACTIF_CIRCULANT", "BILAN_ACTIF", "NET_N", "Total II"), ("TRESORERIE_ACTIF", "BILAN_ACTIF", "NET_N", "Total trésorerie-actif"),
    ("CLIENTS", "BILAN_ACTIF", "NET_N", "Clients et comptes rattachés"), ("TOTAL_PASSIF", "BILAN_PASSIF", "EXERCICE_N", "Total I+II+III"), ("FONDS_PROPRES", "BILAN_PASSIF", "EXERCICE_N", "Total des capitaux propres"), ("TRESORERIE_PASSIF", "BILAN_PASSIF", "EXERCICE_N", "Total III trésorerie-passif"),
    ("CHIFFRE_AFFAIRES", "CPC", "TOTAL_EXERCICE_N", "Chiffre d'affaires"), ("RESULTAT_NET", "CPC", "TOTAL_EXERCICE_N", "Résultat net"), ("PRODUITS_FINANCIERS", "CPC", "TOTAL_EXERCICE_N", "Produits financiers"), ("CHARGES_FINANCIERES", "CPC", "TOTAL_EXERCICE_N", "Charges financières"),
]
NATURES = ["DETAIL", "SUBTOTAL", "SECTION_TOTAL", "GRAND_TOTAL"]
WRONG_LABEL = "Variation de stocks"
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def choice(index: str, values: list[str]) -> str:
    text = [v.replace("'", "''") for v in values]
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(text)) + " END"


def grouped(whole: str) -> tuple[str, str]:
    """An integer with spaces, and with dots, between thousands (below one million)."""
    head, tail = f"concat('', CAST(floor({whole} / 1000) AS BIGINT))", f"lpad(concat('', {whole} % 1000), 3, '0')"
    return tuple(f"CASE WHEN {whole} < 1000 THEN concat('', {whole}) ELSE concat({head}, '{mark}', {tail}) END" for mark in (" ", "."))


def written(cents: str, form: str) -> str:
    """A number of cents in one of six forms; forms 3 and 4 are negative."""
    whole, rest = f"CAST(floor({cents} / 100) AS BIGINT)", f"lpad(concat('', {cents} % 100), 2, '0')"
    space, dot = grouped(whole)
    plain = f"concat({space}, ',', {rest})"
    return f"CASE {form} WHEN 0 THEN {plain} WHEN 1 THEN concat({dot}, ',', {rest}) WHEN 2 THEN concat('', {whole}, ',', {rest}) WHEN 3 THEN concat({plain}, '-') WHEN 4 THEN concat('(', {plain}, ')') ELSE concat({plain}, ' MAD') END"


def candidates_sql(lineitem: str, doc: str, seq: str = "") -> str:
    """Candidates with ``doc`` (a column of the lines) as document; ``seq``: the column that numbers its lines, if they have one."""
    seq = seq or f"row_number() OVER (PARTITION BY {doc} ORDER BY {ORDER})"
    code = "l_partkey % 12"
    cents, form = "CAST(round(l_extendedprice * 100) AS BIGINT)", "(l_orderkey + l_linenumber) % 6"
    pick = lambda k: choice(code, [c[k] for c in CODES])
    current = "l_linestatus = 'O'"
    return f"""
        SELECT {doc} AS doc_id, CAST({seq} AS INT) AS seq, {pick(0)} AS field_code, {written(cents, form)} AS raw_value,
            CASE WHEN {current} THEN 'N' ELSE 'N_MINUS_1' END AS period, {choice("l_linenumber % 4", NATURES)} AS nature, CAST(60 + 5 * l_linenumber AS DOUBLE) / 100 AS confidence, CAST(1 + l_linenumber AS INT) AS page_number, {pick(1)} AS page_type,
            CASE WHEN l_partkey % 11 = 0 THEN '{WRONG_LABEL}' ELSE {pick(3)} END AS raw_label, CASE WHEN l_orderkey % 10 = 0 THEN 'UNKNOWN' WHEN {current} THEN {pick(2)} ELSE 'EXERCICE_N1' END AS column_role,
            CASE WHEN {form} IN (3, 4) THEN -{cents} ELSE {cents} END AS cents
        FROM {lineitem}"""


def candidates(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Sparse: a document is an order; dense: a supplier."""
    doc = "l_suppkey" if dense else "l_orderkey"
    # Lines are numbered first: beside a window Spark makes all columns before it, and would shuffle and sort their texts.
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("_seq", F.expr(f"row_number() OVER (PARTITION BY {doc} ORDER BY {ORDER})"))
    made = spark.sql(candidates_sql("{lineitem}", doc, "_seq"), lineitem=lines)
    return made.withColumns({"column_name": F.lit(None).cast("string"), "source_excerpt": F.lit(""), "warnings": F.array().cast("array<string>")})
