"""Labels are normalised once on their way, and short cuts give what the whole steps give."""

from __future__ import annotations

from pyspark.sql import functions as F

from finquery.functions.text import normalize_ocr_label, without_thought_mark
from finquery.operators.candidates import dedupe_candidates, is_amount, keyed, prepared, repaired
from finquery.plans.synthetic import candidates

TEXTS = [
    None, "", " ", "</think>", "total </THINK>", "a /think ", "a /tHink\t\n", "a </think>\x85", "a <think> ", "think", "a/think b", "thinK", "x </think> y </think>", "K", "a </thinK>", "Total général I+II+III", "dettees de  financement", "DETTEES", "immobliisations nettes", "solid es crediteurs",
    "a_b", "1 234,56", "(1.234,56)", "1 234,56 MAD", "12", "é 12", "½", "12-", "xii", "1\n", "...", "Ⅻ", "_", "a__b",
]


def test_short_cuts(spark):
    pairs = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "a string, b string")
    folded, number = normalize_ocr_label(F.col("a")), r"^[\s.]*-?[0-9]{1,3}(?:[.\s][0-9]{3})*(?:[,.][0-9]{1,2})?\s*$"
    plain = (folded == "") | (folded == normalize_ocr_label(F.col("b"))) | folded.rlike(number)
    mark = F.trim(F.regexp_replace(F.trim("a"), r"(?i)(?:</?think>|/think)\s*$", ""))
    got = pairs.select("a", "b", is_amount(folded, F.col("b")).alias("x"), plain.alias("y"), without_thought_mark(F.col("a")).alias("m"), mark.alias("n")).collect()
    assert [r for r in got if r["x"] != r["y"] or r["m"] != r["n"]] == []


def rows_of(spark, texts):
    rows = [(1, k, "CLIENTS", "1 000,00", "N", "DETAIL", 0.7, 1, "BILAN_ACTIF", t, "NET_N", None, "", []) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, seq int, field_code string, raw_value string, period string, nature string, confidence double, page_number int, page_type string, raw_label string, column_role string, column_name string, source_excerpt string, warnings array<string>")


def test_carried_labels_are_those_of_the_rows(spark):
    """Also where a label is put right, shortened or null; duplicates are told by the label as read."""
    rows = repaired(rows_of(spark, [*TEXTS, "été " * 100]))
    assert [r for r in rows.select("raw_label", "_text", normalize_ocr_label(F.col("raw_label")).alias("want")).collect() if r["_text"] != r["want"]] == []
    both = [{(r["seq"], r["raw_label"]) for r in dedupe_candidates(x).collect()} for x in (rows, rows.drop("_text"))]
    assert both[0] == both[1]
    assert len(dedupe_candidates(repaired(rows_of(spark, ["dettes", "dettees", "DETTES"]))).collect()) == 2
    labels = [{(r["seq"], r["label"]) for r in keyed(x.withColumn("section", F.col("page_type"))).collect()} for x in (rows, rows.drop("_text"))]
    assert labels[0] == labels[1]


def test_a_label_is_normalised_once(spark, sf_dir):
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        plan = prepared(candidates(spark, sf_dir, dense=True))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert 0 < plan.count(", immobilisations, 1)") <= 4  # labels, changed labels, values with letters, headings
