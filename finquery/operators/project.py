"""The fixed output fields of a document, with notes, categories and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.amounts import AMOUNT

OUT = f"struct<number:int,code:string,label:string,source:string,value:{AMOUNT},status:string,confidence:double,note:string>"
SHOWN = ("confirmed", "derived", "ambiguous")


def shown(field: Column) -> Column:
    return F.coalesce(field["status"].isin(*SHOWN) & field["value"].isNotNull(), F.lit(False))


def first_usable(fields: list[Column]) -> Column:
    """``value, status, confidence`` of the first field that can be shown; a conflicting or invalid one before it stops the search."""
    none = F.struct(F.lit(None).cast(AMOUNT).alias("value"), F.lit("missing").alias("status"), F.lit(0.0).alias("confidence"))
    out = none
    for f in reversed(fields):
        sure = F.when(F.coalesce(f["confidence"], F.lit(0.0)) > 0, f["confidence"]).when(f["status"] == "derived", 0.85).when(f["status"] == "confirmed", 0.9).otherwise(0.0)
        taken = F.struct(f["value"].alias("value"), f["status"].alias("status"), sure.alias("confidence"))
        stopped = F.struct(F.lit(None).cast(AMOUNT).alias("value"), f["status"].alias("status"), F.lit(0.0).alias("confidence"))
        out = F.when(shown(f), taken).when(f["status"].isin("conflicting", "invalid"), stopped).otherwise(out)
    return out


def result_type(value: Column) -> Column:
    return F.when(value > 0, "Bénéficiaire").when(value < 0, "Déficitaire").when(value == 0, "Nul")


def output_fields(wide: DataFrame) -> DataFrame:
    """``doc_id`` and ``outputs``: always twenty structs, in order."""
    made, net = [], first_usable([F.col("RESULTAT_NET")])
    for number, code, label, source, names in R.OUTPUTS:
        got = first_usable([F.col(n) for n in names]) if names else None
        note = F.lit(None).cast("string")
        if code == "DETTES_BANCAIRES_MLT":
            note = F.when(got["value"].isNotNull() & ~shown(F.col("DETTES_BANCAIRES_MLT")), "Alias dettes de financement (MLT)")
        if code == "CHARGES_INTERETS":
            note = F.when(got["value"].isNotNull() & ~shown(F.col("CHARGES_INTERETS")), "Proxy charges financières (TOTAL V)")
        if code == "TYPE_RESULTAT":
            note = result_type(net["value"])
            got = F.struct(F.lit(None).cast(AMOUNT).alias("value"), F.when(note.isNotNull(), "derived").otherwise("missing").alias("status"), F.when(note.isNotNull(), F.greatest(net["confidence"], F.lit(0.95))).otherwise(0.0).alias("confidence"))
        made.append(F.struct(F.lit(number), F.lit(code), F.lit(label), F.lit(source), got["value"], got["status"], got["confidence"], note).cast(OUT))
    return wide.withColumn("outputs", F.array(*made))


def found(outputs: Column) -> Column:
    """How many output fields have a value; the category counts by its note."""
    return F.size(F.filter(outputs, lambda x: F.when(x["code"] == "TYPE_RESULTAT", x["note"].isNotNull()).otherwise(x["value"].isNotNull() & x["status"].isin(*SHOWN))))


def completeness(outputs: Column) -> Column:
    return F.round(F.lit(100.0) * found(outputs) / len(R.OUTPUTS), 1)


def flat_map(outputs: Column) -> Column:
    """Code to value as text; the category's note stands for its value."""
    return F.map_from_entries(F.transform(outputs, lambda x: F.struct(x["code"], F.coalesce(x["value"].cast("string"), F.when(x["code"] == "TYPE_RESULTAT", x["note"])))))


def as_json(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.to_json(F.struct(*(c for c in df.columns))).alias("json"))
