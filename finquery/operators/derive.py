"""Derived fields, controls and invalidation, on one wide row a document. The order of the steps is part of the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.amounts import amounts_agree, tolerance
from finquery.functions.columns import with_computed
from finquery.operators.resolve import FIELDS, resting, usable, without_value


def computed(a: Column, sign: str, b: Column) -> Column:
    """A derived field from two usable ones, else null."""
    value = a["value"] + b["value"] if sign == "+" else a["value"] - b["value"]
    return F.when(usable(a) & usable(b), resting(value, "derived", a, b))


def prefer_computed(field: Column, value: Column) -> Column:
    """The computed field where the read one is absent, or usable but in disagreement; what was read stays among its sources then."""
    absent = field.isNull() | field["value"].isNull() | (field["status"] == "missing")
    clash = usable(field) & ~amounts_agree(field["value"], value["value"])
    return F.when(value.isNotNull() & absent, value).when(value.isNotNull() & F.coalesce(clash, F.lit(False)), resting(value["value"], "derived", field, value, warning="contradicts_computed")).otherwise(field)


def fill_missing(field: Column, value: Column) -> Column:
    return F.when(field.isNull() | (field["status"] == "missing") | field["value"].isNull(), F.coalesce(value, field)).otherwise(field)


def derived(wide: DataFrame) -> DataFrame:
    """Accounting derivations, each over what the ones before it left."""
    c = F.col
    steps = [
        ("ACHATS_TOTAL", lambda: F.coalesce(computed(c("ACHATS_REVENDUS"), "+", c("ACHATS_CONSOMMES")), c("ACHATS_TOTAL"))),
        ("RESULTAT_FINANCIER", lambda: prefer_computed(c("RESULTAT_FINANCIER"), computed(c("PRODUITS_FINANCIERS"), "-", c("CHARGES_FINANCIERES")))),
        ("RESULTAT_NON_COURANT", lambda: prefer_computed(c("RESULTAT_NON_COURANT"), computed(c("PRODUITS_NON_COURANTS"), "-", c("CHARGES_NON_COURANTES")))),
        ("RESULTAT_AVANT_IMPOT", lambda: prefer_computed(c("RESULTAT_AVANT_IMPOT"), computed(c("RESULTAT_COURANT"), "+", c("RESULTAT_NON_COURANT")))),
        ("RESULTAT_NET", lambda: F.coalesce(c("RESULTAT_NET"), computed(c("RESULTAT_AVANT_IMPOT"), "-", c("IMPOT_SUR_RESULTATS")))),
        ("TRESORERIE_NETTE", lambda: F.coalesce(c("TRESORERIE_NETTE"), computed(c("TRESORERIE_ACTIF"), "-", c("TRESORERIE_PASSIF")))),
        ("_mlt", lambda: F.when(usable(c("DETTES_FINANCIERES")) & ~usable(c("DETTES_BANCAIRES_MLT")), resting(c("DETTES_FINANCIERES")["value"], "derived", c("DETTES_FINANCIERES"))).otherwise(c("DETTES_BANCAIRES_MLT"))),
        ("DETTES_FINANCIERES", lambda: F.when(usable(c("DETTES_BANCAIRES_MLT")) & ~usable(c("DETTES_FINANCIERES")), c("DETTES_BANCAIRES_MLT")).otherwise(c("DETTES_FINANCIERES"))),
        ("DETTES_BANCAIRES_MLT", lambda: c("_mlt")),
        ("AUTRES_CHARGES_EXTERNES", lambda: F.when(usable(c("AUTRES_CHARGES_EXTERNES_DETAIL")) & ~usable(c("AUTRES_CHARGES_EXTERNES")), resting(c("AUTRES_CHARGES_EXTERNES_DETAIL")["value"], "derived", c("AUTRES_CHARGES_EXTERNES_DETAIL"))).otherwise(c("AUTRES_CHARGES_EXTERNES"))),
        ("FDR", lambda: fill_missing(c("FDR"), working_capital())),
        ("CAF", lambda: fill_missing(c("CAF"), computed(c("RESULTAT_NET"), "+", c("DOTATIONS_AMORTISSEMENTS")))),
        ("FDR", lambda: fill_missing(c("FDR"), permanent_capital())),
        ("BFDR", lambda: fill_missing(c("BFDR"), computed(c("FDR"), "-", c("TRESORERIE_NETTE")))),
    ]
    for name, step in steps:
        wide = wide.withColumn(name, step())
    return wide.drop("_mlt")


def working_capital() -> Column:
    """Current assets and cash less current liabilities and overdrafts."""
    parts = [F.col(x) for x in ("ACTIF_CIRCULANT", "TRESORERIE_ACTIF", "PASSIF_CIRCULANT", "TRESORERIE_PASSIF")]
    v = [p["value"] for p in parts]
    return F.when(reduce(lambda a, b: a & b, map(usable, parts)), resting((v[0] + v[1]) - (v[2] + v[3]), "derived", *parts))


def permanent_capital() -> Column:
    """Equity and, where known, financial debt, less fixed assets."""
    own, debt, fixed = (F.col(x) for x in ("FONDS_PROPRES", "DETTES_FINANCIERES", "ACTIFS_IMMOBILISES"))
    value = own["value"] + F.when(usable(debt), debt["value"]).otherwise(F.lit(0)) - fixed["value"]
    return F.when(usable(own) & usable(fixed), resting(value, "derived", own, fixed))


CONTROL = "struct<code:string,status:string,expected:decimal(24,4),observed:decimal(24,4),difference:decimal(24,4),tolerance:decimal(24,4),fields:array<string>>"


def control(code: str, expected: Column, observed: Column, fields: list[str]) -> Column:
    """Passed or failed within the tolerance of what is expected; not testable if a side is absent."""
    gap = observed - expected
    status = F.when(gap.isNull(), "not_testable").when(F.abs(gap) <= tolerance(expected), "passed").otherwise("failed")
    return F.struct(F.lit(code), status, expected, observed, gap, F.when(gap.isNotNull(), tolerance(expected)), F.array(*map(F.lit, fields))).cast(CONTROL)


def controls(wide: DataFrame) -> DataFrame:
    """Adds ``controls``: those whose inputs are all usable, and the balance always."""
    made = []
    for code, terms, observed in R.CONTROLS:
        inputs = [F.col(t) for t in (*terms[::2], observed)]
        v = [F.when(usable(x), x["value"]) for x in inputs]
        expected = v[0] if len(terms) == 1 else v[0] + v[1] if terms[1] == "+" else v[0] - v[1]
        fields = [*terms[::2], observed] + (["TOTAL_BILAN"] if code == "bilan_equilibre" else [])
        ready = reduce(lambda a, b: a & b, map(usable, inputs))
        if code == "bilan_equilibre":
            made.append(F.when(ready, control(code, expected, v[-1], fields)).otherwise(control(code, F.lit(None).cast("decimal(24,4)"), F.lit(None).cast("decimal(24,4)"), ["TOTAL_BILAN"])))
        elif code == "tresorerie_nette":
            known = usable(inputs[0]) & usable(inputs[1])
            absent = inputs[2].isNull() | (inputs[2]["status"] == "missing")
            made.append(F.when(ready, control(code, expected, v[-1], fields)).when(known & absent, control(code, expected, F.lit(None).cast("decimal(24,4)"), fields[:2])))
        else:
            made.append(F.when(ready, control(code, expected, v[-1], fields)))
    return with_computed(wide, {"controls": F.array_compact(F.array(*made))})


def invalidated(wide: DataFrame) -> DataFrame:
    """Fields of failed controls lose their value and conflict; nothing that was derived from them falls with them."""
    failed = F.array_distinct(F.flatten(F.transform(F.filter("controls", lambda x: x["status"] == "failed"), lambda x: x["fields"])))
    wide = wide.withColumn("invalid", failed)
    return wide.withColumns({c: F.when(F.array_contains("invalid", c) & F.col(c)["status"].isin("confirmed", "derived"), without_value("conflicting", F.col(c), warning="control_failed")).otherwise(F.col(c)) for c in FIELDS})
