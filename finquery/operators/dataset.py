"""A document's dataset: resolved values under fixed attributes, and its warnings from all grains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.operators.resolve import FIELDS, FV, fv, resting, usable

ATTRIBUTES = [*R.DATASET_ATTRIBUTES, *R.OPTIONAL_ATTRIBUTES]


def attribute_of(code: Column) -> Column:
    """The attribute that a code writes; null where it writes none."""
    other = F.create_map(*(F.lit(x) for pair in R.ATTRIBUTE_OF.items() for x in pair))
    name = F.coalesce(other[code], F.when(code.isin("ACHATS", "FRAIS_FINANCIERS", "AMORTISSEMENTS", "TRESORERIE_NETTE"), None).otherwise(F.lower(code)))
    return F.when(name.isin(ATTRIBUTES), name)


def long_form(wide: DataFrame) -> DataFrame:
    """``doc_id, code, place, f``: the fields of wide rows that have a value struct, in the order in which they are resolved.

    Beyond the codes of `refdata.RESOLVED_FIRST` a code's place is that of the
    first candidate it rests on; what derivations add comes last.
    """
    first = {c: k for k, c in enumerate(R.RESOLVED_FIRST)}
    seq = lambda c: F.coalesce(F.array_min(F.col(c)["sources"]), F.lit(0))
    place = lambda c: F.lit(first[c]) if c in first else F.when(F.col(c)["status"] == "derived", F.lit(1 << 30)).otherwise(len(first) + seq(c))
    cells = F.array(*(F.struct(F.lit(c).alias("code"), place(c).cast("int").alias("place"), F.col(c).cast(FV).alias("f")) for c in FIELDS if c in wide.columns))
    return wide.select("doc_id", F.inline(cells)).where("f is not null")


def dataset(values: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each of ``documents`` with a value struct for every attribute and ``warnings``, from `long_form` rows.

    Of the codes of an attribute the last in order writes it (of equal places
    the last by name). The 35 attributes that always stand are missing where no
    code writes them; the optional ones are null then. Net cash, working capital
    and the simplified cash flow are derived where they are missing and their
    parts can be used. One shuffle by document.
    """
    rows = values.withColumn("attribute", attribute_of(F.col("code")))
    order = F.struct("place", "code")
    written = [F.max_by("f", F.when(F.col("attribute") == a, order)).alias(a) for a in ATTRIBUTES]
    told = F.when(F.col("attribute").isNotNull(), F.struct("place", "code", F.concat(F.when(F.col("f.status") == "conflicting", F.array(F.concat("code", F.lit(" conflicting.")))).otherwise(F.array().cast("array<string>")), F.coalesce("f.warnings", F.array().cast("array<string>"))).alias("told")))
    grouped = rows.groupBy("doc_id").agg(*written, F.array_sort(F.collect_list(told)).alias("_told"))
    wide = documents.select("doc_id").distinct().join(grouped, "doc_id", "left")
    missing = fv(F.lit(None), "missing")
    wide = wide.withColumns({a: F.coalesce(a, missing) for a in R.DATASET_ATTRIBUTES} | {"warnings": F.coalesce(F.flatten(F.transform("_told", lambda x: x["told"])), F.array().cast("array<string>"))}).drop("_told")

    def derive(name: str, parts: list[str], value: Column) -> Column:
        ready = reduce(lambda a, b: a & b, (usable(F.col(p)) for p in parts))
        return F.when((F.col(name)["status"] == "missing") & ready, resting(value, "derived", *(F.col(p) for p in parts), warning=f"derived from {', '.join(parts)}")).otherwise(F.col(name))

    v = lambda c: F.col(c)["value"]
    return wide.withColumns({
        "tresorerie_nette": derive("tresorerie_nette", ["tresorerie_actif", "tresorerie_passif"], v("tresorerie_actif") - v("tresorerie_passif")),
        "fdr": derive("fdr", ["actif_circulant", "tresorerie_actif", "passif_circulant", "tresorerie_passif"], v("actif_circulant") + v("tresorerie_actif") - v("passif_circulant") - v("tresorerie_passif")),
        "caf": derive("caf", ["resultat_net", "amortissements"], v("resultat_net") + v("amortissements")),
    })


def attributes(wide: DataFrame) -> DataFrame:
    """``doc_id, attribute, value, status`` of dataset rows, one row an attribute; optional ones where they stand."""
    cells = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a)["value"].alias("value"), F.col(a)["status"].alias("status"), F.col(a).isNotNull().alias("stands")) for a in ATTRIBUTES))
    return wide.select("doc_id", F.inline(cells)).where("stands").drop("stands")


def document_warnings(documents: DataFrame, pages: DataFrame | None = None, recovered: DataFrame | None = None, fields: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """``doc_id, warnings`` for every document: those of its pages, what was recovered, those of its fields, its failed controls; each in its own order.

    ``pages``: `pages.page_counters` rows; ``recovered``: ``doc_id, n_recovered``;
    ``fields``: `dataset` rows; ``controls``: ``doc_id, controls``. Each has one row a document at most.
    """
    none = F.array().cast("array<string>")
    failed = F.transform(F.filter("controls", lambda c: c["status"] == "failed"), lambda c: F.concat(F.lit("control failed: "), c["code"]))
    parts = [
        (pages, F.col("warnings")), (recovered, F.when(F.col("n_recovered") > 0, F.array(F.concat(F.lit("recovered from native text: +"), F.col("n_recovered"))))), (fields, F.col("warnings")), (controls, failed),
    ]
    rows, names = documents.select("doc_id").distinct(), []
    for k, (given, told) in enumerate(parts):
        if given is not None:
            names.append(f"_w{k}")
            rows = rows.join(given.select("doc_id", told.alias(names[-1])), "doc_id", "left")
    return rows.select("doc_id", F.concat(none, *(F.coalesce(n, none) for n in names)).alias("warnings"))
