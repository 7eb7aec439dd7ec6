"""The whole way of a batch of documents: candidates to output fields, controls and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquery.operators.candidates import capped, prepared
from finquery.operators.derive import controls, derived, invalidated
from finquery.operators.pages import classified
from finquery.operators.project import completeness, output_fields
from finquery.operators.recover import united
from finquery.operators.resolve import resolved_fields
from finquery.shared import written


def resolved_documents(candidates: DataFrame) -> DataFrame:
    """One wide row a document: all fields, controls, invalid fields, outputs."""
    return output_fields(invalidated(controls(derived(resolved_fields(prepared(candidates), candidates)))))


def document_results(candidates: DataFrame) -> DataFrame:
    """``doc_id, outputs, controls, completeness``."""
    return resolved_documents(candidates).select("doc_id", "outputs", "controls", completeness(F.col("outputs")).alias("completeness"))


def results_from_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """`document_results` from pages (``doc_id, page_number, native_text``) and the candidates that were read from them, with ``n_recovered``.

    Pages get their types by the fold, candidates beyond an answer's bound go,
    and what the native text still shows is added. A document without any
    candidate, found or recovered, has no row. All candidates are written once:
    they are read three times, and beside the texts that they come from they are few.
    """
    typed = pages.join(classified(pages), ["doc_id", "page_number"])
    whole = written(united(capped(candidates)[0], typed), "candidates")
    counts = whole.groupBy("doc_id").agg(F.first("n_recovered").alias("n_recovered"))
    return document_results(whole.drop("n_recovered", "recovered")).join(counts, "doc_id")
