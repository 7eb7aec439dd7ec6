"""Model answers and uploads as sources of candidate rows, and connectors behind an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finquery.operators.candidates import coerce_code, coerce_confidence, coerce_nature, coerce_period, coerce_role

ITEM = "struct<field_code:string,raw_value:string,value:string,period:string,nature:string,confidence:double,raw_label:string,label:string,column_name:string,column_role:string,source_excerpt:string,warnings:array<string>,evidence:struct<raw_label:string,column_name:string,column_role:string,source_excerpt:string>>"


def json_part(answer: Column) -> Column:
    """The JSON text in an answer: without code fences, and from the first brace to the last where other text surrounds it."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r"(?s)^```[^\n]*\n(.*?)\n?(?:```)?\s*$", "$1"))
    return F.when(bare.rlike(r"^[\{\[]"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def payload_items(answers: DataFrame, answer: str, *keys: str) -> DataFrame:
    """Candidate rows of JSON answers: an object with ``candidates``, a list, or one row; values that cannot be read give no rows.

    Nested evidence comes before the item's own fields; rows without a value or
    a code go; texts are cut at their column's length.
    """
    text = json_part(F.col(answer))
    items = F.when(F.startswith(text, F.lit("[")), F.from_json(text, f"array<{ITEM}>")).otherwise(
        F.coalesce(F.from_json(text, f"struct<candidates:array<{ITEM}>>")["candidates"], F.when(F.get_json_object(text, "$.field_code").isNotNull(), F.array(F.from_json(text, ITEM)))))
    rows = answers.select(*keys, F.posexplode(items).alias("seq", "i"))
    i = F.col("i")
    value, code = F.trim(F.coalesce(i["raw_value"], i["value"])), coerce_code(i["field_code"])
    label = F.coalesce(*(F.nullif(x, F.lit("")) for x in (i["evidence"]["raw_label"], i["raw_label"], i["label"], i["field_code"])), F.lit("?"))
    return rows.select(
        *keys, "seq", code.alias("field_code"), F.substring(value, 1, 64).alias("raw_value"), coerce_period(i["period"]).alias("period"), coerce_nature(i["nature"]).alias("nature"), coerce_confidence(i["confidence"]).alias("confidence"), F.substring(label, 1, 120).alias("raw_label"),
        F.coalesce(i["evidence"]["column_name"], i["column_name"]).alias("column_name"), coerce_role(F.coalesce(i["evidence"]["column_role"], i["column_role"])).alias("column_role"),
        F.substring(F.coalesce(i["evidence"]["source_excerpt"], i["source_excerpt"], F.concat_ws("|", label, value)), 1, 160).alias("source_excerpt"), F.coalesce(i["warnings"], F.array().cast("array<string>")).alias("warnings"),
    ).where("raw_value <> '' and field_code <> ''")


def uploads(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """Files below ``path`` that may be documents, and the rest with the reason."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(~F.lower("path").endswith(".pdf"), "name").when(F.col("length") > most_bytes, "size").when(F.substring("content", 1, 4) != F.lit("%PDF").cast("binary"), "magic")
    rows = files.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "length", "reason")


class PageConnector(Protocol):
    """Anything that turns page rows into answer rows, a batch at a time, in the workers."""

    def __call__(self, pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def connected(pages: DataFrame, connector: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Answers of an external model for each page; retries and timeouts are the connector's."""
    return pages.mapInPandas(connector, schema)


def without_key_codes(pages: DataFrame, candidates: DataFrame, key_codes: list[str]) -> DataFrame:
    """Pages on which no key code was found: those that a focused second pass takes."""
    return pages.join(candidates.where(F.col("field_code").isin(key_codes)).select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")


def best_orientation(scores: Column, declared: Column) -> Column:
    """The rotation with the best score (``array<struct<angle, score>>``): the declared one counts 1.35 times; where 0 is declared another must lead by a quarter."""
    weighted = F.transform(scores, lambda s: F.struct((s["score"] * F.when(s["angle"] == declared, 1.35).otherwise(1.0)).alias("score"), (-s["angle"]).alias("angle")))
    best = F.array_max(weighted)
    upright = F.array_max(F.transform(F.filter(weighted, lambda s: s["angle"] == 0), lambda s: s["score"]))
    return F.when((declared == 0) & (best["score"] < F.coalesce(upright, F.lit(0.0)) * 1.25), 0).otherwise(-best["angle"])


def exploded_pages(files: DataFrame, reader: Callable[[bytes, int], list[tuple[int, int, str]]], most_pages: int) -> DataFrame:
    """``path, page_number, declared_rotation, native_text`` of documents, by a ``reader`` (content, most pages) that an installation brings; the page limit goes to the reader. Files it cannot read give one row without a page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(path, *page) for page in reader(content, most_pages)[:most_pages]]
                except ValueError:
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "page_number", "declared_rotation", "native_text"]).astype({"page_number": "Int64", "declared_rotation": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, declared_rotation int, native_text string")


def fallback_chain(pages: DataFrame, passes: list[tuple[str, Callable[[DataFrame], DataFrame]]], key_codes: list[str], *columns: str) -> DataFrame:
    """Candidates of several passes over ``pages``: each later pass reads the pages on which none before found a key code; ``strategy`` names the pass. Duplicates are the caller's to drop."""
    found: DataFrame | None = None
    left = pages
    for name, read in passes:
        rows = read(left).select("doc_id", "page_number", "field_code", *columns).withColumn("strategy", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
        left = without_key_codes(left, rows, key_codes)
    if found is None:
        raise ValueError("no pass is given")
    return found
