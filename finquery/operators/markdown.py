"""Markdown tables in page text to labelled rows, fuzzy field matching and conflicts of amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.amounts import parse_decimal_amount
from finquery.functions.text import label_similarity, normalize_ocr_label
from finquery.operators.candidates import mapped

MOST_WORDINGS = 1000
TABLE_LINE, RULE_LINE = r"^\|(.+)\|\s*$", r"^\|?+\s*+:?+-{3,}+:?+\s*+(?:\|\s*+:?+-{3,}+:?+\s*+)++\|?+\s*+$"


def section_of(text: Column) -> Column:
    """The first section whose heading the text holds."""
    return reduce(lambda rest, s: F.when(text.rlike(s[1]), s[0]).otherwise(rest), reversed(R.SECTION_HEADINGS), F.lit(None).cast("string"))


def lines_of(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, line, text``; lines count from 0."""
    return pages.select("doc_id", "page_number", F.posexplode(F.split("content", r"\r\n|\n|\r", -1)).alias("line", "text"))


def islands(lines: DataFrame, inside: Column, *keys: str) -> DataFrame:
    """Adds ``island``: runs of consecutive lines that lie inside, numbered within the keys; other lines go."""
    order = Window.partitionBy(*keys).orderBy("line")
    rows = lines.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = F.col("_in") & ~F.coalesce(F.lag("_in").over(order), F.lit(False))
    return rows.withColumn("_start", starts.cast("int")).withColumn("island", F.sum("_start").over(order)).where("_in").drop("_in", "_start")


def cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))


def column_name(header: Column) -> Column:
    name = normalize_ocr_label(header)
    return mapped(name, R.COLUMN_NAMES, F.coalesce(F.nullif(name, F.lit("")), F.lit("value")))


def table_rows(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, line, section, raw_label, normalized_label, values`` of all table rows.

    A table begins at a line between bars and goes on through bars and rules.
    Its first line names the columns. Cells that a row lacks or leaves empty are
    null; of equal headings the last cell counts. A row that is a rule ends the
    table's rows. The section is the last heading before, over lines and pages.
    """
    lines = lines_of(pages).withColumn("is_row", F.col("text").rlike(TABLE_LINE)).withColumn("is_rule", F.col("text").rlike(RULE_LINE))
    lines = lines.withColumn("section", F.coalesce(F.last(section_of(F.col("text")), True).over(Window.partitionBy("doc_id").orderBy("page_number", "line")), F.lit("AUTRE")))
    blocks = islands(lines, F.col("is_row") | F.col("is_rule"), "doc_id", "page_number")
    whole = Window.partitionBy("doc_id", "page_number", "island").orderBy("line")
    numbered = blocks.withColumn("n", F.row_number().over(whole)).withColumns({"header": F.first("text").over(whole), "section": F.first("section").over(whole)})
    stop = F.max(F.when((F.col("n") > 2) & ~F.col("is_row"), 1).otherwise(0)).over(whole)
    rows = numbered.withColumn("_stop", stop).where("n > 1 and _stop = 0 and is_row and not (n = 2 and is_rule)").withColumns({"head": cells(F.col("header")), "cells": cells(F.col("text"))}).where(F.size("head") >= 2)
    label = F.col("cells")[0]
    names = F.transform(F.slice("head", 2, F.size("head")), column_name)
    values = F.transform(F.sequence(F.lit(1), F.size("head") - 1), lambda k: F.nullif(F.try_element_at("cells", k + 1), F.lit("")))
    # Of equal names the last stands.
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))
    return rows.where((label != "") & ~label.rlike(r"^[-—:]+$")).select("doc_id", "page_number", "line", "section", label.alias("raw_label"), normalize_ocr_label(label).alias("normalized_label"), F.map_from_entries(last).alias("values"))


def preferred_amount(values: Column, order: list[str] | None = None) -> Column:
    """The value of the first preferred column that has one, else the first value there is."""
    return F.coalesce(*(values[c] for c in order or R.PREFERRED_COLUMNS), F.try_element_at(F.filter(F.map_values(values), lambda v: v.isNotNull()), F.lit(1)))


def best_wording(labels: DataFrame, label: str, wordings: DataFrame, least: float = 0.7, most: int = MOST_WORDINGS) -> DataFrame:
    """For each distinct label the code of its most similar wording (``ord, code, alias``), the first of equals, from ``least`` on (above zero).

    A list of up to ``most`` goes along with each label, which is compared with all of them in its own row; with more, an index finds
    the wordings that can be similar at all (`similar_pairs`). The results are the same. A null label has neither code nor score.
    """
    listed = wordings.select("ord", "code", "alias").limit(most + 1).collect()
    wanted = labels.select(label).distinct()
    if not listed:
        return wanted.select(label, F.lit(None).cast("string").alias("code"), F.lit(None).cast("double").alias("score"))
    if len(listed) > most:
        # Of equal wordings only the first can be the best one.
        place = F.struct((-F.col("ord")).alias("place"), "code")
        first = wordings.groupBy("alias").agg(F.max(place).alias("b")).select((-F.col("b.place")).alias("ord"), "b.code", "alias")
        pairs = similar_pairs(wanted.select(F.col(label).alias("label")), first)
        best = pairs.groupBy(F.col("label").alias("_label")).agg(F.max(F.struct("score", (-F.col("ord")).alias("place"), "code")).alias("b"))
        found = wanted.join(best.hint("merge"), wanted[label] == best["_label"], "left")
        scored = found.select(label, F.struct(F.coalesce("b.score", F.lit(0.0)).alias("score"), F.col("b.code").alias("code")).alias("b"))
    else:
        known = F.array(*(F.struct(F.lit(-r["ord"]).alias("place"), F.lit(r["code"]).alias("code"), F.lit(r["alias"]).alias("alias")) for r in listed))
        best = F.array_max(F.transform(known, lambda w: F.struct(label_similarity(F.col(label), w["alias"]).alias("score"), w["place"].alias("place"), w["code"].alias("code"))))
        scored = wanted.withColumn("b", best)
    score = F.when(F.col(label).isNotNull(), F.col("b.score"))
    return scored.select(label, F.when(score >= least, F.col("b.code")).alias("code"), score.alias("score"))


#: Labels and wordings are told apart by runs of so many characters.
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of `GRAM` characters of a text; a shorter text is its own."""
    n = F.length(text)
    return F.array_distinct(F.when(n < GRAM, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1))), lambda k: F.substr(text, k, F.lit(GRAM)))))


def short_runs(text: Column) -> Column:
    """All runs of fewer than `GRAM` characters, in which a short wording can lie."""
    runs = [F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda j, k=k: F.substr(text, j, F.lit(k))) for k in range(1, GRAM)]
    return F.concat(*(F.when(F.length(text) >= k, r).otherwise(F.array().cast("array<string>")) for k, r in enumerate(runs, 1)))


def similar_pairs(labels: DataFrame, wordings: DataFrame) -> DataFrame:
    """``label, ord, code, score`` of all pairs whose `label_similarity` is above zero.

    What lies within the other side shares all of its runs of characters with
    it, so the rarest of them finds it; an inverted index of the longer side's
    runs has few entries there. Word sets that share one half have one of the
    rarest words of each in common (prefix filter), and sizes that differ by
    less than a factor of two. Candidates are then compared in full. Joins are
    merged at every size: Spark takes exploded rows for no larger than what they
    come from, and would broadcast an index.
    """
    known = wordings.select("ord", "code", "alias").where("alias <> ''")
    asked = labels.where("label <> ''").distinct()
    entry = F.struct("ord", "code", "alias")

    def rarest(rows: DataFrame, text: str, index: DataFrame) -> DataFrame:
        """Each row with the run of its own that fewest entries of the index have; rows with a run that none has find nothing."""
        counts = index.groupBy("run").agg(F.count("*").alias("n"))
        runs = rows.select("*", F.explode(grams(F.col(text))).alias("run"))
        least = runs.join(counts.hint("merge"), "run", "left").groupBy(*rows.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("x"))
        return least.where("x.n > 0").select(*rows.columns, F.col("x.run").alias("run"))

    label_index = asked.select("label", F.explode(F.array_distinct(F.concat(grams(F.col("label")), short_runs(F.col("label"))))).alias("run"))
    inside = rarest(known, "alias", label_index).join(label_index.hint("merge"), "run").where(F.contains("label", F.col("alias")))
    alias_index = known.select(entry.alias("w"), F.explode(F.array_distinct(F.concat(grams(F.col("alias")), short_runs(F.col("alias"))))).alias("run"))
    around = rarest(asked, "label", alias_index).join(alias_index.hint("merge"), "run").select("label", "w.*").where((F.length("label") >= 0.9 * F.length("alias")) & F.contains("alias", F.col("label")))

    words = lambda c: F.array_distinct(F.split(c, " "))
    sets = asked.select("label", words(F.col("label")).alias("set"))
    others = known.select(entry.alias("w"), words(F.col("alias")).alias("set"))
    counts = sets.select(F.explode("set").alias("word")).unionByName(others.select(F.explode("set").alias("word"))).groupBy("word").agg(F.count("*").alias("n"))

    def prefixes(rows: DataFrame, key: str) -> DataFrame:
        """A set of n words has one of its n - ceil(n / 2) + 1 rarest in common with every set that shares half of their union."""
        place = F.row_number().over(Window.partitionBy(key).orderBy("n", "word"))
        ranked = rows.select(key, F.size("set").alias("size"), F.explode("set").alias("word")).join(counts.hint("merge"), "word").withColumn("place", place)
        return ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") / 2) + 1).select(key, "size", "word")

    left, right = prefixes(sets, "label"), prefixes(others, "w").withColumnRenamed("size", "other")
    shared = left.join(right.hint("merge"), "word").where((F.col("size") <= 2 * F.col("other")) & (F.col("other") <= 2 * F.col("size"))).select("label", "w.*")
    pairs = inside.select("label", "ord", "code", "alias").unionByName(around.select("label", "ord", "code", "alias")).unionByName(shared.select("label", "ord", "code", "alias")).distinct()
    return pairs.select("label", "ord", "code", label_similarity(F.col("label"), F.col("alias")).alias("score")).where("score > 0")


def amount_conflicts(rows: DataFrame, *keys: str) -> DataFrame:
    """``value, status, n``: confirmed if all amounts of a key are one, conflicting if not; keys without an amount go."""
    found = rows.where("amount is not null").groupBy(*keys).agg(F.min("amount").alias("low"), F.max("amount").alias("high"), F.count("*").alias("n"))
    one = F.col("low") == F.col("high")
    return found.select(*keys, F.when(one, F.col("low")).alias("value"), F.when(one, "confirmed").otherwise("conflicting").alias("status"), "n")


def table_fields(pages: DataFrame, wordings: DataFrame) -> DataFrame:
    """Fields of documents from their Markdown tables."""
    rows = table_rows(pages)
    matched = rows.join(best_wording(rows, "normalized_label", wordings), "normalized_label").where("code is not null")
    return amount_conflicts(matched.withColumn("amount", parse_decimal_amount(preferred_amount(F.col("values")))), "doc_id", "code")
