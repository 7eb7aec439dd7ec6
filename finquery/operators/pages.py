"""Page types from native text: lexicon hits, the sequential fold over a document's pages, and attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.functions.text import contains_any, fold_ascii



def hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def lexical_scores(text: Column, markers: list[tuple[str, int, list[str]]] | None = None) -> Column:
    """``type, score, enough`` of the type with the most markers in a folded text; ties fall to the first type."""
    markers = markers or R.MARKERS
    scores = F.array(*(F.struct(hits(text, words).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("type"), F.lit(least).alias("least")) for k, (name, least, words) in enumerate(markers)))
    best = F.array_max(scores)
    return F.struct(best["type"].alias("type"), best["score"].alias("score"), (best["score"] >= best["least"]).alias("enough"))


#: Pages of a block of the scan over a document.
BLOCK = 512


def optional(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)


def page_facts(pages: DataFrame) -> DataFrame:
    """What the fold needs of each page (``doc_id, page_number, native_text``), computed row by row.

    Where there are images: ``image_blank`` (null: no image), and what the
    connector says a page shows: ``asked_type``, and ``asked_again`` where it was
    asked a second time as it had said identification.
    """
    text = fold_ascii(F.col("native_text"))
    rows = pages.withColumn("text", text).withColumn("best", lexical_scores(F.col("text")))
    detail = dict((m[0], m[2]) for m in R.MARKERS)["DETAIL_CPC"]
    n = F.length("text")
    facts = {
        "type": F.col("best.type"), "score": F.when(n < 12, 0).otherwise(F.col("best.score")), "enough": F.col("best.enough") & (n >= 12), "detail": contains_any(F.col("text"), detail) & (n >= 12), "n": n,
        "image": optional(rows, "image_blank", "boolean"), "asked": optional(rows, "asked_type", "string"), "again": optional(rows, "asked_again", "string"), "firm": contains_any(F.col("text"), R.FIRM_IDENTIFICATION),
        "continues": F.array_compact(F.array(*(F.when(contains_any(F.col("text"), words), F.lit(name)) for name, words in R.CONTINUATION.items()))),
    }
    return rows.select("doc_id", F.struct("page_number", *(c.alias(k) for k, c in facts.items())).alias("page"))


def decide(previous: Column, page: Column) -> Column:
    """A page's type, given the final type of the page before."""
    short, goes_on = page["n"] < 12, F.coalesce(F.array_contains(page["continues"], previous), F.lit(False))
    no_picture, said = F.coalesce(page["image"], F.lit(True)), page["asked"]
    lexical = F.when(short, None).when(page["detail"], "DETAIL_CPC").when(page["enough"], page["type"]).when(goes_on & (page["score"] >= 1), previous).when(page["score"] >= 1, page["type"])
    late = page["page_number"] >= 2
    weak = F.coalesce((lexical == "IDENTIFICATION") & late & ~page["firm"], F.lit(False))
    # What usually follows, for a connector that insists on identification.
    follows = F.create_map(*(F.lit(x) for pair in R.GUESSED_NEXT.items() for x in pair))
    insists = (said == "IDENTIFICATION") & (late | F.coalesce(previous == "IDENTIFICATION", F.lit(False))) & ~page["firm"]
    guess = F.coalesce(follows[previous], F.lit("BILAN_ACTIF"))
    seen = F.when(F.coalesce(insists, F.lit(False)), F.when(page["again"] == "IDENTIFICATION", guess).otherwise(F.coalesce(page["again"], said))).otherwise(said)
    nothing = ~page["detail"] & (page["score"] == 0)
    rest = F.when(no_picture & short, "VIDE").when((page["n"] >= 30) & nothing, "AUTRE").when(no_picture, "VIDE").otherwise("AUTRE")
    return F.when(no_picture & short, "VIDE").when(lexical.isNotNull() & ~weak, lexical).when(goes_on, previous).when(~no_picture & seen.isNotNull(), seen).otherwise(rest)


def after(previous: Column, kind: Column) -> Column:
    """The type that the next page goes by: blank and other pages leave it."""
    return F.when(kind.isin("VIDE", "AUTRE"), previous).otherwise(kind)


def classified(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, page_type``: pages in order, each after the type of the one before (blank and other pages leave it).

    A page is a function from the type before it to the type after it. Pages are
    folded in blocks of `BLOCK` page numbers; where a document has several, a
    block's functions are first composed (one entry for each type that can come
    before), and the blocks' compositions tell what each block begins with. So no
    array grows with a document, and the work grows with its pages. One shuffle.
    """
    known = [None, *R.PAGE_TYPES]
    before = F.array(*(F.lit(t).cast("string") for t in known))
    rows = page_facts(pages).withColumn("block", F.floor(F.col("page.page_number") / BLOCK)).repartition("doc_id")
    blocks = rows.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    composed = F.aggregate("pages", before, lambda states, page: F.transform(states, lambda s: after(s, decide(s, page))))
    every = Window.partitionBy("doc_id")
    blocks = blocks.withColumn("several", F.count("*").over(every) > 1).withColumn("composed", F.when(F.col("several"), composed))
    earlier = F.collect_list("composed").over(every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    place = F.create_map(*(x for k, t in enumerate(known[1:]) for x in (F.lit(t), F.lit(k + 1))))
    entry = F.aggregate(earlier, F.lit(None).cast("string"), lambda s, c: F.get(c, F.coalesce(place[s], F.lit(0))))
    start = F.struct(F.col("entry").alias("previous"), F.array().cast("array<struct<page_number:int,page_type:string>>").alias("out"))

    def step(state: Column, page: Column) -> Column:
        kind = decide(state["previous"], page)
        return F.struct(after(state["previous"], kind).alias("previous"), F.array_append(state["out"], F.struct(page["page_number"].cast("int").alias("page_number"), kind.alias("page_type"))).alias("out"))

    return blocks.withColumn("entry", F.when(F.col("several"), entry)).select("doc_id", F.inline(F.aggregate("pages", start, step, lambda s: s["out"])))


def next_types(primary: Column, previous: Column) -> Column:
    """The types to try, in order and without repeats: the primary, what usually follows, then all."""
    follows = F.create_map(*(x for k, v in R.NEXT_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = [*R.FALLBACK_TYPES, "IDENTIFICATION"]
    every = F.concat(F.array(primary), F.coalesce(follows[F.coalesce(previous, primary)], F.array().cast("array<string>")), F.array(*map(F.lit, R.FALLBACK_TYPES)))
    return F.filter(F.array_distinct(every), lambda t: t.isin(known))


def types_to_try(page_type: Column, previous: Column, most: int) -> Column:
    """The first ``most`` of `next_types`; an identification page is tried as that alone."""
    return F.when(page_type == "IDENTIFICATION", F.array(F.lit("IDENTIFICATION"))).otherwise(F.slice(next_types(page_type, previous), 1, most))


def meaningful(page_type: Column, codes: Column) -> Column:
    """Whether an attempt's field codes tell something: one of its page type's codes, or two rows where the type has none."""
    named = F.create_map(*(x for k, v in R.MEANINGFUL_CODES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.arrays_overlap(codes, named[page_type]), F.size(codes) >= 2)


def page_counters(attempts: DataFrame) -> DataFrame:
    """``n_processed, n_skipped, n_failed, latency_ms, warnings`` of each document, from its pages' attempts (``doc_id, page_number, n_rows, latency_ms, skipped, error``).

    A skipped page counts as such; one of which no attempt gave rows has failed
    if an attempt told an error, else it was processed without a find. Latencies are added over all attempts; null where none is known.
    Warnings name the pages that failed, in order.
    """
    pages = attempts.groupBy("doc_id", "page_number").agg(F.max("skipped").alias("skipped"), F.sum("n_rows").alias("rows"), F.sum("latency_ms").alias("latency_ms"), F.max("error").alias("error"))
    failed = ~F.col("skipped") & (F.coalesce("rows", F.lit(0)) == 0) & F.col("error").isNotNull()
    told = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("page_number", "error")))), lambda x: F.concat(F.lit("page "), x["page_number"], F.lit(": "), x["error"]))
    return pages.groupBy("doc_id").agg(F.count_if(~F.col("skipped") & ~failed).alias("n_processed"), F.count_if("skipped").alias("n_skipped"), F.count_if(failed).alias("n_failed"), F.sum("latency_ms").alias("latency_ms"), told.alias("warnings"))


def sticky(rows: DataFrame, value: str, out: str, group: str, *order: str) -> DataFrame:
    """The last value that is not null, up to and with each row."""
    return rows.withColumn(out, F.last(value, True).over(Window.partitionBy(group).orderBy(*order)))


def best_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    """Of each page's attempts (``attempt, n_rows, meaningful``): those up to the first meaningful one; of them the most rows, then the meaningful, then the earliest."""
    first = F.min(F.when(F.col("meaningful"), F.col("attempt"))).over(Window.partitionBy(*keys))
    tried = attempts.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
    return tried.groupBy(*keys).agg(F.max_by(F.struct("attempt", "n_rows", "meaningful"), F.struct("n_rows", "meaningful", -F.col("attempt"))).alias("b"), F.count("*").alias("n_tried")).select(*keys, "b.*", "n_tried")


def first_values(rows: DataFrame, code: str, value: str, codes: list[str], order: str, *keys: str) -> DataFrame:
    """One column for each code with its first value in order."""
    return rows.groupBy(*keys).agg(*(F.min_by(F.when(F.col(code) == c, F.col(value)), F.when((F.col(code) == c) & F.col(value).isNotNull(), F.col(order))).alias(c.lower()) for c in codes))
