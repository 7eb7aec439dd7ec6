"""Benchmark decontamination by template windows, in DataFrame operations only.

White space becomes single spaces, and a text becomes a template: numbers,
units after numbers and names (capitalised words) turn into typed placeholders
that keep their value aside; the rest is lower-cased and stripped of marks.
Whether a capitalised word that opens a sentence is a name cannot be told, so a
text has two templates: in one such words are literal, in the other names.

Each template word is hashed once, and hashes of ``width`` words are made of
them by doubling (pairs, fours, eights). A document's window goes on only if a
bitmap of ``BITS`` bits, made of the benchmark's windows, has its bit; what is
left is hash-joined with the benchmark's windows, each template of an item on
its own. The bitmap's size is fixed: with a large benchmark more windows pass
it, and none is lost. How the join is done is left to Spark, which knows the
bytes of both sides.

Along each diagonal (document position less item position) the slot values must
be consistent: a value of the item always stands for one value of the document.
`leaks` says over what that is asked. Enough consistent windows are a leak,
verbatim if all values are equal, else a re-parameterised question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, with_columns_of

WIDTH, ENOUGH, LITERALS = 8, 6, 4
#: Bits of the bitmap of the benchmark's windows, a power of two: 128 KB in each task.
BITS = 1 << 20
#: Units, as words after a number. Fixed values.
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|mi|mile|miles|meter|meters|metre|metres|feet|foot|ft|inch|inches|hour|hours|h|minute|minutes|min|second|seconds|s|day|days|week|weeks|month|months|year|years|dollar|dollars|usd|euro|euros|eur|cent|cents|percent|degrees|mph|kmh"
TEMPLATES = (1, 2)
#: Stands for the words of the first template with their values.
VERBATIM = 3
OPEN, VALUE, CLOSE = "\u0001", "\u0002", "\u0003"
#: What a text must hold for a pattern to be tried, the pattern, and what takes its place, in order.
MARKS = (
    (lambda t: F.lit(True), r"[\s\p{Z}&&[^ ]][\s\p{Z}]*+| [\s\p{Z}]++", " "),
    (lambda t: F.contains(t, F.lit(OPEN)) | F.contains(t, F.lit(VALUE)) | F.contains(t, F.lit(CLOSE)), r"[\u0001-\u0003]", " "),
    (lambda t: t.rlike("[0-9]"), r"(?<![\p{L}\p{N}])[0-9]++(?:[.,][0-9]++)*+(?![\p{N}])", f"{OPEN}n{VALUE}$0{CLOSE}"),
    (lambda t: F.contains(t, F.lit(CLOSE)), rf"(?<={CLOSE}|{CLOSE} )(?i:{UNITS})(?![\p{{L}}\p{{N}}])", f"{OPEN}u{VALUE}$0{CLOSE}"),
    (lambda t: F.lit(True), r" (?<=[\p{Ll},;:] )(\p{Lu}\p{L}*+)", f" {OPEN}p{VALUE}$1{CLOSE}"),
    (lambda t: F.lit(True), r"(?<![\p{L}\p{N}\u0002])(\p{Lu}\p{L}*+)", f"{OPEN}q{VALUE}$1{CLOSE}"),
)
STRIP = r"[^\p{L}\p{N}\s\u0001-\u0003]+"


def split_words(text: str) -> str:
    """SQL for the words of a text that single spaces part."""
    return f"array_remove(split({text}, ' '), '')"


def template_words(rows: DataFrame) -> DataFrame:
    """Adds ``w1``, the template words of ``text`` with words that open sentences as literals, and ``w2``, with those as names; ``m1`` and ``m2``: the texts of both with their slots' values."""
    rows = rows.withColumn("marked", F.coalesce("text", F.lit("")))
    for test, pattern, to in MARKS:
        text = F.col("marked")
        rows = rows.withColumn("marked", F.when(test(text), F.regexp_replace(text, pattern, to)).otherwise(text))
    rows = rows.withColumn("marked", F.lower(F.regexp_replace("marked", STRIP, "")))
    rows = rows.withColumn("m1", F.regexp_replace("marked", f"{OPEN}q{VALUE}([^{CLOSE}]*){CLOSE}", "$1")).withColumn("m2", F.replace("marked", F.lit(f"{OPEN}q"), F.lit(f"{OPEN}p")))
    return rows.withColumns({f"w{t}": F.expr(split_words(f"regexp_replace(m{t}, '{VALUE}[^{CLOSE}]*{CLOSE}', '')")) for t in TEMPLATES}).drop("marked", "text")


def with_hashes(rows: DataFrame, words: str, widths: list[int], out: str) -> DataFrame:
    """Adds ``<out><n>`` for each of ``widths``: the hashes of all runs of n of the words, by their first words' places."""
    rows = rows.withColumn(f"{out}_1", F.transform(words, lambda x: F.xxhash64(x)))

    def pairs(rows: DataFrame, name: str, a: str, b: str, k: int) -> DataFrame:
        """A run of ``a`` that begins at a place, and the run of ``b`` that begins ``k`` places on."""
        n = f"greatest(size({b}) - {k}, 0)"
        return rows.withColumn(name, F.expr(f"zip_with(slice({a}, 1, {n}), slice({b}, {k + 1}, {n}), (p, q) -> xxhash64(p, q))"))

    k = 1
    while 2 * k <= max(widths, default=0):
        rows = pairs(rows, f"{out}_{2 * k}", f"{out}_{k}", f"{out}_{k}", k)
        k *= 2
    for n in widths:
        made, at = None, 0
        for k in (1 << j for j in range(n.bit_length()) if n >> j & 1):
            if made is None:
                made = f"{out}_{k}"
            else:
                rows = pairs(rows, f"{out}_{n}_{at + k}", made, f"{out}_{k}", at)
                made = f"{out}_{n}_{at + k}"
            at += k
        rows = rows.withColumn(f"{out}{n}", F.col(made))
    return rows


def slots_at(pos: str, words: str, n: str) -> str:
    """SQL for the slot values, in order, of the ``n`` words that begin at ``pos`` (from 0)."""
    return f"regexp_extract_all(array_join(slice({words}, {pos} + 1, {n}), ' '), '{VALUE}([^{CLOSE}]*){CLOSE}', 1)"


def windows(rows: DataFrame, bitmaps: dict[int, list[int]], verbatim: dict[int, list[int]], key: str) -> DataFrame:
    """``key, pos, width, h, slots``: the windows of both templates whose bit is set in the bitmap of their width, and those of the words with their values for the widths of ``verbatim``.

    ``explode_outer``, as for ``explode`` Spark would make all windows once more, to see whether there are any.
    """
    made = []
    if verbatim:
        rows = rows.withColumns({f"w{VERBATIM}": F.expr(split_words("m1")), f"m{VERBATIM}": F.col("m1")})
    for t, bitmaps in (*((t, bitmaps) for t in TEMPLATES), *([(VERBATIM, verbatim)] if verbatim else [])):
        rows = with_hashes(rows, f"w{t}", sorted(bitmaps), f"h{t}_")
        for n, bits in bitmaps.items():
            table = f"cast(split('{','.join(map(str, bits))}', ',') as array<bigint>)"
            hit = f"(shiftrightunsigned(element_at({table}, int(shiftrightunsigned(h, {64 - (len(bits) - 1).bit_length()})) + 1), int(h & 63)) & 1) = 1"
            found = f"array_compact(transform(h{t}_{n}, (h, i) -> if({hit}, named_struct('pos', i, 'width', {n}, 'h', h), null)))"
            # Arrays of one element name a value, so that it is made once; the words with values only where a window was found.
            slots = f"transform(array({split_words(f'm{t}')}), f -> transform(found, x -> named_struct('pos', x.pos, 'width', x.width, 'h', x.h, 'slots', {slots_at('x.pos', 'f', 'x.width')})))"
            made.append(f"flatten(flatten(transform(array({found}), found -> if(size(found) = 0, array(), {slots}))))")
    return rows.select(key, F.explode_outer(F.expr(f"array_distinct(concat({', '.join(made)}))")).alias("x")).where("x.h is not null").select(key, "x.pos", "x.width", "x.h", "x.slots")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id, template, need, item_pos, rank, width, h, item_slots``: windows with enough literal words, and how many make a leak.

    An item without such windows is sought as a whole: by all of its windows.
    """
    at = f"if(n_words < {width}, array(), sequence(0, n_words - {width}))"
    rows = with_hashes(items, "w", [width], "h").withColumn("full", F.expr(f"filter({at}, i -> size(filter(slice(w, i + 1, {width}), x -> not contains(x, '{OPEN}'))) >= {min(LITERALS, width)})"))
    rows = rows.withColumn("need", F.expr(f"if(size(full) = 0, n_words - {width - 1}, least(enough, size(full)))")).withColumn("full", F.expr(f"if(size(full) = 0, {at}, full)"))
    return rows.select("item_id", "template", "need", "f", f"h{width}", F.posexplode_outer("full").alias("rank", "item_pos")).select("item_id", "template", "need", "item_pos", "rank", F.lit(width).alias("width"), F.expr(f"h{width}[item_pos]").alias("h"), F.expr(slots_at("item_pos", "f", str(width))).alias("item_slots"))


def bitmap(sought: DataFrame) -> list[int]:
    """``BITS`` bits as longs: the word is told by a hash's upper bits, the bit by its lower six."""
    words = BITS // 64
    found = sought.groupBy(F.expr(f"int(shiftrightunsigned(h, {64 - (words - 1).bit_length()}))").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63)))").alias("bits")).collect()  # words of a bitmap of fixed size
    out = [0] * words
    for r in found:
        out[r["at"]] = r["bits"]
    return out


def leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, enough: int = ENOUGH, one_to_one: bool = True, stretches: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, verbatim``: each item that a document holds, with its most consistent windows on a diagonal.

    Slot values must be consistent, which by default is asked of a whole
    diagonal or of a run (windows that match without a break), so that one
    conflict spoils a run. With ``stretches`` it is asked of as many successive
    windows of a diagonal as make a leak: a conflict spoils only what holds
    both of its places, and a copy with one of two equal values changed leaks.
    ``n_windows`` counts the windows of such stretches then. ``one_to_one``
    also asks that a value of the document stands for one value of the item.

    Items shorter than ``width`` words are sought as whole windows of their own
    length. Items with fewer than ``LITERALS`` words that are no slots have no
    template to speak of: they are sought with their values, all windows of
    them; fewer than ``LITERALS`` words of any kind (a lone number, say) match
    nothing. ``verbatim``: the windows of a run or of all such stretches have the item's values. Windows count that hold ``LITERALS`` such words. An item leaks at
    ``enough`` windows, or all if it has fewer; an item without any that count
    leaks as a whole. Null and empty texts hold nothing and leak nothing; a
    document without an id leaks nothing that could be told. Repeated rows of a
    doc_id count as one document. An empty benchmark or table gives no rows.
    """
    work = Scratch(spark, "leaks")
    made = template_words(with_columns_of(benchmark, item_id="long", text="string"))
    made = made.select("item_id", F.explode(F.array(*(F.struct(F.lit(t).alias("template"), F.col(f"w{t}").alias("w"), F.expr(split_words(f"m{t}")).alias("f")) for t in TEMPLATES))).alias("x"), F.col("w1").alias("other")).select("item_id", "x.template", "x.w", "x.f", "other").where("template = 1 or w <> other").drop("other")
    literal = F.size(F.filter("w", lambda x: ~x.contains(OPEN))) >= LITERALS
    told = made.withColumn("n_words", F.size("w")).withColumn("enough", F.lit(enough)).withColumn("literal", F.max(literal).over(Window.partitionBy("item_id")))  # two templates an item
    bare = told.where((~F.col("literal")) & (F.col("template") == 1) & (F.col("n_words") >= LITERALS)).withColumns({"template": F.lit(VERBATIM), "w": F.col("f")})
    items = work.table("items", told.where(literal).unionByName(bare))
    widths = [(r["v"], r["n"]) for r in items.select((F.col("template") == VERBATIM).alias("v"), F.least("n_words", F.lit(width)).alias("n")).distinct().orderBy("v", "n").collect()]  # at most twice `width` values
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_windows long, verbatim boolean")
    parts = [item_windows(items.where((F.least("n_words", F.lit(width)) == n) & ((F.col("template") == VERBATIM) == v)), n) for v, n in widths]
    sought = work.table("windows", reduce(DataFrame.unionByName, parts))
    docs = template_words(with_columns_of(documents, doc_id="long", text="string").where("doc_id is not null"))
    bits = {(v, n): bitmap(sought.where((F.col("width") == n) & ((F.col("template") == VERBATIM) == v))) for v, n in widths}
    found = windows(docs, *({n: x for (v, n), x in bits.items() if v == kind} for kind in (False, True)), "doc_id").join(sought, ["width", "h"])
    pairs = F.expr("zip_with(item_slots, slots, (a, b) -> named_struct('item', a, 'doc', b))")
    # A diagonal holds at most the windows of one item.
    diagonals = found.groupBy("doc_id", "item_id", "template", "need", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.array_sort(F.collect_set(F.struct("rank", pairs.alias("pairs")))).alias("hits")).where("size(array_distinct(hits.rank)) >= need")
    consistent = lambda pairs: f"size({pairs}) = size(array_distinct({pairs}.item))" + (f" and size({pairs}) = size(array_distinct({pairs}.doc))" if one_to_one else "")
    if stretches:
        starts = f"filter(sequence(1, size(hits) - need + 1), i -> exists(array(array_distinct(flatten(slice(hits.pairs, i, need)))), p -> {consistent('p')}))"
        places = diagonals.withColumn("places", F.expr(f"array_distinct(flatten(transform({starts}, i -> sequence(i, i + need - 1))))")).where("size(places) > 0")
        judged = places.select("doc_id", "item_id", F.expr("cast(size(array_distinct(transform(places, i -> hits[i - 1].rank))) as long)").alias("n"), F.expr("forall(places, i -> forall(hits[i - 1].pairs, p -> p.item = p.doc))").alias("same"))
    else:
        breaks = "filter(sequence(1, size(hits)), i -> i = 1 or hits[i - 1].rank > hits[i - 2].rank + 1)"
        runs = diagonals.withColumn("breaks", F.expr(breaks)).withColumn("runs", F.expr("concat(array(hits), if(size(breaks) = 1, array(), transform(breaks, (b, k) -> slice(hits, b, coalesce(get(breaks, k + 1), size(hits) + 1) - b))))"))
        runs = runs.withColumn("runs", F.expr("transform(runs, r -> named_struct('n', cast(size(array_distinct(r.rank)) as long), 'pairs', array_distinct(flatten(r.pairs))))"))
        runs = runs.withColumn("runs", F.expr(f"filter(runs, r -> r.n >= need and {consistent('r.pairs')})")).where("size(runs) > 0")
        judged = runs.select("doc_id", "item_id", F.expr("array_max(runs.n)").alias("n"), F.expr("exists(runs, r -> forall(r.pairs, p -> p.item = p.doc))").alias("same"))
    return judged.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.max("same").alias("verbatim"))


def decontaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, enough: int = ENOUGH, one_to_one: bool = True, stretches: bool = False) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id, n_items, n_windows, first_item, verbatim, contaminated``."""
    found = leaks(spark, documents, benchmark, width, enough, one_to_one, stretches).groupBy(F.col("doc_id").alias("leaked")).agg(F.count("*").alias("n_items"), F.max("n_windows").alias("n_windows"), F.min("item_id").alias("first_item"), F.max("verbatim").alias("verbatim"))
    rows = with_columns_of(documents, doc_id="long").join(found, F.col("doc_id").eqNullSafe(F.col("leaked")), "left")
    return rows.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), "first_item", "verbatim", F.col("n_items").isNotNull().alias("contaminated"))
