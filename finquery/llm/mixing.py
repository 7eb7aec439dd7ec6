"""Mixing sources to target weights by soft domain membership, in DataFrame operations only.

A naive Bayes classifier over the presence of words, fitted on labelled rows, gives each
document a posterior over three domains: clean, low (quality 0) and toxic.
Non-negative rates then make the expected tokens of each domain, summed over
documents as rate x tokens x posterior, match targets. What rates can reach is
the cone of the posteriors; the least squares' answer is the point of it that
is nearest to the targets (`nearest`, a few passes that each return one row).
Projected gradient steps then lead the rates there, preconditioned so that all
directions are equally steep: where a point can be reached, its gaps vanish in
any norm. Each step is one pass over the compact table of posteriors that
returns three sums. A document's rate follows from its
own posterior and the few past gaps, so no rate is stored between steps.
"""

from __future__ import annotations

import itertools
import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, with_columns_of

DOMAINS = ("clean", "low", "toxic")
#: Targets as multiples of the tokens that each domain is expected to have now.
TARGETS = {"clean": 1.1, "low": 0.25, "toxic": 0.05}
BUCKETS, PLACED, UNIT, MOST = 8192, 1024, 64, 640
#: Labelled documents that the classifier is fitted on at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: A word tells something if its shares of documents differ by so many standard errors and one of them is COMMON
#: (rarer words follow groups of copies rather than domains); the FEATURES strongest are kept.
SURE, COMMON, FEATURES = 5.5, 0.02, 4096
LONG_TEXT = 1 << 24
#: Gaps stand still when a step changes each by less than this part of what counts as close.
STILL = 1e-2
#: Keeps the matrix of a step invertible where a domain has next to nothing.
RIDGE = 1e-5


def marked_words(text: Column) -> Column:
    """Lower-cased words, with runs of marks as words of their own."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\s]+)", " $1 ")
    return F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ")


def moved(hashes: list[int], slots: int, groups: int) -> tuple[int, list[int]] | None:
    """A table without collisions: a shift, and a displacement for each group of hashes (told by their upper bits).

    A hash's place is its ``slots`` bits after the shift, xor its group's
    displacement. Groups are placed from the largest on, each at the first
    displacement at which all its places are free.
    """
    for shift in range(48):
        parts: dict[int, list[int]] = {}
        for h in hashes:
            parts.setdefault((h % 2**64) * groups >> 64, []).append((h >> shift) % slots)
        taken, out = set(), [0] * groups
        for g, low in sorted(parts.items(), key=lambda x: (-len(x[1]), x[0])):
            d = next((d for d in range(slots) if not any(x ^ d in taken for x in low)), None) if len(set(low)) == len(low) else None
            if d is None:
                break
            out[g] = d
            taken.update(x ^ d for x in low)
        else:
            return shift, out
    return None


class Model:
    """Word hashes with their weights of low and toxic against clean (in 1/UNIT nats), and the prior log odds of both; each word has a place of its own in the tables."""

    def __init__(self, weights: list[tuple[int, int, int]], prior: tuple[float, float]):
        self.prior = prior
        self.keys, self.low, self.toxic = [0] * BUCKETS, [0] * BUCKETS, [0] * BUCKETS
        found = moved([h for h, *_ in weights], BUCKETS, PLACED)
        if found is None:
            raise RuntimeError("no table without collisions was found")
        self.shift, self.displaced = found
        for h, low, toxic in weights:
            k = (h >> self.shift) % BUCKETS ^ self.displaced[(h % 2**64) * PLACED >> 64]
            self.keys[k], self.low[k], self.toxic[k] = h, low, toxic


def fitted(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Naive Bayes on the presence of words. Without labelled documents of a domain its words weigh nothing."""
    given = with_columns_of(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null and (toxic = 1 or quality is not null)")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    sample = given.groupBy("doc_id").agg(F.max(domain).alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = with_columns_of(documents, doc_id="long", text="string").join(F.broadcast(sample), "doc_id")  # `rows` ids at most
    n = dict(texts.groupBy("domain").count().collect())
    n = [n.get(k, 0) for k in range(3)]
    words = texts.select("domain", F.explode(F.array_distinct(marked_words(F.col("text")))).alias("word")).groupBy(F.xxhash64("word").alias("h")).agg(*(F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(3)))
    share = lambda k: (F.col(f"n{k}") + 0.5) / (n[k] + 1)

    def told(k: int) -> tuple[Column, Column]:
        """How sure the difference from clean is, and its weight."""
        if not n[k] or not n[0]:
            return F.lit(0.0), F.lit(0)
        both = (F.col(f"n{k}") + F.col("n0") + 1) / (n[k] + n[0] + 2)
        sure = F.abs(share(k) - share(0)) / F.sqrt(both * (1 - both) * (1 / n[k] + 1 / n[0]) + 1e-12)
        weight = F.round(F.log(share(k) / share(0)) * UNIT)
        return sure, F.when((sure > SURE) & (F.greatest(share(k), share(0)) >= COMMON), F.greatest(F.lit(-MOST), F.least(F.lit(MOST), weight))).otherwise(0).cast("long")

    (sure_low, low), (sure_toxic, toxic) = told(1), told(2)
    best = words.select("h", "n0", "n1", "n2", low.alias("low"), toxic.alias("toxic"), F.greatest(F.when(low != 0, sure_low), F.when(toxic != 0, sure_toxic)).alias("sure")).where("h <> 0 and (low <> 0 or toxic <> 0)").orderBy(F.desc("sure"), "h").limit(FEATURES)
    kept = best.collect()  # FEATURES rows at most
    prior = [math.log((n[k] + 1e-3) / (n[0] + 1e-3)) if n[k] else -30.0 for k in (1, 2)]
    weights = []
    for r in kept:
        p = [(r[f"n{k}"] + 0.5) / (n[k] + 1) for k in range(3)]
        w = [r["low"], r["toxic"]]
        for k in (1, 2):
            if w[k - 1] > 0 and p[0] < COMMON:  # a mark of the domain: that it is absent tells something too
                absent = math.log((1 - p[k]) / (1 - p[0]))
                prior[k - 1] += absent
                w[k - 1] -= round(absent * UNIT)
        weights.append((r["h"], *w))
    return Model(weights, tuple(prior))


def posteriors(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, p_clean, p_low, p_toxic`` of every whole text."""
    literal = lambda x: "array(" + ",".join(f"{v}L" for v in x) + ")"
    place = f"int((shiftright(h, {model.shift}) & {BUCKETS - 1}L) ^ element_at({literal(model.displaced)}, int(shiftrightunsigned(h, {64 - (PLACED - 1).bit_length()})) + 1)) + 1"
    total = lambda table: F.expr(f"aggregate(hashes, 0L, (a, h) -> a + if(element_at({literal(model.keys)}, {place}) = h, element_at({literal(table)}, {place}), 0L))")
    # Both sums in one pass over the words: the upper and the lower half of a long.
    both = total([a * (1 << 32) + b for a, b in zip(model.low, model.toxic, strict=True)])
    rows = with_columns_of(documents, doc_id="long", text="string").select("doc_id", F.length("text").alias("size"), marked_words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "size", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long").alias("n_tokens"), F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("doc_id", "n_tokens", F.when(F.coalesce("size", F.lit(0)) < LONG_TEXT, F.struct(F.lit(True).alias("packed"), both.alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.lit(False).alias("packed"), total(model.low).alias("a"), total(model.toxic).alias("b"))).alias("s"))
    under = F.expr("shiftright(shiftleft(s.a, 32), 32)")
    rows = rows.select("doc_id", "n_tokens", (F.when(F.col("s.packed"), F.expr("shiftright(s.a - shiftright(shiftleft(s.a, 32), 32), 32)")).otherwise(F.col("s.a")) / UNIT + model.prior[0]).alias("l"), (F.when(F.col("s.packed"), under).otherwise(F.col("s.b")) / UNIT + model.prior[1]).alias("t"))
    top = F.greatest("l", "t", F.lit(0.0))
    e = [F.exp(-top), F.exp(F.col("l") - top), F.exp(F.col("t") - top)]
    return rows.select("doc_id", "n_tokens", *((x / (e[0] + e[1] + e[2])).alias(f"p_{d}") for x, d in zip(e, DOMAINS, strict=True)))


def rate_of(steps: list[tuple[float, ...]]) -> Column:
    """A document's rate after gradient steps; each step has one coefficient for each domain."""
    if not steps:
        return F.lit(1.0)
    past = "array(" + ",".join("array(" + ",".join(f"{c!r}D" for c in s) + ")" for s in steps) + ")"
    return F.expr(f"aggregate({past}, 1.0D, (r, c) -> greatest(0.0D, r - (p_clean * c[0] + p_low * c[1] + p_toxic * c[2])))")


def solved(h: list[list[float]], g: list[float]) -> list[float]:
    """x with h x = g, for a small symmetric positive h, by elimination."""
    rows = [[*row, x] for row, x in zip(h, g, strict=True)]
    for k in range(len(rows)):
        for j in range(len(rows)):
            if j != k:
                by = rows[j][k] / rows[k][k]
                rows[j] = [x - by * y for x, y in zip(rows[j], rows[k], strict=True)]
    return [row[-1] / row[k] for k, row in enumerate(rows)]


def combined(points: list[list[float]], goal: list[float]) -> tuple[list[list[float]], list[float]]:
    """Of at most four points those (three at most, apart in direction) whose nonnegative combination is nearest to ``goal``, and that combination."""
    best: tuple[float, list[list[float]], list[float]] = (sum(g * g for g in goal), [], [0.0] * len(goal))
    for some in (list(c) for k in (1, 2, 3) for c in itertools.combinations(points, k)):
        gram = [[sum(a * b for a, b in zip(x, y, strict=True)) for y in some] for x in some]
        try:
            w = solved(gram, [sum(a * b for a, b in zip(x, goal, strict=True)) for x in some])
        except ZeroDivisionError:  # one of them is a multiple of another
            continue
        at = [sum(v * x[d] for v, x in zip(w, some, strict=True)) for d in range(len(goal))]
        away = sum((a - g) ** 2 for a, g in zip(at, goal, strict=True))
        if min(w) >= 0 and away < best[0] - 1e-15:
            best = away, some, at
    return best[1], best[2]


def nearest(table: DataFrame, goal: list[float], rounds: int = 40) -> list[float]:
    """The point nearest to ``goal``, by least squares, of all that nonnegative rates can reach.

    Active sets: the document whose posterior lies farthest towards what is
    missing joins the (at most three) that hold the point, until none does any
    more. One pass a round; three rounds or four are usual.
    """
    p, held, at = [f"p_{d}" for d in DOMAINS], [], [0.0] * len(DOMAINS)
    for _ in range(rounds):
        missing = [g - a for g, a in zip(goal, at, strict=True)]
        towards = " + ".join(f"{c} * {m!r}D" for c, m in zip(p, missing, strict=True))
        found = table.where("n_tokens > 0").agg(F.max(F.struct(F.expr(towards).alias("v"), *p)).alias("x")).first()["x"]
        if found is None or found["v"] <= 1e-9:
            break
        held, point = combined([*held, [found[c] for c in p]], goal)
        if max(abs(a - b) for a, b in zip(point, at, strict=True)) < 1e-12:
            break
        at = point
    return at


def mixed_rates(spark: SparkSession, documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most_steps: int = 40, close: float = 1e-4, shares: dict[str, float] | None = None, total: float = 1.0) -> DataFrame:
    """``doc_id, n_tokens, p_clean, p_low, p_toxic, rate`` for each row of ``documents``.

    ``targets``: expected tokens of each domain as multiples of what is there
    now. ``shares`` in its place: each domain's share of the expected output,
    of ``total`` times the tokens that are there now. Where no rates meet the
    targets, the nearest totals by least squares take their place, and a warning
    tells the gaps. Steps end when every gap to what can be met is below
    ``close`` of its domain's tokens, or with a warning when gaps do not change
    any more or ``most_steps`` are over.

    Null and empty texts have no tokens, the prior as posterior, and a rate like
    any other. Repeated rows each count. Duplicate labels of a document: the
    worst holds. Empty tables give no rows.
    """
    targets = targets or TARGETS
    table = Scratch(spark, "mixing").table("posteriors", posteriors(documents, fitted(spark, documents, labels)))
    p = [f"p_{d}" for d in DOMAINS]
    sums = table.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col(a)).alias(a) for a in p), *(F.sum(F.col("n_tokens") * F.col(p[i]) * F.col(p[j])).alias(f"h{i}{j}") for i in range(3) for j in range(3))).first()
    if not sums["n"]:
        return table.withColumn("rate", F.lit(1.0))
    share = [sums[a] / sums["n"] for a in p]
    goal = [shares[d] / sum(shares.values()) * total if shares else targets[d] * s for d, s in zip(DOMAINS, share, strict=True)]
    weight = [1 / max(s, 1e-9) for s in share]
    met = nearest(table, goal)
    if max(abs(a - b) * w for a, b, w in zip(met, goal, weight, strict=True)) > close:
        warnings.warn(f"no rates meet the targets; gaps remain: {dict(zip(DOMAINS, [a - b for a, b in zip(met, goal, strict=True)], strict=True))}", stacklevel=2)
        goal = met
    # Preconditioned by the inverse of this matrix, gradient steps have a constant of one, and none of them is slow.
    h = [[sums[f"h{i}{j}"] / sums["n"] * (1 + RIDGE * (i == j)) + RIDGE * RIDGE * (i == j) for j in range(3)] for i in range(3)]
    steps, now, last = [], share, None
    for _ in range(most_steps):
        gap = [a - b for a, b in zip(now, goal, strict=True)]
        relative = [abs(g) * w for g, w in zip(gap, weight, strict=True)]
        if max(relative) < close:
            break
        if last is not None and max(abs(a - b) for a, b in zip(relative, last, strict=True)) < close * STILL:
            warnings.warn(f"the gaps stand still: {dict(zip(DOMAINS, gap, strict=True))}", stacklevel=2)
            break
        last = relative
        steps.append(tuple(solved(h, gap)))
        got = table.withColumn("r", rate_of(steps)).agg(*(F.sum(F.col("r") * F.col("n_tokens") * F.col(a)) for a in p)).first()
        now = [x / sums["n"] for x in got]
    else:
        warnings.warn(f"not settled in {most_steps} steps; gaps remain: {dict(zip(DOMAINS, [a - b for a, b in zip(now, goal, strict=True)], strict=True))}", stacklevel=2)
    return table.withColumn("rate", rate_of(steps))


def realised(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of ``documents``, each as often as its rate says: the whole part, and once more with the rest as probability (by a hash of the id)."""
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(1 << 30)
    copies = rates.groupBy("doc_id").agg(F.max("rate").alias("rate")).select(F.col("doc_id").alias("_mixed_id"), F.floor(F.col("rate") + u).cast("int").alias("_mix_copies")).where("_mix_copies > 0").hint("merge")
    out = documents.join(copies, F.col("doc_id").eqNullSafe(F.col("_mixed_id")))
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*(documents[f"`{c}`"] for c in documents.columns))
