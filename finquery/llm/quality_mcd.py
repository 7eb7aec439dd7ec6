"""Quality rules: fixed text rules, then robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics. For each (language,
source) a minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps over *all* its documents: distances under the
current estimate are dealt into fixed logarithmic bins, each bin carries its
count and moments (summed before any shuffle), and the nearest bins that hold
at least ``share`` of the documents give the next estimate. Two deterministic
starts are followed (coordinate scales, and spatial signs); the smaller
determinant wins; a reweighting step follows. A document is rejected when its
squared Mahalanobis distance exceeds ``cutoff``.

No step gathers a group: a step's shuffle holds at most one row for each task,
group and bin. Groups below ``least`` documents are pooled by language, and
where that is still too few, over everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, with_columns_of
from finquery.llm.words import U64, Words, covered, mixed, slices, window_hashes, window_starts

SPACE, SYMBOLS, UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
MARKS = b"!?;:=+@^~_{}[]()/\\\""
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
FEATURES = ("x0", "x1", "x2", "x3", "x4", "x5")
D, BINS, PER_E = len(FEATURES), 640, 40
#: Least scale of each feature: keeps scatter invertible where a statistic hardly varies.
FLOORS = (0.25, 0.05, 0.05, 0.05, 0.05, 0.25)
WINDOW, FEW_WORDS, REPEAT_PERCENT = 8, 20, 30


def repeat_words(words: Words) -> np.ndarray:
    """For each text, the words in 8-word windows that the text holds twice or more."""
    ids, ends = words.ids, words.ends
    starts, doc = window_starts(ends, WINDOW)
    if not len(starts):
        return np.zeros(len(ends) - 1, dtype=np.int64)
    keys = window_hashes(words.hashes(), WINDOW, 0x9E3779B97F4A7C15)[starts] ^ mixed(doc.astype(U64) + U64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    equal = doc[order[:-1][same]] == doc[order[1:][same]]
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    found = np.zeros(len(ids), dtype=bool)
    found[a[equal]] = found[b[equal]] = True
    if not equal.all():  # hash values met: compare all windows of those hash values by their words
        seen: dict[tuple, int] = {}
        for k in np.flatnonzero(np.isin(keys, keys[order[1:][same]][~equal])):
            p, q = starts[k], seen.setdefault((doc[k], *ids[starts[k] : starts[k] + WINDOW]), starts[k])
            if q != p:
                found[[p, q]] = True
    hit = covered(np.flatnonzero(found), WINDOW, len(ids))
    return np.concatenate([[0], np.cumsum(hit)])[ends[1:]] - np.concatenate([[0], np.cumsum(hit)])[ends[:-1]]


def text_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words, texts = Words(batch.column("text")), [t or b"" for t in batch.column("text").cast("binary").to_pylist()]
                lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
                count = lambda drop: [len(t) - len(t.translate(None, drop)) for t in texts]
                found = [np.diff(words.ends), [len(t.translate(None, CONTINUATION + SPACE)) for t in texts], count(SYMBOLS), [len(x) - len(set(x)) for x in lines], repeat_words(words), count(UPPER), count(MARKS), [len(x) for x in lines]]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(x, pa.int64()) for x in found], ["doc_id", "lang", "source", *COUNTS])

    rows = with_columns_of(documents, doc_id="long", lang="string", source="string", text="string")
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def transformed(counts: DataFrame) -> DataFrame:
    """The statistic vector: logarithms of sizes, square roots of shares (0 where a text has no words)."""
    root = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), root("n_symbols", "word_chars"), root("n_upper", "word_chars"), root("n_marks", "word_chars"), root("n_dup_lines", "n_lines")]
    return counts.withColumns(dict(zip(FEATURES, (v.cast("double") for v in x), strict=True)))


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns ``m`` (centre) and ``f`` (rows of a whitening factor)."""
    dev = [F.col(x) - F.col("m")[k] for k, x in enumerate(FEATURES)]
    rows = [reduce(lambda a, b: a + b, [F.col("f")[j * D + k] * dev[k] for k in range(j + 1)]) for j in range(D)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def _moments() -> list[Column]:
    return [F.count("*").cast("double").alias("n"), *(F.sum(x).alias(f"s_{x}") for x in FEATURES), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i in range(D) for j in range(i + 1))]


def _estimate(sums: pd.Series, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    n, mean = sums["n"], np.array([sums[f"s_{x}"] for x in FEATURES]) / sums["n"]
    cov = np.empty((D, D))
    for i in range(D):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = sums[f"p{i}{j}"] / n - mean[i] * mean[j]
    cov = cov * scale + np.diag(np.square(FLOORS))
    return mean, np.linalg.inv(np.linalg.cholesky(cov)), float(np.linalg.slogdet(cov)[1])


def chi_square(p: float) -> float:
    """Quantile of chi-square with D degrees (Wilson and Hilferty)."""
    from statistics import NormalDist

    return D * (1 - 2 / (9 * D) + NormalDist().inv_cdf(p) * (2 / (9 * D)) ** 0.5) ** 3


PARAMS = "grp string, start int, m array<double>, f array<double>, det double"


def mcd_distances(work: Scratch, rows: DataFrame, share: float = 0.75, steps: int = 5, least: int = 60) -> DataFrame:
    """``rows`` (a written table with the features) with ``grp`` and ``d2``, the robust squared distance."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n_group"))
    by_lang = sizes.where(F.col("n_group") < least).groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n_group").alias("n_lang"))
    groups = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.when(F.col("n_group") >= least, F.concat_ws("/", name(F.col("lang")), name(F.col("source")))).when(F.col("n_lang") >= least, F.concat(name(F.col("lang")), F.lit("/*"))).otherwise("*").alias("grp"),
    )
    groups = work.table("groups", groups)
    rows = work.table("grouped", rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source"))

    marks = rows.groupBy("grp").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in FEATURES))
    spread = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(f)) for x, f in zip(FEATURES, FLOORS, strict=True)]
    first = marks.select("grp", F.lit(0).alias("start"), F.array(*(F.col(x)[1] for x in FEATURES)).alias("m"), F.array(*(1 / spread[j] if j == k else F.lit(0.0) for j in range(D) for k in range(D))).alias("f"), F.lit(0.0).alias("det"))
    params = work.table("start0", first)

    def signs(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        s = np.array([[one[f"q{max(i, j)}{min(i, j)}"] for j in range(D)] for i in range(D)]) / one["n"] + np.eye(D) * 0.02
        back = np.linalg.inv(np.linalg.cholesky(s)) @ np.asarray(one["f"]).reshape(D, D)
        root = np.linalg.cholesky(np.linalg.inv(back.T @ back))  # lower triangular again
        return pd.DataFrame([{"grp": one["grp"], "start": 1, "m": list(one["m"]), "f": list(np.linalg.inv(root).ravel()), "det": 0.0}])

    z = [(F.col(x) - F.col("m")[k]) * F.col("f")[k * D + k] for k, x in enumerate(FEATURES)]
    norm = F.greatest(reduce(lambda a, b: a + b, [v * v for v in z]), F.lit(1e-9))
    sums = rows.join(params, "grp").groupBy("grp").agg(F.count("*").cast("double").alias("n"), F.first("m").alias("m"), F.first("f").alias("f"), *(F.sum(z[i] * z[j] / norm).alias(f"q{i}{j}") for i in range(D) for j in range(i + 1)))
    params = work.table("start1", params.unionByName(sums.groupBy("grp").applyInPandas(signs, PARAMS)))

    def concentrate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin").reset_index(drop=True)
        total = part.drop(columns=["grp", "start", "bin"]).cumsum()
        mean, factor, det = _estimate(total.iloc[int(np.searchsorted(total["n"], share * total["n"].iloc[-1]))])
        return pd.DataFrame([{"grp": part["grp"][0], "start": int(part["start"][0]), "m": list(mean), "f": list(factor.ravel()), "det": det}])

    bin_of = F.least(F.floor(PER_E * F.log1p(F.col("d2"))), F.lit(BINS - 1)).cast("int")
    for k in range(steps):
        binned = rows.join(params, "grp").withColumn("d2", _distance()).withColumn("bin", bin_of).groupBy("grp", "start", "bin").agg(*_moments())
        params = work.table(f"step{k}", binned.groupBy("grp", "start").applyInPandas(concentrate, PARAMS))
    best = params.groupBy("grp").agg(F.min_by(F.struct("m", "f"), F.struct("det", "start")).alias("b")).select("grp", "b.m", "b.f")

    def consistent(found: DataFrame, name: str) -> DataFrame:
        """Scaled so that the median distance is that of a normal law. The medians are a table, so that Spark knows its few bytes and need not sort all rows by group."""
        mid = work.table(name, found.groupBy("grp").agg((F.percentile_approx("d2", 0.5, 2000) / chi_square(0.5)).alias("mid")))
        return found.join(mid, "grp").withColumn("d2", F.col("d2") / F.greatest(F.col("mid"), F.lit(1e-6))).drop("mid")

    best = work.table("best", best)
    raw = consistent(rows.join(best, "grp").withColumn("d2", _distance()).drop("m", "f"), "mid0")
    final = lambda part: pd.DataFrame([{"grp": part["grp"].iloc[0], **dict(zip(("m", "f"), (list(x.ravel()) for x in _estimate(part.drop(columns="grp").iloc[0])[:2]), strict=True))}])
    kept = work.table("final", raw.where(F.col("d2") <= chi_square(0.975)).groupBy("grp").agg(*_moments()).groupBy("grp").applyInPandas(final, "grp string, m array<double>, f array<double>"))
    return consistent(rows.join(kept, "grp").withColumn("d2", _distance()).drop("m", "f"), "mid1")


def quality_rules(spark: SparkSession, documents: DataFrame, cutoff: float = 150.0, share: float = 0.75, steps: int = 5, least: int = 60) -> DataFrame:
    """One row for each row of ``documents``: the counts, ``base_failed``, ``d2``, ``kept``.

    A text that is null, empty or without words fails the base rules. Null
    languages or sources form groups of their own. Repeated rows count as rows.
    An empty table gives no rows. Other columns are ignored.
    """
    work = Scratch(spark, "quality")
    rows = work.table("counts", transformed(text_counts(documents)))
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    judged = work.table("judged", mcd_distances(work, rows.where("not base_failed"), share, steps, least).select("doc_id", *COUNTS, "base_failed", "grp", "d2"))
    out = judged.unionByName(rows.where("base_failed").select("doc_id", *COUNTS, "base_failed"), allowMissingColumns=True)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))
