"""URL filters: host-and-path rules matched by a sort-merge range join, in DataFrame operations only.

The canonical key of a rule is its reversed host (``org.example`` for
``example.org``), a separator, and its path, so the rules that fit a URL under
one of its hosts are exactly the keys that are prefixes of the URL's key: each
rule is an interval of keys, and intervals nest or are disjoint. URLs stand in
the order once for each host they belong to (the host and its parent domains).

Rules and URLs are sorted together by ranges of the key (salted, so one URL
repeated over a third of all rows fills many ranges). A sweep carries, for each
key, the stack of nested rules open at the latest rule before it, within its
range by a window, across ranges by a carry of one row a range; the deepest
rule of the stack that is a prefix of the key is the longest that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, with_columns_of

CUT = "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``(verdict, rule)``; a rule is a host and a path that begins at the first ``/``.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.", -1)))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``verdict, host, path, rule`` of ``(verdict, rule)`` pairs."""
    given = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules)).cast("array<struct<verdict:string,rule:string>>")
    return spark.range(1).select(F.inline(given)).select("verdict", F.substring_index("rule", "/", 1).alias("host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "rule")


def stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: for each rule the nested rules open at its start, outermost first, itself last."""
    keyed = rules.select(F.concat(reversed_host(F.translate("host", UPPER, LOWER)), F.lit(CUT), "path").alias("key"), "rule", "verdict").groupBy("key").agg(F.min_by(F.struct("rule", "verdict"), F.struct("verdict", "rule")).alias("r"))
    prefixes = keyed.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.col("key").substr(F.lit(1), n))).alias("outer_key"))
    outer = keyed.select(F.col("key").alias("outer_key"), F.struct(F.col("key"), F.col("r.rule"), F.col("r.verdict")).alias("open"))
    return prefixes.join(outer, "outer_key").groupBy("key").agg(F.array_sort(F.collect_list("open")).alias("stack"))  # prefixes sort by length


def url_rules(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (``page_id, url``).

    Null urls and urls without ``://`` have an empty host and path, no rule and
    the default verdict. Repeated rows each give a row. Equal rules with two
    verdicts: allow. An empty table, or no rules, is served; other columns are
    ignored.
    """
    work = Scratch(spark, "urls")
    urls = with_columns_of(pages, page_id="long", url="string").select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.", -1)
    under = urls.withColumn("labels", labels).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("labels")))).select("row", "page_id", "host", "path", F.concat(reversed_host(F.concat_ws(".", F.expr("slice(labels, n, size(labels))"))), F.lit(CUT), "path").alias("key"), F.lit(1).alias("kind"))
    both = under.unionByName(stacks(rules).withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("salt", F.xxhash64("row"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = work.table("sorted", both.repartitionByRange(ranges, "key", "kind", "salt").withColumn("range", F.spark_partition_id()))

    latest = swept.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("latest"))
    every = spark.range(ranges).select(F.col("id").cast("int").alias("range"))
    carried = every.join(latest, "range", "left").select("range", F.last("latest", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))  # one row a range
    here = F.last("stack", True).over(Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = swept.withColumn("here", here).where("kind = 1").join(carried, "range").withColumn("open", F.coalesce("here", "carry"))
    fit = F.filter("open", lambda r: F.col("key").startswith(r["key"]))
    best = seen.withColumn("fit", F.try_element_at(fit, F.lit(-1))).groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max_by("fit", F.struct(F.length("fit.rule"), "fit.rule")).alias("fit"))
    return best.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
