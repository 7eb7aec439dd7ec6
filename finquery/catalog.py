"""All queries of the engine by name, and their SQL twins.

The twins say what a query returns in another dialect and by other means (the
amounts, for instance, come from the integers they were written from).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery import refdata as R
from finquery.config import Settings
from finquery.functions import amounts as A
from finquery.functions import text as X
from finquery.operators import candidates as C
from finquery.operators import dataset, derive, markdown, pages, project, recover, resolve
from finquery.operators.eligibility import labelled, priority, rejection_reasons
from finquery.plans import lifecycle
from finquery.plans.synthetic import CODES, ORDER, WRONG_LABEL, candidates, candidates_sql, choice, written
from finquery.shared import shared_folder
from finquery.sources import connector, payload
from finquery.streaming import job_table, jobs, live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CENTS, FORM = "CAST(round(l_extendedprice * 100) AS BIGINT)", "(l_orderkey + l_linenumber) % 6"
SPARSE, DENSE = candidates_sql("lineitem", "l_orderkey"), candidates_sql("lineitem", "l_suppkey")
AMOUNT_SQL = "CAST(CAST(cents AS DECIMAL(24,4)) / 100 AS DECIMAL(24,4))"
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# --- Scalars -------------------------------------------------------------------------------------------------------


@query(f"SELECT {LINE}, CAST(CAST(CASE WHEN {FORM} IN (3, 4) THEN -{CENTS} ELSE {CENTS} END AS DECIMAL(20,0)) / 100 AS DECIMAL(24,4)) AS amount FROM lineitem")
def amount_parse_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*LINE.split(", "), A.parse_decimal_amount(F.expr(written(CENTS, FORM))).alias("amount"))


@query(f"SELECT {LINE}, abs(CAST(l_linenumber AS DECIMAL(24,4)) - 3) * 2 <= greatest(1.0, {CENTS} / 100 * 0.0001) AS agree, CAST(greatest(CAST(1 AS DECIMAL(29,8)), CAST({CENTS} AS DECIMAL(20,0)) * CAST(0.000001 AS DECIMAL(7,6))) AS DECIMAL(29,8)) AS tolerance FROM lineitem")
def amount_agree_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = (F.expr(CENTS).cast("decimal(24,4)") / 100).cast(A.AMOUNT)
    other = (amount + (F.col("l_linenumber") - 3) * 2).cast(A.AMOUNT)
    return table(spark, sf_dir, "lineitem").select(*LINE.split(", "), A.amounts_agree(amount, other).alias("agree"), A.tolerance(amount).cast("decimal(29,8)").alias("tolerance"))


def folded_sql(text: str, marks: str) -> str:
    plain = f"regexp_replace(lower(strip_accents(coalesce({text}, ''))), '{marks}', ' ', 'g')" if marks else f"lower(strip_accents(coalesce({text}, '')))"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({folded_sql('text', '[^\\p{L}\\p{N}_\\s]')}) AS label_md5 FROM documents")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_ocr_label(F.col("text"))).alias("label_md5"))


@query(f"SELECT doc_id, md5({folded_sql('text', '[^a-z0-9\\s]+')}) AS folded_md5 FROM documents")
def fold_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold_ascii(F.col("text"))).alias("folded_md5"))


@query(f"SELECT doc_id, md5({folded_sql('text', '')}) AS folded_md5 FROM documents")
def fold_keep_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold_keep_marks(F.col("text"))).alias("folded_md5"))


ALIASES = ["small copper", "copper", "large blue steel box", "blue", "green box", "red", "steel", "standard tin", "economy brass case", "polished"]


@query(f"""
    WITH l AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM part),
    a(ord, alias) AS (VALUES {", ".join(f"({k}, '{a}')" for k, a in enumerate(ALIASES))}),
    t AS (SELECT *, list_distinct(string_split(label, ' ')) AS x, list_distinct(string_split(alias, ' ')) AS y FROM l, a),
    j AS (SELECT *, CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) AS jac, length(label)::DOUBLE AS n, length(alias)::DOUBLE AS m FROM t),
    s AS (SELECT label, ord, alias, CASE WHEN label = '' THEN 0 WHEN label = alias THEN 1 WHEN contains(label, alias) THEN 0.75 + 0.25 * (m / n) WHEN contains(alias, label) THEN CASE WHEN n / m >= 0.9 THEN 0.7 + 0.2 * (n / m) ELSE 0 END WHEN jac >= 0.5 THEN jac ELSE 0 END AS score FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS k FROM s)
    SELECT label, CASE WHEN score >= 0.7 THEN alias END AS code, round(score, 9) AS score FROM r WHERE k = 1""")
def label_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(X.normalize_label(F.col("p_name")).alias("label"))
    wordings = spark.createDataFrame([(k, a, a) for k, a in enumerate(ALIASES)], "ord int, code string, alias string")
    return markdown.best_wording(labels, "label", wordings).withColumn("score", F.round("score", 9))


PART_SQL = "trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
    WITH p AS (SELECT DISTINCT p_partkey, {PART_SQL} AS label, string_split({PART_SQL}, ' ') AS w FROM part), l AS (SELECT DISTINCT label FROM p),
    a AS (SELECT p_partkey AS ord, alias, alias AS code FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN w[1] || ' ' || w[len(w)] WHEN 1 THEN array_to_string(list_reverse(w), ' ') WHEN 2 THEN substr(label, 3, 9) ELSE label || ' x' END AS alias FROM p)),
    t AS (SELECT *, list_distinct(string_split(label, ' ')) AS x, list_distinct(string_split(alias, ' ')) AS y, length(label)::DOUBLE AS n, length(alias)::DOUBLE AS m FROM l, a),
    j AS (SELECT *, CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) AS jac FROM t),
    s AS (SELECT label, ord, code, CASE WHEN label = '' OR alias = '' THEN 0 WHEN label = alias THEN 1 WHEN contains(label, alias) THEN 0.75 + 0.25 * (m / n) WHEN contains(alias, label) THEN CASE WHEN n / m >= 0.9 THEN 0.7 + 0.2 * (n / m) ELSE 0 END WHEN jac >= 0.5 THEN jac ELSE 0 END AS score FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS k FROM s)
    SELECT label, CASE WHEN score >= 0.7 THEN code END AS code, round(score, 9) AS score FROM r WHERE k = 1""")
def label_similarity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All part names against as many wordings as there are parts, by the index."""
    parts = table(spark, sf_dir, "part").select("p_partkey", X.normalize_label(F.col("p_name")).alias("label")).withColumn("w", F.split("label", " "))
    alias = F.when(F.col("p_partkey") % 4 == 0, F.concat_ws(" ", F.col("w")[0], F.element_at("w", -1))).when(F.col("p_partkey") % 4 == 1, F.concat_ws(" ", F.reverse("w"))).when(F.col("p_partkey") % 4 == 2, F.substring("label", 3, 9)).otherwise(F.concat("label", F.lit(" x")))
    wordings = parts.select(F.col("p_partkey").alias("ord"), alias.alias("code"), alias.alias("alias"))
    return markdown.best_wording(parts, "label", wordings, most=0).withColumn("score", F.round("score", 9))


@query("SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_quantity) AS BIGINT) END) AS DECIMAL(24,4)) AS returned FROM lineitem GROUP BY l_orderkey")
def null_skipping_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("l_returnflag") == "R", F.round("l_quantity")).cast(A.AMOUNT)
    lines = [F.sum(F.when(F.col("l_linenumber") % 7 == k, amount)) for k in range(7)]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.null_skipping_sum(*lines).cast(A.AMOUNT).alias("returned"))


@query("SELECT o_orderkey, CAST(round(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS DECIMAL(24,4)) / (o_custkey % 7) END, 2) AS DECIMAL(24,2)) AS ratio FROM orders")
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = A.safe_divide(F.col("o_orderkey").cast("decimal(18,0)"), (F.col("o_custkey") % 7).cast("decimal(18,0)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", A.quantized(ratio, 2).cast("decimal(24,2)").alias("ratio"))


# --- Candidates ----------------------------------------------------------------------------------------------------

RAW_CODES = ["ca", " RN ", "TOTAL_GENERAL", "Capitaux_Propres", "STOCKS", "chiffre_d_affaires", "CLIENTS"]
RAW_PERIODS, RAW_ROLES, RAW_NATURES = ["n-1", "exercice precedent", "CURRENT", "2023", "N"], ["net", "totaux", "4", "exercice precedent", "brut", "whatever"], ["detail", "Grand_Total", "other"]


@query(f"""
    SELECT {LINE}, CASE l_partkey % 7 WHEN 0 THEN 'CHIFFRE_AFFAIRES' WHEN 1 THEN 'RESULTAT_NET' WHEN 2 THEN 'TOTAL_ACTIF' WHEN 3 THEN 'FONDS_PROPRES' WHEN 4 THEN 'STOCKS' WHEN 5 THEN 'CHIFFRE_AFFAIRES' ELSE 'CLIENTS' END AS code,
        CASE l_suppkey % 5 WHEN 0 THEN 'N_MINUS_1' WHEN 1 THEN 'N_MINUS_1' ELSE 'N' END AS period, CASE l_orderkey % 6 WHEN 0 THEN 'NET_N' WHEN 1 THEN 'TOTAL_EXERCICE_N' WHEN 2 THEN 'EXERCICE_N1' WHEN 3 THEN 'EXERCICE_N1' WHEN 4 THEN 'BRUT' ELSE 'UNKNOWN' END AS role,
        CASE l_linenumber % 3 WHEN 1 THEN 'GRAND_TOTAL' ELSE 'DETAIL' END AS nature, CASE WHEN l_linenumber % 4 = 0 THEN 0.7 ELSE l_linenumber / 10.0 END AS confidence FROM lineitem""")
def candidate_alias_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda key, n, values: F.expr(choice(f"{key} % {n}", values))
    weak = F.when(F.col("l_linenumber") % 4 == 0, 0.0).otherwise(F.col("l_linenumber") / 10)
    return table(spark, sf_dir, "lineitem").select(*LINE.split(", "), C.coerce_code(raw("l_partkey", 7, RAW_CODES)).alias("code"), C.coerce_period(raw("l_suppkey", 5, RAW_PERIODS)).alias("period"), C.coerce_role(raw("l_orderkey", 6, RAW_ROLES)).alias("role"), C.coerce_nature(raw("l_linenumber", 3, RAW_NATURES)).alias("nature"), C.coerce_confidence(weak).alias("confidence"))


@query(f"SELECT doc_id, seq, field_code, page_type FROM ({SPARSE}) WHERE (page_type = 'BILAN_ACTIF' AND field_code IN ('TOTAL_ACTIF', 'CLIENTS')) OR (page_type = 'CPC' AND field_code = 'RESULTAT_NET') OR page_type = 'BILAN_PASSIF'")
def candidate_allowlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("BILAN_ACTIF", "TOTAL_ACTIF"), ("BILAN_ACTIF", "CLIENTS"), ("CPC", "RESULTAT_NET")], "page_type string, field_code string")
    return C.allowed_only(candidates(spark, sf_dir), allowed).select("doc_id", "seq", "field_code", "page_type")


@query(f"SELECT doc_id, seq, field_code FROM ({SPARSE}) WHERE confidence >= 0.7 AND length(raw_value) <= 9")
def candidate_split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = C.split_valid(candidates(spark, sf_dir), (F.col("confidence") >= 0.7) & (F.length("raw_value") <= 9))
    return good.select("doc_id", "seq", "field_code")


FORM_SHAPE = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, seq, field_code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_code, period, {FORM_SHAPE.format('raw_label')}, {FORM_SHAPE.format('raw_value')} ORDER BY seq) AS k FROM ({DENSE})) WHERE k = 1")
def candidate_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only what the rows are told apart by: the rest would be made and carried for every line.
    return C.dedupe_candidates(candidates(spark, sf_dir, dense=True).select("doc_id", "seq", "field_code", "period", "raw_label", "raw_value")).select("doc_id", "seq", "field_code")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def doc_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_wins(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5")), [F.col("text_md5")], "doc_id")


IN_ROLE = {c: r for c, _, r, _ in CODES}
ROLE_SQL = "CASE " + " ".join(f"WHEN field_code = '{c}' THEN '{r}'" for c, r in IN_ROLE.items()) + " END"
TWO_YEARS = "('CHIFFRE_AFFAIRES', 'RESULTAT_NET', 'FONDS_PROPRES', 'TOTAL_ACTIF', 'TOTAL_PASSIF')"
BROKEN_SQL = f"""
    CASE WHEN period = 'N_MINUS_1' AND field_code NOT IN {TWO_YEARS} THEN ['E3'] ELSE list_filter([
        CASE WHEN period = 'N_MINUS_1' AND column_role <> 'EXERCICE_N1' THEN 'E4' END,
        CASE WHEN period = 'N' AND page_type = 'BILAN_ACTIF' AND column_role <> {ROLE_SQL} THEN 'E5' END,
        CASE WHEN period = 'N' AND page_type = 'BILAN_PASSIF' AND column_role <> {ROLE_SQL} THEN 'E6' END,
        CASE WHEN period = 'N' AND page_type = 'CPC' AND column_role <> {ROLE_SQL} THEN 'E7' END,
        CASE WHEN field_code IN ('TOTAL_ACTIF', 'TOTAL_PASSIF') AND NOT (nature = 'GRAND_TOTAL' AND raw_label LIKE 'Total%I+II+III') THEN 'E9' END,
        CASE WHEN field_code = 'CLIENTS' AND raw_label = '{WRONG_LABEL}' THEN 'E11' END,
        CASE WHEN field_code = 'CHIFFRE_AFFAIRES' AND raw_label = '{WRONG_LABEL}' THEN 'E16' END], lambda x: x IS NOT NULL) END"""


@query(f"SELECT doc_id, seq, array_to_string({BROKEN_SQL}, ',') AS reasons FROM ({SPARSE})")
def candidate_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(candidates(spark, sf_dir)).withColumn("section", F.col("page_type")).select("doc_id", "seq", F.array_join(rejection_reasons(), ",").alias("reasons"))


HINTED = "(('CLIENTS', 'Clients et comptes rattachés'), ('CHIFFRE_AFFAIRES', 'Chiffre d''affaires'), ('FONDS_PROPRES', 'Total des capitaux propres'), ('TRESORERIE_ACTIF', 'Total trésorerie-actif'), ('TRESORERIE_PASSIF', 'Total III trésorerie-passif'), ('CHARGES_FINANCIERES', 'Charges financières'))"
POINTS_SQL = f"""
    CASE nature WHEN 'GRAND_TOTAL' THEN 400.0 WHEN 'SECTION_TOTAL' THEN 300.0 WHEN 'SUBTOTAL' THEN 200.0 ELSE 100.0 END::DOUBLE + confidence * 20.0::DOUBLE
    + CASE WHEN field_code NOT IN ('PRODUITS_FINANCIERS', 'CHARGES_FINANCIERES') THEN 100.0 ELSE 0 END::DOUBLE + 80.0::DOUBLE
    + CASE WHEN (period = 'N' AND column_role IN ('NET_N', 'EXERCICE_N', 'TOTAL_EXERCICE_N')) OR (period = 'N_MINUS_1' AND column_role = 'EXERCICE_N1') THEN 60.0 ELSE 0 END::DOUBLE
    + CASE WHEN (field_code, raw_label) IN {HINTED} THEN 50.0 ELSE 0 END::DOUBLE + CASE WHEN field_code = 'CHIFFRE_AFFAIRES' AND raw_label LIKE 'Chiffre%' THEN 40.0 ELSE 0 END::DOUBLE
    + CASE WHEN field_code = 'RESULTAT_NET' THEN 30.0 ELSE 0 END::DOUBLE - CASE WHEN field_code = 'CHARGES_FINANCIERES' THEN least(page_number, 20) * 0.5 ELSE 0 END::DOUBLE"""


@query(f"SELECT doc_id, seq, round({POINTS_SQL}, 6) AS points, CAST(row_number() OVER (PARTITION BY doc_id, field_code ORDER BY {POINTS_SQL} DESC, seq) AS INT) AS place FROM ({SPARSE})")
def candidate_priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(candidates(spark, sf_dir)).withColumn("section", F.col("page_type")).withColumn("priority", priority())
    return rows.select("doc_id", "seq", F.round("priority", 6).alias("points"), F.row_number().over(Window.partitionBy("doc_id", "field_code").orderBy(F.desc("priority"), "seq")).alias("place"))


PICK_SQL = f"""
    WITH e AS (SELECT *, CASE WHEN period = 'N_MINUS_1' AND field_code IN ('CHIFFRE_AFFAIRES', 'RESULTAT_NET', 'FONDS_PROPRES') THEN concat(field_code, '_N1') ELSE field_code END AS key, {POINTS_SQL} AS points, {AMOUNT_SQL} AS amount FROM ({{}}) WHERE len({BROKEN_SQL}) = 0),
    t AS (SELECT *, max(points) OVER (PARTITION BY doc_id, key) AS top FROM e)
    SELECT doc_id, key, CASE WHEN count(DISTINCT CASE WHEN top - points <= 5 THEN amount END) > 1 THEN NULL ELSE arg_min(amount, (-points, seq)) END AS value, CASE WHEN count(DISTINCT CASE WHEN top - points <= 5 THEN amount END) > 1 THEN 'conflicting' ELSE 'confirmed' END AS status, count(*) AS n_ranked FROM t GROUP BY doc_id, key"""


def picks(spark: SparkSession, sf_dir: str, dense: bool) -> DataFrame:
    rows = C.keyed(candidates(spark, sf_dir, dense).withColumn("section", F.col("page_type")))
    return resolve.picked(resolve.ranked(rows), "doc_id", "key").select("doc_id", "key", "value", "status", "n_ranked")


@query(PICK_SQL.format(DENSE))
def pick_best_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks(spark, sf_dir, dense=True)


@query(PICK_SQL.format(SPARSE))
def pick_best_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks(spark, sf_dir, dense=False)


@query(PICK_SQL.split("    SELECT doc_id, key, CASE")[0].format(DENSE) + """, p AS (SELECT doc_id, key, count(DISTINCT CASE WHEN top - points <= 5 THEN amount END) > 1 AS clash, arg_min(seq, (-points, seq)) AS best FROM t GROUP BY doc_id, key)
    SELECT doc_id, key AS code, CAST(row_number() OVER (PARTITION BY doc_id, key ORDER BY seq) - 1 AS INT) AS place, seq, field_code, page_number, raw_label, raw_value, column_role, confidence FROM t JOIN p USING (doc_id, key) WHERE CASE WHEN clash THEN top - points <= 5 ELSE seq = best END""")
def value_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that each pick rests on, found again by its sources."""
    rows = C.keyed(candidates(spark, sf_dir, dense=True).withColumn("section", F.col("page_type")))
    chosen = resolve.picked(resolve.ranked(rows), "doc_id", "key").withColumnRenamed("key", "code")
    return resolve.provenance(chosen, rows)


@query(f"SELECT doc_id, seq, page_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, page_type ORDER BY seq) AS k FROM ({DENSE})) WHERE k <= CASE page_type WHEN 'CPC' THEN 40 ELSE 30 END")
def candidate_list_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    within, _ = C.capped(candidates(spark, sf_dir, dense=True))
    return within.select("doc_id", "seq", "page_type")


@query(f"SELECT l_orderkey, l_partkey, CASE WHEN min({CENTS}) = max({CENTS}) THEN CAST(CAST(min({CENTS}) AS DECIMAL(20,0)) / 100 AS DECIMAL(24,4)) END AS value, CASE WHEN min({CENTS}) = max({CENTS}) THEN 'confirmed' ELSE 'conflicting' END AS status, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey")
def distinct_amount_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("amount", (F.expr(CENTS).cast("decimal(20,0)") / 100).cast(A.AMOUNT))
    return markdown.amount_conflicts(lines, "l_orderkey", "l_partkey")


HEADINGS = ["Net", "Exercice précédent", "Brut", "Totaux de l'exercice", "3 = 1 + 2", "Exercice", "4", "Opérations"]
HEADED_SQL = f"""
    SELECT *, CASE
        WHEN page_type = 'CPC' AND h IN (3, 4) THEN 'TOTAL_EXERCICE_N' WHEN page_type = 'CPC' AND h IN (1, 6) THEN 'EXERCICE_N1' WHEN page_type = 'BILAN_ACTIF' AND h = 0 THEN 'NET_N' WHEN page_type = 'BILAN_ACTIF' AND h = 1 THEN 'EXERCICE_N1' WHEN page_type = 'BILAN_ACTIF' AND h = 2 THEN 'BRUT'
        WHEN page_type = 'BILAN_PASSIF' AND h = 1 THEN 'EXERCICE_N1' WHEN page_type = 'BILAN_PASSIF' AND h IN (3, 5) THEN 'EXERCICE_N' ELSE column_role END AS role FROM (SELECT *, seq % 8 AS h FROM ({SPARSE}))"""


@query(f"""SELECT doc_id, seq, role, p AS period, CASE WHEN p = 'N_MINUS_1' AND field_code IN ('CHIFFRE_AFFAIRES', 'RESULTAT_NET', 'FONDS_PROPRES') THEN concat(field_code, '_N1') ELSE field_code END AS key
    FROM (SELECT *, CASE WHEN role = 'EXERCICE_N1' THEN 'N_MINUS_1' WHEN role IN ('NET_N', 'EXERCICE_N', 'TOTAL_EXERCICE_N') THEN 'N' ELSE period END AS p FROM ({HEADED_SQL}))""")
def role_period_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumns({"section": F.col("page_type"), "column_name": F.expr(choice("seq % 8", HEADINGS))})
    return C.keyed(C.period_from_role(C.role_from_heading(rows))).select("doc_id", "seq", F.col("column_role").alias("role"), "period", "key")


@query(f"""SELECT doc_id, seq, CASE WHEN field_code IN ('TOTAL_ACTIF', 'TOTAL_PASSIF') AND raw_label LIKE 'Total%I+II+III' THEN 'GRAND_TOTAL' WHEN field_code IN ('TOTAL_ACTIF', 'TOTAL_PASSIF') THEN 'GRAND_TOTAL' WHEN field_code IN ('ACTIFS_IMMOBILISES', 'ACTIF_CIRCULANT', 'FONDS_PROPRES', 'TRESORERIE_ACTIF', 'TRESORERIE_PASSIF') AND nature = 'DETAIL' THEN 'SECTION_TOTAL' ELSE nature END AS nature,
    CASE WHEN column_role = 'UNKNOWN' THEN CASE WHEN period = 'N_MINUS_1' THEN 'EXERCICE_N1' ELSE {ROLE_SQL} END ELSE column_role END AS role FROM ({SPARSE})""")
def candidate_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair(candidates(spark, sf_dir)).select("doc_id", "seq", "nature", F.col("column_role").alias("role"))


def label_sql(label: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({label})), '[^a-z0-9_]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH c AS (SELECT *, {label_sql("raw_label")} AS label, {label_sql("raw_value")} AS amount FROM ({SPARSE})), o AS (SELECT *, max(seq) OVER (PARTITION BY doc_id, field_code, label, amount) AS last, min(seq) OVER (PARTITION BY doc_id, label, amount) AS first FROM c)
    SELECT doc_id, seq, CAST(CASE WHEN seq % 2 = 0 THEN last ELSE first END AS INT) AS origin FROM o""")
def provenance_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original of a value: by code, label and value the last row; where the code is unknown, by label and value the first."""
    rows = candidates(spark, sf_dir).select("doc_id", "seq", "field_code", "raw_label", "raw_value")
    written = F.when(F.col("seq") % 3 == 0, F.concat(F.upper("raw_label"), F.lit("  !"))).otherwise(F.col("raw_label"))
    asked = rows.withColumns({"field_code": F.when(F.col("seq") % 2 == 0, F.col("field_code")).otherwise("OTHER"), "raw_label": written, "raw_value": F.concat(F.lit(" "), "raw_value")})
    return resolve.originals(asked, rows).select("doc_id", "seq", "origin")


# --- Fields of a document ------------------------------------------------------------------------------------------


def sums_sql(*cases: str) -> str:
    return f"SELECT l_orderkey AS doc_id, {', '.join(cases)} FROM lineitem GROUP BY l_orderkey"


def part_sum(name: str, test: str) -> str:
    return f"CAST(sum(CASE WHEN {test} THEN CAST({CENTS} AS DECIMAL(20,0)) END) / 100 AS DECIMAL(24,4)) AS {name}"


def field_struct(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), resolve.fv(F.col(name), "confirmed", F.lit(0.9)))


def wide_fields(spark: SparkSession, sf_dir: str, tests: dict[str, str]) -> DataFrame:
    """Documents (orders) with one struct a field: the sum of the lines that a test takes, null without such a line; all other fields null."""
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*((F.sum(F.when(F.expr(t), F.expr(CENTS).cast("decimal(20,0)"))) / 100).cast(A.AMOUNT).alias(f"s_{c}") for c, t in tests.items()))
    return made.select("doc_id", *(field_struct(f"s_{c}").alias(c) if c in tests else F.lit(None).cast(resolve.FV).alias(c) for c in resolve.FIELDS))


THREE = {"ACTIFS_IMMOBILISES": "l_linenumber % 3 = 0", "ACTIF_CIRCULANT": "l_linenumber % 3 = 1", "TRESORERIE_ACTIF": "l_linenumber % 3 = 2"}


@query(f"SELECT doc_id, a + b + c AS total FROM ({sums_sql(part_sum('a', 'l_linenumber % 3 = 0'), part_sum('b', 'l_linenumber % 3 = 1'), part_sum('c', 'l_linenumber % 3 = 2'))})")
def section_sum_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_fields(spark, sf_dir, THREE)
    return wide.select("doc_id", resolve.section_total([F.col(c) for c in resolve.SECTION_PARTS])["value"].alias("total"))


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN l IS NULL THEN 'derived' WHEN abs(o - l) <= greatest(1, abs(o) * 0.0001) THEN 'confirmed' ELSE 'conflicting' END AS status, CASE WHEN l IS NULL OR abs(o - l) <= greatest(1, abs(o) * 0.0001) THEN o END AS value
    FROM (SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS DECIMAL(20,0)) / 100 AS DECIMAL(24,4)) AS o FROM orders) LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST({CENTS} AS DECIMAL(20,0))) / 100 AS DECIMAL(24,4)) AS l FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def total_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(F.expr(CENTS).cast("decimal(20,0)")) / 100).cast(A.AMOUNT).alias("l"))
    both = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)") / 100).cast(A.AMOUNT).alias("o")).join(lines, F.col("doc_id") == F.col("l_orderkey"), "left")
    made = both.withColumn("f", resolve.reconciled(field_struct("o"), field_struct("l")))
    return made.select("doc_id", "f.status", "f.value")


NETS = {"RESULTAT_NET_XIII": "l_linenumber % 4 = 0", "RESULTAT_NET_XVI": "l_linenumber % 4 = 1", "NET_CPC": "l_linenumber % 4 = 2", "NET_BILAN": "l_linenumber % 4 = 3"}


@query(f"""WITH s AS ({sums_sql(*(part_sum(n, t) for n, t in zip('abcd', NETS.values(), strict=True)))}), g AS (SELECT *, abs(a - b) <= greatest(1, abs(a) * 0.0001) AS ab, abs(c - d) <= greatest(1, abs(c) * 0.0001) AS cd FROM s)
    SELECT doc_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN ab THEN a ELSE d END WHEN c IS NOT NULL AND d IS NOT NULL AND NOT cd THEN d ELSE coalesce(c, d) END AS value, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND NOT ab AND d IS NULL THEN 'conflicting' WHEN (a IS NOT NULL AND b IS NOT NULL) OR c IS NOT NULL OR d IS NOT NULL THEN 'confirmed' END AS status FROM g""")
def net_result_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*((F.sum(F.when(F.expr(t), F.expr(CENTS).cast("decimal(20,0)"))) / 100).cast(A.AMOUNT).alias(c) for c, t in NETS.items()))
    wide = made.select("doc_id", *(field_struct(c).alias(c) for c in NETS))
    return resolve.net_result(wide).select("doc_id", "RESULTAT_NET.value", "RESULTAT_NET.status")


#: Confidences of the four lines of a net result, and of three financial fields.
SURE = {"RESULTAT_NET_XIII": 0.6, "RESULTAT_NET_XVI": 0.99, "NET_CPC": 0.7, "NET_BILAN": 0.8}


def told(field: Column) -> list[Column]:
    """What a field says of itself."""
    return [field["value"].alias("value"), field["status"].alias("status"), field["confidence"].alias("confidence"), F.array_join(field["sources"], ",").alias("sources"), F.array_join(field["warnings"], ",").alias("warnings")]


@query(f"""WITH s AS ({sums_sql(*(part_sum(n, t) for n, t in zip('abcd', NETS.values(), strict=True)))}), g AS (SELECT *, abs(a - b) <= greatest(1, abs(a) * 0.0001) AS ab, abs(a - d) <= greatest(1, abs(a) * 0.0001) AS ad, abs(c - d) <= greatest(1, abs(c) * 0.0001) AS cd FROM s),
    k AS (SELECT *, CASE WHEN ab THEN CASE WHEN d IS NOT NULL AND NOT ad THEN 'agree_other' ELSE 'agree' END WHEN a + b IS NOT NULL THEN CASE WHEN d IS NOT NULL THEN 'sheet' ELSE 'clash' END WHEN cd THEN 'both' WHEN c + d IS NOT NULL THEN 'differ' WHEN c IS NOT NULL THEN 'c' WHEN d IS NOT NULL THEN 'd' END AS k FROM g)
    SELECT doc_id, CASE WHEN k LIKE 'agree%' THEN a WHEN k IN ('both', 'c') THEN c WHEN k IN ('sheet', 'differ', 'd') THEN d END AS value, CASE WHEN k = 'clash' THEN 'conflicting' WHEN k IS NOT NULL THEN 'confirmed' END AS status, CASE WHEN k LIKE 'agree%' OR k = 'clash' THEN 0.99 WHEN k = 'c' THEN 0.7 WHEN k IS NOT NULL THEN 0.8 END AS confidence,
        CASE WHEN k LIKE 'agree%' OR k = 'clash' THEN '1,2' WHEN k = 'both' THEN '3,4' WHEN k = 'c' THEN '3' WHEN k IS NOT NULL THEN '4' END AS sources, CASE WHEN k = 'agree_other' THEN 'balance_sheet_differs' WHEN k IN ('sheet', 'clash') THEN 'income_statement_lines_differ' WHEN k = 'differ' THEN 'income_statement_differs' WHEN k IS NOT NULL THEN '' END AS warnings FROM k""")
def net_result_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net result with its confidence, what it rests on and what speaks against it."""
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*((F.sum(F.when(F.expr(t), F.expr(CENTS).cast("decimal(20,0)"))) / 100).cast(A.AMOUNT).alias(c) for c, t in NETS.items()))
    wide = made.select("doc_id", *(F.when(F.col(c).isNotNull(), resolve.fv(F.col(c), "confirmed", F.lit(SURE[c]), F.array(F.lit(k)))).alias(c) for k, c in enumerate(NETS, 1)))
    return resolve.net_result(wide).select("doc_id", *told(F.col("RESULTAT_NET")))


OPERATING = "CASE WHEN l_linenumber = 1 THEN 'RESULTAT_COURANT' WHEN l_linenumber = 2 THEN 'CHIFFRE_AFFAIRES' ELSE 'RESULTAT_EXPLOITATION' END"


@query(f"""WITH c AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) AS seq, {OPERATING} AS key, 1 + l_linenumber AS page, CAST({CENTS} AS DECIMAL(20,0)) / 100 AS amount, l_partkey % 3 AS kind FROM lineitem),
    k AS (SELECT doc_id, arg_min(amount, seq) FILTER (key = 'CHIFFRE_AFFAIRES') AS ca, arg_min(amount, seq) FILTER (key = 'RESULTAT_COURANT') AS rc FROM c GROUP BY doc_id),
    f AS (SELECT c.*, rc FROM c JOIN k USING (doc_id) WHERE key = 'RESULTAT_EXPLOITATION' AND (ca IS NULL OR amount <= ca) AND (rc IS NULL OR rc = 0 OR abs(amount - rc) <= abs(rc) * 2.5 + 10000)),
    n AS (SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank FROM f), b AS (SELECT *, min(rank) OVER (PARTITION BY doc_id) AS best FROM n), p AS (SELECT *, min(page) OVER (PARTITION BY doc_id) AS first FROM b WHERE rank = best),
    d AS (SELECT *, abs(amount - rc) AS gap, min(abs(amount - rc)) OVER (PARTITION BY doc_id) AS least FROM p WHERE best <> 1 OR page = first)
    SELECT doc_id, count(*) AS n_kept, min(seq) AS first_seq FROM d WHERE least IS NULL OR least > abs(rc) * 1.5 + 5000 OR gap <= least + 1 GROUP BY doc_id""")
def operating_result_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(f"SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) AS seq FROM {{lineitem}}", lineitem=table(spark, sf_dir, "lineitem"))
    label = F.when(F.col("key") == "CHIFFRE_AFFAIRES", "Chiffre d'affaires").when(F.col("l_partkey") % 3 == 0, "Résultat d'exploitation").when(F.col("l_partkey") % 3 == 1, "Solde VI").otherwise("Autre solde")
    rows = lines.withColumn("key", F.expr(OPERATING)).select(F.col("l_suppkey").alias("doc_id"), "seq", "key", F.lit("N").alias("period"), (1 + F.col("l_linenumber")).alias("page_number"), F.expr(written(CENTS, "2")).alias("raw_value"), label.alias("raw_label"))
    return resolve.operating_result_rows(rows).where("key = 'RESULTAT_EXPLOITATION'").groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.min("seq").cast("long").alias("first_seq"))


@query("SELECT l_suppkey, count(*) AS n_kept FROM (SELECT *, max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 AND l_partkey % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS any_better FROM lineitem) WHERE any_better = 0 OR (l_returnflag = 'R' AND l_linenumber = 7 AND l_partkey % 50 = 0) GROUP BY l_suppkey")
def filter_or_all_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7) & (F.col("l_partkey") % 50 == 0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit("STOCKS").alias("key"), F.when(better, "SECTION_TOTAL").otherwise("DETAIL").alias("nature"), F.lit("Stocks").alias("raw_label"), F.lit("1,00").alias("raw_value"), F.lit("BILAN_ACTIF").alias("section"))
    return resolve.preferred(rows).groupBy(F.col("doc_id").alias("l_suppkey")).agg(F.count("*").alias("n_kept"))


CHAIN = {"PRODUITS_FINANCIERS": "l_linenumber = 1", "CHARGES_FINANCIERES": "l_linenumber = 2", "RESULTAT_FINANCIER": "l_linenumber = 3", "RESULTAT_COURANT": "l_linenumber = 4", "RESULTAT_NON_COURANT": "l_linenumber = 5", "IMPOT_SUR_RESULTATS": "l_linenumber = 6", "TRESORERIE_ACTIF": "l_linenumber = 1", "TRESORERIE_PASSIF": "l_linenumber = 7", "ACTIF_CIRCULANT": "l_linenumber = 2", "PASSIF_CIRCULANT": "l_linenumber = 3", "FONDS_PROPRES": "l_linenumber = 4", "ACTIFS_IMMOBILISES": "l_linenumber = 5", "DOTATIONS_AMORTISSEMENTS": "l_linenumber = 6"}
LINES_SQL = sums_sql(*(part_sum(f"v{k}", f"l_linenumber = {k}") for k in range(1, 8)))


@query(f"SELECT doc_id, CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL AND (v3 IS NULL OR abs(v3 - (v1 - v2)) > greatest(1, abs(v3) * 0.0001)) THEN v1 - v2 ELSE v3 END AS value FROM ({LINES_SQL})")
def prefer_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_fields(spark, sf_dir, CHAIN)
    computed = derive.computed(F.col("PRODUITS_FINANCIERS"), "-", F.col("CHARGES_FINANCIERES"))
    return wide.select("doc_id", derive.prefer_computed(F.col("RESULTAT_FINANCIER"), computed)["value"].alias("value"))


@query(f"""WITH k AS (SELECT *, CASE WHEN v1 + v2 IS NULL THEN CASE WHEN v3 IS NOT NULL THEN 'read' END WHEN v3 IS NULL THEN 'computed' WHEN abs(v3 - (v1 - v2)) > greatest(1, abs(v3) * 0.0001) THEN 'clash' ELSE 'read' END AS k FROM ({LINES_SQL}))
    SELECT doc_id, CASE WHEN k = 'read' THEN v3 WHEN k IS NOT NULL THEN v1 - v2 END AS value, CASE WHEN k = 'read' THEN 'confirmed' WHEN k IS NOT NULL THEN 'derived' END AS status, CASE WHEN k = 'computed' THEN 0.6 WHEN k IS NOT NULL THEN 0.95 END AS confidence, CASE k WHEN 'read' THEN '3' WHEN 'computed' THEN '1,2' WHEN 'clash' THEN '3,1,2' END AS sources, CASE WHEN k = 'clash' THEN 'contradicts_computed' WHEN k IS NOT NULL THEN '' END AS warnings FROM k""")
def prefer_derived_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = wide_fields(spark, sf_dir, CHAIN)
    a, b, c = (F.when(F.col(n).isNotNull(), resolve.fv(F.col(n)["value"], "confirmed", F.lit(sure), F.array(F.lit(k)))) for k, (n, sure) in enumerate((("PRODUITS_FINANCIERS", 0.5), ("CHARGES_FINANCIERES", 0.6), ("RESULTAT_FINANCIER", 0.95)), 1))
    made = sums.select("doc_id", a.alias("a"), b.alias("b"), c.alias("c"))
    return made.select("doc_id", derive.prefer_computed(F.col("c"), derive.computed(F.col("a"), "-", F.col("b"))).alias("f")).select("doc_id", *told(F.col("f")))


@query(f"""WITH s AS ({LINES_SQL}), t AS (SELECT *, v4 + v5 AS before_tax, v1 - v7 AS cash FROM s), u AS (SELECT *, before_tax - v6 AS net, coalesce((v2 + v1) - (v3 + v7), v4 - v5) AS fdr FROM t)
    SELECT doc_id, before_tax, net, cash, net + v6 AS caf, fdr, fdr - cash AS bfdr FROM u""")
def derive_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = derive.derived(wide_fields(spark, sf_dir, CHAIN))
    return wide.select("doc_id", *(F.col(c)["value"].alias(n) for n, c in (("before_tax", "RESULTAT_AVANT_IMPOT"), ("net", "RESULTAT_NET"), ("cash", "TRESORERIE_NETTE"), ("caf", "CAF"), ("fdr", "FDR"), ("bfdr", "BFDR"))))


CONTROLLED = {"TOTAL_ACTIF": "l_linenumber IN (1, 2)", "TOTAL_PASSIF": "l_linenumber IN (1, 3)", "PRODUITS_FINANCIERS": "l_linenumber = 1", "CHARGES_FINANCIERES": "l_linenumber = 2", "RESULTAT_FINANCIER": "l_linenumber = 3", "TRESORERIE_ACTIF": "l_linenumber = 4", "TRESORERIE_PASSIF": "l_linenumber = 5"}
CONTROL_ROWS = f"""WITH s AS ({sums_sql(*(part_sum(c.lower(), t) for c, t in CONTROLLED.items()))}), c AS (
    SELECT doc_id, 'bilan_equilibre' AS code, CASE WHEN total_passif IS NOT NULL THEN total_actif END AS expected, CASE WHEN total_actif IS NOT NULL THEN total_passif END AS observed FROM s
    UNION ALL SELECT doc_id, 'resultat_financier', produits_financiers - charges_financieres, resultat_financier FROM s WHERE produits_financiers - charges_financieres + resultat_financier IS NOT NULL
    UNION ALL SELECT doc_id, 'tresorerie_nette', tresorerie_actif - tresorerie_passif, NULL FROM s WHERE tresorerie_actif - tresorerie_passif IS NOT NULL)"""


@query(f"{CONTROL_ROWS} SELECT doc_id, code, expected, observed, CASE WHEN observed - expected IS NULL THEN 'not_testable' WHEN abs(observed - expected) <= greatest(1, abs(expected) * 0.0001) THEN 'passed' ELSE 'failed' END AS status FROM c")
def controls_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = derive.controls(wide_fields(spark, sf_dir, CONTROLLED))
    return wide.select("doc_id", F.inline("controls")).select("doc_id", "code", "expected", "observed", "status")


EIGHT = {
    "TOTAL_ACTIF": "1, 2", "TOTAL_PASSIF": "1, 3", "TRESORERIE_ACTIF": "1, 2", "TRESORERIE_PASSIF": "2", "TRESORERIE_NETTE": "1, 4", "PRODUITS_EXPLOITATION": "1, 2", "CHARGES_EXPLOITATION": "2", "RESULTAT_EXPLOITATION": "1, 5", "PRODUITS_FINANCIERS": "2, 3",
    "CHARGES_FINANCIERES": "3", "RESULTAT_FINANCIER": "2, 6", "RESULTAT_COURANT": "1, 2", "PRODUITS_NON_COURANTS": "3, 4", "CHARGES_NON_COURANTES": "4", "RESULTAT_NON_COURANT": "3, 7", "RESULTAT_AVANT_IMPOT": "1, 2, 3", "IMPOT_SUR_RESULTATS": "3", "RESULTAT_NET": "1, 2, 6",
}
EIGHT = {c: f"l_linenumber IN ({lines})" for c, lines in EIGHT.items()}
EXPECTED = {
    "resultat_exploitation": ("produits_exploitation - charges_exploitation", "resultat_exploitation"), "resultat_financier": ("produits_financiers - charges_financieres", "resultat_financier"), "resultat_courant": ("resultat_exploitation + resultat_financier", "resultat_courant"),
    "resultat_non_courant": ("produits_non_courants - charges_non_courantes", "resultat_non_courant"), "resultat_avant_impot": ("resultat_courant + resultat_non_courant", "resultat_avant_impot"), "resultat_net": ("resultat_avant_impot - impot_sur_resultats", "resultat_net"),
}
EIGHT_SQL = f"""WITH s AS ({sums_sql(*(part_sum(c.lower(), t) for c, t in EIGHT.items()))}), c AS (
    SELECT doc_id, 'bilan_equilibre' AS code, CASE WHEN total_passif IS NOT NULL THEN total_actif END AS expected, CASE WHEN total_actif IS NOT NULL THEN total_passif END AS observed FROM s
    UNION ALL SELECT doc_id, 'tresorerie_nette', tresorerie_actif - tresorerie_passif, tresorerie_nette FROM s WHERE tresorerie_actif - tresorerie_passif IS NOT NULL
    {" ".join(f"UNION ALL SELECT doc_id, '{code}', {expected}, {observed} FROM s WHERE {expected} + {observed} IS NOT NULL" for code, (expected, observed) in EXPECTED.items())})"""


@query(f"{EIGHT_SQL} SELECT doc_id, code, expected, observed, CASE WHEN observed - expected IS NULL THEN 'not_testable' WHEN abs(observed - expected) <= greatest(1, abs(expected) * 0.0001) THEN 'passed' ELSE 'failed' END AS status FROM c")
def controls_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight controls, each of them passed, failed or not tested in some document."""
    wide = derive.controls(wide_fields(spark, sf_dir, EIGHT))
    return wide.select("doc_id", F.inline("controls")).select("doc_id", "code", "expected", "observed", "status")


@query(f"{CONTROL_ROWS}, f AS (SELECT doc_id, max(CASE WHEN code = 'bilan_equilibre' AND abs(observed - expected) > greatest(1, abs(expected) * 0.0001) THEN 1 ELSE 0 END) AS b, max(CASE WHEN code = 'resultat_financier' AND abs(observed - expected) > greatest(1, abs(expected) * 0.0001) THEN 1 ELSE 0 END) AS r FROM c GROUP BY doc_id) SELECT doc_id, CASE WHEN b = 0 THEN total_actif END AS total_actif, CASE WHEN r = 0 THEN resultat_financier END AS resultat_financier, tresorerie_actif FROM f JOIN s USING (doc_id)")
def invalidate_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = derive.invalidated(derive.controls(wide_fields(spark, sf_dir, CONTROLLED)))
    return wide.select("doc_id", *(F.col(c)["value"].alias(c.lower()) for c in ("TOTAL_ACTIF", "RESULTAT_FINANCIER", "TRESORERIE_ACTIF")))


WRITTEN = {"TRESORERIE_ACTIF": "l_linenumber = 1", "TRESORERIE_PASSIF": "l_linenumber = 2", "ACHATS_TOTAL": "l_linenumber = 3", "AUTRES_CHARGES_EXTERNES": "l_linenumber = 4", "AUTRES_CHARGES_EXTERNES_DETAIL": "l_linenumber = 5", "RESULTAT_NET": "l_linenumber = 2", "DOTATIONS_AMORTISSEMENTS": "l_linenumber = 3", "CAISSE": "l_linenumber = 6", "TOTAL_ACTIF": "l_linenumber = 1", "TOTAL_PASSIF": "l_linenumber = 4"}
WRITTEN_SQL = f"""s AS ({sums_sql(*(part_sum(c.lower(), t) for c, t in WRITTEN.items()))}),
    v AS (SELECT doc_id, tresorerie_actif, tresorerie_passif, achats_total AS achats, coalesce(autres_charges_externes_detail, autres_charges_externes) AS autres_charges_externes, resultat_net, dotations_amortissements AS amortissements, caisse, total_actif, total_passif,
        tresorerie_actif - tresorerie_passif AS tresorerie_nette, resultat_net + dotations_amortissements AS caf FROM s),
    u AS (UNPIVOT v ON COLUMNS(* EXCLUDE doc_id) INTO NAME attribute VALUE value)"""


def written_dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wide = wide_fields(spark, sf_dir, WRITTEN)
    return wide, dataset.dataset(dataset.long_form(wide), wide)


@query(f"""WITH {WRITTEN_SQL}, a(attribute) AS (VALUES {", ".join(f"('{a}')" for a in R.DATASET_ATTRIBUTES)}), d AS (SELECT DISTINCT doc_id FROM v)
    SELECT doc_id, attribute, value, CASE WHEN value IS NULL THEN 'missing' WHEN attribute IN ('tresorerie_nette', 'caf') THEN 'derived' ELSE 'confirmed' END AS status FROM d CROSS JOIN a LEFT JOIN u USING (doc_id, attribute)
    UNION ALL SELECT doc_id, attribute, value, 'confirmed' FROM u WHERE attribute IN ('autres_charges_externes', 'caisse', 'total_actif', 'total_passif') AND value IS NOT NULL""")
def dataset_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 35 attributes of every document, and the optional ones that stand: last writers by order, simple derivations."""
    return dataset.attributes(written_dataset(spark, sf_dir)[1])


@query(f"""WITH {WRITTEN_SQL}, g AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, count(*) AS k, max(l_linestatus) FILTER (WHERE l_returnflag = 'R') AS error FROM lineitem GROUP BY 1, 2),
    n AS (SELECT doc_id, sum(k) AS lines, string_agg(concat('page ', page, ': ', error), '|' ORDER BY page) FILTER (WHERE error IS NOT NULL) AS pages FROM g GROUP BY doc_id)
    SELECT doc_id, concat_ws('|', pages, CASE WHEN lines > 3 THEN concat('recovered from native text: +', CAST(lines - 3 AS BIGINT)) END, CASE WHEN abs(total_passif - total_actif) > greatest(1, abs(total_actif) * 0.0001) THEN 'control failed: bilan_equilibre' END) AS warnings FROM n JOIN v USING (doc_id)""")
def document_warning_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of pages, recovery, fields and controls in one list a document."""
    wide, made = written_dataset(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.lit(0).alias("n_rows"), F.lit(1).alias("latency_ms"), F.lit(False).alias("skipped"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("error"))
    found = lines.groupBy("doc_id").agg((F.count("*") - 3).alias("n_recovered"))
    told = dataset.document_warnings(wide, pages.page_counters(lines), found, made, derive.controls(wide))
    return told.withColumn("warnings", F.array_join("warnings", "|"))


ALTERNATES = {"DETTES_BANCAIRES_MLT": "l_linenumber = 1", "DETTES_FINANCIERES": "l_linenumber = 2", "RESULTAT_NET": "l_linenumber = 3"}


@query(f"SELECT doc_id, coalesce(a, b) AS value, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'Alias dettes de financement (MLT)' END AS note, CASE WHEN coalesce(a, b) IS NULL THEN 'missing' ELSE 'confirmed' END AS status FROM ({sums_sql(part_sum('a', 'l_linenumber = 1'), part_sum('b', 'l_linenumber = 2'))})")
def project_first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project.output_fields(wide_fields(spark, sf_dir, ALTERNATES)).select("doc_id", F.col("outputs")[4].alias("o"))
    return out.select("doc_id", "o.value", "o.note", "o.status")


@query(f"SELECT doc_id, CASE WHEN n > 0 THEN 'Bénéficiaire' WHEN n < 0 THEN 'Déficitaire' WHEN n = 0 THEN 'Nul' END AS note, CASE WHEN n IS NULL THEN 0.0 ELSE 0.95 END AS confidence FROM (SELECT doc_id, a - b AS n FROM ({sums_sql(part_sum('a', 'l_linenumber = 3'), part_sum('b', 'l_linenumber = 4'))}))")
def result_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_fields(spark, sf_dir, {"RESULTAT_AVANT_IMPOT": "l_linenumber = 3", "IMPOT_SUR_RESULTATS": "l_linenumber = 4"})
    out = project.output_fields(derive.derived(wide)).select("doc_id", F.col("outputs")[19].alias("o"))
    return out.select("doc_id", "o.note", "o.confidence")


COMPLETE_SQL = f"""WITH p AS (SELECT doc_id, key, status FROM ({PICK_SQL.format(SPARSE)}) WHERE key NOT LIKE '%_N1'), s AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem)
    SELECT s.doc_id, CAST(count(CASE WHEN status = 'confirmed' AND key IN ('ACTIFS_IMMOBILISES', 'CHIFFRE_AFFAIRES', 'TRESORERIE_PASSIF', 'ACTIF_CIRCULANT', 'CLIENTS', 'TRESORERIE_ACTIF') THEN 1 END) AS INT) AS n_found FROM s LEFT JOIN p USING (doc_id) GROUP BY s.doc_id"""


@query(COMPLETE_SQL)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: candidates are ranked and picked, spread to the spine of outputs, and counted (six of the codes have no other way than the pick)."""
    rows = C.keyed(candidates(spark, sf_dir).withColumn("section", F.col("page_type")))
    chosen = resolve.picked(resolve.ranked(rows), "doc_id", "key").groupBy("doc_id").agg(*(F.max_by(F.struct(*resolve.F_NAMES).cast(resolve.FV), F.when(F.col("key") == c, 1)).alias(c) for c in resolve.FIELDS))
    spine = rows.select("doc_id").distinct().join(chosen, "doc_id", "left")
    plain = {"ACTIFS_IMMOBILISES", "CHIFFRE_AFFAIRES", "TRESORERIE_PASSIF", "ACTIF_CIRCULANT", "CREANCES_CLIENTS", "TRESORERIE_ACTIF"}
    return project.output_fields(spine).select("doc_id", F.size(F.filter("outputs", lambda o: o["code"].isin(*plain) & o["value"].isNotNull())).alias("n_found"))


@query()
def document_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of it: repair, duplicates, sections, picks, derivations, controls, projection. Tested on hand-made documents and against its parts."""
    return lifecycle.document_results(candidates(spark, sf_dir, dense=True)).select("doc_id", F.to_json("outputs").alias("outputs"), F.size("controls").alias("n_controls"), "completeness")


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND text IS NOT NULL) AS user, arg_min(text, turn) FILTER (role = 'assistant' AND text IS NOT NULL) AS assistant FROM conversations GROUP BY conv_id")
def identity_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.first_values(table(spark, sf_dir, "conversations"), "role", "text", ["user", "assistant"], "turn", "conv_id")


# --- Pages ---------------------------------------------------------------------------------------------------------

FREQUENT = [("A", 2, ["the", "ation", "erre"]), ("B", 1, ["queue", "leau", "ment"]), ("C", 2, ["cion", "esta", "los"]), ("D", 1, ["ung", "sch"])]


@query("WITH f AS (SELECT doc_id, " + folded_sql("text", "[^a-z0-9\\s]+") + " AS t FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{n}' AS type, {least} AS least, " + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + " AS score FROM f" for k, (n, least, words) in enumerate(FREQUENT)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM s) SELECT doc_id, type, score, score >= least AS enough FROM r WHERE k = 1")
def page_lexical_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pages.lexical_scores(X.fold_ascii(F.col("text")), FREQUENT).alias("s")).select("doc_id", "s.*")


PAGE_TEXTS = ["", "bilan actif immobilisations corporelles", "stocks et creances", "capitaux propres passif circulant", "resultat", "compte de produits et charges produits d exploitation", "etat des soldes de gestion", "raison sociale identifiant fiscal", "rien de tout cela ici", "detail des postes du cpc"]


@query(f"""WITH RECURSIVE p AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS n, (conv_id * 3 + turn * 7) % 10 AS k FROM conversations),
    f AS (SELECT doc_id, 0 AS n, CAST(NULL AS VARCHAR) AS prev, CAST(NULL AS VARCHAR) AS type FROM (SELECT DISTINCT doc_id FROM p)
        UNION ALL SELECT doc_id, n, CASE WHEN type IN ('VIDE', 'AUTRE') THEN prev ELSE type END, type FROM (SELECT p.doc_id, p.n, f.prev, CASE p.k WHEN 0 THEN 'VIDE' WHEN 1 THEN 'BILAN_ACTIF' WHEN 2 THEN CASE WHEN prev = 'BILAN_ACTIF' THEN prev ELSE 'VIDE' END WHEN 3 THEN 'BILAN_PASSIF' WHEN 4 THEN 'VIDE' WHEN 5 THEN 'CPC' WHEN 6 THEN 'ESG' WHEN 7 THEN CASE WHEN p.n < 2 THEN 'IDENTIFICATION' ELSE 'VIDE' END WHEN 8 THEN 'VIDE' ELSE 'DETAIL_CPC' END AS type FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1))
    SELECT doc_id, n AS page_number, type AS page_type FROM f WHERE n > 0""")
def page_fold_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("page_number"), F.expr(choice("(conv_id * 3 + turn * 7) % 10", PAGE_TEXTS)).alias("native_text"))
    return pages.classified(rows)


@query("SELECT doc_id, n AS page_number, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM (SELECT conv_id AS doc_id, turn AS n, CASE WHEN text ILIKE '%the%' THEN 'T' WHEN text ILIKE '%le%' THEN 'L' END AS s FROM conversations)")
def sticky_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.when(F.contains(low, F.lit("the")), "T").when(F.contains(low, F.lit("le")), "L").alias("s"))
    return pages.sticky(rows, "s", "section", "doc_id", "page_number").drop("s")


# The twin reads whole runs of digits, so that what ends one amount may also begin the next.
@query("SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, '([0-9]+[.][0-9]{2})(?:[^0-9]|$)|[0-9]+', 1), lambda x: x <> ''), '|') AS found FROM pages")
def native_amount_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"(?<![0-9])([0-9]+[.][0-9]{2})(?![0-9])"), 1), "|").alias("found"))


EMPTY = ["dettes de financement (c) provisions durables 1 000,00", "dettes de financement (c) 12 500,00 provisions durables", "dettes de financement rien du tout", "autre section 5,00"]


@query("SELECT page_id, page_id % 4 IN (0, 2) AS empty FROM pages")
def section_empty_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(choice("page_id % 4", EMPTY))
    return table(spark, sf_dir, "pages").select("page_id", recover.empty_between(text, r"dettes de financement\s*\(?\s*c?\s*\)?", r"provisions durables|total i\s*\(|ecarts de conversion").alias("empty"))


NATIVE = ["compte de produits et charges ventes de marchandises 1 234 567,89 1 000,00", "texte sans montant mais assez long pour etre lu en entier ici", "achats revendus de marchandises 45 000,50 et autres lignes du compte", "12 300,00 iii. resultat d'exploitation (i-ii) du compte de produits"]


@query("""WITH p AS (SELECT doc_id % 50 AS doc, doc_id AS page, doc_id % 4 AS k FROM documents), have AS (SELECT DISTINCT doc_id % 50 AS doc, CASE WHEN quality = 1 THEN 'CHIFFRE_AFFAIRES' ELSE 'ACHATS_REVENDUS' END AS code FROM labels WHERE doc_id % 50 < 20 AND doc_id < 100),
    m AS (SELECT doc, page, CASE k WHEN 0 THEN 'CHIFFRE_AFFAIRES' WHEN 2 THEN 'ACHATS_REVENDUS' END AS code, CASE k WHEN 0 THEN '1 234 567,89' WHEN 2 THEN '45 000,50' END AS v FROM p WHERE k IN (0, 2))
    SELECT doc AS doc_id, code AS field_code, min(page) AS page_number, min(v) AS raw_value FROM m ANTI JOIN have USING (doc, code) GROUP BY doc, code UNION ALL SELECT doc, 'RESULTAT_EXPLOITATION', page, '12 300,00' FROM p WHERE k = 3""")
def recover_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("page_number"), F.lit("CPC").alias("page_type"), F.expr(choice("doc_id % 4", NATIVE)).alias("native_text"))
    have = table(spark, sf_dir, "labels").where("doc_id % 50 < 20 and doc_id < 100").select((F.col("doc_id") % 50).alias("doc_id"), F.when(F.col("quality") == 1, "CHIFFRE_AFFAIRES").otherwise("ACHATS_REVENDUS").alias("field_code"))
    return recover.recovered(shown, have).select("doc_id", "field_code", "page_number", "raw_value")


@query("""WITH p AS (SELECT doc_id, doc_id % 4 AS k FROM documents), raw AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'CHIFFRE_AFFAIRES' ELSE 'ACHATS_REVENDUS' END AS code FROM labels, range(2) t(i) WHERE i = 0 OR doc_id % 3 = 0), have AS (SELECT DISTINCT doc_id, code FROM raw),
    m AS (SELECT doc_id, CASE k WHEN 0 THEN 'CHIFFRE_AFFAIRES' WHEN 2 THEN 'ACHATS_REVENDUS' END AS code, CASE k WHEN 0 THEN '1 234 567,89' WHEN 2 THEN '45 000,50' END AS v FROM p WHERE k IN (0, 2))
    SELECT doc_id, code AS field_code, 1 AS page_number, v AS raw_value FROM m ANTI JOIN have USING (doc_id, code) UNION ALL SELECT doc_id, 'RESULTAT_EXPLOITATION', 1, '12 300,00' FROM p WHERE k = 3""")
def recover_anti_join_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recover_anti_join`` over all documents, with their texts, and all labels, by the ids they have."""
    text = F.concat(F.expr(choice("doc_id % 4", NATIVE)), F.lit("\n"), F.coalesce("text", F.lit("")))
    shown = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit("CPC").alias("page_type"), text.alias("native_text"))
    have = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "CHIFFRE_AFFAIRES").otherwise("ACHATS_REVENDUS").alias("field_code"))
    return recover.recovered(shown, have).select("doc_id", "field_code", "page_number", "raw_value")


@query("""WITH p AS (SELECT doc_id, doc_id % 4 AS k FROM documents), raw AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'CHIFFRE_AFFAIRES' ELSE 'ACHATS_REVENDUS' END AS code FROM labels, range(2) t(i) WHERE i = 0 OR doc_id % 3 = 0), have AS (SELECT DISTINCT doc_id, code FROM raw),
    m AS (SELECT doc_id, CASE k WHEN 0 THEN 'CHIFFRE_AFFAIRES' WHEN 2 THEN 'ACHATS_REVENDUS' END AS code FROM p WHERE k IN (0, 2)),
    r AS (SELECT doc_id, code, true AS recovered FROM m ANTI JOIN have USING (doc_id, code) UNION ALL SELECT doc_id, 'RESULTAT_EXPLOITATION', true FROM p WHERE k = 3), u AS (SELECT * FROM r UNION ALL SELECT doc_id, code, false FROM have)
    SELECT doc_id, code AS field_code, recovered, greatest(count(*) OVER (PARTITION BY doc_id) - coalesce(n, 0), 0) AS n_recovered FROM u LEFT JOIN (SELECT doc_id, count(*) AS n FROM raw GROUP BY doc_id) USING (doc_id)""")
def recover_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found candidates (by the labels) with those that the pages still show, and how many came to each document."""
    text = F.concat(F.expr(choice("doc_id % 4", NATIVE)), F.lit("\n"), F.coalesce("text", F.lit("")))
    shown = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit("CPC").alias("page_type"), text.alias("native_text"))
    have = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "CHIFFRE_AFFAIRES").otherwise("ACHATS_REVENDUS").alias("field_code"), F.lit("N").alias("period"), F.lit("-").alias("raw_label"), F.lit("0,00").alias("raw_value"))
    have = have.unionByName(have.where("doc_id % 3 = 0").withColumn("seq", F.lit(2)))  # some are read twice
    return recover.united(have, shown).select("doc_id", "field_code", "recovered", "n_recovered")


@query("""WITH l AS (SELECT DISTINCT doc_id, quality = 1 AS good FROM labels), p AS (SELECT doc_id, doc_id % 4 AS k, coalesce(bool_or(good), false) AS sales, coalesce(bool_or(NOT coalesce(good, false)) FILTER (l.doc_id IS NOT NULL), false) AS purchases, count(l.doc_id) > 0 AS told FROM documents LEFT JOIN l USING (doc_id) GROUP BY doc_id),
    r AS (SELECT *, k = 0 AND NOT sales AS a, k = 2 AND NOT purchases AS b FROM p)
    SELECT doc_id, CASE WHEN a THEN CAST('1234567.89' AS DECIMAL(24,4)) END AS sales, CASE WHEN b THEN CAST('45000.50' AS DECIMAL(24,4)) END AS purchases, CASE WHEN a OR b THEN 5.0 ELSE 0.0 END::DOUBLE AS completeness, CASE WHEN a OR b THEN 1 ELSE 0 END::BIGINT AS n_recovered FROM r WHERE told OR a OR b""")
def pages_to_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to output fields: types, bounds, what the native text adds, picks and completeness. The labels stand for candidates that no rule accepts."""
    text = F.concat(F.expr(choice("doc_id % 4", NATIVE)), F.lit("\n"), F.coalesce("text", F.lit("")))
    shown = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), text.alias("native_text"))
    found = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "CHIFFRE_AFFAIRES").otherwise("ACHATS_REVENDUS").alias("field_code"), F.lit("0,00").alias("raw_value"), F.lit("N").alias("period"), F.lit("DETAIL").alias("nature"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page_number"), F.lit("CPC").alias("page_type"), F.lit("Ligne illisible").alias("raw_label"), F.lit("TOTAL_EXERCICE_N").alias("column_role"), F.lit(None).cast("string").alias("column_name"), F.lit("").alias("source_excerpt"), F.array().cast("array<string>").alias("warnings"))
    out = lambda code: F.filter("outputs", lambda o: o["code"] == code)[0]["value"]
    return lifecycle.results_from_pages(found, shown).select("doc_id", out("CHIFFRE_AFFAIRES").alias("sales"), out("ACHATS_REVENDUS").alias("purchases"), "completeness", F.col("n_recovered").cast("long").alias("n_recovered"))


@query()
def native_amounts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All amounts of every document's text and every page's html. The pattern looks around itself, which the SQL of the twins cannot: tested against Python."""
    shown = table(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    return shown.select("kind", "id", F.array_join(recover.amounts_in(F.col("text")), "|").alias("found"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE contains(text, '|')), f AS (SELECT *, contains(t, '|') AS i, lag(contains(t, '|')) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM l), g AS (SELECT *, sum(CASE WHEN i AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM f) SELECT doc_id, CAST(island AS BIGINT) AS island, count(*) AS n_lines, CAST(min(line) AS INT) AS first_line FROM g WHERE i GROUP BY doc_id, island")
def md_table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("content"))
    lines = markdown.lines_of(docs)
    return markdown.islands(lines, F.contains("text", F.lit("|")), "doc_id").groupBy("doc_id", "island").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


@query("SELECT s_suppkey AS doc_id, 'CPC' AS section, concat('Ligne ', s_name) AS raw_label, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat(s_suppkey, ',50') END AS net_n, concat(s_nationkey, ',00') AS brut FROM supplier")
def md_rows_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat("s_suppkey", F.lit(",50")))
    text = F.concat_ws("\n", F.lit("# Compte de produits et charges"), F.lit("| Libellé | Brut | Net |"), F.lit("|---|---|---|"), F.concat(F.lit("| Ligne "), "s_name", F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(",00 | "), cell, F.lit(" |")), F.lit("| --- | x | y |"), F.lit("fin"))
    rows = markdown.table_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page_number"), text.alias("content")))
    return rows.select("doc_id", "section", "raw_label", F.col("values")["net_n"].alias("net_n"), F.col("values")["brut"].alias("brut"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('', o_custkey) WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'z' END AS picked FROM orders")
def preferred_column_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("other"), F.lit("z"), F.lit("brut"), F.when(F.col("o_orderkey") % 3 == 0, "b"), F.lit("net_n"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", markdown.preferred_amount(values).alias("picked"))


@query("SELECT event_id, CAST(0 AS INT) AS seq, 'CHIFFRE_AFFAIRES' AS field_code, regexp_extract(props, '([0-9]+)', 1) AS raw_value, 'N_MINUS_1' AS period, CASE WHEN event_id % 2 = 0 THEN 0.7 ELSE 0.5 END AS confidence FROM events WHERE regexp_extract(props, '([0-9]+)', 1) <> ''")
def json_payload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in three shapes (fenced object, bare list, text around one row) around each event's number."""
    number = F.regexp_extract("props", "([0-9]+)", 1)
    item = F.concat(F.lit('{"field_code": "ca", "raw_value": "'), number, F.lit('", "period": "n-1", "confidence": '), F.when(F.col("event_id") % 2 == 0, "0").otherwise("0.5"), F.lit("}"))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n{"candidates": ['), item, F.lit("]}\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit("Voici : "), item, F.lit(" fin")))
    rows = payload.payload_items(table(spark, sf_dir, "events").select("event_id", answer.alias("answer")), "answer", "event_id")
    return rows.select("event_id", "seq", "field_code", "raw_value", "period", "confidence")


@query("WITH a AS (SELECT user_id, event_type = 'purchase' AS meaningful, CAST(floor(value) AS BIGINT) AS n_rows, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events), s AS (SELECT *, min(CASE WHEN meaningful THEN attempt END) OVER (PARTITION BY user_id) AS stop FROM a), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_rows DESC NULLS LAST, meaningful DESC, attempt) AS k, count(*) OVER (PARTITION BY user_id) AS n_tried FROM s WHERE stop IS NULL OR attempt <= stop) SELECT user_id, CAST(attempt AS INT) AS attempt, n_rows, meaningful, n_tried FROM t WHERE k = 1")
def attempt_best_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").alias("meaningful"), F.floor("value").alias("n_rows"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt"))
    return pages.best_attempt(rows, "user_id")


# --- Jobs ----------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


STATE_SQL = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last_value, count(*) AS n_events FROM events GROUP BY user_id"


@query(STATE_SQL)
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(events(spark, sf_dir), "user_id", F.struct("ts", "event_id"), "event_type", "value")


@query("SELECT event_id, CAST(least(80, 15 + floor(70 * (event_id % 13) / 12)) AS INT) AS percent FROM events")
def job_progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jobs.progress_percent(F.col("event_id") % 13, F.lit(12)).alias("percent"))


@query("SELECT event_id, user_id, CAST(k AS INT) AS place_from_end FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def job_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay(events(spark, sf_dir), "user_id", "ts", "event_id", most=5).select("event_id", "user_id", "place_from_end")


SESSIONS_SQL = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 60 MINUTES) AS expires_us, count(*) AS n_events FROM s GROUP BY user_id, k"


@query(SESSIONS_SQL)
def job_ttl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.idle_sessions(events(spark, sf_dir), "user_id", "ts").select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("expires_at").alias("expires_us"), "n_events")


@query("SELECT event_id, user_id FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events) WHERE coalesce(done, 0) = 0")
def job_until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.until_terminal(events(spark, sf_dir), "user_id", F.col("event_type") == "error", "ts", "event_id").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, CAST(CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 422 ELSE 409 END AS INT) AS gate FROM events GROUP BY event_type")
def job_result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("gate", jobs.result_gate(status))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the pattern stands for one file as well as for a folder."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    return jobs.run_once(stream, f"{shared_folder(spark)}/{label}_{uuid.uuid4().hex}")


@query(STATE_SQL)
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = jobs.latest_state(event_stream(spark, sf_dir), "user_id", F.struct("ts", "event_id"), "event_type", "value")
    return drained(spark, state, "job_state")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type, count(*) AS n_events, epoch_us(max(ts) + INTERVAL 60 MINUTES) AS expires_us FROM s GROUP BY user_id, k")
def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each stretch of a job, with a watermark that lets a stream forget what has expired."""
    state = jobs.latest_state_of_sessions(event_stream(spark, sf_dir), "user_id", "ts", F.struct("ts", "event_id"), "event_type", late="10 minutes")
    return drained(spark, state.select("user_id", "last_event_type", "n_events", F.unix_micros("expires_at").alias("expires_us")), "session_state")


@query(SESSIONS_SQL)
def stream_job_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = jobs.idle_sessions(event_stream(spark, sf_dir), "user_id", "ts", late="10 minutes")
    return drained(spark, sessions.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("expires_at").alias("expires_us"), "n_events"), "job_sessions")


#: Events of the table as events of jobs, each user a job.
KINDS = {"signup": "pages_rendered", "view": "page_extracted", "click": "page_skipped", "error": "job_failed", "purchase": "result_ready"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


def job_events(rows: DataFrame) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("event_type")]
    return rows.select("user_id", "ts", "event_id", kind.alias("event"), kind.alias("event_type"), (F.col("event_id") % 13).alias("page"), F.when(kind == "pages_rendered", F.col("event_id") % 4 * 4).alias("count")).withColumn("page", F.when(F.col("event").startswith("page_"), F.col("page")))


SILENCE, LATE = 1500, 10
SERVER_EVENTS_SQL = f"""
    WITH e AS (SELECT user_id, ts, event_id, {KIND_SQL} AS event, epoch_us(ts) AS us FROM events),
    g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new, lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM e),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
    l AS (SELECT *, min(us) OVER (PARTITION BY user_id, k) AS life, coalesce(sum(CASE WHEN event IN ('result_ready', 'job_failed') THEN 1 END) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM k),
    m AS (SELECT max(epoch_ms(ts)) - {LATE} * 60000 AS mark FROM events),
    r AS (SELECT user_id, life, ts, event_id AS of, 0 AS place, us AS at_us, event_id, event FROM l WHERE done = 0
        UNION ALL SELECT user_id, life, ts, event_id, n, us + n * {SILENCE} * 1000000, NULL, 'keepalive' FROM l, m, range(1, 3600 // {SILENCE} + 2) t(n)
            WHERE done = 0 AND event NOT IN ('result_ready', 'job_failed') AND us + n * {SILENCE} * 1000000 <= coalesce(after, mark * 1000))
    SELECT user_id, life, row_number() OVER (PARTITION BY user_id, life ORDER BY ts, of, place) AS number, CAST(at_us AS BIGINT) AS at_us, event_id, event FROM r"""


@query(SERVER_EVENTS_SQL)
def stream_server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber of every job sees, by keyed state and timers: events until an end, keep-alive rows in silence."""
    with live.keyed_state(spark):
        rows = live.server_events(job_events(event_stream(spark, sf_dir)), "user_id", late=f"{LATE} minutes", silence=SILENCE)
        shown = jobs.run_once(rows, f"{shared_folder(spark)}/server_events_{uuid.uuid4().hex}", mode="append")
    return shown.select("user_id", "life", "number", F.unix_micros("at").alias("at_us"), "event_id", "event")


@query(SERVER_EVENTS_SQL)
def job_server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the table, by windows."""
    rows = job_events(events(spark, sf_dir))
    mark = rows.agg((F.max(F.unix_millis("ts")) - LATE * 60_000)).first()[0]
    shown = live.server_events_of(rows, "user_id", F.lit(mark), silence=SILENCE)
    return shown.select("user_id", "life", "number", F.unix_micros("at").alias("at_us"), "event_id", "event")


STATES_SQL = f"""
    WITH e AS (SELECT user_id, ts, event_id, {KIND_SQL} AS event, CASE WHEN event_type IN ('view', 'click') OR event_type = 'signup' THEN event_id % 13 END AS page, CASE WHEN event_type = 'signup' THEN event_id % 4 * 4 END AS n FROM events),
    p AS (SELECT * REPLACE (CASE WHEN starts_with(event, 'page_') THEN page END AS page) FROM e),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
    l AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM k QUALIFY k = max(k) OVER (PARTITION BY user_id)),
    t AS (SELECT * REPLACE (last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total) FROM l),
    c AS (SELECT *, CASE WHEN page IS NOT NULL AND total > 0 THEN least(80, 15 + (70 * page) // total) WHEN event = 'pages_rendered' THEN 15 WHEN event = 'result_ready' THEN 100 END AS pct FROM t)
    SELECT user_id, coalesce(arg_max(CASE event WHEN 'result_ready' THEN 'completed' ELSE 'failed' END, (ts, event_id)) FILTER (WHERE event IN ('result_ready', 'job_failed')), 'queued') AS status,
        arg_max(CASE event WHEN 'pages_rendered' THEN 'rendering' WHEN 'result_ready' THEN 'completed' WHEN 'job_failed' THEN 'failed' ELSE 'extracting_page' END, (ts, event_id)) AS step,
        CAST(coalesce(arg_max(pct, (ts, event_id)) FILTER (WHERE pct IS NOT NULL), 0) AS INT) AS progress_pct, CAST(arg_max(page, (ts, event_id)) FILTER (WHERE page IS NOT NULL) AS INT) AS current_page,
        CAST(arg_max(total, (ts, event_id)) FILTER (WHERE total IS NOT NULL) AS INT) AS pages_total, count(*) FILTER (WHERE event = 'page_extracted') AS pages_financial, count(*) FILTER (WHERE event = 'page_skipped') AS pages_skipped,
        count(*) FILTER (WHERE event = 'page_failed') AS pages_failed, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us, count(*) AS n_events FROM c GROUP BY user_id"""


def shown_states(states: DataFrame) -> DataFrame:
    return states.withColumns({"created_us": F.unix_micros("created_at"), "updated_us": F.unix_micros("updated_at")}).drop("created_at", "updated_at")


@query(STATES_SQL)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each job's last life, folded at once."""
    return shown_states(job_table.folded(job_events(events(spark, sf_dir)), "user_id", "ts", "event_id"))


@query(f"SELECT * FROM ({STATES_SQL}) WHERE updated_us >= (SELECT epoch_us(max(ts)) FROM events) - 3600000000")
def job_table_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after a quarter of the time span's events each, merged batch by batch; a batch that comes again changes nothing, idle jobs go."""
    rows = job_events(events(spark, sf_dir))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    kept = job_table.JobTable(spark, f"{shared_folder(spark)}/jobs_{uuid.uuid4().hex}", "user_id")
    for batch in (0, 1, 1, 2, 3):
        begin, end = (first + (last - first) * k / 4 for k in (batch, batch + 1))
        kept.merge(rows.where((F.col("ts") >= F.lit(begin)) & ((F.col("ts") < F.lit(end)) | F.lit(batch == 3))), batch, "ts", "event_id")
    return shown_states(kept.read())


@query(f"SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) = 'purchase'")
def stream_result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of completed jobs through the gate into JSON files, by a stream whose batch is delivered twice; read back."""
    path = f"{shared_folder(spark)}/results_{uuid.uuid4().hex}"
    sink = job_table.ResultSink(spark, f"{path}/results", "user_id")

    def write(batch: DataFrame, number: int) -> None:
        states = job_table.folded(batch, "user_id", "ts", "event_id", minutes=1 << 30)
        results = batch.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))
        for _ in range(2):
            sink.write(results, states, number)

    jobs.run_each(job_events(event_stream(spark, sf_dir)), f"{path}/checkpoint", write)
    return sink.read("user_id long, n_events long, last_event long")


@query("""WITH h AS (SELECT * FROM events WHERE event_id < (SELECT count(*) // 2 FROM events)), r AS (SELECT event_id, user_id, 'replayed' AS part FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)
    SELECT * FROM r UNION ALL SELECT event_id, user_id, 'live' FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM h WHERE h.user_id = e.user_id), -1)""")
def stream_hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of what had come by the middle, then the live stream, without loss or repeat."""
    rows = events(spark, sf_dir)
    history = rows.where(F.col("event_id") < rows.count() // 2)
    replayed, fresh = live.handed_over(history, event_stream(spark, sf_dir), "user_id", "event_id", most=5)
    drained_ = jobs.run_once(fresh.select("event_id", "user_id"), f"{shared_folder(spark)}/hand_over_{uuid.uuid4().hex}", mode="append")
    return replayed.select("event_id", "user_id", F.lit("replayed").alias("part")).unionByName(drained_.withColumn("part", F.lit("live")))


# --- Sources -------------------------------------------------------------------------------------------------------


def paged_lines(content: bytes, most: int) -> Iterator[tuple[int, str]]:
    """Pages of four lines; what begins with an A is refused."""
    lines = content.decode().split("\n")
    if lines[0].startswith("A"):
        raise ValueError("refused")
    for k in range(min(most, -(-len(lines) // 4))):
        yield k + 1, "\n".join(lines[4 * k : 4 * k + 4])


@query("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, l, unnest(range(1, 1 + least(6, (len(l) + 3) // 4))) AS n FROM d WHERE NOT starts_with(text, 'A'))
    SELECT doc_id, CAST(n AS INT) AS page_number, md5(array_to_string(l[4 * n - 3:4 * n], chr(10))) AS page_md5, NULL AS error FROM p
    UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN text IS NULL THEN 'no content' ELSE 'refused' END FROM d WHERE text IS NULL OR starts_with(text, 'A')""")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary documents to pages by a table function with the page limit; documents that cannot be read keep a row."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return connector.page_rows(files, paged_lines, 6).select("doc_id", "page_number", F.md5("native_text").alias("page_md5"), "error")


def flaky(row: dict, attempt: int) -> str:
    """Answers with a candidate; some rows fail once, some always, some are cut."""
    k = row["doc_id"]
    if k % 11 == 0:
        raise connector.Truncated("cut")
    if k % 7 == 0 or (k % 3 == 1 and attempt == 1):
        raise connector.Failed(f"away {attempt}")
    return '{"candidates": [{"field_code": "CLIENTS", "raw_value": "%d,00"}]}' % k


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 7 = 0 OR doc_id % 3 = 1 THEN 2 ELSE 1 END AS INT) AS n_attempts, CASE WHEN doc_id % 11 > 0 AND doc_id % 7 > 0 THEN CAST(doc_id AS VARCHAR) || ',00' END AS raw_value,
    CASE WHEN doc_id % 11 = 0 THEN 'cut' WHEN doc_id % 7 = 0 THEN 'away 2' END AS error FROM documents""")
def connector_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through an unreliable connector: attempts, the parsed answer, or the error for which it is set aside."""
    tried = connector.attempted(table(spark, sf_dir, "documents").select("doc_id"), flaky, "doc_id", wait=lambda attempt: 0)
    found = payload.payload_items(connector.answered(tried), "answer", "doc_id").select("doc_id", "raw_value")
    counts = tried.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_attempts"))
    return counts.join(found, "doc_id", "left").join(connector.quarantined(tried).select("doc_id", "error"), "doc_id", "left")


# --- Sets ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, list_sort(list_distinct(list_concat(string_split(lang, ' '), string_split(source, ' '))))[1] AS first_code, len(list_intersect(string_split(lang, ' '), ['en', 'fr'])) > 0 AS has_key FROM documents")
def key_code_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_sort(F.array_union(F.split("lang", " "), F.split("source", " ")))
    return table(spark, sf_dir, "documents").select("doc_id", codes[0].alias("first_code"), F.arrays_overlap(F.split("lang", " "), F.array(F.lit("en"), F.lit("fr"))).alias("has_key"))


@query("SELECT doc_id, count(*) AS n, CAST(min(k) AS INT) AS first FROM (SELECT DISTINCT doc_id, k FROM (SELECT l_orderkey AS doc_id, l_linenumber AS k FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 3)) GROUP BY doc_id")
def region_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two overlapping regions together, each once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k"))
    both = lines.where("k <= 4").withColumn("region", F.lit(1)).unionByName(lines.where("k >= 3").withColumn("region", F.lit(2)))
    return C.first_wins(both, [F.col("doc_id"), F.col("k")], "region").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("k").alias("first"))


TYPE_SQL = "CASE conv_id % 3 WHEN 0 THEN 'BILAN_ACTIF,BILAN_PASSIF,CPC,DETAIL_CPC,RESULTAT_FISCAL,ESG' WHEN 1 THEN 'CPC,DETAIL_CPC,RESULTAT_FISCAL,BILAN_PASSIF,BILAN_ACTIF,ESG' ELSE 'IDENTIFICATION,BILAN_ACTIF,BILAN_PASSIF,CPC,DETAIL_CPC,RESULTAT_FISCAL,ESG' END"


@query(f"SELECT DISTINCT conv_id, {TYPE_SQL} AS types FROM conversations")
def next_types_to_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = F.expr(choice("conv_id % 3", ["BILAN_ACTIF", "CPC", "IDENTIFICATION"]))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(pages.next_types(primary, F.lit(None).cast("string")), ",").alias("types"))


@query(f"SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 2 THEN 'IDENTIFICATION' ELSE array_to_string(string_split({TYPE_SQL}, ',')[1:3], ',') END AS types FROM conversations")
def types_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that a page is tried with, within the setting's number."""
    primary = F.expr(choice("conv_id % 3", ["BILAN_ACTIF", "CPC", "IDENTIFICATION"]))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(pages.types_to_try(primary, F.lit(None).cast("string"), Settings.from_environment().types_tried), ",").alias("types"))


SHOWN_TYPES = ["BILAN_ACTIF", "CPC", "ESG", "AUTRE"]


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN bool_or(field_code IN ('TOTAL_ACTIF', 'CLIENTS', 'TRESORERIE_ACTIF', 'ACTIF_CIRCULANT', 'ACTIFS_IMMOBILISES')) WHEN 1 THEN bool_or(field_code IN ('CHIFFRE_AFFAIRES', 'RESULTAT_NET', 'CHARGES_FINANCIERES')) WHEN 2 THEN false ELSE count(*) >= 2 END AS meaningful FROM ({SPARSE}) GROUP BY doc_id""")
def attempt_meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = candidates(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("field_code").alias("codes"))
    return codes.select("doc_id", pages.meaningful(F.expr(choice("doc_id % 4", SHOWN_TYPES)), F.col("codes")).alias("meaningful"))


@query("""WITH p AS (SELECT user_id AS doc_id, event_id % 9 AS n, bool_or(event_type = 'error') AS skipped, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END) AS found, sum(CASE WHEN event_id % 5 > 0 THEN event_id % 100 END) AS ms, max(CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN concat('timeout ', event_id % 3) END) AS error FROM events GROUP BY 1, 2),
    q AS (SELECT *, NOT skipped AND found = 0 AND error IS NOT NULL AS failed FROM p)
    SELECT doc_id, count(CASE WHEN NOT skipped AND NOT failed THEN 1 END) AS n_processed, count(CASE WHEN skipped THEN 1 END) AS n_skipped, count(CASE WHEN failed THEN 1 END) AS n_failed, CAST(sum(ms) AS BIGINT) AS latency_ms, coalesce(string_agg(CASE WHEN failed THEN concat('page ', n, ': ', error) END, '; ' ORDER BY n), '') AS warnings FROM q GROUP BY doc_id""")
def page_audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 9).alias("page_number"), F.when(F.col("event_type") == "purchase", 3).otherwise(0).alias("n_rows"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 100).alias("latency_ms"), (F.col("event_type") == "error").alias("skipped"), F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), F.concat(F.lit("timeout "), F.col("event_id") % 3)).alias("error"))
    return pages.page_counters(attempts).withColumn("warnings", F.array_join("warnings", "; "))
