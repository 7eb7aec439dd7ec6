from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finquery.functions import amounts as A
from finquery.functions import text as X

AMOUNTS = [
    ("14 757 502,81", "14757502.81"), ("14.757.502,81", "14757502.81"), ("594 733,04-", "-594733.04"), ("(27 264,00)", "-27264"), ("9,116,785,07", "9116785.07"), ("14.757", "14757"), ("0.500", "500"), ("1234.567", "1234.567"), ("1,234", "1.234"), ("14,757.50", None),
    ("-", None), ("", None), ("n/a", None), ("0,00", "0"), ("12/05/2023", "12052023"), ("TOTAL 5", "5"), ("(27", "-27"), ("27)", "27"), ("-5-", "-5"), ("1 234 567,5", "1234567.5"), ("20,49 MAD", "20.49"), ("1000000000001", None), ("1000000000000", "1000000000000"), (None, None), ("9,999,999,999,999,99", "9999999999999.99"), ("− 12", "-12"),
]


def test_amounts(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(AMOUNTS)], "k int, raw string, want string")
    for r in rows.withColumn("got", A.parse_decimal_amount(F.col("raw"))).collect():
        assert r["got"] == (None if r["want"] is None else Decimal(r["want"])), r["raw"]


def test_zero_is_not_missing(spark):
    got = spark.createDataFrame([("0,00",), ("",), (None,), ("1",)], "raw string").select(A.is_explicit_zero(F.col("raw"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]


@pytest.mark.parametrize(("reference", "want"), [("5000", "1"), ("50000", "5"), ("-50000", "5"), (None, "1")])
def test_tolerance(spark, reference, want):
    got = spark.createDataFrame([(reference,)], "r string").select(A.tolerance(F.col("r").try_cast(A.AMOUNT)).alias("t")).first()["t"]
    assert got == Decimal(want)


def test_agreement_is_asymmetric(spark):
    rows = spark.createDataFrame([("20000", "20002"), ("10000", "10001.5"), ("1", "2")], "a string, b string")
    got = rows.select(A.amounts_agree(F.col("a").cast(A.AMOUNT), F.col("b").cast(A.AMOUNT))).collect()
    assert [r[0] for r in got] == [True, False, True]


LABELS = [("Clients et comptes rattachés", "clients et comptes rattaches"), ("RÉSULTAT  NET (I-II)", "resultat net i ii"), ("Œuvres & cœur", "oeuvres coeur"), ("dettees fournisseurs", "dettes fournisseurs"), ("Solid es crediteurs", "soldes crediteurs"), (None, ""), ("a_b-c", "a_b c"), ("état", "etat")]


def test_labels(spark):
    rows = spark.createDataFrame(LABELS, "raw string, want string")
    assert [r["got"] for r in rows.withColumn("got", X.normalize_ocr_label(F.col("raw"))).collect()] == [w for _, w in LABELS]


SIMILAR = [("ca", "ca export", 0.0), ("x", "x", 1.0), ("", "x", 0.0), ("resultat net de l exercice", "resultat net", 0.75 + 0.25 * 12 / 26), ("total actifs", "total actifs n", 0.0), ("chiffre affaires net", "chiffre affaires brut", 0.5), ("abcdefghij", "abcdefghijk", 0.7 + 0.2 * 10 / 11)]


def test_similarity(spark):
    rows = spark.createDataFrame(SIMILAR, "a string, b string, want double")
    for r in rows.withColumn("got", X.label_similarity(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["want"]), (r["a"], r["b"])


def test_folds(spark):
    rows = spark.createDataFrame([("Chiffres d'Affaires — 1",)], "t string")
    got = rows.select(X.fold_ascii(F.col("t")), X.fold_keep_marks(F.col("t"))).first()
    assert tuple(got) == ("chiffres d affaires 1", "chiffres d'affaires — 1")


def test_labels_fold_like_the_character_database(spark):
    """Every assigned code point, alone and within a word; those that this JVM's tables do not know yet are left out."""
    import re
    import unicodedata

    from finquery.functions import text as X

    def plain(text):
        value = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("œ", "oe").replace("æ", "ae")
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", value)).strip()

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c, f"a{chr(c)}b {chr(c)}") for c in codes], "code int, t string").repartition(4)
    known = df.where(~F.substring("t", 2, 1).rlike(r"\p{Cn}")).select("code", "t", X.normalize_label(F.col("t")).alias("got")).toPandas()
    assert len(known) > 140_000
    wrong = [(hex(c), g, plain(t)) for c, t, g in known.itertuples(index=False) if g != plain(t)]
    assert not wrong, (len(wrong), wrong[:20])
    texts = ["ﬁnancier Ⅲ", "ＴＯＴＡＬ　ＧÉＮÉＲＡＬ", "한국어 각", "½ ㎏ ㍿", "é \U0001d400"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize_label(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]
