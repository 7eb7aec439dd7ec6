"""Localised amounts as exact decimals, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finquery.functions.columns import let

AMOUNT = "decimal(24,4)"
BODY = r"[0-9]{1,3}(?:[\s.][0-9]{3})*(?:[,.][0-9]{1,4})?|[0-9]+(?:[,.][0-9]{1,4})?"
CORE = rf"^(\()?([-−–])?({BODY})([-−–])?\)?$"
MIXED = r"^-?[0-9]{1,3}(?:,[0-9]{3})+,[0-9]{2}$"
LIMIT = "1000000000000"


def compact(raw: Column) -> Column:
    """Without white space of any kind; null stays null."""
    return F.regexp_replace(raw, r"(?U)\s+", "")


def is_mixed_comma(raw: Column) -> Column:
    """Groups of three digits and two decimals, all behind commas."""
    return F.coalesce(compact(raw).rlike(MIXED), F.lit(False))


def parse_amount(raw: Column) -> Column:
    """DECIMAL(24,4) of an amount, or null: one of many written forms, else what digits and marks are left of the text.

    A bracket or dash in front or a dash behind makes it negative. With a comma,
    dots part thousands; dots alone part thousands if there are several or one
    before three last digits of at most six. Beyond 1e12 there is no amount.
    """
    # Step by step over one text, as each further mention of a step would compute it again. A text of no written form keeps the mark and casts to null.
    core = F.concat(F.lit("#"), F.regexp_replace(raw, r"[^0-9,.\-−–()]", ""))
    parts = F.regexp_replace(core, rf"^#{CORE[1:]}", "$1$2$4|$3")
    plain = F.regexp_replace(parts, r"\.(?=[0-9.]*[,.])|(?<=\.[0-9]{3})\.|(?<=\|[0-9]{1,3})\.(?=[0-9]{3}$)", "")
    signed = F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit(","), F.lit(".")), r"^[^|#]+\|", "-"), r"^\|", "")
    return let(signed.try_cast(AMOUNT), lambda number: F.when(F.abs(number) <= F.lit(LIMIT).cast(AMOUNT), number))


def parse_decimal_amount(raw: Column) -> Column:
    """`parse_amount`, else the mixed-comma form, in which the last comma is the decimal one."""
    text = compact(raw)
    mixed = F.concat(F.replace(F.regexp_replace(text, ",[0-9]{2}$", ""), F.lit(","), F.lit("")), F.lit("."), F.right(text, F.lit(2))).try_cast(AMOUNT)
    return F.coalesce(parse_amount(raw), F.when(text.rlike(MIXED), mixed))


def is_explicit_zero(raw: Column) -> Column:
    return F.coalesce(parse_decimal_amount(raw) == 0, F.lit(False))


def tolerance(reference: Column) -> Column:
    """One, or a ten-thousandth of the reference if that is more."""
    return F.greatest(F.lit(1).cast("decimal(29,8)"), F.abs(reference) * F.lit("0.0001").cast("decimal(4,4)"))


def amounts_agree(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= tolerance(a)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def quantized(value: Column, places: int = 2) -> Column:
    """Rounded half away from zero."""
    return F.round(value, places)


def null_skipping_sum(*values: Column) -> Column:
    """Null only if all are."""
    zero = F.lit(0).cast(AMOUNT)
    present = F.coalesce(*values)
    total = sum((F.coalesce(v, zero) for v in values[1:]), F.coalesce(values[0], zero))
    return F.when(present.isNotNull(), total)
