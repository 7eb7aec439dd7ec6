"""Label normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from finquery.functions.columns import let
from finquery.refdata import LABEL_FIXES


def ranges(codes: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    parts, k = [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\x{{{codes[k]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > k else ""))
        k = j + 1
    return "".join(parts)


HANGUL, LEADS, VOWELS, TAILS = 0xAC00, 19, 21, 28


class Decompositions:
    """What compatibility decomposition without combining characters makes of every code point, from the character database.

    ``one``: characters that become one other; ``gone``: a class of those that
    become nothing; ``several``: a class of those that become more, ``keys`` and
    ``values`` of them. Korean syllables, the largest block, follow a formula.
    """

    def __init__(self) -> None:
        one, several, gone = [], [], []
        for code in range(0x80, 0x110000):
            if HANGUL <= code < HANGUL + LEADS * VOWELS * TAILS or 0xD800 <= code < 0xE000:
                continue
            char = chr(code)
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if plain == char:
                continue
            if not plain:
                gone.append(code)
            elif len(plain) == 1:
                one.append((char, plain))
            else:
                several.append((char, plain))
        self.one = "".join(a for a, _ in one), "".join(b for _, b in one)
        self.gone = f"[{ranges(gone)}]"
        self.keys, self.values = "".join(a for a, _ in several), "\u0001".join(b for _, b in several)
        self.several = f"[{ranges(sorted([ord(a) for a, _ in several] + list(range(HANGUL, HANGUL + LEADS * VOWELS * TAILS))))}]"


decompositions = cache(Decompositions)


def letters_of(char: Column) -> Column:
    """What one character becomes."""
    d, code = decompositions(), F.ascii(char) - HANGUL
    table = F.split(F.lit(d.values), "\u0001")
    jamo = [F.lit("".join(chr(first + k) for k in range(n))) for first, n in ((0x1100, LEADS), (0x1161, VOWELS), (0x11A8, TAILS - 1))]
    at = lambda k, place: F.substr(jamo[k], place.cast("int"), F.lit(1))
    tail = code % TAILS
    syllable = F.concat(at(0, F.floor(code / (VOWELS * TAILS)) + 1), at(1, F.floor(code % (VOWELS * TAILS) / TAILS) + 1), F.when(tail > 0, at(2, tail)).otherwise(""))
    place = F.instr(F.lit(d.keys), char)
    return F.when((code >= 0) & (code < LEADS * VOWELS * TAILS), syllable).when(place > 0, F.try_element_at(table, place)).otherwise(char)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def folded_letters(t: Column) -> Column:
    d = decompositions()
    # The long classes are tried only where a short one finds characters above the usual Latin ones.
    some = F.when(t.rlike(r"[\x{a8}-\x{be}\x{132}-\x{10ffff}]") & t.rlike(d.several), F.array_join(F.transform(F.split(t, ""), letters_of), "")).otherwise(t)
    return let(F.translate(some, *d.one), lambda same: F.when(same.rlike(r"[\x{300}-\x{10ffff}]"), F.regexp_replace(same, d.gone, "")).otherwise(same))


def plain_letters(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining characters: most by one table, the rest, where a text has any, character by character."""
    return let(text, lambda t: F.when(is_ascii(t), t).otherwise(folded_letters(t)))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, nearly all of a text's, are not matched; within ASCII the short class will do."""
    return let(text, lambda t: F.trim(F.when(is_ascii(t), F.regexp_replace(t, r"\s{2,}|[\t-\r]", " ")).otherwise(F.regexp_replace(t, r"(?U)\s{2,}|[^\S ]", " "))))


#: Neither part of a word nor white space: like letters count numerals of any kind; marks, ties and joiners do not.
MARK = r"(?U)[^\w\s\p{No}]|[\p{M}\p{Pc}\p{IsJoin_Control}\x{1f130}-\x{1f189}&&[^_]]"


def normalize_label(label: Column) -> Column:
    """Accents, case, ligatures and marks folded away; null gives the empty string."""
    # Within ASCII (as many bytes as characters) marks and white space go in one step, without the tables; the classes of the whole character set are slow.
    short = lambda low: F.trim(F.regexp_replace(low, rf"[^{ascii_lowercase}{digits}_]+", " "))
    rest = lambda low: squeezed(F.regexp_replace(F.replace(F.replace(low, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")), MARK, " "))
    whole = lambda t: let(F.lower(folded_letters(t)), lambda low: F.when(is_ascii(low), short(low)).otherwise(rest(low)))
    return let(F.coalesce(label, F.lit("")), lambda t: F.when(is_ascii(t), short(F.lower(t))).otherwise(whole(t)))


def misread(text: Column) -> Column:
    """Whether a raw text has any of the usual misreadings."""
    return text.rlike("(?i)" + "|".join(wrong for wrong, _ in LABEL_FIXES))


def normalize_ocr_label(label: Column) -> Column:
    """`normalize_label` after the usual misreadings are put right, in the raw text, so accented variants keep them."""
    text = F.coalesce(label, F.lit(""))
    fixed = reduce(lambda text, fix: F.regexp_replace(text, "(?i)" + fix[0], fix[1]), LABEL_FIXES, text)
    # One search tells that there is nothing to put right, as nearly always.
    return normalize_label(F.when(misread(text), fixed).otherwise(text))


def fold_ascii(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces; marks become spaces."""
    # Characters named one by one are looked up in a table, ranges are not.
    return F.trim(F.regexp_replace(F.lower(plain_letters(F.coalesce(text, F.lit("")))), rf"[^{ascii_lowercase}{digits}]+", " "))


def fold_keep_marks(text: Column) -> Column:
    """Lower case without accents; marks stay."""
    return squeezed(F.lower(plain_letters(F.coalesce(text, F.lit("")))))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(False)


def label_similarity(label: Column, alias: Column) -> Column:
    """0 to 1 of two normalised labels: equality, the alias inside the label, the label inside the alias if nearly as long, or shared words from one half on."""
    n, m = F.length(label).cast("double"), F.length(alias).cast("double")
    a, b = F.array_distinct(F.split(label, " ")), F.array_distinct(F.split(alias, " "))
    shared = F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))
    return (
        F.when((label == "") | (alias == ""), 0.0).when(label == alias, 1.0).when(F.contains(label, alias), 0.75 + 0.25 * (m / n))
        .when(F.contains(alias, label), F.when(n / m >= 0.9, 0.7 + 0.2 * (n / m)).otherwise(0.0)).when(shared >= 0.5, shared).otherwise(0.0)
    )


def without_thought_mark(text: Column) -> Column:
    """Without a reasoning marker at the end."""
    whole = F.trim(text)
    # A marker ends so, or what ends so stands behind it.
    return F.when(F.right(whole, F.lit(1)).isin(*"kK>\t\n\x0b\f\r\x85\u2028\u2029"), F.trim(F.regexp_replace(whole, r"(?i)(?:</?think>|/think)\s*$", ""))).otherwise(whole)
