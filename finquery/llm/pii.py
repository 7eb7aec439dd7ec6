"""Personal data in text, in SQL expressions only.

Regular expressions propose spans; validators confirm them (part ranges for
addresses, Luhn for cards, mod 97 for bank accounts, digit counts for phones);
context words near a span, before or behind it, raise its score. A proposal
stays when its score reaches ``THRESHOLD``. The confirmed spans of the four base
kinds always stay. Context reaches ``REACH`` characters, over two other matches
of the kind at most.

Everything is row by row: no shuffle, and repeated groups in patterns are
possessive or bounded, so that long texts need no deep recursion. Positions
are running sums of the lengths of the parts between matches; n matches take n
log n steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquery.llm.scratch import with_columns_of

THRESHOLD = 0.5
REACH = 40

#: kind -> (a cheap test that texts with a match pass, pattern, validator of v, score without context, context words). Fixed values.
# A local part that fails fails from each of its later characters too, so a match begins where a run does or where the last match ended.
KINDS = {
    "email": ("contains(t, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|email|e-mail|contact"),
    "ip": (r"t rlike '[0-9]\\.[0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"v rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$'", 0.7, "ip|address|host|server"),
    "card": ("t rlike '[0-9](?:[ -]?[0-9]){11}'", r"[0-9](?:[ -]?[0-9])++", "luhn", 0.8, "card|visa|mastercard|credit|carte|karte|tarjeta"),
    "phone": ("contains(t, '+')", r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '')) between 9 and 15", 0.7, "phone|tel|call|mobile|fax|telefon|movil"),
    "iban": ("t rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]'", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "mod97", 0.6, "iban|account|bank|konto|compte|cuenta"),
    "local_phone": (r"t rlike '[0-9]{3}[ .-][0-9]{4}'", r"(?<![0-9+().-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "true", 0.2, "phone|tel|call|mobile|fax|telefon|movil"),
    "secret": ("t rlike '[0-9A-Fa-f]{32}'", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])", "v rlike '[0-9]' and v rlike '[A-Fa-f]'", 0.2, "token|secret|password|api_key|apikey|key|passwd"),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "struct<s:int,k:int,e:int,kind:string,score:double>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


LUHN = "(length(regexp_replace(v, '[ -]', '')) between 12 and 19 and aggregate(split(reverse(regexp_replace(v, '[ -]', '')), ''), named_struct('i', 0, 'a', 0), (x, c) -> if(c = '', x, named_struct('i', x.i + 1, 'a', x.a + if(x.i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0)))), x -> x.a % 10 = 0))"
MOD97 = "aggregate(split(concat(substring(regexp_replace(v, ' ', ''), 5), substring(regexp_replace(v, ' ', ''), 1, 4)), ''), 0, (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end, a -> a = 1)"


def spans_of(kind: str) -> str:
    """SQL for the confirmed spans of one kind in the text ``t``, with scores."""
    test, pattern, valid, score, context = KINDS[kind]
    valid = {"luhn": LUHN, "mod97": MOD97}.get(valid, valid)
    words = quoted(f"(?i)(?<![a-z])(?:{context})(?![a-z])")
    # What stands before and behind, out of the parts and matches next to it: the text itself is not searched for each span.
    match = lambda k: f"coalesce(get(y.m, c.i + {k}), '')"
    part = lambda k, end: f"coalesce({end}(get(y.p, c.i + {k}), {REACH}), '')"
    before = f"right(concat({part(-2, 'right')}, {match(-2)}, {part(-1, 'right')}, {match(-1)}, {part(0, 'right')}), {REACH})"
    after = f"left(concat({part(1, 'left')}, {match(1)}, {part(2, 'left')}, {match(2)}, {part(3, 'left')}), {REACH})"
    lengths = "zip_with(slice(y.p, 1, size(y.m)), y.m, (p, v) -> length(p) + length(v))"
    # Running sums by doubling: in as many passes as the number of matches has bits.
    ends = f"aggregate(sequence(0, length(bin(size(y.m))) - 1), {lengths}, (a, k) -> zip_with(a, slice(concat(array_repeat(0, int(pow(2, k))), a), 1, size(a)), (p, q) -> p + q))"
    confirmed = f"filter(transform(y.m, (v, i) -> named_struct('v', v, 'i', i)), c -> exists(array(c.v), v -> {valid}))"
    scored = f"transform({confirmed}, c -> named_struct('s', e[c.i] - length(c.v), 'k', {list(KINDS).index(kind)}, 'e', e[c.i], 'kind', '{kind}', 'score', cast({score} + if({before} rlike {words} or {after} rlike {words}, 0.35, 0) as double)))"
    # Arrays of one element name a value, so that it is made once.
    each = f"flatten(transform(array({ends}), e -> filter({scored}, x -> x.score >= {0 if kind in BASE else THRESHOLD})))"
    found = f"flatten(transform(array(named_struct('p', split(t, {quoted(pattern)}, -1), 'm', regexp_extract_all(t, {quoted(pattern)}, 0))), y -> if(size(y.m) = 0, cast(array() as array<{SPAN}>), {each})))"
    return f"if({test}, {found}, cast(array() as array<{SPAN}>))"


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: start, end (code points, end exclusive), kind and score, by start, then kind as listed.

    Null and empty texts have no spans; repeated rows each give a row; an empty
    table gives no rows; other columns are ignored.
    """
    rows = with_columns_of(documents, doc_id="long", text="string").withColumn("t", F.coalesce("text", F.lit("")))
    found = rows.select("doc_id", *(F.expr(spans_of(k)).alias(f"f_{k}") for k in KINDS))
    return found.select("doc_id", F.array_sort(F.concat(*(f"f_{k}" for k in KINDS))).alias("spans"))


def personal_data_digest(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    line = lambda test: f"array_join(transform(filter(spans, x -> {test}), x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    base = "x.k < 4"
    return personal_data(documents).select("doc_id", *(F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE), F.sha2(F.expr(line(base)).cast("binary"), 256).alias("base_sha256"), F.expr(line("true")).alias("spans"))
