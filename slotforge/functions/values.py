"""Normalisers and value tests as column expressions (ids F1-F6, F8-F10, F17-F21 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten fields in order, with kind and tier.
FIELDS = (
    ("invoice_number", "code", "TIER1"),
    ("total_gross", "amount", "TIER1"),
    ("total_net", "amount", "TIER1"),
    ("total_vat", "amount", "TIER1"),
    ("amount_due", "amount", "TIER1"),
    ("seller_vat_id", "code", "TIER1"),
    ("seller_name", "party", "TIER2"),
    ("buyer_name", "party", "TIER2"),
    ("issue_date", "date", "TIER2"),
    ("due_date", "date", "TIER2"),
)
NAMES = tuple(f[0] for f in FIELDS)
KIND = {f[0]: f[1] for f in FIELDS}
TIER1 = tuple(f[0] for f in FIELDS if f[2] == "TIER1")
#: Legal forms that a party name is compared without.
LEGAL_FORMS = (
    r"(?i)\b(inc|ltd|limited|llc|l\.l\.c|gmbh|corp|corporation|co|company|sa|s\.a"
    r"|bv|b\.v|nv|n\.v|plc|ag|kg|oy|ab|as|aps|srl|spa|pty)\b\.?"
)
#: Document classes, the first that matches counts.
CLASSES = (
    ("credit_note", r"credit|rebate|refund"),
    ("proforma", r"pro\s*-?\s*forma"),
    ("confirmation", r"confirmation|confirm"),
    ("purchase_order", r"\border\b"),
    ("estimate", r"estimate|quote|quotation"),
    ("contract", r"contract|agreement"),
    ("receipt", r"receipt|\bcheck\b|donation"),
    ("invoice", r"invoice|voucher|sale"),
)


def ascii_bounds(pattern: str) -> str:
    """The pattern with ``\\b`` as the place between an ASCII word character and any other, as SQL engines have it; Java's
    counts letters such as u umlaut to the word."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def blank_to_null(value: Column) -> Column:
    """Absent, blank and ABSTAIN all mean that nothing is claimed."""
    text = F.trim(value)
    # most texts are told from ABSTAIN by their length (one letter may be a ligature of two)
    return F.when((text != "") & ~(F.length(text).between(6, 7) & (F.upper(text) == "ABSTAIN")), text)


def amount(value: Column) -> Column:
    """The longest number of the text with two decimals, or null; the last separator is the decimal one."""
    runs = F.regexp_extract_all(value, F.lit(r"[0-9][0-9.,'’\s]*"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    raw = F.regexp_replace(F.trim(longest), r"['’ ]", "")
    comma, dot = (F.length(raw) - F.locate(c, F.reverse(raw)) for c in ",.")  # places, from 0, of the last ones
    bare = F.regexp_replace(raw, ",", "")
    number = (
        F.when(raw.contains(",") & raw.contains("."), F.when(dot > comma, bare).otherwise(F.translate(raw, ",.", ".")))
        .when(raw.contains(","), F.when(comma == F.length(raw) - 3, F.translate(F.regexp_replace(raw, r",(?=.*,)", ""), ",", ".")).otherwise(bare))
        .otherwise(raw)
    )
    # most are written plainly, and are all of it
    return F.when(value.rlike(r"^[0-9]+(\.[0-9]+)?$"), value).otherwise(number).try_cast("decimal(38,2)")


def digit_groups(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))


def date_key(value: Column) -> Column:
    """Digit groups in order, joined by a hyphen; null without any."""
    groups = digit_groups(value)
    return F.when(F.size(groups) > 0, F.array_join(groups, "-"))


def party(value: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.regexp_replace(value, LEGAL_FORMS, "")), "[^a-z0-9]", "")
    return F.nullif(F.substring(folded, 1, 40), F.lit(""))


def code(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(value), "[^a-z0-9]", ""), F.lit(""))


def plain(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(value), r"\s+", " "), r"^[ .,:;]+|[ .,:;]+$", ""), F.lit(""))


def normalised(field: Column, value: Column) -> Column:
    """The comparable form of a field's value by the field's kind; null where there is none."""
    of = lambda kind: field.isin(*[n for n, k in KIND.items() if k == kind])
    return (
        F.when(of("amount"), amount(value).cast("string")).when(of("date"), date_key(value)).when(of("party"), party(value))
        .when(of("code"), code(value)).otherwise(plain(value))
    )


def date_parts(value: Column) -> Column:
    """The digit groups as numbers if they may be a date: two or three, none above 9999, one in 1 to 31."""
    parts = F.transform(digit_groups(value), lambda x: x.try_cast("int"))
    fits = F.size(parts).isin(2, 3) & F.forall(parts, lambda x: x <= 9999) & F.exists(parts, lambda x: (x >= 1) & (x <= 31))
    return F.when(fits, parts)


def date_order(*parts: Column) -> Column:
    """``day`` or ``month`` first, as the first date that leaves no doubt says; else null."""
    def one(p: Column) -> Column:
        sure = (F.size(p) == 3) & (F.get(p, F.lit(0)) <= 31)
        return F.when(sure & (F.get(p, F.lit(0)) > 12), "day").when(sure & (F.get(p, F.lit(1)) > 12), "month")
    return F.coalesce(*[one(p) for p in parts]) if len(parts) > 1 else one(parts[0])


def date_ymd(parts: Column, prefer: Column) -> Column:
    """The parts as year, month, day (year, month for two); doubtful ones as ``prefer`` says, day first by default."""
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    three = (
        F.when(a > 31, F.array(a, b, c)).when(a > 12, F.array(c, b, a)).when((b > 12) | (prefer == "month"), F.array(c, a, b)).otherwise(F.array(c, b, a))
    )
    return F.when(F.size(parts) == 2, F.when(a > 31, F.array(a, b)).otherwise(F.array(b, a))).when(F.size(parts) == 3, three)


def date_keys(parts: Column) -> Column:
    """Three parts as numbers that compare like dates: (sure, day, month), what the date itself says of the order, and its
    number read with the day and with the month first; null for fewer parts."""
    a, b, c = (F.get(parts, F.lit(i)).cast("long") for i in range(3))
    key = lambda y, m, d: y * 100_000_000 + m * 10_000 + d
    # a year or a day above twelve in front leaves no choice
    both = F.when(a > 31, key(a, b, c)).when(a > 12, key(c, b, a))
    day = both.when(b > 12, key(c, a, b)).otherwise(key(c, b, a))
    return F.when(F.size(parts) == 3, F.struct(date_order(parts).alias("sure"), day.alias("day"), both.otherwise(key(c, a, b)).alias("month")))


def coverage(tokens: Column, hay: Column) -> Column:
    """Share of the distinct tokens that occur in the other set; 0 for none."""
    own = F.array_distinct(tokens)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, hay)) / F.size(own)).otherwise(0.0)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def malformed(field: Column, value: Column) -> Column:
    """Why a present value cannot be of its field's kind; null if it can."""
    of = lambda kind: field.isin(*[n for n, k in KIND.items() if k == kind])
    return (
        F.when(of("amount") & amount(value).isNull(), "C4_amount").when(of("date") & date_parts(value).isNull(), "C5_date")
        .when(of("code") & code(value).isNull(), "C6_code")
    )


def document_class(text: Column) -> Column:
    """The first class whose pattern the free text matches; ``no_claim`` if blank, ``unmapped`` if none does."""
    low = F.lower(F.trim(text))
    out = F.when(F.coalesce(low, F.lit("")) == "", "no_claim")
    for name, pattern in CLASSES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unmapped")


def target_id(*parts: Column) -> Column:
    return F.concat(F.lit("T-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


_BITS = {n: 1 << i for i, n in enumerate(sorted(NAMES))}


def field_bits(condition: Column, field: str = "field") -> Column:
    """An aggregate: the fields of rows where the condition holds, as a mask."""
    bit = F.create_map(*[F.lit(x) for kv in _BITS.items() for x in kv])[F.col(field)]
    return F.coalesce(F.bit_or(F.when(condition, bit)), F.lit(0))


def fields_of(mask: str) -> Column:
    """The names of a mask's fields, sorted."""
    return F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(b)) != 0, n) for n, b in _BITS.items()]))


def unit_hash(key: Column) -> Column:
    """The first 16 hex digits of SHA-256: uniform, compared as text."""
    return F.substring(F.sha2(key, 256), 1, 16)


def rate_bound(rate: float) -> str:
    """The bound below which ``unit_hash`` falls with this probability."""
    return f"{min(int(rate * 2**64), 2**64 - 1):016x}"
