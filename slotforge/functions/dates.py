"""Calendar dates and payment terms in lines of text (ids F7, P5-P7 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = r"(?<!\d)\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(?!\d)"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
NAMED = rf"(?i)\b(?:{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH},?\s+\d{{4}})\b"
#: Labels of the dates that terms count from.
ISSUE_LABEL = r"\b(?:invoice\s+date|issue\s+date|date\s+issued|date\s+of\s+invoice)\b"
RECEIPT_LABEL = r"\b(?:receipt\s+date|date\s+received|received\s+date|date\s+of\s+receipt)\b"
#: Payment terms as (the date they count from, the term, its number of days or None for none).
TERMS = (
    ("invoice", r"(?i)\bnet\s*-?\s*\d{1,3}\b|\b\d{1,3}\s+days?\s+(?:after|from)\s+(?:the\s+)?(?:invoice\s+date|date\s+of\s+(?:the\s+)?invoice|issue\s+date|date\s+issued|invoice)\b"
     r"|\b(?:due|payable)\s+(?:in|within)\s+\d{1,3}\s+days?\b|\b\d{1,3}\s+days?\s+net\b", r"(\d{1,3})"),
    ("invoice", r"(?i)(?:^|[\s,;])(?:\d{1,2}\s*/\s*\d{1,2}\s+)?n\s*/\s*\d{1,3}\b", r"(?i)n\s*/\s*(\d{1,3})"),
    ("invoice", r"(?i)\b(?:cash\s+in\s+advance|payment\s+in\s+advance|payable\s+in\s+advance|cash\s+with\s+order|prepay(?:ment)?)\b", None),
    ("receipt", r"(?i)\b\d{1,3}\s+days?\s+(?:after|from)\s+(?:the\s+)?(?:receipt|date\s+of\s+receipt)\b", r"(\d{1,3})"),
    ("receipt", r"(?i)\bdue\s+(?:on|upon)\s+receipt\b", None),
)
#: Terms that are recognised and not computed.
END_OF_MONTH = r"(?i)\b(?:e\.?o\.?m\.?|end\s+of\s+(?:the\s+)?month|prox)\b"


def _numeric(text: Column, first: str) -> Column:
    """Day, month and year by place; two-digit years 69-99 are of the last century."""
    p = F.split(F.regexp_replace(text, "[./]", "-"), "-")
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    y, m, d = (c, a, b) if first == "month" else (c, b, a)
    year = F.when(F.length(y) == 4, y.try_cast("int")).when(F.length(y) == 2, y.try_cast("int") + F.when(y.try_cast("int") >= 69, 1900).otherwise(2000))
    iso = F.when(F.length(a) == 4, F.format_string("%s-%s-%s", a, F.lpad(b, 2, "0"), F.lpad(c, 2, "0")))
    made = F.format_string("%s-%s-%s", year.cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.when(F.length(a) <= 2, F.try_to_date(made, "yyyy-MM-dd")))


def parse(text: Column) -> Column:
    """The date, or null where month first and day first are both possible and differ."""
    plain = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(text, r"[.,]", ""), r"\s+", " ")))
    month = F.coalesce(
        F.try_to_date(F.regexp_replace(plain, r"^([A-Z][a-z]{2})[a-z]*", "$1"), "MMM d yyyy"), F.try_to_date(F.regexp_replace(plain, r"^(\d{1,2} [A-Z][a-z]{2})[a-z]*", "$1"), "d MMM yyyy")
    )
    a, b = _numeric(text, "month"), _numeric(text, "day")
    return F.coalesce(month, F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b)))


def ambiguous(text: Column) -> Column:
    return F.coalesce(_numeric(text, "month") != _numeric(text, "day"), F.lit(False))


def labelled(lines: DataFrame, label: str) -> DataFrame:
    """(doc_id, date, reason) from the lines that hold the label: one date that leaves no doubt, or why not."""
    found = F.concat(F.regexp_extract_all("line", F.lit(NUMERIC), F.lit(0)), F.regexp_extract_all("line", F.lit(NAMED), F.lit(0)))
    rows = lines.where(F.col("line").rlike(f"(?i){label}")).select("doc_id", F.explode(found).alias("raw"))
    rows = rows.select("doc_id", parse(F.col("raw")).alias("date"), ambiguous(F.col("raw")).alias("doubt"))
    out = rows.groupBy("doc_id").agg(F.count_distinct("date").alias("n"), F.bool_or("doubt").alias("doubt"), F.min("date").alias("date"))
    reason = F.when(F.col("doubt"), "ambiguous").when(F.col("n") == 0, "unreadable").when(F.col("n") > 1, "several")
    return out.select("doc_id", F.when(reason.isNull(), F.col("date")).alias("date"), reason.alias("reason"))


def terms(lines: DataFrame) -> DataFrame:
    """(doc_id, base, days, reason): the one term that all lines agree on, in words as well as in days.

    Each kind of term counts by its first match on a line. A term that ends with a month is refused wherever it stands.
    """
    found = []
    for base, pattern, number in TERMS:
        said = F.lower(F.trim(F.regexp_extract("line", pattern, 0)))
        days = F.regexp_extract(said, number, 1).cast("int") if number else F.lit(0)
        found.append(F.when(F.col("line").rlike(pattern), F.struct(F.lit(base).alias("base"), days.alias("days"), said.alias("said"))))
    rows = lines.select("doc_id", F.col("line").rlike(END_OF_MONTH).alias("eom"), F.array_compact(F.array(*found)).alias("found")).where("eom OR size(found) > 0")
    rows = rows.select("doc_id", "eom", F.explode_outer("found").alias("t"))
    out = rows.groupBy("doc_id").agg(F.bool_or("eom").alias("eom"), F.count_distinct("t").alias("n"), F.min("t").alias("t"))
    reason = F.when(F.col("eom"), "end_of_month").when(F.col("n") > 1, "several")
    return out.select("doc_id", F.when(reason.isNull(), F.col("t.base")).alias("base"), F.when(reason.isNull(), F.col("t.days")).alias("days"), reason.alias("reason"))


def derive_due(lines: DataFrame) -> DataFrame:
    """(doc_id, due, base, reason): the date that the term counts from plus its days, or why it cannot be said."""
    issue, receipt = (labelled(lines, label).toDF("doc_id", f"{n}_date", f"{n}_reason") for n, label in (("invoice", ISSUE_LABEL), ("receipt", RECEIPT_LABEL)))
    rows = lines.select("doc_id").distinct().join(issue, "doc_id", "left").join(receipt, "doc_id", "left").join(terms(lines), "doc_id", "left")
    of = lambda what: F.when(F.col("base") == "invoice", F.col(f"invoice_{what}")).otherwise(F.col(f"receipt_{what}"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("term_"), F.col("reason"))).when(F.col("base").isNull(), "no_term")
        .when(of("date").isNull() & of("reason").isNull(), F.concat(F.lit("no_"), F.col("base"), F.lit("_date")))
        .when(of("reason").isNotNull(), F.concat(F.when(F.col("base") == "invoice", "date_").otherwise("receipt_"), of("reason")))
    )
    return rows.select("doc_id", F.when(reason.isNull(), F.date_add(of("date"), F.col("days"))).alias("due"), "base", reason.alias("reason"))
