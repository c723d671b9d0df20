"""Checks of field values, as column expressions: each gives null where the value is good, else a short reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing value, and headers that are no values.
PLACEHOLDERS = ["not found", "n/a", "none", "unknown", "null", "undefined", "missing", "sample", "test", "untitled", "placeholder", ""]
NOT_NUMBERS = ["invoice", "tax invoice", "bill", "receipt", "number", "details", "payment", "amount", "subtotal"]
NOT_COMPANIES = ["invoice", "tax invoice", "receipt", "statement", "bill to", "billed to", "date"]
NOT_NAMES = ["resume", "curriculum vitae", "cv", "summary", "profile", "contact", "education", "experience"]
# Date formats in the order in which they are tried, each with the shape it needs.
DATES = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d-MMMM-yyyy", r"^\d{1,2}-[A-Za-z]{4,9}-\d{4}$"),
    ("d/MMM/yyyy", r"^\d{1,2}/[A-Za-z]{3}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{4,9} \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMM, yyyy", r"^\d{1,2} [A-Za-z]{3}, \d{4}$"),
    ("MMMM d yyyy", r"^[A-Za-z]{3,9} \d{1,2} \d{4}$"),
]


def missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(PLACEHOLDERS)


def email_error(c: Column) -> Column:
    v = F.trim(c)
    domain = F.split_part(v, F.lit("@"), F.lit(2))
    return (
        F.when(missing(c), "missing")
        .when(~v.rlike(r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"), "format")
        .when(F.length(F.regexp_extract(domain, r"\.([^.]*)$", 1)) < 2, "domain")
    )


def phone_error(c: Column, most: int = 16) -> Column:
    v = F.trim(c)
    n = F.length(F.regexp_replace(v, "[^0-9]", ""))
    shape = rf"^(\+?[0-9]{{1,4}}[\s.-]?)?(\(?\d{{2,4}}\)?[\s.-]?)?[\d\s.-]{{5,{most}}}$"
    return F.when(missing(c), "missing").when(n < 7, "short").when(n > 16, "long").when(~v.rlike(shape), "characters")


def parsed_date(c: Column) -> Column:
    """The date by the first format that fits; null where none does."""
    v = F.trim(c)
    return F.coalesce(*(F.to_date(F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(fmt)))) for fmt, shape in DATES))


def date_error(c: Column, least: int = 1950, most: int = 2035) -> Column:
    v = F.trim(c)
    year = F.coalesce(F.year(parsed_date(c)), F.regexp_extract(v, r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int"))
    return F.when(missing(c), "missing").when(year.isNull(), "format").when(~year.between(least, most), "range")


def amount(c: Column) -> Column:
    """The first number once currency words and commas are dropped."""
    t = F.regexp_replace(F.trim(c), r"(?i)\b(USD|PKR|EUR|GBP|Rs\.?|AUD|CAD)\b", "")
    return F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), r"[-+]?[0-9]*\.?[0-9]+", 0).try_cast("double")


def amount_error(c: Column) -> Column:
    return F.when(missing(c), "missing").when(amount(c).isNull(), "format").when(amount(c) <= 0, "range")


def invoice_number_error(c: Column) -> Column:
    v = F.trim(c)
    return F.when(missing(c), "missing").when(F.length(v) < 3, "short").when(F.length(v) > 35, "long").when(F.lower(v).isin(NOT_NUMBERS), "header").when(~v.rlike("[A-Za-z0-9]"), "characters")


def company_error(c: Column) -> Column:
    v = F.trim(c)
    return F.when(missing(c), "missing").when(F.length(v) < 2, "short").when(F.length(v) > 80, "long").when(F.lower(v).isin(NOT_COMPANIES), "header")


def name_error(c: Column) -> Column:
    v = F.trim(c)
    return F.when(missing(c), "missing").when(F.length(v) < 2, "short").when(F.length(v) > 60, "long").when(F.lower(v).isin(NOT_NAMES), "header").when(~v.rlike("[A-Za-z]"), "characters")


def skills_error(c: Column) -> Column:
    return presence_error(c)


def presence_error(c: Column) -> Column:
    return F.when(missing(c), "missing")


def optional_phone_error(c: Column) -> Column:
    """A phone number is checked only where one is given."""
    return F.when(~missing(c), phone_error(c))


# Checks of each type: (field, check, whether it counts where the field is missing).
RULES = {
    "Invoice": [("invoice_number", invoice_number_error, True), ("date", date_error, True), ("company", company_error, True), ("total_amount", amount_error, True)],
    "Resume": [("name", name_error, True), ("email", email_error, True), ("skills", skills_error, True), ("phone", optional_phone_error, False)],
    "Contract": [("contract_title", presence_error, True), ("effective_date", presence_error, True)],
    "Other": [("document_title", lambda c: F.lit(None).cast("string"), True)],
}
# The earlier stage checks the title of other papers, and their date where one is given.
DETAILED = RULES | {"Other": [("document_title", presence_error, True), ("date", lambda c: F.when(~missing(c), date_error(c)), False)]}


def report(values: dict[str, Column], kind: str, rules: dict | None = None) -> Column:
    """struct(document_type, is_valid, passed_fields, failed_fields, field_errors, parsed_amount, total_fields_checked, passed_count).

    A field that isn't among the values counts as missing; other papers are always valid.
    """
    none = F.lit(None).cast("string")
    made = []
    for name, check, always in (rules or RULES)[kind]:
        v = values.get(name, none)
        made.append((name, check(v), F.lit(True) if always else ~missing(v)))
    passed = F.array_compact(F.array(*(F.when(counts & e.isNull(), F.lit(n)) for n, e, counts in made)))
    failed = F.array_compact(F.array(*(F.when(counts & e.isNotNull(), F.lit(n)) for n, e, counts in made)))
    errors = F.map_from_entries(F.array_compact(F.array(*(F.when(counts & e.isNotNull(), F.struct(F.lit(n).alias("field"), e.alias("error"))) for n, e, counts in made))))
    total = values.get("total_amount", none)
    parsed = F.when(~missing(total), amount(total)) if kind == "Invoice" else F.lit(None).cast("double")
    return F.struct(
        F.lit(kind).alias("document_type"), (F.size(failed) == 0).alias("is_valid"), passed.alias("passed_fields"), failed.alias("failed_fields"), errors.alias("field_errors"),
        parsed.alias("parsed_amount"), (F.size(passed) + F.size(failed)).alias("total_fields_checked"), F.size(passed).alias("passed_count"),
    )


def validate(kind: Column, values: Column, rules: dict | None = None) -> Column:
    """The report of a map of values by the document type of the row; unknown types count as Other."""

    def of(k: str) -> Column:
        return report({n: F.try_element_at(values, F.lit(n)) for n, _, _ in (rules or RULES)[k]}, k, rules)

    return F.when(kind == "Invoice", of("Invoice")).when(kind == "Resume", of("Resume")).when(kind == "Contract", of("Contract")).otherwise(of("Other"))


def detailed(df: DataFrame, kind: str, values: str, name: str = "validation") -> DataFrame:
    """df with the earlier stage's report: also field_results, a row for each checked field, and a summary in words."""
    df = df.withColumn(name, validate(F.col(kind), F.col(values), DETAILED))
    r = F.col(name)

    def row(n: Column) -> Column:
        e = F.try_element_at(r["field_errors"], n)
        return F.struct(n.alias("field"), F.try_element_at(F.col(values), n).alias("value"), e.isNull().alias("valid"), F.coalesce(e, F.lit("valid")).alias("reason"))

    bad = F.size(r["failed_fields"])
    summary = F.when(bad == 0, F.format_string("All %d required fields successfully validated.", F.size(r["passed_fields"]))).otherwise(
        F.format_string("Validation failed for %d field(s): %s.", bad, F.array_join(r["failed_fields"], ", "))
    )
    results = F.transform(F.concat(r["passed_fields"], r["failed_fields"]), row)
    return df.withColumns({"_results": results, "_summary": summary}).withColumn(name, r.withField("field_results", F.col("_results")).withField("summary", F.col("_summary"))).drop("_results", "_summary")
