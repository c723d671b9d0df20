"""Text functions as column expressions: cleaning, quality, counting, splitting."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_EDGE = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"


def stripped(c: Column) -> Column:
    """Without blanks, tabs and line ends at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def words(c: Column) -> Column:
    """The non-blank parts between white space; null for null."""
    return F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(c, F.lit("")))), F.lit(0))


def squeezed(c: Column) -> Column:
    """Words joined by single blanks."""
    return F.array_join(words(c), " ")


def preview(c: Column, limit: int = 1200) -> Column:
    return F.substring(squeezed(c), 1, limit)


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; the one text function without a built-in counterpart."""
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def ascii_fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition, then only ASCII is kept."""
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def clean(c: Column, compose: bool = True) -> Column:
    """NFKC, no control characters but line ends and tabs, single blanks, at most one blank line, stripped."""
    t = nfkc(c) if compose else c
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\r\t]]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return stripped(F.regexp_replace(t, r"\n{3,}", "\n\n"))


# Characters that the long form of cleaning replaces.
REPLACED = [(" ", " "), ("​", ""), ("‌", ""), ("‍", ""), ("﻿", ""), ("‘", "'"), ("’", "'"), ("“", '"'),
            ("”", '"'), ("–", "-"), ("—", "-"), ("•", "-"), ("●", "-"), ("▪", "-")]


def clean_lines(c: Column, keep_newlines: bool = True, compose: bool = True) -> Column:
    """The long form: line ends unified, quotes, dashes and bullets made plain, every line trimmed."""
    t = nfkc(c) if compose else c
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for a, b in REPLACED:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    t = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return stripped(t) if keep_newlines else squeezed(t)


def normalised(c: Column) -> Column:
    """For classification: small letters, no addresses, no punctuation."""
    t = F.lower(c)
    t = F.regexp_replace(t, r"[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9.-]+", " ")
    t = F.regexp_replace(t, r"(https?://|www\.)[^ \t\n\r\f]+", " ")
    t = F.regexp_replace(t, r"[^a-z0-9 \t\n\r\f]", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def quality(c: Column, least: int = 25) -> Column:
    """struct(chars, words, lines, status): EMPTY, VERY_SHORT or VALID."""
    t = stripped(F.coalesce(c, F.lit("")))
    n = F.length(t)
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    status = F.when(n == 0, "EMPTY").when(n < least, "VERY_SHORT").otherwise("VALID")
    return F.struct(n.alias("chars"), token_count(t).alias("words"), lines.alias("lines"), status.alias("status"))


def reduction(raw: Column, cleaned: Column) -> Column:
    """Percent of characters that cleaning removed, one decimal."""
    n = F.length(F.coalesce(raw, F.lit("")))
    return F.when(n > 0, F.bround((n - F.length(F.coalesce(cleaned, F.lit("")))) * 100.0 / n, 1)).otherwise(F.lit(0.0))


def cleaning_summary(raw: Column, cleaned: Column) -> Column:
    """struct(raw_chars, clean_chars, raw_words, clean_words, removed_chars, reduction): what cleaning did."""
    a, b = F.coalesce(raw, F.lit("")), F.coalesce(cleaned, F.lit(""))
    return F.struct(
        F.length(a).alias("raw_chars"), F.length(b).alias("clean_chars"), token_count(a).alias("raw_words"), token_count(b).alias("clean_words"),
        (F.length(a) - F.length(b)).alias("removed_chars"), reduction(a, b).alias("reduction"),
    )


def sentences(c: Column) -> Column:
    """Parts after a point, question or exclamation mark or a line end that white space follows."""
    return F.filter(F.split(c, r"(?<=[.!?\n])\s+"), lambda x: F.trim(x) != "")


def word_set(c: Column) -> Column:
    """Distinct words of at least three letters, digits or underscores, in small letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w{3,})\b"), F.lit(1)))


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def excerpt(c: Column, limit: int = 180) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def parse_numeric(c: Column) -> Column:
    """The first number of a text, commas dropped; null where there is none."""
    return F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")), r"[-+]?[0-9]*\.?[0-9]+", 0).try_cast("double")
