"""Row predicates, as plain Columns that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: tokens and patterns --------------------------------------
# \z is used where the pattern must end at the very last character.
# Whitespace is spelled out so that it means the same five characters everywhere.
MISSING_TOKENS = (
    "na",
    "n/a",
    "null",
    "none",
    "-",
    "?",
    "unknown",
    "missing",
    "todo",
    "tbd",
    "n.a.",
)
PLACEHOLDERS = ("test", "xxx", "foo", "abc", "12345", "dummy", "example")
FORMULA_PREFIXES = ("=", "+", "-", "@", "\t", "\r")
REPEATED_SPACE = r"[\t\n\f\r ]{2,}"
CONTROL_CHARACTER = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
EMAIL = r"^[^@\t\n\f\r ]+@[^@\t\n\f\r ]+\.[^@\t\n\f\r ]+\z"
URL = r"^(https?|ftp)://[^\t\n\f\r ]+\z"
IPV4 = (
    r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    r"(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}\z"
)
FULLWIDTH = r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"
REPLACEMENT_CHARACTER = "�"
NUMERIC_TEXT = r"^[+-]?[\d,.\t\n\f\r ]+\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{4}\z"
DOT_DATE = r"^\d{1,2}\.\d{1,2}\.\d{4}\z"
COMPACT_DATE = r"^\d{8}\z"
MIN_DIGITS, MAX_DIGITS = 7, 15
LONG_TEXT = 1024
FUZZY_STRIP = "[^0-9A-Za-z一-鿿]"
VARIANT_STRIP = "[^0-9a-z]+"
# ---- end of fixed values ----------------------------------------------------


def is_missing_token(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*MISSING_TOKENS)


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def has_outer_space(c: Column) -> Column:
    return c != F.trim(c)


def has_repeated_space(c: Column) -> Column:
    return c.rlike(REPEATED_SPACE)


def has_control_character(c: Column) -> Column:
    return c.rlike(CONTROL_CHARACTER)


def is_long(c: Column, limit: int = LONG_TEXT) -> Column:
    return F.length(c) > limit


def is_bad_email(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).rlike(EMAIL)


def is_bad_phone(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return ~digits.between(MIN_DIGITS, MAX_DIGITS)


def is_bad_url(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).rlike(URL)


def is_bad_ipv4(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).rlike(IPV4)


def has_formula_prefix(c: Column) -> Column:
    return F.substring(c, 1, 1).isin(*FORMULA_PREFIXES)


def has_fullwidth(c: Column) -> Column:
    return c.rlike(FULLWIDTH)


def has_replacement_character(c: Column) -> Column:
    return c.contains(REPLACEMENT_CHARACTER)


def is_not_numeric_text(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).rlike(NUMERIC_TEXT)


def is_not_iso_date(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).rlike(ISO_DATE)


def calendar_date(c: Column) -> Column:
    """The date an ISO-shaped text names, NULL when there is no such day."""
    return F.try_to_date(F.trim(c), "yyyy-MM-dd")


def is_impossible_date(c: Column) -> Column:
    return F.trim(c).rlike(ISO_DATE) & calendar_date(c).isNull()


def date_class(c: Column) -> Column:
    """Name of the date notation a text uses."""
    text = F.regexp_replace(c, r"^\s+|\s+\z", "")
    return (
        F.when(text.rlike(ISO_DATE), "iso")
        .when(text.rlike(SLASH_DATE), "slash")
        .when(text.rlike(DOT_DATE), "dot")
        .when(text.rlike(COMPACT_DATE), "compact")
        .otherwise("other")
    )


def fuzzy_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, FUZZY_STRIP, ""))


def variant_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), VARIANT_STRIP, "")


def case_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def changes(before: Column, after: Column) -> Column:
    """the cell differs, counting NULL as a value."""
    return ~before.eqNullSafe(after)
