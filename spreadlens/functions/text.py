"""Scalar text functions as JVM-side column expressions (no Python UDFs)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's behaviour:
# - a token is a run of two or more Unicode word characters (letters, digits, underscore), text lower-cased first;
# - answer clean-up strips the characters Python's str.isspace() accepts, then lower-cases;
# - numbers in prompts are shown with two decimals, no grouping separator.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
NUMBER_FORMAT = "0.00"

# Derived by rule (not transcribed): every code point Python treats as whitespace.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def tokens(text: Column) -> Column:
    """array<string> of lower-cased word tokens, in text order (duplicates kept)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def strip_lower(text: Column) -> Column:
    """Python ``s.strip().lower()``: Spark's ``trim`` drops spaces only, so trim the full whitespace set."""
    return F.lower(F.btrim(text, F.lit(WHITESPACE)))


def capitalize(text: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower ('fake NEWS' -> 'Fake news')."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def fmt2(x: Column) -> Column:
    """Two-decimal display equal to Python's ``f'{x:.2f}'`` (half-even on the binary value, no grouping)."""
    return F.call_function("format_number", x.cast("double"), F.lit(NUMBER_FORMAT))


def sql_str_literal(s: str) -> str:
    """Quote a Python string as a SQL string literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"
