"""Label clean-up and binarisation (positive class = 'fake')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_lower

# Fixed values that must match the reference's behaviour.
POSITIVE = "fake"
NEGATIVE = "real"
LENIENT_POSITIVE = ["fake", "yes"]
AFFIRMATIVE = "yes"
NEGATORY = "no"


def normalize_answer(raw: Column) -> Column:
    """Raw model answer -> stripped, lower-cased text."""
    return strip_lower(raw)


def extract_label(text: Column) -> Column:
    """Lower-case; contains 'fake' or equals 'yes' -> 'fake'; else contains 'real' or equals 'no' -> 'real';
    otherwise the lower-cased text itself. NULL stays NULL."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit(POSITIVE)) | (low == AFFIRMATIVE), F.lit(POSITIVE))
        .when(F.contains(low, F.lit(NEGATIVE)) | (low == NEGATORY), F.lit(NEGATIVE))
        .otherwise(low)
    )


def binarize_strict(label: Column) -> Column:
    """1 iff the label equals 'fake' exactly; anything else (incl. NULL) -> 0."""
    return F.coalesce((label == POSITIVE).cast("int"), F.lit(0))


def binarize_lenient(label: Column) -> Column:
    """1 iff the label is 'fake' or 'yes'; anything else (incl. NULL) -> 0."""
    return F.coalesce(label.isin(*LENIENT_POSITIVE).cast("int"), F.lit(0))


def is_parsed(label: Column) -> Column:
    """True when a cleaned label is one of the two classes (used for the `unparsed` count)."""
    return F.coalesce(label.isin(POSITIVE, NEGATIVE), F.lit(False))
