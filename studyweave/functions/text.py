"""Reading values out of text. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import MISSING_CODES, WHITE_SPACE

NUMBER_PREFIX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
NUMBER_TEXT = NUMBER_PREFIX + "$"


def trim_all(text: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's own trim strips spaces only).

    A text that begins and ends with a visible ASCII character is told by these two, which costs less than the search.
    """
    visible = [F.ascii(F.substring(text, at, 1)).between(33, 126) for at in (1, -1)]
    return F.when(visible[0] & visible[1], text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def is_recorded(value: Column, codes=MISSING_CODES) -> Column:
    """True where the value is present and is not a placeholder."""
    return value.isNotNull() & ~value.isin(*codes)


def prefix_real(text: Column) -> Column:
    """Leading number of a text as double; 0.0 where it has none, NULL for NULL."""
    number = F.regexp_extract(trim_all(text), NUMBER_PREFIX, 0).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0.0)))


def number_or_null(text: Column) -> Column:
    """The whole text as double, NULL where it is not a plain decimal number.

    The pattern goes first because a cast alone also takes Java suffixes such as ``3D``.
    """
    bare = trim_all(text)
    return F.when(bare.rlike(NUMBER_TEXT), bare.try_cast("double"))
