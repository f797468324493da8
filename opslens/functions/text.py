"""Small text expressions shared by the parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space other than the blank; a line has none of it as a rule.
_OTHER_SPACE = r"[\t\x0B\f\r]"


def blanks(text: Column) -> Column:
    """The text with every kind of white space as a blank, so that it splits without a pattern."""
    return F.when(text.rlike(_OTHER_SPACE), F.regexp_replace(text, _OTHER_SPACE, " ")).otherwise(text)


def without(text: Column, mark: str) -> Column:
    """The text without ``mark``; missing text is empty."""
    return F.coalesce(F.replace(text, F.lit(mark), F.lit("")), F.lit(""))


def number(text: Column) -> Column:
    """A number written with thousands separators."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")
