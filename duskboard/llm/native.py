"""Column expressions the native operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Plain lower() is quicker and the same where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row. A later filter or lambda over a plain alias may get the alias's whole
    expression in its place, and so split a text anew for each of its words; it cannot look behind a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
