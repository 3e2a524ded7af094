"""Text columns: whitespace, words, numbers as text.

All but the shortest text of a double are native expressions.  Word arrays take a ``limit`` so that a
rule needing only the first few words never splits a whole document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.fixed_values import WHITESPACE, WHITESPACE_CLASS

_NUMBER = (
    r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
)


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace (linear, no regex backtracking)."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(stripped: Column, limit: int = -1) -> Column:
    """Words of an already stripped text.

    With ``limit`` the array stops there: its last element is the unsplit rest.
    """
    parts = F.split(stripped, WHITESPACE_CLASS + "+", limit)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(parts)


def word_count(stripped: Column, up_to: int = -1) -> Column:
    """Number of words, counting no further than ``up_to`` when given."""
    return F.size(words(stripped, up_to))


def head(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def capitalise(text: Column) -> Column:
    """Upper-case the first character, leave the rest."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def float_or_null(text: Column) -> Column:
    """Read text as a double.

    Allows surrounding whitespace, digit-group underscores, inf and nan; rejects
    the type suffixes (``1d``, ``1f``) that a SQL cast would take.
    """
    body = strip(text)
    lowered = F.lower(F.regexp_replace(body, "^[+-]", ""))
    return (
        F.when(body.rlike(_NUMBER), F.regexp_replace(body, "_", "").try_cast("double"))
        .when(lowered == "nan", F.lit(float("nan")))
        .when(
            lowered.isin("inf", "infinity"),
            F.when(body.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
        )
    )


@F.pandas_udf(StringType())
def _shortest(values: pd.Series) -> pd.Series:
    return pd.Series([repr(value) for value in values.tolist()], dtype="object")


def float_text(value: Column) -> Column:
    """Shortest text of a double: 20.5, 12345678.0, 1e-05, 1e+16.

    An Arrow UDF: the JVM before version 19 may print more digits than needed and
    switches to exponents at other sizes, and undoing both in expressions
    overflows generated code once a few columns are rendered together.
    """
    return F.when(value.isNotNull(), _shortest(value))


def two_decimals(value: Column) -> Column:
    """Exact two-decimal rendering of the binary value, ties to even.

    ``format_string('%.2f')`` rounds the shortest decimal text half-up, so 1.005
    and 0.125 come out differently.  Here the fraction is scaled by 2**56 and
    rounded in integers, which is exact.
    """
    size = F.abs(value)
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(2**56))
    units = F.floor(scaled)
    rest = scaled - units
    hundredfold = units * F.lit(100).cast("bigint")
    cents = F.shiftright(hundredfold, 56)
    over_half = hundredfold.bitwiseAND(F.lit(2**56 - 1)) - F.lit(2**55)
    excess = over_half + rest * 100
    bump = F.when((excess > 0) | ((excess == 0) & (cents % 2 == 1)), 1).otherwise(0)
    total = whole * 100 + cents + bump
    text = F.concat(
        F.when(value < 0, "-").otherwise(""),
        ((total - total % 100) / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((total % 100).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value < 0, "-inf").otherwise("inf"))
        .when(size >= float(2**46), F.format_string("%.2f", value))
        .otherwise(text)
    )


def right_align(text: Column, width: int) -> Column:
    """Pad on the left up to ``width``; longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)
