"""Column expressions the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: blank and U+0009 to U+000D
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"


def without_space(text: Column) -> Column:
    """The text without ASCII white space; plain replacement is cheaper than a pattern."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), _SPACES, text)


def whole_text(text: str | Column) -> Column:
    """The text itself, NULL as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def join_null_safe(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join on columns of different names, NULL matching NULL; the right keys are dropped."""
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in on.items()])
    return left.join(right, same, how).drop(*on.values())
