"""Number parsing and NULL-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(_\d+)*"
_PLAIN = r"^[+-]?\d+(\.\d*)?$"
_FLOAT = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
PLAIN_NUMBER = _FLOAT  # what counts as a number at the edge; a suffix such as 1d does not
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def parse_number(text: Column) -> Column:
    """Cleaned text to double: thousands commas dropped, sign kept, anything odd becomes NULL.

    Nearly all numbers have the plain shape, so the general patterns run only for the rest.
    """
    t = F.translate(text, ",", "")
    return (
        F.when(t.rlike(_PLAIN), t.try_cast("double"))
        .when(t.rlike(_FLOAT), F.translate(t, "_", "").try_cast("double"))
        .when(t.rlike(_INFINITE), t.try_cast("double"))
    )


def parse_number_lenient(c: Column, scale: str = "decimal(12,2)") -> Column:
    """Keep only digits, dot and minus; the storage layer's way of reading a number."""
    return F.nullif(F.regexp_replace(c, r"[^0-9.-]", ""), F.lit("")).try_cast(scale)


def flag(c: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(c, F.lit(False))


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; unlike ``greatest``/``least`` alone a NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))
