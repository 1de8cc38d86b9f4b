"""Dates, ISO weeks and week labels as column expressions.

Every text shape is recognised by a pattern first, so a row is read by the one rule that fits
it.  Readings are assembled as ``yyyy-m-d`` text and cast, which is far cheaper than a pattern
driven date parser and never throws.  :func:`add_feed_date` puts every intermediate value into
its own column, so that none is worked out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharetide.functions.text import clean_string, lookup

_YEAR = r"(?!0000)\d{4}"
_YMD = rf"^{_YEAR}(-\d{{1,2}}-|/\d{{1,2}}/)\d{{1,2}}$"
_D_MON_Y = rf"^\d{{1,2}}-[A-Za-z]{{3}}-{_YEAR}$"
_MON_D_Y = rf"^[A-Za-z]{{3}}\s+\d{{1,2}},\s+{_YEAR}$"
# The month is checked by the pattern: reading an impossible date throws inside the cast, which costs more than all else.
_MONTH = r"(0?[1-9]|1[0-2])"
_MONTH_FIRST = rf"^({_MONTH}/\d{{1,2}}/|{_MONTH}-\d{{1,2}}-){_YEAR}$"
_DAY_FIRST = rf"^(\d{{1,2}}/{_MONTH}/|\d{{1,2}}-{_MONTH}-){_YEAR}$"
_INTEGER = r"^[+-]?\d+$"
_INTEGRAL = r"^[+-]?\d+(\.0*)?$"
# Month abbreviations in order.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NUMBER = {name: str(i) for i, name in enumerate(_MONTHS, 1)}


def _assemble(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day)


def _month(name: Column) -> Column:
    return lookup(F.lower(name), _MONTH_NUMBER)


def _middle(c: Column, mark: str) -> Column:
    return F.substring_index(F.substring_index(c, mark, 2), mark, -1)


def parse_date_multi(text: Column) -> Column:
    """Year-first and month-name shapes of trimmed text: one reading each."""
    year = F.right(text, F.lit(4))
    comma_day = F.trim(F.translate(F.substr(F.substring_index(text, ",", 1), F.lit(4)), "\t\n\r", "   "))
    reading = (
        F.when(text.rlike(_YMD), F.translate(text, "/", "-"))
        .when(text.rlike(_D_MON_Y), _assemble(year, _month(_middle(text, "-")), F.substring_index(text, "-", 1)))
        .when(text.rlike(_MON_D_Y), _assemble(year, _month(F.left(text, F.lit(3))), comma_day))
    )
    return reading.try_cast("date")


def numeric_date_readings(text: Column) -> tuple[Column, Column]:
    """``a/b/yyyy`` or ``a-b-yyyy`` read month-first and day-first; NULL where impossible."""
    slashed = F.translate(text, "-", "/")
    first, second, year = F.substring_index(slashed, "/", 1), _middle(slashed, "/"), F.right(text, F.lit(4))
    return (
        F.when(text.rlike(_MONTH_FIRST), _assemble(year, first, second)).try_cast("date"),
        F.when(text.rlike(_DAY_FIRST), _assemble(year, second, first)).try_cast("date"),
    )


def hint_number(text: Column, strict: bool = False) -> Column:
    """A delivered week number (trimmed text) as a whole number, NULL if it is not one."""
    whole = text if strict else F.substring_index(text, ".", 1)
    return F.when(text.rlike(_INTEGER if strict else _INTEGRAL), whole.try_cast("bigint"))


def iso_year(d: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), d)


def iso_week(d: Column, clamp53: bool = True) -> Column:
    w = F.weekofyear(d)
    return F.when(w > 52, F.lit(52)).otherwise(w) if clamp53 else w


def running_week(d: Column, epoch_year: int, clamp53: bool = False) -> Column:
    return (iso_year(d) - F.lit(epoch_year)) * F.lit(52) + iso_week(d, clamp53)


def week_label(year: Column, week: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def year_week(d: Column, clamp53: bool = True) -> Column:
    """ISO label ``YYYY-Www``; NULL for a NULL date, as ``concat`` passes NULL on."""
    return week_label(iso_year(d), iso_week(d, clamp53))


def disambiguate(month_first: Column, day_first: Column, hint: Column, epoch_year: int) -> Column:
    """Pick the reading whose ISO or running week lies nearer to the hint; month-first on ties."""

    def distance(d: Column) -> Column:
        return F.least(
            F.abs(hint - F.weekofyear(d)), F.abs(hint - running_week(d, epoch_year))
        )

    return (
        F.when(month_first.isNull(), day_first)
        .when(day_first.isNull() | hint.isNull() | (month_first == day_first), month_first)
        .when(distance(month_first) > distance(day_first), day_first)
        .otherwise(month_first)
    )


def week_mismatch(hint_text: Column, hint: Column, year: Column, week: Column, epoch_year: int = 2022) -> Column:
    """The hint agrees with neither the ISO week (off by 1) nor the running week (off by 2)."""
    running = (year - F.lit(epoch_year)) * F.lit(52) + week
    return (
        F.when(hint_text.isNull() | week.isNull(), False)
        .when(hint.isNull(), True)
        .otherwise((F.abs(hint - week) > 1) & (F.abs(hint - running) > 2))
    )


def add_feed_date(
    df: DataFrame,
    date: str = "date",
    hint: str = "week_number",
    epoch_year: int = 2022,
    clamp53: bool = True,
    strict_hint: bool = False,
) -> DataFrame:
    """Add ``parsed_date``, ``iso_date``, ``iso_year``, ``iso_week``, ``year_week`` and
    ``is_week_mismatch`` to a feed."""
    texts = {"_date": clean_string(F.col(date)), "_hint_text": clean_string(F.col(hint))}
    direct = {
        "_direct": parse_date_multi(F.col("_date")),
        "_hint": hint_number(F.col("_hint_text"), strict_hint),
    }
    month_first, day_first = numeric_date_readings(F.col("_date"))
    open_still = F.col("_direct").isNull()
    readings = {
        "_month_first": F.when(open_still, month_first),
        "_day_first": F.when(open_still, day_first),
    }
    chosen = disambiguate(F.col("_month_first"), F.col("_day_first"), F.col("_hint"), epoch_year)
    d = F.col("parsed_date")
    return (
        df.withColumns(texts)
        .withColumns(direct)
        .withColumns(readings)
        .withColumn("parsed_date", F.coalesce("_direct", chosen))
        .withColumns(
            {"iso_date": d.cast("string"), "iso_year": iso_year(d), "iso_week": iso_week(d, clamp53)}
        )
        .withColumns(
            {
                "year_week": week_label(F.col("iso_year"), F.col("iso_week")),
                "is_week_mismatch": week_mismatch(
                    F.col("_hint_text"), F.col("_hint"), F.col("iso_year"), F.col("iso_week"), epoch_year
                ),
            }
        )
        .drop("_date", "_hint_text", "_direct", "_hint", "_month_first", "_day_first")
    )


def monday_of(label: Column) -> Column:
    """Monday of a ``YYYY-Www`` label; NULL for a malformed label or an impossible week."""
    shaped = F.when(label.rlike(rf"^{_YEAR}-W\d{{1,2}}$"), label)
    year = F.split_part(shaped, F.lit("-W"), F.lit(1)).try_cast("int")
    week = F.split_part(shaped, F.lit("-W"), F.lit(2)).try_cast("int")
    first = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    day = F.date_add(first, (week - 1) * 7)
    return F.when(week.between(1, 53) & (iso_year(day) == year), day)


def next_year_weeks(label: Column, horizon: int) -> Column:
    """Array of the following labels, on the true 52/53-week calendar.

    The elements stand side by side: compiled code works the Monday out once for all of them, where a function over a
    sequence would be interpreted and find it anew for every week.
    """
    monday = monday_of(label)
    return F.array(*[year_week(F.date_add(monday, 7 * k), clamp53=False) for k in range(1, horizon + 1)])
