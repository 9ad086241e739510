"""Numbers and dates out of text. Bad text is NULL unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY


def _one_dot(s: Column) -> Column:
    """Text that is a plain decimal number, else NULL (try_cast alone would take exponents and blanks)."""
    return F.when(s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), s).try_cast(MONEY)


def italian_decimal(text: Column, thousands: bool = True) -> Column:
    """`1.091,50` is 1091.50; a lone dot before three digits groups thousands, if asked for."""
    s = F.regexp_replace(F.trim(text), "[€$ ]", "")
    dot, comma = s.contains("."), s.contains(",")
    plain = F.when(dot & comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma, F.replace(s, F.lit(","), F.lit(".")))
    if thousands:
        plain = plain.when(s.rlike(r"^[0-9-]*[0-9][0-9-]*\.[^.]{3}$"), F.replace(s, F.lit("."), F.lit("")))
    return _one_dot(plain.otherwise(s))


def screen_decimal(text: Column) -> Column:
    """As italian_decimal, and a lone dot is always a decimal point."""
    return italian_decimal(text, thousands=False)


def voter_decimal(text: Column, strict: bool = False) -> Column:
    """A magnitude: commas group where there is a dot, or before exactly three digits; strict raises on other text."""
    s = F.trim(F.regexp_replace(text, "[$€£ ]", ""))
    dot, comma = s.contains("."), s.contains(",")
    grouped = (dot & comma) | (comma & s.rlike(r"^[^,]*,[^,]{3}$"))
    value = F.abs(_one_dot(F.when(grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))))
    if not strict:
        return value
    return F.when(text.isNull() | (s == ""), F.lit(None).cast(MONEY)).when(value.isNull(), F.raise_error(F.concat(F.lit("not a decimal number: "), text)).cast(MONEY)).otherwise(value)


def whole_number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text)).try_cast("bigint")


def moment(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats))


def statement_date(text: Column) -> Column:
    """Dates as broker statements write them."""
    return moment(text, ("dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd"))


def add_years(at: Column, years: Column | int) -> Column:
    """The same day so many years on; February 29 becomes 28 where the year has none."""
    return at + F.make_ym_interval(F.lit(years) if isinstance(years, int) else years, F.lit(0))


def end_of_day(at: Column) -> Column:
    """A bound at midnight means the whole day."""
    return F.when(at == F.date_trunc("day", at), at + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")).otherwise(at)


def money(value: Column) -> Column:
    return F.bround(value, 2)
