"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalized_name(name: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]", "")


def year_in_text(text: Column) -> Column:
    """First four-digit run as an integer, null when there is none."""
    return F.regexp_substr(text, F.lit(r"\d{4}")).cast("int")


def labelled(prefix: str, value: Column) -> Column:
    """``prefix value``, null for a missing value."""
    return F.concat(F.lit(prefix + " "), value.cast("string"))


def to_date(text: Column) -> Column:
    """ISO date, null when the text is none."""
    return F.try_to_date(text, "yyyy-MM-dd")


def year_month_day(text: Column) -> Column:
    """Date from year, month and day in this order, with any separators or none; null when the text is none.

    Months are numbers or English names; years have four digits, or two
    (69 to 99 are of the last century).
    """
    parts = r"^\s*(\d{4}|\d{2})[^0-9A-Za-z]*(\d{1,2}|[A-Za-z]{3,9})[^0-9A-Za-z]*(\d{1,2})\D*$"
    packed = r"^\s*(\d{4}|\d{2})(\d{2})(\d{2})\s*$"
    year, month, day = (
        F.when(text.rlike(packed), F.regexp_extract(text, packed, i)).otherwise(F.regexp_extract(text, parts, i))
        for i in (1, 2, 3)
    )
    century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
    spelt = F.concat(century, year, F.lit("-"), F.initcap(F.substring(month, 1, 3)), F.lit("-"), day)
    plain = F.concat(century, year, F.lit("-"), month, F.lit("-"), day)
    return F.coalesce(F.try_to_date(plain, "yyyy-M-d"), F.try_to_date(spelt, "yyyy-MMM-d"))
