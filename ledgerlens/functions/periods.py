"""Year-month labels and month arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.functions.text import col


def period_label(year: Column | str, month: Column | str) -> Column:
    return F.format_string("%04d-%02d", col(year).cast("int"), col(month).cast("int"))


def is_period(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(C.PERIOD_PATTERN), F.lit(False))


def period_year(c: Column | str) -> Column:
    return F.substring(col(c), 1, 4).try_cast("int")


def period_month(c: Column | str) -> Column:
    return F.substring(col(c), 6, 2).try_cast("int")


def month_index(c: Column | str) -> Column:
    return period_year(c) * 12 + period_month(c) - 1


def index_label(i: Column | str) -> Column:
    return F.format_string(
        "%04d-%02d", F.floor(col(i) / 12).cast("int"), (col(i) % 12 + 1).cast("int"))


def strict_int(c: Column | str, field: str) -> Column:
    """Digits only; anything else fails the query, as a broken period must."""
    x = col(c).cast("string")
    return F.when(x.rlike(r"^[0-9]+\z"), x.cast("int")).otherwise(
        F.raise_error(F.concat(
            F.lit(f"{field} no es un entero: "), F.coalesce(x, F.lit("None")))))


def check_period_text(value: str) -> str:
    """Validate a period given as a parameter; raise ValueError with the usual message."""
    text = " ".join(value.replace("\ufeff", "").split())
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}", text):
        raise ValueError(C.GATE_BAD_PERIOD % value)
    if not 1 <= int(text[5:]) <= 12:
        raise ValueError(C.GATE_BAD_MONTH % value)
    return text


def usable_period_range(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """Filter bounds from a user: malformed ones are unset, reversed ones swapped."""
    bounds = []
    for value in (start, end):
        try:
            bounds.append(check_period_text(value) if value else None)
        except ValueError:
            bounds.append(None)
    if None not in bounds:
        bounds.sort()
    return bounds[0], bounds[1]
