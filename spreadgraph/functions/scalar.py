"""Scalar functions of the reports, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_uncertain(value: Column, error: Column) -> Column:
    """``value ± error`` with as many decimals (4 at most) as the error needs to show."""
    text = lambda d: F.format_string(f"%.{d}f ± %.{d}f", value, error)
    out = F.when(error >= 1, text(0))
    for d in (1, 2, 3):
        out = out.when(error >= 10.0**-d, text(d))
    return out.otherwise(text(4))


def fixed(value: Column, decimals: int = 2) -> Column:
    """A number as text with fixed decimals; null shows as nothing."""
    number = value.cast("double")
    return F.when(number.isNull(), F.lit("")).otherwise(F.format_string(f"%.{decimals}f", number))


def blend(colour: Column, share: Column, target: float) -> Column:
    """A colour (array of channels from 0 to 1) moved to white (1.0) or black (0.0) by a share."""
    return F.transform(colour, lambda c: c + (F.lit(target) - c) * share)


def lighter(colour: Column, share: Column) -> Column:
    return blend(colour, share, 1.0)


def darker(colour: Column, share: Column) -> Column:
    return blend(colour, share, 0.0)


def host_of(url: Column) -> Column:
    """The host of an address, null if it can't be read."""
    return F.try_parse_url(url, F.lit("HOST"))


def without_suffix(name: Column, suffix: str = ".gt") -> Column:
    """A name without an ending (the ending as a whole, not its letters)."""
    return F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def relabel(column: Column, labels: Mapping[str, str]) -> Column:
    """Display names for values; a value without one keeps its own."""
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(named, column), column) if labels else column
