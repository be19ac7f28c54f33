"""Display-only number formats; tables keep full precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decimals(c: Column, pattern: str) -> Column:
    """Fixed decimals, rounding the exact value half to even (format_string rounds half up)."""
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def fmt_pct(c: Column, digits: int = 1) -> Column:
    """A share as a percentage, e.g. 12.5%."""
    return F.concat(_decimals(c * 100, f"0.{'0' * digits}"), F.lit("%"))


def fmt_num(c: Column, digits: int = 3, signed: bool = False) -> Column:
    """Fixed decimals, optionally with an explicit sign."""
    pattern = f"0.{'0' * digits}"
    return _decimals(c, f"+{pattern};-{pattern}" if signed else pattern)


def round_even(c: Column, digits: int = 3) -> Column:
    """Half-to-even rounding, as the report tables show."""
    return F.bround(c, digits)
