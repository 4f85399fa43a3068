"""Column functions on numbers. Each says what it does with null, NaN and infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def numeric_text(c: Column) -> Column:
    """Text in plain decimal notation as a double; any other text is null."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.trim(c).try_cast("double"))


def price_text(c: Column) -> Column:
    """Text of a price. With both separators the last is the decimal one; commas alone before groups of three digits
    part thousands, else the comma is decimal; all other characters go."""
    s = F.regexp_replace(c, r"[^0-9.,-]", "")
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    both, comma = s.contains(",") & s.contains("."), s.contains(",")
    plain = (
        F.when(both & comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(s, F.lit(","), F.lit("")))
        .when(comma & s.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+$"), F.replace(s, F.lit(","), F.lit("")))
        .when(comma, F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(s)
    )
    return plain.try_cast("double")


def half_up(c: Column) -> Column:
    """floor(x + 0.5), as browsers round."""
    return F.floor(c + 0.5)


def percent_change(now: Column, before: Column) -> Column:
    """(now - before) / |before| in percent; null if before is zero or null."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def whole_or_none(c: Column, lowest: float, highest: float) -> Column:
    """The array if it has elements and all lie in [lowest, highest]; else null."""
    return F.when((F.size(c) > 0) & F.forall(c, lambda x: F.coalesce((x >= lowest) & (x <= highest), F.lit(False))), c)
