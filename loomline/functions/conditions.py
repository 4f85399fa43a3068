"""Conditions and orders given as data, for sources whose callers pass filters by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def condition(name: str, op: str, value) -> Column:
    """One condition. and/or take a list of conditions as value, not takes one; null never satisfies a comparison.

    ops: eq neq gt gte lt lte in is like ilike and or not. `*` is the wildcard of like and ilike.
    """
    if op in ("and", "or"):
        parts = [condition(*v) for v in value]
        return reduce(lambda a, b: a & b if op == "and" else a | b, parts)
    if op == "not":
        return ~condition(*value)
    c = F.col(name)
    if op == "in":
        return c.isin(list(value))
    if op == "is":
        return c.isNull() if value is None else c == F.lit(value)
    if op in ("like", "ilike"):
        return getattr(c, op)(value.replace("*", "%"))
    compare = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
    if op not in compare:
        raise ValueError(f"unknown condition {op!r}")
    return getattr(c, compare[op])(F.lit(value))


def order(name: str, descending: bool = False, nulls_first: bool = False) -> Column:
    """Nulls come last unless asked for, in either direction."""
    c = F.col(name)
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
