"""Pushed filters of the Python data sources: three-valued checks of a value against the filters that a reader takes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import datasource as D

#: The option of relations that ``readers.scan`` offers filters to; without it a reader takes none.
FILTERED = "filtered"

_ORDER = {D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x, D.LessThan: lambda v, x: v < x, D.LessThanOrEqual: lambda v, x: v <= x}
_TEXT = {D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: str.__contains__}


def column_of(f: D.Filter) -> str | None:
    """The top-level column that a filter is about."""
    f = f.child if isinstance(f, D.Not) else f
    at = getattr(f, "attribute", ())
    return at[0] if len(at) == 1 else None


def known(f: D.Filter) -> bool:
    f = f.child if isinstance(f, D.Not) else f
    return isinstance(f, (D.EqualTo, D.EqualNullSafe, D.In, D.IsNull, D.IsNotNull, *_ORDER, *_TEXT))


def holds(f: D.Filter, v) -> bool | None:
    """SQL's answer for the value ``v`` of the filter's column; None is unknown."""
    if isinstance(f, D.Not):
        inner = holds(f.child, v)
        return None if inner is None else not inner
    if isinstance(f, D.IsNull):
        return v is None
    if isinstance(f, D.IsNotNull):
        return v is not None
    if isinstance(f, D.EqualNullSafe):
        return v == f.value
    if v is None:
        return None
    if isinstance(f, D.In):
        return True if v in f.value else None if None in f.value else False
    if isinstance(f, D.EqualTo):
        return None if f.value is None else v == f.value
    return (_ORDER | _TEXT)[type(f)](v, f.value)


class Pushed:
    """The filters of a reader, by column. ``take`` splits what Spark offers in those it applies and the rest."""

    def __init__(self):
        self.by: dict[str, list[D.Filter]] = {}

    def take(self, filters: Iterable[D.Filter], columns: Iterable[str], also: Iterable[str] = ()) -> list[D.Filter]:
        """Filters on ``columns`` are applied here alone; those on ``also`` prune here and are checked again by Spark."""
        columns, also, rest = set(columns), set(also), []
        for f in filters:
            c = column_of(f)
            if known(f) and c in columns | also:
                self.by.setdefault(c, []).append(f)
            if not known(f) or c not in columns:
                rest.append(f)
        return rest

    def passes(self, **values) -> bool:
        return all(holds(f, v) is True for c, v in values.items() for f in self.by.get(c, ()))

    def span(self, column: str, low: int, high: int) -> tuple[int, int]:
        """The part of low..high (end exclusive) that bounds on a whole-number column leave."""
        for f in self.by.get(column, ()):
            if isinstance(f, (D.EqualTo, D.GreaterThanOrEqual)):
                low = max(low, f.value)
            elif isinstance(f, D.GreaterThan):
                low = max(low, f.value + 1)
            if isinstance(f, (D.EqualTo, D.LessThanOrEqual)):
                high = min(high, f.value + 1)
            elif isinstance(f, D.LessThan):
                high = min(high, f.value)
            elif isinstance(f, D.In) and all(v is not None for v in f.value):
                low, high = max(low, min(f.value, default=high)), min(high, max(f.value, default=low - 1) + 1)
        return low, max(low, high)

    def prefixes(self, column: str) -> list[str]:
        """Strings that every passing value begins with."""
        return [f.value for f in self.by.get(column, ()) if isinstance(f, (D.EqualTo, D.StringStartsWith)) and f.value is not None]
