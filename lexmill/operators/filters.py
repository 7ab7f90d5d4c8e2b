"""Request parameters as column predicates; bad values are dropped, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = (1900, 2100)


def number(x) -> float | None:
    """A finite number of at least 0, else None."""
    try:
        v = float(str(x).replace(",", "."))
    except ValueError:
        return None
    return v if 0 <= v < float("inf") else None


def bounds(params: dict, name: str) -> tuple[float | None, float | None]:
    """(least, most) from name_min and name_max, put in order; years are clamped."""
    a, b = number(params.get(f"{name}_min", "")), number(params.get(f"{name}_max", ""))
    if name == "year":
        a, b = (None if v is None else min(max(v, YEARS[0]), YEARS[1]) for v in (a, b))
    return (b, a) if a is not None and b is not None and a > b else (a, b)


def ranges(params: dict, **columns: Column) -> Column:
    """A predicate from all ``<name>_min`` and ``<name>_max`` in params that name a column."""
    out = F.lit(True)
    for name, c in columns.items():
        a, b = bounds(params, name)
        if a is not None:
            out = out & (c >= a)
        if b is not None:
            out = out & (c <= b)
    return out
