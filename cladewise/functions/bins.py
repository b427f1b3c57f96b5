"""Break tables: labels and bin lookup under both closing conventions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_breaks(breaks: list[float]) -> list[float]:
    values = [float(b) for b in breaks]
    if len(values) < 2 or math.isinf(values[0]) or any(a >= b for a, b in zip(values, values[1:])):
        raise ValueError("breaks must increase strictly and start at a finite bound")
    return values


def format_bound(value: float) -> str:
    if math.isinf(value):
        return "Inf"
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def labels(breaks: list[float], right: bool = False) -> list[str]:
    """``[a,b)`` labels, or ``(a,b]`` when bins are closed on the right."""
    values = check_breaks(breaks)
    form = "({},{}]" if right else "[{},{})"
    return [form.format(format_bound(a), format_bound(b)) for a, b in zip(values, values[1:])]


def suffix(threshold: float) -> str:
    """Threshold as part of a column name: the decimal point becomes ``_``."""
    return format_bound(threshold).replace(".", "_")


def _by_bin(value: Column, breaks: list[float], results: list, right: bool, include_lowest: bool) -> Column:
    values = check_breaks(breaks)
    last = len(values) - 1
    found = None
    for number, (low, high) in enumerate(zip(values, values[1:]), start=1):
        if right:
            above = value >= F.lit(low) if include_lowest and number == 1 else value > F.lit(low)
            inside = above & (value <= F.lit(high))
        else:
            below = value <= F.lit(high) if include_lowest and number == last else value < F.lit(high)
            inside = (value >= F.lit(low)) & below
        result = F.lit(results[number - 1])
        found = F.when(inside, result) if found is None else found.when(inside, result)
    return found


def bin_index(value: Column, breaks: list[float], right: bool = False, include_lowest: bool = True) -> Column:
    """1-based bin of the value, null outside all bins.

    ``right=False`` gives ``[a,b)`` and ``include_lowest`` then closes the last
    bin; ``right=True`` gives ``(a,b]`` and ``include_lowest`` closes the first.
    """
    return _by_bin(value, breaks, list(range(1, len(breaks))), right, include_lowest)


def bin_label(value: Column, breaks: list[float], names: list[str] | None = None, right: bool = False,
              include_lowest: bool = True) -> Column:
    """Label of the value's bin, null outside all bins."""
    return _by_bin(value, breaks, names or labels(breaks, right), right, include_lowest)
