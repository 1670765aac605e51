"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row.

    An expression named inside a lambda would be computed again for every
    element; bound as a lambda variable it is computed before.
    """
    return F.get(F.transform(F.array(value), use), 0)
