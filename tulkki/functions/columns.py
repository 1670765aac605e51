"""Small helpers for DataFrames and Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns computed exactly once per row.

    Catalyst inlines a projected expression into every lambda that uses it,
    so an array used inside ``transform``/``filter`` would be rebuilt per
    element.  Producing the columns through a one-row ``inline`` generator
    makes them generator output, which is never inlined.
    """
    keep = [c for c in df.columns if c not in exprs]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))))
