"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions the optimizer can't copy into those that use them.

    A chain of large expressions, each used several times by the next, would else be inlined and grow without end. A
    generator over one struct stays where it is, within the same stage, and hands on plain values.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
