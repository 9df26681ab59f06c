"""Column expressions shared by operators over the tunnel tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snapshot_number(snapshot: Column) -> Column:
    """The last number before ``.pdb`` in a snapshot's file name; null if there is none or it overflows int."""
    return F.regexp_extract(snapshot, r"([0-9]+)[^0-9]*\.pdb", 1).try_cast("int")


def is_number(value: Column) -> Column:
    """True if a double is neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def number_or_null(value: Column) -> Column:
    return F.when(is_number(value), value)
