"""Marks of multiple-answer questions as Column expressions (no UDFs, so they stay in generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(sel: Column, ans: Column) -> Column:
    """1 for exactly the right options; 0.5 for at least half of two or more right ones and no wrong one; else 0.

    Nothing picked, and a question without a key, give 0. The published table ends at five right options; beyond that the
    same rule is our assumption.
    """
    wrong = F.size(F.array_except(sel, ans))
    right, n = F.size(F.array_intersect(sel, ans)), F.size(ans)
    clean = (F.size(sel) > 0) & (wrong == 0)
    return F.when(clean & (right == n), 1.0).when(clean & (n >= 2) & (2 * right >= n), 0.5).otherwise(0.0)


def half_up(x: Column) -> Column:
    """Rounding to whole numbers, halves up."""
    return F.floor(x + 0.5)


def mark20(total: Column, n: Column) -> Column:
    """A mark out of 20 with two decimals."""
    return half_up(total / n * 2000) / 100


def percent(part: Column, whole: Column) -> Column:
    return half_up(100 * part / whole).cast("long")
