"""Pair-wise rule expressions over similarity columns.

A rule is an ordinary Column. ``atom`` cuts a similarity at its threshold; the
combinators return 0 where the pair does not satisfy them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def atom(sim: Column, theta: float) -> Column:
    """The similarity where it reaches ``theta``, else 0; a missing value is 0."""
    return F.when(sim >= theta, sim).otherwise(F.lit(0.0))


def all_of(*parts: Column) -> Column:
    """AND: the smallest part."""
    return F.least(*parts) if len(parts) > 1 else parts[0]


def any_of(*parts: Column) -> Column:
    """OR: the largest part."""
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def minus(first: Column, second: Column) -> Column:
    return F.when(second == 0, first).otherwise(F.lit(0.0))


def one_of(first: Column, second: Column) -> Column:
    """XOR: the larger part where exactly one is satisfied."""
    return F.when((first > 0) != (second > 0), F.greatest(first, second)).otherwise(F.lit(0.0))


def weighted(first: Column, second: Column, c1: float, c2: float, theta: float) -> Column:
    """ADD: c1*first + c2*second where both hold and the sum reaches ``theta``."""
    total = first * c1 + second * c2
    return F.when((first > 0) & (second > 0) & (total >= theta), total).otherwise(F.lit(0.0))


def product(first: Column, second: Column, c1: float, c2: float, theta: float) -> Column:
    """MULT: c1*c2*first*second where it reaches ``theta``."""
    total = first * second * (c1 * c2)
    return F.when((first > 0) & (second > 0) & (total >= theta), total).otherwise(F.lit(0.0))
