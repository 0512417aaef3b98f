"""Labels for value ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Label of the first rule that holds; a NULL condition does not hold."""
    label = None
    for condition, name in rules:
        label = F.when(condition, name) if label is None else label.when(condition, name)
    return F.lit(otherwise) if label is None else label.otherwise(otherwise)


def at_most(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first upper bound that ``value`` does not exceed."""
    return first_match([(value <= F.lit(bound), name) for bound, name in bounds], otherwise)


def at_least(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first lower bound that ``value`` reaches."""
    return first_match([(value >= F.lit(bound), name) for bound, name in bounds], otherwise)
