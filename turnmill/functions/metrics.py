"""Retrieval measures of one query: two arrays in, one number out.

``retrieved`` is in rank order. A null array counts as empty. Ids are compared as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ids(c: Column) -> Column:
    return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    """One over the first rank that holds an expected id; 0 if none does."""
    hits = F.filter(F.transform(_ids(expected), lambda x: F.array_position(_ids(retrieved), x)), lambda p: p > 0)
    return F.coalesce(1.0 / F.array_min(hits), F.lit(0.0))


def recall(retrieved: Column, expected: Column) -> Column:
    """Share of the expected ids that were retrieved (repeated ones count each time); null where
    nothing is expected, since there is nothing to measure against."""
    hits = F.size(F.filter(_ids(expected), lambda x: F.array_contains(_ids(retrieved), x)))
    return F.try_divide(hits, F.size(_ids(expected)))


def precision(retrieved: Column, expected: Column) -> Column:
    """Share of the retrieved ids that were expected; 0 where either is empty."""
    hits = F.size(F.filter(_ids(retrieved), lambda x: F.array_contains(_ids(expected), x)))
    return F.coalesce(F.try_divide(hits, F.size(_ids(retrieved))), F.lit(0.0))


#: Measures by name; more may be added.
EVALUATORS: dict[str, Callable[[Column, Column], Column]] = {"mrr": reciprocal_rank, "recall": recall, "precision": precision}

#: Measures that plans work out from the number of expected ids, without their list.
BUILT_IN = frozenset(EVALUATORS)


def evaluator(name: str) -> Callable[[Callable[[Column, Column], Column]], Callable[[Column, Column], Column]]:
    """Decorator that registers a measure."""

    def add(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        EVALUATORS[name] = f
        return f

    return add
