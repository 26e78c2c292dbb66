"""Vector and rank arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    return let(a, lambda v: let(norm(v), lambda length: F.transform(
        v, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def same_dimension(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def rank_vote(rank: Column, k: int = L.RRF_K) -> Column:
    """Reciprocal-rank vote of a 1-based rank."""
    return F.coalesce(F.lit(1.0) / (rank + k), F.lit(0.0))


def scaled(votes: Column, k: int = L.RRF_K) -> Column:
    """1 means first in both lists."""
    return votes / F.lit(2.0 / (k + 1))


def page_factor(page: Column, decay: float = L.PAGE_DECAY) -> Column:
    """Early pages weigh slightly more."""
    return F.when(page > 1, F.lit(1.0) / (1 + (page - 1) * F.lit(decay))).otherwise(F.lit(1.0))


def candidate_depth(limit: int) -> int:
    return max(limit * 4, L.MIN_CANDIDATES)


def percent(part: Column, whole: Column) -> Column:
    """Null when there is nothing to measure."""
    return F.try_divide(part * F.lit(100.0), whole)
