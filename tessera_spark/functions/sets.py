"""Set measures over array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, *, empty: float = 0.0, either_empty: float | None = None) -> Column:
    """|a & b| / |a | b|; `empty` if both are empty, `either_empty` (by default the plain 0) if only one is. Nulls are empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    ratio = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")
    out = F.when((F.size(a) == 0) & (F.size(b) == 0), float(empty))
    if either_empty is not None:
        out = out.when((F.size(a) == 0) | (F.size(b) == 0), float(either_empty))
    return out.otherwise(ratio)


def count_left(a: Column, b: Column) -> Column:
    """Elements of a, duplicates included, that occur in b."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))
