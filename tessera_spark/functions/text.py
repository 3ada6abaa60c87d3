"""Names, words and numbers as the engine's rules read them."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a camel-case, snake-case, kebab-case or spaced name; acronyms stay whole. The two patterns are fixed values."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[_\s\-]+"), lambda x: x != "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(r"\b" + re.escape(word) + r"\b")


def round3(x: Column) -> Column:
    """Half up on the scaled double."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4.0))


def name_similarity(a: Column, b: Column) -> Column:
    """Token Jaccard plus shares for common leading and trailing tokens, at most 1, with three decimals; 0 if either has no token."""
    from .sets import jaccard

    most = F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double")
    shares = common_prefix(a, b) / most * 0.15, common_suffix(a, b) / most * 0.15
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(clamp(round3(jaccard(a, b) + shares[0] + shares[1])))


def path_tokens(path: Column) -> Column:
    """Lower-case parts of a path's segments without its extension; camel case is split, repeats stay."""
    plain = F.regexp_replace(path, r"\.[^.]+$", "")
    return F.filter(F.split(F.lower(F.regexp_replace(plain, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), lambda x: x != "")
