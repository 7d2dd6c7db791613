"""Labels and predicates decided by names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_by_pattern(
    name: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None
) -> Column:
    """Label of the first rule whose case-sensitive pattern matches; else ``otherwise``."""
    labels = [F.when(name.like(pattern), F.lit(text)) for pattern, text in rules]
    return F.coalesce(*labels, F.lit(otherwise))


def like_any(name: Column, patterns: Sequence[str]) -> Column:
    """True where at least one case-sensitive pattern matches."""
    return reduce(or_, [name.like(pattern) for pattern in patterns])


def not_named(name: Column, excluded: str) -> Column:
    """Exact comparison; a missing name does not pass."""
    return name != F.lit(excluded)


def not_named_any(name: Column, excluded: Sequence[str]) -> Column:
    """Comparison in lower case against a list; a missing name does not pass."""
    return ~F.lower(name).isin(*excluded)
