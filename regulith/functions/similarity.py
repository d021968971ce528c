"""Similarities of texts and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as the lexical measures count them: runs of letters, digits and apostrophes.
TOKEN = r"[\p{L}0-9']+"


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two vectors; null if one has length 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def tokens(text: str | Column) -> Column:
    """Distinct lower-cased words."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def content_tokens(text: str | Column, stop: tuple[str, ...]) -> Column:
    """Distinct words without stop words, of three letters or more, not numbers."""
    return F.filter(tokens(text), lambda x: (F.length(x) >= 3) & ~x.isin(*stop) & ~x.rlike("^[0-9]+$"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all, of two token sets; 0 if both are empty."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, F.round(shared / every, 4)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.round(F.size(F.array_intersect(a, b)) / least, 4)).otherwise(0.0)
