"""Argmax, latest, top-k and effective-row operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(order: Sequence[str], c: str | Column, otherwise: int) -> Column:
    """Place of a value in ``order`` (from 1), or ``otherwise``."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("int")
    for i, v in enumerate(order, 1):
        out = F.when(c == v, i).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given total order (DISTINCT ON). The window's rank limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def effective_rows(rows: DataFrame, key: Sequence[str], signature: Sequence[str], legacy: str, score: Column, order: Sequence[Column]) -> DataFrame:
    """Drop legacy rows that a canonical row of the same signature covers, then keep the best per key."""
    canonical = rows.filter(~F.col(legacy)).select(*signature).distinct()
    kept = rows.filter(~F.col(legacy)).unionByName(rows.filter(legacy).join(canonical, list(signature), "left_anti"))
    return first_per(kept.withColumn("_score", score), key, [F.col("_score").desc(), *order]).drop("_score")


def near_best(df: DataFrame, keys: Sequence[str], score: str, slack: float, floor: float) -> DataFrame:
    """Candidates whose score is at least ``max(floor, best of the key - slack)``."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return df.withColumn("_best", best).filter(F.col(score) >= F.greatest(F.lit(floor), F.col("_best") - slack)).drop("_best")


def as_of(events: DataFrame, keys: Sequence[str], at: str, value: Column) -> Column:
    """Last non-null ``value`` at or before each row, within the keys."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
