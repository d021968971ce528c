"""Upserts, deltas and guarded rebuilds as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], values: dict[str, Column], kinds: bool = False) -> DataFrame:
    """Merge by key: ``values`` are columns over ``o.*`` (old) and ``n.*`` (new); unmatched rows of either side pass through the same expressions."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), cond, "full")
    kind = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").otherwise("updated")
    return joined.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[c.alias(a) for a, c in values.items()], *([kind.alias("merge_kind")] if kinds else []))


def delta(wanted: DataFrame, existing: DataFrame, keys: Sequence[str], reason: Column) -> DataFrame:
    """Rows that must run again: ``reason`` over ``w.*`` and ``e.*`` (``e._known`` says that the key exists); null is skipped."""
    cond = None
    for k in keys:
        c = F.col(f"w.{k}") == F.col(f"e.{k}")
        cond = c if cond is None else cond & c
    return wanted.alias("w").join(existing.withColumn("_known", F.lit(True)).alias("e"), cond, "left").select("w.*", reason.alias("reason")).filter("reason IS NOT NULL")
