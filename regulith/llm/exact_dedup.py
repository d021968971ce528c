"""Exact dedup by content sort.

Sampled splitters (leading characters and a digest) range-partition the texts, the shuffle's external sort puts
equal texts next to each other and the window over the sorted run compares
whole neighbouring texts. A text that holds a large share of all rows would put
all its copies into one range, so such texts (at most ``1 / hot_share`` of
them, found by counting 64-bit digests) are aggregated by their full text with
map-side combine instead and their rows are marked through a broadcast of at
most ``1 / hot_share`` digests.

Defined cases: null text counts as empty; a null id sorts below all ids and can
stay only in a group without other ids; of repeated rows (same id and text)
exactly one stays; an empty table gives an empty result. Other columns of the
input never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: A text is hot from this share of all rows (and HOT_ROWS rows) on.
HOT_SHARE = 1 / 1000
HOT_ROWS = 500
#: Code points of a text that splitters hold.
LEADING = 32


def mark_copies(docs: DataFrame, payload: Column | None = None, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256[, payload]``.

    The row with the largest ``doc_id`` of equal texts is kept.
    """
    more = [] if payload is None else [payload.alias("payload")]
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *(["payload"] if more else [])]
    rows = docs.select("doc_id", text_of().alias("t"), *more).withColumn("h", F.xxhash64("t"))
    least = max(hot_rows, int(hot_share * docs.count()))
    hot = [r.h for r in rows.groupBy("h").count().filter(F.col("count") >= least).select("h").collect()]

    cold = rows.filter(~F.col("h").isin(hot)) if hot else rows
    # splitters are sampled on the leading bytes and a digest, so that what the driver gathers of them is small;
    # both are functions of the text, and the window compares whole texts
    run = Window.partitionBy("p", "h", "t")
    first = run.orderBy(F.col("doc_id").desc_nulls_last())
    out = (
        cold.withColumn("p", F.substring("t", 1, LEADING))
        .repartitionByRange("p", "h")
        .withColumn("rn", F.row_number().over(first))
        .withColumn("keep_id", F.first("doc_id").over(first))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
        .withColumn("kept", F.col("rn") == 1)
        .withColumn("text_sha256", F.sha2("t", 256))
        .select(*names)
    )
    if not hot:
        return out
    warm = rows.filter(F.col("h").isin(hot))
    groups = (
        warm.groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    marked = warm.withColumn("text_sha256", F.sha2("t", 256)).drop("t").join(F.broadcast(groups), "text_sha256")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = Window.partitionBy("text_sha256").orderBy("doc_id")
    stay = marked.filter(best).withColumn("kept", F.row_number().over(one) == 1).select(*names)
    gone = marked.filter(~best).withColumn("kept", F.lit(False)).select(*names)
    return out.unionByName(stay).unionByName(gone)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return mark_copies(docs, whole).filter("kept").select("payload.*")


EXACT_DEDUP_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t
"""
