"""Mixing sources to target weights by systematic sampling.

Each source's target (in words) follows from its weight; the rate
``target / source size`` is every document's expected number of copies. The
documents of a source stand in order of size, their expected copies are
prefix-summed, one random offset per source is added (a digest of its name, so
that reruns agree), and a document is emitted once for each integer boundary
that its interval crosses. Ordering by size makes the taken words follow the
target closely, because neighbours are of equal size: they miss it by at most
the words of the source's largest document.

The prefix sum is two-level: rows are counted per (source, size bucket, salt)
chunk, chunk offsets are summed over the small chunk table (at most 64 salts
times some 16 buckets per e-fold of size), and only within a chunk are rows
numbered. A source with a third of all rows is spread over all its chunks.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; a null id sorts last; of repeated rows each takes part; rows equal in
id and size stand in order of a digest of their texts; very long texts are
counted whole; sources without words get target 0; an empty table gives an empty
result; other columns, whatever their names, are kept by ``mix_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

WEIGHTS = (5, 2, 1)
CAP = 3


def _digest_fraction(prefix: str, c: Column) -> Column:
    """A reproducible number in [0, 1) from the leading 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(prefix), c)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target, rate, u`` from rows of ``source, size``.

    Water filling in closed form: in order of cap per weight, the first source
    whose share of what is left stays under its cap fixes the common level.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    every = Window.partitionBy()
    t = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size").cast("double") * cap)
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_w"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("lambda", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("lambda"), F.lit(0.0)) * F.col("w"))
    return t.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0).alias("rate"),
        _digest_fraction("mix:", F.coalesce(F.col("source"), F.lit(""))).alias("u"),
    )


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, payload: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken[, payload]``, a row per input row."""
    keyed = (
        docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_of()).alias("digest"), F.when(F.col("doc_id").isNull(), text_of()).alias("salted"), *([] if payload is None else [payload.alias("payload")]))
        .withColumn("bucket", F.floor(F.log(F.col("size") + F.lit(1.0)) * 16))
        .withColumn("salt", F.floor(_digest_fraction("", F.coalesce(F.col("doc_id").cast("string"), F.col("salted"))) * 64))
        .drop("salted")
    )
    # the sizes are read for the targets, for the chunks and for the rows: keep the few small columns
    base = cut(keyed.drop("payload"))
    rows = base if payload is None else keyed
    chunk = ["source", "bucket", "salt"]
    chunks = base.groupBy(*chunk).count()
    before = Window.partitionBy("source").orderBy("bucket", "salt")
    targets = source_targets(base, weights, cap)
    chunks = (
        chunks.withColumn("before", F.sum("count").over(before) - F.col("count"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("salt").alias("a"), "before", "source_size", "target", "rate", "u")
    )
    inside = Window.partitionBy(*chunk).orderBy("size", F.col("doc_id").asc_nulls_last(), "digest")
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("salt") == F.col("a"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(inside)).join(chunks, on).withColumn("n", F.col("before") + F.col("rn"))

    def copies(u: Column) -> Column:
        return F.floor(F.col("n") * F.col("rate") + u) - F.floor((F.col("n") - 1) * F.col("rate") + u)

    return (
        placed(rows)
        .withColumn("copies", copies(F.col("u")))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([] if payload is None else ["payload"]))
    )


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    taken = mix_copies(docs, weights, cap, whole).filter("copies > 0")
    return taken.select("payload", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("payload.*")


MIXING_SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, CAST(length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g')) - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size FROM documents),
keyed AS (
  SELECT *, floor(ln(size + 1.0) * 16) AS bucket, floor(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 64) AS salt FROM base),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s0),
s2 AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio FROM s2),
s4 AS (SELECT *, sum(cap) OVER (ORDER BY ratio, rnk ROWS UNBOUNDED PRECEDING) - cap AS capped,
         sum(w) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total, row_number() OVER (ORDER BY ratio, rnk) AS place FROM s3),
s5 AS (SELECT *, (total - capped) / left_w AS level FROM s4),
lam AS (SELECT level AS lvl FROM s5 WHERE level <= ratio ORDER BY place LIMIT 1),
tgt AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM lam), 0.0) * w) AS target,
          CAST(('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s5),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, salt, size, doc_id NULLS LAST) AS n FROM keyed),
rated AS (SELECT k.source, k.doc_id, k.size, k.n, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate
          FROM numbered k JOIN tgt t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(n * rate + u) - floor((n - 1) * rate + u)) * size AS BIGINT) AS taken
FROM rated
"""
