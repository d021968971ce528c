"""Imports and upserts into stored tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import Store
from ..registry import query, table
from ..streaming.events import shared_folder

#: Datasets of an import: table, key, value.
IMPORTS = (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"), ("part", "p_partkey", "p_retailprice"), ("orders", "o_orderkey", "o_totalprice"))


def _import_sql() -> str:
    parts = []
    for t, k, v in IMPORTS:
        parts.append(f"SELECT '{t}' AS dataset, 1 AS run, count(*) AS inserted, 0 AS updated, 0 AS skipped FROM {t} WHERE {k} % 3 <> 0")
        parts.append(f"SELECT '{t}', 2, count(*) FILTER (WHERE {k} % 3 = 0), count(*) FILTER (WHERE {k} % 3 <> 0 AND {k} % 5 = 0), count(*) FILTER (WHERE {k} % 3 <> 0 AND {k} % 5 <> 0) FROM {t}")
        parts.append(f"SELECT '{t}', 3, 0, 0, count(*) FROM {t}")
    return " UNION ALL ".join(parts)


@query("import_counts", _import_sql())
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    """DML5: what each run of an import inserts, updates and skips: a part of each table, all of it with changed values, and the same again, which changes nothing."""
    folder, rows = shared_folder(spark), []
    for t, k, v in IMPORTS:
        store = Store(spark, f"{folder}/{t}", "id long, v double", ["id"])
        x = table(spark, d, t).select(F.col(k).cast("long").alias("id"), F.round(v, 2).cast("double").alias("v"))
        second = x.withColumn("v", F.when(F.col("id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
        for run, new in enumerate((x.filter("id % 3 <> 0"), second, second), 1):
            got = store.merge(new)
            rows.append((t, run, got["inserted"], got["updated"], got["skipped"]))
    return spark.createDataFrame(rows, "dataset string, run int, inserted long, updated long, skipped long")  # three rows a dataset


@query(
    "stored_checks",
    """WITH n AS (SELECT o_custkey AS id, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1), o AS (SELECT c_custkey AS id, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey % 3 <> 0),
       c AS (SELECT o_custkey AS id, count(*) AS gaps, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
       SELECT coalesce(o.id, n.id) AS id, coalesce(n.v, o.v) AS v, CASE WHEN o.id IS NULL OR n.id IS NULL OR n.v = o.v THEN 1 ELSE 2 END AS version, coalesce(gaps, 0) AS gaps, coalesce(total, 0) AS total
       FROM o FULL JOIN n ON o.id = n.id LEFT JOIN c ON c.id = coalesce(o.id, n.id)""",
)
def stored_checks(spark: SparkSession, d: str) -> DataFrame:
    """DML2, DML4: checks upserted with their versions; the gaps of each check are replaced with it."""
    folder = shared_folder(spark)
    checks, gaps = Store(spark, f"{folder}/checks", "id long, v double", ["id"]), Store(spark, f"{folder}/gaps", "id long, price double", ["id"])
    orders = table(spark, d, "orders")
    new = orders.groupBy(F.col("o_custkey").cast("long").alias("id")).agg(F.round(F.max("o_totalprice"), 2).cast("double").alias("v"))
    price = lambda x: x.select(F.col("o_custkey").cast("long").alias("id"), F.col("o_totalprice").cast("double").alias("price"))
    checks.merge(table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("id"), F.round("c_acctbal", 2).cast("double").alias("v")))
    gaps.replace_children(price(orders), price(orders.filter("o_orderstatus = 'O'")))
    checks.merge(new)
    gaps.replace_children(new, price(orders.filter("o_orderstatus = 'F'")))
    c = gaps.read().groupBy("id").agg(F.count("*").alias("gaps"), F.round(F.sum("price"), 2).alias("total"))
    return checks.read().join(c, "id", "left").select("id", "v", "version", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("total", F.lit(0.0)).alias("total"))
