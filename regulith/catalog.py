"""Compliance views of the tables, the same expressions that the SQL uses.

The register of requirements is projected on ``lineitem`` (type, status,
confidence of a requirement of a document), checks, gaps and evidence on
``orders``, sites and scopes on ``region > nation > customer``, decisions and
the event log on ``events``, reviews on ``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: The day on which policies are evaluated; never the clock.
AS_OF = "1998-12-01"

REQUIREMENTS_SQL = """requirements AS (
  SELECT l_orderkey * 8 + l_linenumber AS requirement_id, l_orderkey AS doc_id, l_partkey AS article_id, l_suppkey AS profile_id,
         CASE l_returnflag WHEN 'A' THEN 'OBLIGATION' WHEN 'N' THEN 'INTERDICTION' WHEN 'R' THEN 'CONDITION' ELSE NULL END AS req_type,
         CASE WHEN l_linestatus = 'O' THEN 'TO_VALIDATE' WHEN l_discount >= 0.05 THEN 'DRAFT' ELSE 'PROMOTED' END AS status,
         CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.05 THEN 'ENVIRONNEMENT' ELSE 'SST' END AS domain,
         l_discount * 10 AS confidence, l_quantity AS page, l_shipdate AS created_at
  FROM lineitem)"""

CHECKS_SQL = """checks AS (
  SELECT o_orderkey AS check_id, o_custkey AS profile_id,
         CASE o_orderstatus WHEN 'F' THEN 'CONFORME' WHEN 'O' THEN 'NON_CONFORME' ELSE 'NON_EVALUE' END AS compliance_status,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITIQUE' WHEN '2' THEN 'MAJEURE' WHEN '3' THEN 'MINEURE' ELSE NULL END AS severity,
         CASE WHEN o_totalprice < 20000 THEN NULL ELSE floor(o_totalprice / 5000) END AS score, o_orderdate AS created_at
  FROM orders)"""


def requirements(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "OBLIGATION").when(F.col("l_returnflag") == "N", "INTERDICTION").when(F.col("l_returnflag") == "R", "CONDITION")
    status = F.when(F.col("l_linestatus") == "O", "TO_VALIDATE").when(F.col("l_discount") >= 0.05, "DRAFT").otherwise("PROMOTED")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("requirement_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_suppkey").alias("profile_id"),
        kind.alias("req_type"),
        status.alias("status"),
        F.when(F.col("l_tax") < 0.02, None).when(F.col("l_tax") < 0.05, "ENVIRONNEMENT").otherwise("SST").alias("domain"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_quantity").alias("page"),
        F.col("l_shipdate").alias("created_at"),
    )


def checks(spark: SparkSession, d: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("check_id"),
        F.col("o_custkey").alias("profile_id"),
        F.when(F.col("o_orderstatus") == "F", "CONFORME").when(F.col("o_orderstatus") == "O", "NON_CONFORME").otherwise("NON_EVALUE").alias("compliance_status"),
        F.when(rank == "1", "CRITIQUE").when(rank == "2", "MAJEURE").when(rank == "3", "MINEURE").alias("severity"),
        F.when(F.col("o_totalprice") < 20000, None).otherwise(F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("score"),
        F.col("o_orderdate").alias("created_at"),
    )


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def tenant(df: DataFrame, value: str, column: str = "tenant_id") -> DataFrame:
    """The mandatory tenant filter, blind to case, null as empty."""
    return df.filter(F.lower(F.coalesce(F.col(column), F.lit(""))) == value.lower())
