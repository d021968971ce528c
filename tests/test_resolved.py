"""Candidates of orders: their texts are read once, lines that share a number come in one order."""

from pyspark.sql import functions as F

from regulith.operators import candidates
from regulith.operators import postcall as pc
from regulith.plans import postcall, requirements

D = "/root/testdata/sf0.001"
NAMES = ["l_orderkey", "representative", "kind", "members", "conflict", "quality", "decision", "status", "kept"]


def test_resolved_candidates_are_those_of_each_line_read_apart(spark):
    x = requirements.statements_of(spark, D, "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    x = x.select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), F.col("r").alias("requirement"), F.col("m").alias("kind"), F.col("s").alias("snippet"), F.concat("s", F.lit(" "), "other").alias("chunk"), (F.col("l_quantity") % 21 / 20).cast("double").alias("confidence"), F.when(F.col("l_returnflag") == "R", "TO_VALIDATE").otherwise("DRAFT").alias("status"), F.lit("").alias("strength"))
    item = F.struct("seq", F.col("requirement").alias("text"), "kind", "status", "confidence", "a.grounding", "a.grounding_verdict", "a.completeness", "a.completeness_verdict", F.array_contains("a.missing", "EXCEPTION").alias("missing_exception"), "a.type_match", "a.overlap", "a.quality", F.lit(False).alias("error"), "snippet")
    by_order = pc.assess(x).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    want = candidates.resolve(by_order, "items", "l_orderkey").select(*NAMES, F.array_join("reasons", ",").alias("reasons"))
    got = postcall.resolved_candidates(spark, D).select(*NAMES, "reasons")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_lines_meet_what_was_read_and_are_put_in_order(spark):
    plan = postcall.resolved_candidates(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    # one reading of texts, below the join with the line items
    assert plan.count("Join") == 1 and "array_sort" in plan[: plan.index("Join")] and "grounding" not in plan[: plan.index("Join")].split("ArrowEvalPython")[-1].split("Aggregate")[0]
    assert "array_sort" in postcall.runtime_dedup(spark, D)._jdf.queryExecution().optimizedPlan().toString()
