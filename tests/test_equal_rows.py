"""Equal statements are read once, whatever the table's size; lots of scopes."""

from pyspark.sql import functions as F

from regulith.operators import postcall as pc
from regulith.plans import postcall, relational, requirements, segments

D = "/root/testdata/sf0.001"


def _lines(spark):
    return spark.read.parquet(f"{D}/lineitem.parquet").count()


def test_scopes_meet_requirements_by_lots(spark):
    got = relational.scope_candidates(spark, D)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [b" in plan and plan.count("BroadcastHashJoin") <= 2
    req = {r[0]: r[1] for r in spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_size").collect()}
    sc = {r[0]: r[1] for r in spark.read.parquet(f"{D}/supplier.parquet").select("s_suppkey", "s_nationkey").collect()}
    want = set()
    for k, a in req.items():
        rated = [(s, 2 * (a % 4 == b % 4) + 3 * (a % 3 == b % 3) + 5 * (a == b)) for s, b in sc.items() if a % 5 == b % 5]
        best = max((v for _, v in rated), default=0)
        want |= {(k, s, v) for s, v in rated if v >= max(2, best - 1)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_chosen_and_viewed_hold_each_statement_once(spark):
    s = requirements.statements_of(spark, D)
    for got, columns in ((requirements.chosen(spark, D), ["r", "s", "m"]), (requirements.viewed(spark, D), s.columns)):
        assert got.agg(F.sum("n")).first()[0] == _lines(spark)
        assert got.count() == s.select(*columns).distinct().count() < _lines(spark)


def test_issues_of_acts_are_split_once(spark):
    plan = requirements.act_blocks(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :]
    assert "Aggregate" in below


def test_judged_reads_texts_once_and_tells_calls_apart(spark):
    names = ["requirement", "kind", "snippet", "chunk", "confidence", "status", "strength", "n"]
    got, want = postcall.judged(spark, D, pc.with_wording), pc.assess(postcall.assessed(spark, D))
    assert got.drop("wording").select(*names, "a").exceptAll(want.select(*names, "a")).isEmpty()
    assert got.agg(F.sum("n")).first()[0] == _lines(spark)


def test_texts_of_fallbacks_are_counted_without_calls(spark):
    x = postcall.stated(spark, D)
    assert x.columns == ["requirement", "kind", "snippet", "chunk", "n"] and x.agg(F.sum("n")).first()[0] == _lines(spark)


def test_units_are_grouped_before_they_are_read(spark):
    plan = segments.unit_fallbacks(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate") :]
    assert "RLIKE" not in below and "regexp_replace" not in below, below[:900]
