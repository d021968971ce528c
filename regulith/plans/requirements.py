"""Requirement rules over sentences that the tables' keys choose, so that every branch is met and the work grows with the table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import acts
from ..operators import requirement_rules as rr
from ..registry import query, table
from ..rules import fr_requirements as fr
from ..rules.fr_examples import APPLICABLE, COMPANIES, ISSUES, QUESTIONS, SENTENCES

_PICK = "CAST((l_orderkey * 7 + l_linenumber) % {n} AS INT) + 1"


_SLOTS = (("{n}", "CAST(l_partkey % 89 + 2 AS {s})"), ("{a}", "CAST(l_linenumber AS {s})"))


def _filled(x: str, string: str) -> str:
    for slot, value in _SLOTS:
        x = f"replace({x}, '{slot}', {value.replace('{s}', string)})"
    return x


def statements_of(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """``r, s, m, other`` and ``more`` columns: a statement of each line item with the item's numbers in it, its citation, a model's type, and another statement."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("r", "s", "m"), row, strict=False)]) for row in SENTENCES])
    x = table(spark, d, "lineitem").select(F.element_at(rows, F.expr(_PICK.format(n=len(SENTENCES)))).alias("x"), F.element_at(rows, F.expr(f"CAST(l_partkey % {len(SENTENCES)} AS INT) + 1")).alias("y"), "l_partkey", "l_linenumber", *more)
    return x.select(F.expr(_filled("x.r", "STRING")).alias("r"), F.expr(_filled("x.s", "STRING")).alias("s"), F.col("x.m").alias("m"), F.expr(_filled("y.r", "STRING")).alias("other"), *more)


def views_of(rows: DataFrame) -> DataFrame:
    """Add the texts that filters and scores read, their markers, ``heavy`` and ``signals`` of OCR, ``model`` and ``kind`` to rows with ``r, s, c, m``."""
    for layer in rr.statement_views():
        rows = rows.withColumns({n: rr.spark_sql(x) for n, x in layer.items()})
    repaired = tx.ocr_repaired("lead")
    rows = rows.withColumns({"core": rr.plain(F.translate(repaired, "’‘", "''")), "lone": repaired.rlike(fr.LONE_LETTER), "heavy": tx.ocr_heavy("text"), "signals": tx.ocr_signals("text")})
    rows = rr.with_bits(rows, "req", "src", "both", "chunk_plain").withColumn("model", rr.spark_sql(rr.type_alias("m")))
    return rows.withColumn("kind", rr.spark_sql(rr.requirement_type("req", "both", "model"), *_MARKED))


_MARKED = ("req", "src", "both", "chunk_plain")


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number ``n``: what is worked out from the texts is worked out once for each, whatever the table's size."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def viewed(spark: SparkSession, d: str) -> DataFrame:
    """Statements with their views and their number ``n``; the chunk is the citation and the other statement."""
    return views_of(counted(statements_of(spark, d)).withColumn("c", F.concat("s", F.lit(" "), "other")))


def _viewed_sql() -> str:
    """``viewed``: the statements' texts hold no OCR noise, so nothing is repaired here."""
    rows = ", ".join(f"({i + 1}, {rr.lit(r)}, {rr.lit(s)}, {rr.lit(m)})" for i, (r, s, m, _) in enumerate(SENTENCES))
    sql = f"""e(i, r, s, m) AS (VALUES {rows}), v0 AS (SELECT {_filled("a.r", "VARCHAR")} AS r, {_filled("a.s", "VARCHAR")} AS s, a.m AS m, {_filled("a.s", "VARCHAR")} || ' ' || {_filled("b.r", "VARCHAR")} AS c
      FROM lineitem JOIN e a ON a.i = {_PICK.format(n=len(SENTENCES))} JOIN e b ON b.i = CAST(l_partkey % {len(SENTENCES)} AS INT) + 1)"""
    layers = [*rr.statement_views(), {"heavy": "FALSE", "signals": "FALSE", "model": rr.type_alias("m")}, {"kind": rr.requirement_type("req", '"both"', "model")}]
    for i, layer in enumerate(layers):
        columns = ", ".join(f'{rr.other_sql(x)} AS "{n}"' for n, x in layer.items())
        sql += f", v{i + 1} AS (SELECT *, {columns} FROM v{i})"
    return sql + f", viewed AS (SELECT * FROM v{len(layers)})"


def chosen(spark: SparkSession, d: str) -> DataFrame:
    """``req, both, kind, src, model, n``: the line items' statements, in plain text, with markers, type and number."""
    x = counted(statements_of(spark, d).select("r", "s", "m")).select(rr.plain("r").alias("req"), rr.plain("s").alias("src"), "m", "n").withColumn("both", F.concat("req", F.lit(" || "), "src"))
    x = rr.with_bits(x, "req", "both").withColumn("model", rr.spark_sql(rr.type_alias("m")))
    return x.withColumn("kind", rr.spark_sql(rr.requirement_type("req", "both", "model"), "req", "both"))


def _chosen_sql() -> str:
    rows = ", ".join(f"({i + 1}, {rr.lit(r)}, {rr.lit(s)}, {rr.lit(m)})" for i, (r, s, m, _) in enumerate(SENTENCES))
    return f"""e(i, r, s, m) AS (VALUES {rows}), s AS (SELECT {_filled("r", "VARCHAR")} AS r, {_filled("s", "VARCHAR")} AS s, m FROM lineitem JOIN e ON i = {_PICK.format(n=len(SENTENCES))}),
  p AS (SELECT {rr.plain_sql("r")} AS req, {rr.plain_sql("s")} AS src, m FROM s),
  b AS (SELECT *, req || ' || ' || src AS "both", {rr.other_sql(rr.type_alias("m"))} AS model FROM p), chosen AS (SELECT *, {rr.other_sql(rr.requirement_type("req", '"both"', "model"))} AS kind FROM b)"""


@query("type_arbitration", f"WITH {_chosen_sql()} SELECT model, kind, count(*) AS n FROM chosen GROUP BY 1, 2")
def type_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """RT1, RT2: a model's type by its aliases, then the type by markers."""
    return chosen(spark, d).groupBy("model", "kind").agg(F.sum("n").alias("n"))


@query(
    "domain_classes",
    f"""WITH {_chosen_sql()}, r AS (SELECT *, {rr.other_sql(rr.domain_score('"both"', "kind"))} AS score FROM chosen), c AS (SELECT string_split({rr.other_sql(rr.domain("req", '"both"', "kind", "score"))}, '|') AS c FROM r)
        SELECT c[1] AS domain, c[2] AS sub_domain, c[3] AS strategy, count(*) AS n FROM c GROUP BY 1, 2, 3""",
)
def domain_classes(spark: SparkSession, d: str) -> DataFrame:
    """QD1, QD2: domain and sub-domain by guards, first rules, scored markers, then the type."""
    c = domains(chosen(spark, d))
    return c.groupBy("domain", "sub_domain", "strategy").agg(F.sum("n").alias("n"))


def domains(rows: DataFrame) -> DataFrame:
    """Add ``domain, sub_domain, strategy`` to rows with ``req, both, kind``."""
    marked = [c for c in ("req", "both") if f"{c}_bits" in rows.columns]
    rows = rows.withColumn("score", rr.spark_sql(rr.domain_score("both", "kind"), *marked))
    c = F.split(rr.spark_sql(rr.domain("req", "both", "kind", "score"), *marked), r"\|")
    return rows.withColumn("c", c).select("*", F.col("c")[0].alias("domain"), F.col("c")[1].alias("sub_domain"), F.col("c")[2].alias("strategy")).drop("c", "score")


#: A statement without its header, in plain text.
_HEADLESS = rr._folded(rr._replaced("text", rr.HEADER))


def _quoted(x: str) -> str:
    return re.sub(r"\bboth\b", '"both"', x)


_HITS = rr.filter_hits()
_EVENTS = rr.filter_events({n: f"h_{n}" for n in _HITS})


def with_filters(rows: DataFrame) -> DataFrame:
    """RJ1: add whether each filter holds (``h_<filter>``) and ``events array<struct<filter, soft>>``: soft hits up to the first hard one, and that."""
    rows = rows.withColumns({f"h_{n}": rr.spark_sql(x, *_MARKED) for n, x in _HITS.items()})
    events = [F.when(F.expr(e), F.struct(F.lit(n).alias("filter"), F.expr(soft).alias("soft"))) for n, e, soft in _EVENTS]
    return rows.withColumn("events", F.array_compact(F.array(*events)))


def _filtered_sql() -> str:
    hits = ", ".join(f"{_quoted(rr.other_sql(x))} AS h_{n}" for n, x in _HITS.items())
    events = ", ".join(f"CASE WHEN {e} THEN CASE WHEN {soft} THEN 'SOFT_{n}' ELSE '{n}' END END" for n, e, soft in _EVENTS)
    return f"{_viewed_sql()}, h AS (SELECT *, {hits} FROM viewed), filtered AS (SELECT *, [{events}] AS events FROM h)"


@query("rejection_events", f"WITH {_filtered_sql()}, x AS (SELECT unnest(events) AS reason FROM filtered) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1")
def rejection_events(spark: SparkSession, d: str) -> DataFrame:
    """RJ1: the filters' events of each statement; those of soft filters that legal risk overrides go on to the next filter."""
    # outer, and nulls dropped at the end: an inner explode would copy all steps into a filter below them
    e = with_filters(viewed(spark, d)).select("n", F.explode_outer("events").alias("e"))
    return e.groupBy(F.concat(F.when(F.col("e.soft"), "SOFT_").otherwise(""), "e.filter").alias("reason")).agg(F.sum("n").alias("n")).filter("reason IS NOT NULL")


_STATUS = "CASE WHEN {c} >= 0.86D THEN 'DRAFT' ELSE 'TO_VALIDATE' END"


@query(
    "requirement_confidence",
    f"WITH {_viewed_sql()}, x AS (SELECT kind, {_quoted(rr.other_sql(rr.confidence('kind')))} AS confidence FROM viewed) SELECT kind, confidence, {rr.other_sql(_STATUS.format(c='confidence'))} AS status, count(*) AS n FROM x GROUP BY 1, 2, 3",
)
def requirement_confidence(spark: SparkSession, d: str) -> DataFrame:
    """CF1, CF2: confidence of each statement by sixteen detectors over statement, citation and chunk."""
    x = viewed(spark, d).select("kind", "n", rr.spark_sql(rr.confidence("kind"), *_MARKED).alias("confidence"))
    return x.groupBy("kind", "confidence", rr.spark_sql(_STATUS.format(c="confidence")).alias("status")).agg(F.sum("n").alias("n"))


_NO_SIGN = "regexp_replace(req, §p'^ *([-•*]|[0-9]+[)]|[a-z][)]) *', '')"
_DEFINITIONS = {"definition_article": rr.definition_article("folded"), "definition_unit": rr.definition_unit("req"), "scope_extension": rr.scope_extension("unit", "chunk_plain")}


@query("definition_predicates", f"WITH {_viewed_sql()}, u AS (SELECT *, {rr.other_sql(_NO_SIGN)} AS unit FROM viewed) SELECT {', '.join(f'{rr.other_sql(x)} AS {n}' for n, x in _DEFINITIONS.items())}, count(*) AS n FROM u GROUP BY 1, 2, 3")
def definition_predicates(spark: SparkSession, d: str) -> DataFrame:
    """FIL16: definitions of articles and units, and extensions of scope."""
    x = viewed(spark, d).withColumn("unit", rr.spark_sql(_NO_SIGN))
    return x.groupBy(*[rr.spark_sql(e, *_MARKED).alias(n) for n, e in _DEFINITIONS.items()]).agg(F.sum("n").alias("n"))


@query("cross_references", f"WITH {_viewed_sql()}, x AS (SELECT kind, {rr.other_sql(_HEADLESS)} AS t FROM viewed) SELECT kind, 'ARTICLE_HAS_CROSS_REFERENCE' AS event_type, count(*) AS n FROM x WHERE regexp_matches(t, {rr.lit(fr.CROSS_REFERENCE)}) GROUP BY 1")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    """XR1: an event for every statement that refers to another text, own header off, by type."""
    x = viewed(spark, d).withColumn("t", rr.spark_sql(_HEADLESS))
    return x.filter(F.col("t").rlike(fr.CROSS_REFERENCE)).groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("ARTICLE_HAS_CROSS_REFERENCE").alias("event_type"), "n")


_DECIDED = rr.applicability("req", "headcount", "sector", "chemicals", "means")


def _applicable_sql() -> str:
    reqs = ", ".join(f"({i}, {rr.lit(q)})" for i, q in enumerate(APPLICABLE))
    firms = ", ".join(f"({i}, {', '.join(map(rr.lit, c))})" for i, c in enumerate(COMPANIES))
    return f"""WITH q(i, q0) AS (VALUES {reqs}), f(k, s0, c0, m0) AS (VALUES {firms}),
  x AS (SELECT {rr.plain_sql("q0")} AS req, {rr.plain_sql("s0")} AS sector, {rr.plain_sql("c0")} AS chemicals, {rr.plain_sql("m0")} AS means, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 400 AS INT) END AS headcount
    FROM orders JOIN q ON (o_orderkey + o_custkey) % {len(APPLICABLE)} = i JOIN f ON o_custkey % {len(COMPANIES)} = k)
  SELECT {rr.other_sql(_DECIDED)} AS decision, count(*) AS n FROM x GROUP BY 1"""


@query("text_applicability", _applicable_sql())
def text_applicability(spark: SparkSession, d: str) -> DataFrame:
    """RU1: the five rules by what a requirement's text and a company's profile say; null goes to the provider."""
    firms = F.array(*[F.struct(*[rr.plain(F.lit(v)).alias(n) for n, v in zip(("sector", "chemicals", "means"), c, strict=True)]) for c in COMPANIES])
    reqs = F.array(*[rr.plain(F.lit(q)) for q in APPLICABLE])
    at = lambda x, n: F.pmod(x, F.lit(n)).cast("int") + 1
    headcount = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_custkey") % 400).cast("int")).alias("headcount")
    x = table(spark, d, "orders").select(F.element_at(reqs, at(F.col("o_orderkey") + F.col("o_custkey"), len(APPLICABLE))).alias("req"), F.element_at(firms, at(F.col("o_custkey"), len(COMPANIES))).alias("f"), headcount)
    return x.select("req", "f.*", "headcount").groupBy(rr.spark_sql(_DECIDED).alias("decision")).agg(F.count("*").alias("n"))


#: Filter, reason code, verdict of grounding, whether the type and the subject agree; family.
ERRORS = (
    ("", "completeness_fused_action_chain", None, True, True, "STRUCTURAL_FUSION"),
    ("", "COMPLETENESS_DANGLING_TAIL_DROP", None, True, True, "SNIPPET_TRUNCATION"),
    ("", "COMPLETENESS_MISSING_SUBJECT", None, True, True, "MISSING_COMPONENT"),
    ("", "LOW_SNIPPET_OVERLAP_0.1", None, True, True, "WEAK_GROUNDING"),
    ("", "OTHER", "soft_fail", True, True, "WEAK_GROUNDING"),
    ("", "OTHER", "PASS", False, True, "TYPE_DRIFT"),
    ("", "SUBJECT_CHANGED", None, True, True, "SUBJECT_DRIFT"),
    ("LOW_VALUE", "OTHER", None, True, True, "NON_NORMATIVE_FALSE_POSITIVE"),
    ("", "OUT_OF_SCOPE_PUBLICATION", None, True, True, "NON_NORMATIVE_FALSE_POSITIVE"),
    ("", "OTHER", None, True, True, None),
)


def _errors_sql() -> str:
    rows = ", ".join(f"({i}, {'NULL' if e[5] is None else rr.lit(e[5])})" for i, e in enumerate(ERRORS))
    fixes = ", ".join(f"({rr.lit(f)}, {rr.lit(x)})" for f, x in fr.FAMILY_FIX.items())
    return f"""WITH e(i, family) AS (VALUES {rows}), f(name, fix) AS (VALUES {fixes})
SELECT family, CASE WHEN family IS NULL THEN NULL WHEN family = 'NON_NORMATIVE_FALSE_POSITIVE' THEN 'OBSERVE_ONLY' ELSE 'FORCE_VALIDATE' END AS action,
  CASE WHEN family IS NULL THEN NULL WHEN family IN ('TYPE_DRIFT', 'SUBJECT_DRIFT', 'NON_NORMATIVE_FALSE_POSITIVE') THEN 'MEDIUM' ELSE 'HIGH' END AS severity, fix, count(*) AS n
FROM events JOIN e ON event_id % {len(ERRORS)} = i LEFT JOIN f ON family = name GROUP BY ALL"""


@query("error_families", _errors_sql())
def error_families(spark: SparkSession, d: str) -> DataFrame:
    """EM2: family, action, severity and fix of an error's reasons."""
    rows = F.array(*[F.struct(F.lit(f).alias("f"), F.array(F.lit("SEEN"), F.lit(r)).alias("r"), F.lit(v).cast("string").alias("v"), F.lit(t).alias("t"), F.lit(s).alias("s")) for f, r, v, t, s, _ in ERRORS])
    e = table(spark, d, "events").select(F.element_at(rows, (F.col("event_id") % len(ERRORS)).cast("int") + 1).alias("e"))
    x = e.select(rr.error_family(F.col("e.f"), F.col("e.r"), F.col("e.v"), F.col("e.t"), F.col("e.s")).alias("x"))
    return x.groupBy("x.family", "x.action", "x.severity", "x.fix").agg(F.count("*").alias("n"))


def _kpi(t: str) -> tuple[str, str]:
    """QA2: kind of a counting question, and whether a question is about the state of operations, as SQL over plain text."""
    some = lambda *m: rr.any_of(t, m)
    counts = some("combien", "nombre", "nb", "total", "taux", "pourcentage", "ratio")
    kind = rr.cascade(
        [
            (f"({some('taux', 'pourcentage', 'ratio')} AND {some('conformit')})", "'compliance_rate'"),
            (f"({counts} AND {some('non conform', 'non-conform')})", "'non_conformity_count'"),
            (f"({counts} AND {some('preuve')} AND {some('manqu', 'absence de preuve')})", "'absence_proof_count'"),
            (f"({counts} AND {some('applicable', 'a2')} AND {some('non evalue', 'pas evalue', 'reste', 'restent')})", "'unevaluated_applicable_count'"),
        ],
        "NULL",
    )
    about = f"(({some('preuve', 'preuves', 'justificatif', 'justificatifs')} AND ({some('manqu', 'absence', 'absent', 'insuffisant', 'completer')} OR {some('conforme', 'conformite', 'non conform', 'non-conform')})) OR {some('ecart', 'ecarts', 'gap', 'gaps')} OR ({some('action', 'corriger', 'traiter')} AND {some('conforme', 'conformite', 'non conform', 'non-conform')}))"
    return kind, about


def _kpi_sql() -> str:
    rows = ", ".join(f"({i}, {rr.lit(q)})" for i, q in enumerate(QUESTIONS))
    kind, about = map(rr.other_sql, _kpi("t"))
    return f"WITH q(i, t0) AS (VALUES {rows}), p AS (SELECT {rr.plain_sql('t0')} AS t FROM conversations JOIN q ON (conv_id + turn) % {len(QUESTIONS)} = i) SELECT {kind} AS kind, {about} AS operational, count(*) AS n FROM p GROUP BY 1, 2"


@query("kpi_intents", _kpi_sql())
def kpi_intents(spark: SparkSession, d: str) -> DataFrame:
    """QA2: intents of questions, one for each turn."""
    at = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTIONS))).cast("int") + 1
    t = table(spark, d, "conversations").select(rr.plain(F.element_at(F.array(*map(F.lit, QUESTIONS)), at)).alias("t"))
    kind, about = map(rr.spark_sql, _kpi("t"))
    return t.groupBy(kind.alias("kind"), about.alias("operational")).agg(F.count("*").alias("n"))


@query("act_blocks")
def act_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SG2, SG6: acts of an issue of each order, and whether they only appoint persons (checked on each issue)."""
    issue = F.element_at(F.array(*map(F.lit, ISSUES)), F.col("i"))
    o = counted(table(spark, d, "orders").select(((F.col("o_orderkey") % len(ISSUES)).cast("int") + 1).alias("i")))
    o = o.select("n", acts.split_acts(issue).alias("a")).select("n", F.explode("a").alias("a"))
    return o.groupBy("a.title").agg(F.sum("n").alias("n"), F.bool_and(acts.individual("a.title", "a.text")).alias("individual"), F.max(F.length("a.text")).alias("chars"))


def stale(state: Column, stamp: Column, now: Column, hours: int = 12) -> Column:
    """DT5: a job that is still active but has not moved for more than ``hours``; one without a stamp is stale."""
    return state.isin("QUEUED", "RUNNING") & (stamp.isNull() | ((now.cast("timestamp") - stamp.cast("timestamp")) > F.expr(f"INTERVAL {hours} HOURS")))


@query(
    "stale_jobs",
    """WITH j AS (SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last, max(ts) AS ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
       SELECT last, count(*) AS jobs, count(*) FILTER (WHERE last IN ('click', 'view') AND now - ts > INTERVAL 12 HOUR) AS stale FROM j, n GROUP BY 1""",
)
def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    """DT5: of each user's last event as a job's state (click queued, view running), at the log's end."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now")).first().now
    j = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("ts"))
    state = F.when(F.col("last") == "click", "QUEUED").when(F.col("last") == "view", "RUNNING").otherwise("DONE")
    return j.groupBy("last").agg(F.count("*").alias("jobs"), F.count_if(stale(state, F.col("ts"), F.lit(now))).alias("stale"))
