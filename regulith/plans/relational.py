"""Filters (FIL), joins (JN), ranking (RES), sorts (TK), set operations and merges (SET, DML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import CHECKS_SQL, REQUIREMENTS_SQL, checks, day, requirements, tenant
from ..operators.merge import delta, upsert
from ..operators.ranking import effective_rows, first_per, near_best, ranked, top_per
from ..registry import query, table
from .aggregates import ACTIONS_SQL, MEMORY_SQL, actions, folded_state, memory

# --- filters and projections -------------------------------------------------


@query("tenant_filter", "SELECT c_custkey, c_name, lower(c_mktsegment) AS tenant_id FROM customer WHERE lower(coalesce(c_mktsegment, '')) = lower('Machinery')")
def tenant_filter(spark: SparkSession, d: str) -> DataFrame:
    """FIL1."""
    return tenant(table(spark, d, "customer"), "Machinery", "c_mktsegment").select("c_custkey", "c_name", F.lower("c_mktsegment").alias("tenant_id"))


def search(df: DataFrame, *, equal: dict[str, str] | None = None, like: str | None = None, over: tuple[str, ...] = (), confidence: tuple[float, float] | None = None) -> DataFrame:
    """Optional equality filters, one substring over several columns blind to case, and a confidence range."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    if like:
        cond = F.lit(False)
        for c in over:
            cond = cond | F.ilike(F.col(c), F.lit(f"%{like}%"))
        df = df.filter(cond)
    if confidence:
        df = df.filter(F.col("confidence").between(*confidence))
    return df


@query("requirement_search", f"WITH {REQUIREMENTS_SQL} SELECT requirement_id, req_type, status, domain, round(confidence, 4) AS confidence FROM requirements WHERE status = 'DRAFT' AND (req_type ILIKE '%oblig%' OR status ILIKE '%oblig%' OR domain ILIKE '%oblig%') AND confidence BETWEEN 0.5 AND 0.85")
def requirement_search(spark: SparkSession, d: str) -> DataFrame:
    """FIL2."""
    r = search(requirements(spark, d), equal={"status": "DRAFT"}, like="oblig", over=("req_type", "status", "domain"), confidence=(0.5, 0.85))
    return r.select("requirement_id", "req_type", "status", "domain", F.round("confidence", 4).alias("confidence"))


@query("ilike_search", "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%LICENSE%'")
def ilike_search(spark: SparkSession, d: str) -> DataFrame:
    """FIL3."""
    return table(spark, d, "documents").filter(F.ilike("text", F.lit("%LICENSE%"))).select("doc_id", "lang", "source")


@query(
    "prefix_duplicates",
    """WITH p AS (SELECT doc_id, substr(lower(text), 1, 80) AS k FROM documents),
       j AS (SELECT a.doc_id, b.doc_id AS other_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS place FROM p a JOIN p b ON a.k = b.k AND a.doc_id <> b.doc_id)
       SELECT doc_id, other_id, place FROM j WHERE place <= 3""",
)
def prefix_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """FIL4, JN16: up to three other documents with the same eighty first characters, by id.

    The three smallest other ids are among the four smallest of the prefix, so each row meets four ids at most and not its whole group.
    """
    p = table(spark, d, "documents").select("doc_id", F.xxhash64(F.substring(F.lower("text"), 1, 80)).alias("h"), F.substring(F.lower("text"), 1, 80).alias("k"))
    least = top_per(p.select("h", "k", F.col("doc_id").alias("other_id")), ["h", "k"], [F.col("other_id")], 4).drop("place")
    j = p.join(least, ["h", "k"]).filter("doc_id <> other_id").select("doc_id", "other_id")
    return top_per(j, ["doc_id"], [F.col("other_id")], 3)


@query(
    "act_type",
    """SELECT doc_id, CASE WHEN regexp_matches(t, 'arr[êe]t[ée]') THEN 'ARRETE' WHEN t LIKE '%decret%' THEN 'DECRET' WHEN t LIKE '%loi%' THEN 'LOI' ELSE 'JORT_ACTE' END AS act
       FROM (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'Arrêté du ministre ' WHEN 1 THEN 'ARRETE conjoint ' WHEN 2 THEN 'Decret-loi ' WHEN 3 THEN 'Loi de finances ' ELSE '' END || source) AS t FROM documents)""",
)
def act_type(spark: SparkSession, d: str) -> DataFrame:
    """FIL5: type of act by its title, first match wins; titles begin as acts do."""
    k = F.col("doc_id") % 5
    t = F.lower(F.concat(F.when(k == 0, "Arrêté du ministre ").when(k == 1, "ARRETE conjoint ").when(k == 2, "Decret-loi ").when(k == 3, "Loi de finances ").otherwise(""), "source"))
    return table(spark, d, "documents").select("doc_id", F.when(t.rlike("arr[êe]t[ée]"), "ARRETE").when(t.contains("decret"), "DECRET").when(t.contains("loi"), "LOI").otherwise("JORT_ACTE").alias("act"))


def blocked_reason(status, quality, grounding, confidence):
    """FIL6: why a requirement is not promoted; the thresholds are the registry's."""
    return (
        F.when(status == "DRAFT", "PRE_VALIDATED_AUTO")
        .when((quality < 0.84) & (grounding < 0.72), "QUALITY_AND_GROUNDING")
        .when(quality < 0.84, "QUALITY")
        .when(grounding < 0.72, "GROUNDING")
        .when(confidence < 0.65, "CONFIDENCE")
        .otherwise("POLICY_OR_TYPE")
    )


@query(
    "blocked_reasons",
    f"""WITH {REQUIREMENTS_SQL} SELECT status, CASE WHEN status = 'DRAFT' THEN 'PRE_VALIDATED_AUTO' WHEN page / 50 < 0.84 AND article_id % 10 / 10.0 < 0.72 THEN 'QUALITY_AND_GROUNDING' WHEN page / 50 < 0.84 THEN 'QUALITY'
        WHEN article_id % 10 / 10.0 < 0.72 THEN 'GROUNDING' WHEN confidence < 0.65 THEN 'CONFIDENCE' ELSE 'POLICY_OR_TYPE' END AS reason, count(*) AS n FROM requirements GROUP BY 1, 2""",
)
def blocked_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = requirements(spark, d)
    return r.groupBy("status", blocked_reason(F.col("status"), F.col("page") / 50, F.col("article_id") % 10 / 10, F.col("confidence")).alias("reason")).agg(F.count("*").alias("n"))


@query("human_edited", "SELECT d.doc_id, d.source = 'src0' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) AS human_edited FROM documents d")
def human_edited(spark: SparkSession, d: str) -> DataFrame:
    """FIL7."""
    e = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("e")).distinct()
    return table(spark, d, "documents").select("doc_id", "source").join(e, F.col("doc_id") == F.col("e"), "left").select("doc_id", ((F.col("source") == "src0") | F.col("e").isNotNull()).alias("human_edited"))


@query(
    "scope_keys",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SITE:' || CAST(c_nationkey AS VARCHAR) WHEN c_mktsegment = 'MACHINERY' THEN 'PROCESS:' || CAST(c_custkey AS VARCHAR)
       WHEN c_acctbal < 0 THEN 'ORGANIZATION' ELSE 'ACTIVITY:LEGACY:' || md5(lower(concat_ws('|', CAST(c_nationkey AS VARCHAR), c_mktsegment, c_name))) END AS scope_key FROM customer""",
)
def scope_keys(spark: SparkSession, d: str) -> DataFrame:
    """FIL8, HA1: key of a scope; scopes without an id of their own get a digest."""
    seg = F.col("c_mktsegment")
    legacy = F.concat(F.lit("ACTIVITY:LEGACY:"), F.md5(F.lower(F.concat_ws("|", F.col("c_nationkey").cast("string"), seg, "c_name"))))
    key = F.when(seg == "BUILDING", F.concat(F.lit("SITE:"), F.col("c_nationkey").cast("string"))).when(seg == "MACHINERY", F.concat(F.lit("PROCESS:"), F.col("c_custkey").cast("string"))).when(F.col("c_acctbal") < 0, "ORGANIZATION").otherwise(legacy)
    return table(spark, d, "customer").select("c_custkey", key.alias("scope_key"))


@query("scope_labels", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 1000 THEN '' ELSE c_name END, ''), nullif(CASE WHEN c_nationkey < 5 THEN '' ELSE c_mktsegment END, ''), 'ORGANIZATION') AS label FROM customer")
def scope_labels(spark: SparkSession, d: str) -> DataFrame:
    """FIL9."""
    a = F.when(F.col("c_acctbal") < 1000, "").otherwise(F.col("c_name"))
    b = F.when(F.col("c_nationkey") < 5, "").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("ORGANIZATION")).alias("label"))


@query("array_membership", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = ANY ([1, 5, 9, 42, 77, 100])")
def array_membership(spark: SparkSession, d: str) -> DataFrame:
    """FIL10."""
    return table(spark, d, "orders").filter(F.col("o_custkey").isin(1, 5, 9, 42, 77, 100)).select("o_orderkey", "o_custkey")


@query("array_overlap", f"WITH {MEMORY_SQL} SELECT family, trigger_id, len(doc_ids) AS docs FROM memory WHERE list_has_any(doc_ids, [1, 7, 11])")
def array_overlap(spark: SparkSession, d: str) -> DataFrame:
    """FIL11."""
    return memory(spark, d).filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in (1, 7, 11)]))).select("family", "trigger_id", F.size("doc_ids").cast("long").alias("docs"))


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    """FIL12, JS2."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k > 90")


@query("page_of_results", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_results(spark: SparkSession, d: str) -> DataFrame:
    """FIL13: the third page of twenty."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("chemicals", "SELECT DISTINCT p_name, p_type FROM part WHERE starts_with(p_name, 'red') OR upper(p_type) = 'ECONOMY'")
def chemicals(spark: SparkSession, d: str) -> DataFrame:
    """FIL14, SET4: prefix of the reference or equality of the type, distinct."""
    return table(spark, d, "part").filter(F.col("p_name").startswith("red") | (F.upper("p_type") == "ECONOMY")).select("p_name", "p_type").distinct()


@query("date_range", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    """FIL15: the last seven days."""
    return table(spark, d, "events").filter(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("row_search", "SELECT p_partkey FROM part WHERE p_size > 10 AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def row_search(spark: SparkSession, d: str) -> DataFrame:
    """FIL17."""
    return table(spark, d, "part").filter((F.col("p_size") > 10) & F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("brand#1")).select("p_partkey")


@query("confidence_band", f"WITH {REQUIREMENTS_SQL} SELECT CASE WHEN confidence < 0.65 THEN 'HIGH' WHEN confidence < 0.76 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM requirements GROUP BY 1")
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    """FIL18."""
    c = F.col("confidence")
    return requirements(spark, d).groupBy(F.when(c < 0.65, "HIGH").when(c < 0.76, "MEDIUM").otherwise("LOW").alias("risk")).agg(F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------


@query("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    """JN1."""
    c = table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("left_chain", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_chain(spark: SparkSession, d: str) -> DataFrame:
    """JN2."""
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("left_join_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_count(spark: SparkSession, d: str) -> DataFrame:
    """JN3: children counted before the join, so the join meets one row per parent."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "preaggregated_joins",
    """SELECT s_suppkey, coalesce(a.n, 0) AS requirements, coalesce(b.n, 0) AS peers FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) a ON s_suppkey = a.l_suppkey
       LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON supplier.s_nationkey = b.s_nationkey""",
)
def preaggregated_joins(spark: SparkSession, d: str) -> DataFrame:
    """JN4."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("a"))
    b = s.groupBy(F.col("s_nationkey").alias("nk")).agg(F.count("*").alias("b"))
    out = s.join(a, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(b, F.col("s_nationkey") == F.col("nk"), "left")
    return out.select("s_suppkey", F.coalesce("a", F.lit(0)).alias("requirements"), F.coalesce("b", F.lit(0)).alias("peers"))


@query("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    """JN5."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("anti_not_exists", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """JN6."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_then_anti", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_then_anti(spark: SparkSession, d: str) -> DataFrame:
    """JN7."""
    o = table(spark, d, "orders")
    yes, no = o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(yes, F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(no, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(
    "null_safe_key",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END AS site, lower(c_mktsegment) AS name FROM customer),
       b AS (SELECT CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_nationkey END AS site, count(*) AS suppliers FROM supplier GROUP BY 1)
       SELECT c_custkey, site, suppliers FROM a JOIN b USING (site) UNION ALL SELECT c_custkey, a.site, suppliers FROM a JOIN b ON a.site IS NULL AND b.site IS NULL""",
)
def null_safe_key(spark: SparkSession, d: str) -> DataFrame:
    """JN8: null equals null in a composite key."""
    a = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, None).otherwise(F.col("c_nationkey")).alias("site"))
    b = table(spark, d, "supplier").groupBy(F.when(F.col("s_nationkey") % 3 == 0, None).otherwise(F.col("s_nationkey")).alias("s")).agg(F.count("*").alias("suppliers"))
    return a.join(b, F.col("site").eqNullSafe(F.col("s"))).select("c_custkey", "site", "suppliers")


@query("update_join", "SELECT p_partkey, coalesce(n.price, p_retailprice) AS price FROM part LEFT JOIN (SELECT l_partkey, round(max(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 45 GROUP BY 1) n ON p_partkey = l_partkey")
def update_join(spark: SparkSession, d: str) -> DataFrame:
    """JN9: UPDATE … FROM as a left join."""
    n = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy("l_partkey").agg(F.round(F.max("l_extendedprice"), 2).alias("price"))
    return table(spark, d, "part").select("p_partkey", "p_retailprice").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("price", "p_retailprice").alias("price"))


@query(
    "star_labels",
    """SELECT l_orderkey, l_linenumber, o_orderpriority, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def star_labels(spark: SparkSession, d: str) -> DataFrame:
    """JN10: evidence with the labels of its scopes; the small chain of scopes is joined first."""
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_orderpriority", "c_name", "n_name", "r_name")


@query(
    "scope_match",
    """WITH req AS (SELECT s_suppkey AS requirement_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS site, s_suppkey % 7 AS process FROM supplier),
       ev AS (SELECT c_custkey AS evidence_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS site, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 END AS process FROM customer)
       SELECT requirement_id, count(*) AS evidence, min(evidence_id) AS first_id FROM req JOIN ev ON req.site IS NULL OR ev.site IS NULL AND ev.process IS NULL OR req.site = ev.site OR req.process = ev.process GROUP BY 1""",
)
def scope_match(spark: SparkSession, d: str) -> DataFrame:
    """JN11: an organisation's requirement sees all evidence, others evidence of their site or process or without scope.

    The OR of the theta join is split into equi joins by its arms, counted by inclusion and exclusion, so that no pair of rows is made that the keys do not match.
    """
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    req = s.select(F.col("s_suppkey").alias("requirement_id"), F.when(F.col("s_suppkey") % 4 == 0, None).otherwise(F.col("s_nationkey")).alias("site"), (F.col("s_suppkey") % 7).alias("process"))
    ev = c.select(F.col("c_custkey").alias("evidence_id"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_nationkey")).alias("site"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_custkey") % 11).alias("process"))
    every = ev.agg(F.count("*").alias("n"), F.min("evidence_id").alias("m")).withColumn("k", F.lit(1))
    free = ev.filter("site IS NULL AND process IS NULL").agg(F.count("*").alias("fn"), F.min("evidence_id").alias("fm")).withColumn("k", F.lit(1))
    part = lambda keys, p: ev.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias(f"{p}n"), F.min("evidence_id").alias(f"{p}m"))
    org = req.filter("site IS NULL").withColumn("k", F.lit(1)).join(F.broadcast(every), "k").select("requirement_id", F.col("n").alias("evidence"), F.col("m").alias("first_id"))
    own = req.filter("site IS NOT NULL").withColumn("k", F.lit(1)).join(F.broadcast(free), "k").join(part(["site"], "s"), "site", "left").join(part(["process"], "p"), "process", "left").join(part(["site", "process"], "b"), ["site", "process"], "left")
    z = lambda x: F.coalesce(x, F.lit(0))
    own = own.select("requirement_id", (z("fn") + z("sn") + z("pn") - z("bn")).alias("evidence"), F.least("fm", "sm", "pm").alias("first_id"))
    return org.unionByName(own).filter("evidence > 0")


#: Lots of requirements that a nation's scopes meet apart.
LOTS = 64


@query(
    "scope_candidates",
    """WITH req AS (SELECT p_partkey AS requirement_id, p_size % 5 AS level, p_size AS a FROM part), sc AS (SELECT s_suppkey AS scope_id, s_nationkey % 5 AS level, s_nationkey AS b FROM supplier),
       x AS (SELECT requirement_id, scope_id, CASE WHEN a % 4 = b % 4 THEN 2 ELSE 0 END + CASE WHEN a % 3 = b % 3 THEN 3 ELSE 0 END + CASE WHEN a = b THEN 5 ELSE 0 END AS score FROM req JOIN sc USING (level)),
       y AS (SELECT *, max(score) OVER (PARTITION BY requirement_id) AS best FROM x) SELECT requirement_id, scope_id, score FROM y WHERE score >= greatest(2, best - 1)""",
)
def scope_candidates(spark: SparkSession, d: str) -> DataFrame:
    """JN12, RES8, SC3: requirements meet scopes of their routed level only, then candidates near the best are kept."""
    # the score depends on few values of either side (sizes, nations): those are scored, then the survivors take their requirements and scopes
    req = table(spark, d, "part").select(F.col("p_partkey").alias("requirement_id"), F.col("p_size").alias("a"))
    sc = table(spark, d, "supplier").select(F.col("s_suppkey").alias("scope_id"), F.col("s_nationkey").alias("b"))
    kinds, places = req.select("a", (F.col("a") % 5).alias("level")).distinct(), sc.select("b", (F.col("b") % 5).alias("level")).distinct()
    same = lambda n: F.col("a") % n == F.col("b") % n
    x = kinds.join(places, "level").withColumn("score", F.when(same(4), 2).otherwise(0) + F.when(same(3), 3).otherwise(0) + F.when(F.col("a") == F.col("b"), 5).otherwise(0))
    # a nation's scopes meet the requirements lot by lot, so that no task gets a whole nation and no table is broadcast but the pairs of values
    near = req.repartition("requirement_id").join(F.broadcast(near_best(x, ["a"], "score", 1, 2)), "a").withColumn("lot", F.pmod(F.xxhash64("requirement_id"), F.lit(LOTS)))
    lots = sc.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long"))))
    return near.join(lots.hint("merge"), ["b", "lot"]).select("requirement_id", "scope_id", "score")


ARTICLES_SQL = """pages_of AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page, o_orderkey FROM orders),
  articles AS (SELECT doc_id, page AS start_page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, page + 5) AS end_page, o_orderkey AS article_id FROM pages_of WHERE page % 3 = 1)"""


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("page"), "o_orderkey")
    a = p.filter("page % 3 = 1").select("doc_id", F.col("page").alias("start_page"), F.col("o_orderkey").alias("article_id")).withColumn("end_page", F.coalesce(F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("start_page")) - 1, F.col("start_page") + 5))
    return p, a.select("doc_id", "start_page", "end_page", "article_id")


@query("range_join", f"WITH {ARTICLES_SQL} SELECT p.doc_id, p.page, a.article_id FROM pages_of p JOIN articles a ON p.doc_id = a.doc_id AND p.page BETWEEN a.start_page AND a.end_page")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """JN13: page within an article's range, equal document first."""
    p, a = _pages(spark, d)
    return p.join(a, "doc_id").filter(F.col("page").between(F.col("start_page"), F.col("end_page"))).select("doc_id", "page", "article_id")


@query(
    "as_of_join",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""",
)
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """JN14, RES9: last heading before each position, as an ordered window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query(
    "label_match",
    """WITH r AS (SELECT p_partkey AS id, lower(p_name) AS label, p_type AS t FROM part), a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS label FROM part)
       SELECT id, (SELECT min(a.label) FROM a WHERE a.label = r.label OR starts_with(r.label, a.label || ' ')) AS matched FROM r""",
)
def label_match(spark: SparkSession, d: str) -> DataFrame:
    """JN15: equal label, or one that begins with the other's words; tried as equi joins on every word-aligned prefix."""
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label"))
    a = table(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key")).distinct()
    words = F.split("label", " ")
    keys = r.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("key"))
    best = keys.join(a, "key").groupBy("id").agg(F.min("key").alias("matched"))
    return r.select("id").join(best, "id", "left")


@query(
    "hash_lookup",
    "SELECT o_orderkey, l.n IS NOT NULL AS known, coalesce(l.n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey",
)
def hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN17: existing decisions by key."""
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("n").isNotNull().alias("known"), F.coalesce("n", F.lit(0)).alias("lines"))


@query(
    "tiered_resolution",
    """WITH q AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS by_id, CASE WHEN event_id % 3 = 1 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS by_code, CASE WHEN event_id % 3 = 2 THEN user_id % 25 END AS by_nation FROM events),
       n AS (SELECT c_nationkey, min(c_custkey) AS id FROM customer GROUP BY 1)
       SELECT event_id, coalesce(a.c_custkey, b.c_custkey, n.id) AS resolved, CASE WHEN a.c_custkey IS NOT NULL THEN 'ID' WHEN b.c_custkey IS NOT NULL THEN 'CODE' WHEN n.id IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS tier
       FROM q LEFT JOIN customer a ON by_id = a.c_custkey LEFT JOIN customer b ON by_code = b.c_name LEFT JOIN n ON by_nation = n.c_nationkey""",
)
def tiered_resolution(spark: SparkSession, d: str) -> DataFrame:
    """JN18, JN19: by id, else by code, else by name, ties by the smallest id."""
    k = F.col("event_id") % 3
    q = table(spark, d, "events").select("event_id", F.when(k == 0, F.col("user_id")).alias("by_id"), F.when(k == 1, F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).alias("by_code"), F.when(k == 2, F.col("user_id") % 25).alias("by_nation"))
    c = table(spark, d, "customer")
    a, b = c.select(F.col("c_custkey").alias("a")), c.select(F.col("c_custkey").alias("b"), F.col("c_name").alias("bn"))
    n = c.groupBy(F.col("c_nationkey").alias("nk")).agg(F.min("c_custkey").alias("n"))
    j = q.join(a, F.col("by_id") == F.col("a"), "left").join(b, F.col("by_code") == F.col("bn"), "left").join(n, F.col("by_nation") == F.col("nk"), "left")
    return j.select("event_id", F.coalesce("a", "b", "n").alias("resolved"), F.when(F.col("a").isNotNull(), "ID").when(F.col("b").isNotNull(), "CODE").when(F.col("n").isNotNull(), "NAME").otherwise("NONE").alias("tier"))


@query(
    "scored_unique_match",
    """WITH r AS (SELECT p_partkey AS req, p_brand, p_size, p_type FROM part), c AS (SELECT p_partkey AS art, p_brand, p_size, p_type FROM part),
       x AS (SELECT req, art, 60 + CASE WHEN r.p_type = c.p_type THEN 25 ELSE 0 END + CASE WHEN r.p_size = c.p_size THEN 35 WHEN abs(r.p_size - c.p_size) <= 1 THEN 8 ELSE 0 END AS score FROM r JOIN c ON r.p_brand = c.p_brand AND r.req <> c.art),
       b AS (SELECT req, max(score) AS best FROM x GROUP BY req), w AS (SELECT x.req, min(art) AS art, count(*) AS n, max(score) AS score FROM x JOIN b ON x.req = b.req AND x.score = b.best GROUP BY x.req)
       SELECT r.req, CASE WHEN n = 1 THEN art END AS art, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS outcome, score FROM r LEFT JOIN w ON r.req = w.req""",
)
def scored_unique_match(spark: SparkSession, d: str) -> DataFrame:
    """JN20: best additive score per requirement; a tied best is ambiguous."""
    # the score depends on type and size within a brand, so kinds of parts meet, not parts; a part's own kind scores most
    kind = ["p_brand", "p_type", "p_size"]
    p = table(spark, d, "part").select(F.col("p_partkey").alias("req"), *kind)
    kinds = p.groupBy(*kind).agg(F.count("*").alias("n"), F.min("req").alias("low"), F.max("req").alias("high"))
    other = kinds.select(F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"), F.col("n").alias("m"), F.col("low").alias("art"))
    score = F.lit(60) + F.when(F.col("p_type") == F.col("t"), 25).otherwise(0) + F.when(F.col("p_size") == F.col("s"), 35).when(F.abs(F.col("p_size") - F.col("s")) <= 1, 8).otherwise(0)
    met = kinds.filter("n = 1").join(other, (F.col("p_brand") == F.col("b")) & ((F.col("p_type") != F.col("t")) | (F.col("p_size") != F.col("s")))).select(*kind, "m", "art", score.alias("score"))
    per = met.groupBy(*kind, "score").agg(F.sum("m").alias("m"), F.min("art").alias("art"))
    best = per.groupBy(*kind).agg(F.max_by(F.struct("score", "m", "art"), "score").alias("w"))
    x = p.join(kinds, kind).join(best, kind, "left")
    twin = F.col("n") > 1
    n = F.when(twin, F.col("n") - 1).otherwise(F.col("w.m"))
    art = F.when(twin, F.col("low") + F.col("high") - F.col("req")).otherwise(F.col("w.art"))
    return x.select("req", F.when(n == 1, art).alias("art"), F.when(n.isNull(), "UNRESOLVED").when(n > 1, "AMBIGUOUS").otherwise("RESOLVED").alias("outcome"), F.when(twin, 120).otherwise(F.col("w.score")).alias("score"))


# --- ranking -----------------------------------------------------------------


@query(
    "effective_rows",
    """WITH a AS (SELECT event_id AS seq, user_id AS requirement_id, event_type AS level, user_id % 4 = 1 AND event_id % 2 = 0 AS legacy, value / 100 AS confidence, ts FROM events),
       k AS (SELECT * FROM a WHERE NOT legacy OR NOT EXISTS (SELECT 1 FROM a c WHERE NOT c.legacy AND c.requirement_id = a.requirement_id AND c.level = a.level)),
       s AS (SELECT *, row_number() OVER (PARTITION BY requirement_id, level ORDER BY round(least(1, greatest(0, confidence)) + CASE WHEN legacy THEN 0 ELSE 0.35 END, 6) DESC, ts DESC, seq) AS rn FROM k)
       SELECT requirement_id, level, seq, legacy, round(confidence, 4) AS confidence FROM s WHERE rn = 1""",
)
def effective(spark: SparkSession, d: str) -> DataFrame:
    """RES1, SET2, MA2: a legacy row gives way to a canonical one of its signature; the best row per key by clipped confidence (+0.35 if canonical), then recency."""
    a = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("requirement_id"), F.col("event_type").alias("level"), ((F.col("user_id") % 4 == 1) & (F.col("event_id") % 2 == 0)).alias("legacy"), (F.col("value") / 100).alias("confidence"), "ts")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))) + F.when(F.col("legacy"), 0.0).otherwise(0.35), 6)
    e = effective_rows(a, ["requirement_id", "level"], ["requirement_id", "level"], "legacy", score, [F.desc("ts"), F.col("seq")])
    return e.select("requirement_id", "level", "seq", "legacy", F.round("confidence", 4).alias("confidence"))


@query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'PROMOTED' ELSE 'DRAFT' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """RES2, DML10: latest validation per requirement; an approval promotes a draft."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return e.select("user_id", "x.event_id", "x.event_type", F.when(F.col("x.event_type") == "purchase", "PROMOTED").otherwise("DRAFT").alias("status"))


@query(
    "few_shot",
    "SELECT * FROM (SELECT user_id, event_id, round(value, 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 20) WHERE rn = 1) ORDER BY confidence DESC, user_id LIMIT 25",
)
def few_shot(spark: SparkSession, d: str) -> DataFrame:
    """RES3: one approved or edited example per requirement, the twenty-five most confident."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup") & (F.col("value") >= 20))
    return first_per(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.round("value", 2).alias("confidence")).orderBy(F.desc("confidence"), "user_id").limit(25)


@query("first_site", "SELECT c_nationkey AS profile_id, min(c_custkey) AS site_id, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY 1")
def first_site(spark: SparkSession, d: str) -> DataFrame:
    """RES4."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("profile_id")).agg(F.min("c_custkey").alias("site_id"), F.min_by("c_name", "c_custkey").alias("name"))


@query(
    "best_hit",
    f"""WITH {MEMORY_SQL}, h AS (SELECT *, CASE family WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2 ELSE 1 END AS severity FROM memory)
        SELECT trigger_id, family, severity, hit_count FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY severity DESC, hit_count DESC, family) AS rn FROM h) WHERE rn = 1""",
)
def best_hit(spark: SparkSession, d: str) -> DataFrame:
    """RES5, EM3: the hit of the highest severity, then count."""
    s = F.when(F.col("family") == "error", 3).when(F.col("family").isin("purchase", "signup"), 2).otherwise(1)
    return first_per(memory(spark, d).withColumn("severity", s), ["trigger_id"], [F.desc("severity"), F.desc("hit_count"), F.col("family")]).select("trigger_id", "family", "severity", "hit_count")


@query(
    "group_representative",
    f"WITH {REQUIREMENTS_SQL} SELECT doc_id, article_id, requirement_id, status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'PROMOTED' THEN 3 WHEN 'DRAFT' THEN 2 ELSE 1 END DESC, confidence DESC, page DESC, requirement_id, article_id, profile_id) AS rn FROM requirements) WHERE rn = 1",
)
def group_representative(spark: SparkSession, d: str) -> DataFrame:
    """RES6."""
    rank = F.when(F.col("status") == "PROMOTED", 3).when(F.col("status") == "DRAFT", 2).otherwise(1)
    return first_per(requirements(spark, d), ["doc_id"], [rank.desc(), F.desc("confidence"), F.desc("page"), F.col("requirement_id"), F.col("article_id"), F.col("profile_id")]).select("doc_id", "article_id", "requirement_id", "status")


TYPE_ORDER = ["INTERDICTION", "OBLIGATION", "CONDITION"]


@query(
    "mode_with_priority",
    f"""WITH {REQUIREMENTS_SQL}, c AS (SELECT doc_id, req_type, count(*) AS n FROM requirements WHERE req_type IS NOT NULL GROUP BY 1, 2)
        SELECT doc_id, req_type, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, CASE req_type WHEN 'INTERDICTION' THEN 1 WHEN 'OBLIGATION' THEN 2 ELSE 3 END) AS rn FROM c) WHERE rn = 1""",
)
def mode_with_priority(spark: SparkSession, d: str) -> DataFrame:
    """RES7: most frequent type, ties by priority."""
    c = requirements(spark, d).filter("req_type IS NOT NULL").groupBy("doc_id", "req_type").agg(F.count("*").alias("n"))
    return first_per(c, ["doc_id"], [F.desc("n"), ranked(TYPE_ORDER, "req_type", 9)])


#: Entries of a block of positions, and of a block of blocks.
BLOCK = 64


@query(
    "article_end",
    """WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders)
       SELECT a.doc_id, a.pos, min(b.pos) AS next_pos FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.no >= a.no GROUP BY 1, 2""",
)
def article_end(spark: SparkSession, d: str) -> DataFrame:
    """RES10: an article ends where the next header of no lower number begins; headers that go back are skipped.

    Positions lie in blocks of BLOCK, blocks in blocks of BLOCK blocks and so on, each with its largest number. A row climbs
    to the first level where a later block of its own parent reaches its number, and goes down from there to the first
    position that does: equi joins with lists of at most BLOCK entries, as many as there are levels.
    """
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("no"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos"))
    most = p.agg(F.max("pos")).first()[0] or 0
    block, level, levels = p.select("doc_id", (F.col("pos") - 1).cast("long").alias("b"), F.col("no").alias("m")), 0, []
    up = lambda c: F.floor(F.col(c) / BLOCK)
    while True:
        lists = block.withColumn("parent", up("b")).groupBy("doc_id", "parent").agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("kids"), F.max("m").alias("m"))
        levels.append(lists.select("doc_id", "parent", "kids"))
        level += 1
        if most <= BLOCK**level:
            break
        block = lists.select("doc_id", F.col("parent").alias("b"), "m")
    x = p.withColumn("b", (F.col("pos") - 1).cast("long")).withColumn("f", F.lit(None).cast("long")).withColumn("level", F.lit(None).cast("int"))
    for k, kids in enumerate(levels):
        x = x.withColumn("parent", up("b")).join(kids, ["doc_id", "parent"], "left")
        later = F.get(F.filter("kids", lambda y: (y["b"] > F.col("b")) & (y["m"] >= F.col("no"))), 0)["b"]
        x = x.withColumn("f", F.coalesce("f", later)).withColumn("level", F.coalesce("level", F.when(F.col("f").isNotNull(), k))).withColumn("b", F.col("parent")).drop("parent", "kids")
    for k, kids in reversed(list(enumerate(levels[:-1]))):
        x = x.withColumn("parent", F.when(F.col("level") > k, F.col("f"))).join(kids, ["doc_id", "parent"], "left")
        first = F.get(F.filter("kids", lambda y: y["m"] >= F.col("no")), 0)["b"]
        x = x.withColumn("f", F.when(F.col("level") > k, first).otherwise(F.col("f"))).drop("parent", "kids")
    return x.select("doc_id", "pos", (F.col("f") + 1).cast("int").alias("next_pos"))


# --- sorts and top-k ----------------------------------------------------------


@query("severity_sort", f"WITH {CHECKS_SQL} SELECT check_id, severity, strftime(created_at, '%Y-%m-%d') AS day FROM checks ORDER BY CASE severity WHEN 'CRITIQUE' THEN 1 WHEN 'MAJEURE' THEN 2 WHEN 'MINEURE' THEN 3 ELSE 4 END, created_at DESC, check_id LIMIT 80")
def severity_sort(spark: SparkSession, d: str) -> DataFrame:
    """TK1."""
    c = checks(spark, d).orderBy(ranked(["CRITIQUE", "MAJEURE", "MINEURE"], "severity", 4), F.desc("created_at"), "check_id").limit(80)
    return c.select("check_id", "severity", day("created_at").alias("day"))


@query(
    "action_sort",
    f"WITH {ACTIONS_SQL} SELECT gap_id, action_no, state, strftime(due, '%Y-%m-%d') AS due FROM actions ORDER BY CASE strip_accents(upper(state)) WHEN 'EN_COURS' THEN 1 WHEN 'PLANIFIEE' THEN 2 WHEN 'CLOTUREE' THEN 3 ELSE 4 END, actions.due ASC NULLS LAST, gap_id DESC, action_no LIMIT 120",
)
def action_sort(spark: SparkSession, d: str) -> DataFrame:
    """TK2: by state (accents folded), due date with missing last."""
    a = actions(spark, d).orderBy(ranked(["EN_COURS", "PLANIFIEE", "CLOTUREE"], folded_state(), 4), F.col("due").asc_nulls_last(), F.desc("gap_id"), "action_no").limit(120)
    return a.select("gap_id", "action_no", "state", day("due").alias("due"))


@query("top_documents", f"WITH {REQUIREMENTS_SQL} SELECT doc_id, count(*) AS n FROM requirements GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 12")
def top_documents(spark: SparkSession, d: str) -> DataFrame:
    """TK3."""
    return requirements(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(12)


@query("validation_queue", f"WITH {REQUIREMENTS_SQL} SELECT requirement_id, status, round(confidence, 4) AS confidence FROM requirements ORDER BY CASE WHEN status = 'DRAFT' THEN 0 ELSE 1 END, requirements.confidence DESC, requirement_id LIMIT 100")
def validation_queue(spark: SparkSession, d: str) -> DataFrame:
    """TK4."""
    return requirements(spark, d).orderBy(F.when(F.col("status") == "DRAFT", 0).otherwise(1), F.desc("confidence"), "requirement_id").limit(100).select("requirement_id", "status", F.round("confidence", 4).alias("confidence"))


@query(
    "vector_top_k",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
       SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s) WHERE rn <= 8""",
)
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """TK5, SIM5: exact cosine search of every twentieth vector against all, in blocks; the eight nearest of each."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return blocked_top_k(e.filter("id % 20 = 0"), e, 8).select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), "similarity")


def blocked_top_k(queries: DataFrame, rows: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """``q, id, similarity``: the k nearest rows (``id, v``) of each query by cosine; blocks of queries meet blocks of rows, each pair sends k rows a query."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        n = max(1, df.count() // block)
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_v")).drop("b")

    def near(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, qids, qv = (c[i].values for c in batch.columns)
                ids, qids = ids.to_numpy(), qids.to_numpy()
                unit = [np.stack(x.to_numpy(zero_copy_only=False)) for x in (v, qv)]
                unit = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in unit]
                like = np.round(unit[1] @ unit[0].T, 6)
                like[qids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, like.shape), -like), axis=1)[:, :k]
                take = np.take_along_axis(like, order, 1)
                ok = np.isfinite(take)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, order.shape[1])[ok.ravel()]), pa.array(ids[order].ravel()[ok.ravel()]), pa.array(take.ravel()[ok.ravel()])], ["q", "id", "similarity"])

    met = packed(rows, "r").crossJoin(packed(queries, "q")).mapInArrow(near, "q long, id long, similarity double")
    return top_per(met, ["q"], [F.desc("similarity"), F.col("id")], k).drop("place")


@query(
    "evidence_top5",
    "SELECT requirement_id, evidence_id, place FROM (SELECT o_custkey AS requirement_id, o_orderkey AS evidence_id, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, substr(o_orderpriority, 1, 1), o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 5",
)
def evidence_top5(spark: SparkSession, d: str) -> DataFrame:
    """TK6: the five best pieces of evidence of each requirement."""
    o = table(spark, d, "orders")
    return top_per(o, ["o_custkey"], [F.floor(F.col("o_totalprice") / 50000).desc(), F.substring("o_orderpriority", 1, 1), F.desc("o_orderdate"), F.col("o_orderkey")], 5).select(F.col("o_custkey").alias("requirement_id"), F.col("o_orderkey").alias("evidence_id"), "place")


@query("nulls_last_sort", "SELECT c_custkey, n FROM (SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) ORDER BY n DESC, last DESC NULLS LAST, c_custkey LIMIT 60")
def nulls_last_sort(spark: SparkSession, d: str) -> DataFrame:
    """TK7."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"), F.max("o_orderdate").alias("last"))
    j = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", F.lit(0)).alias("n"), "last")
    return j.orderBy(F.desc("n"), F.col("last").desc_nulls_last(), "c_custkey").limit(60).select("c_custkey", "n")


@query("tenant_first_sort", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END, c_name, c_custkey LIMIT 40")
def tenant_first_sort(spark: SparkSession, d: str) -> DataFrame:
    """TK8."""
    return table(spark, d, "customer").orderBy(F.when(F.col("c_mktsegment") == "FURNITURE", 0).otherwise(1), "c_name", "c_custkey").limit(40).select("c_custkey", "c_mktsegment")


LEVELS = ["ORGANIZATION", "SITE", "PROCESS", "ACTIVITY"]


@query(
    "scope_level_sort",
    """WITH t AS (SELECT 'ORGANIZATION' AS level, r_name AS label FROM region UNION ALL SELECT 'SITE', n_name FROM nation UNION ALL SELECT 'PROCESS', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'ACTIVITY', p_brand FROM (SELECT DISTINCT p_brand FROM part))
       SELECT level, label, row_number() OVER (ORDER BY CASE level WHEN 'ORGANIZATION' THEN 1 WHEN 'SITE' THEN 2 WHEN 'PROCESS' THEN 3 ELSE 4 END, label) AS place FROM t""",
)
def scope_level_sort(spark: SparkSession, d: str) -> DataFrame:
    """TK9, SC1: the scope tree as a union of its levels, in order."""
    t = table(spark, d, "region").select(F.lit("ORGANIZATION").alias("level"), F.col("r_name").alias("label"))
    t = t.union(table(spark, d, "nation").select(F.lit("SITE"), "n_name")).union(table(spark, d, "customer").select(F.lit("PROCESS"), "c_mktsegment").distinct()).union(table(spark, d, "part").select(F.lit("ACTIVITY"), "p_brand").distinct())
    return t.withColumn("place", F.row_number().over(Window.orderBy(ranked(LEVELS, "level", 9), "label")).cast("long"))


@query("action_plan_sort", f"WITH {ACTIONS_SQL} SELECT gap_id, action_no FROM actions ORDER BY CASE state WHEN 'EN_COURS' THEN 1 WHEN 'PLANIFIEE' THEN 2 ELSE 3 END, coalesce(due, TIMESTAMP '9999-12-31'), gap_id, action_no LIMIT 60")
def action_plan_sort(spark: SparkSession, d: str) -> DataFrame:
    """TK10."""
    return actions(spark, d).orderBy(ranked(["EN_COURS", "PLANIFIEE"], "state", 3), F.coalesce("due", F.lit("9999-12-31").cast("timestamp_ntz")), "gap_id", "action_no").limit(60).select("gap_id", "action_no")


@query("worst_items", f"WITH {CHECKS_SQL}, t AS (SELECT * FROM checks ORDER BY score ASC NULLS FIRST, created_at DESC, check_id LIMIT 120) SELECT check_id, score FROM t ORDER BY coalesce(score, 0), check_id LIMIT 25")
def worst_items(spark: SparkSession, d: str) -> DataFrame:
    """TK11."""
    t = checks(spark, d).orderBy(F.col("score").asc_nulls_first(), F.desc("created_at"), "check_id").limit(120)
    return t.orderBy(F.coalesce("score", F.lit(0.0)), "check_id").limit(25).select("check_id", "score")


@query("operational_context", f"WITH {CHECKS_SQL} SELECT check_id, compliance_status FROM checks ORDER BY CASE compliance_status WHEN 'NON_CONFORME' THEN 1 WHEN 'NON_EVALUE' THEN 2 ELSE 3 END, profile_id, severity ASC NULLS LAST, created_at DESC, check_id LIMIT 18")
def operational_context(spark: SparkSession, d: str) -> DataFrame:
    """TK12."""
    return checks(spark, d).orderBy(ranked(["NON_CONFORME", "NON_EVALUE"], "compliance_status", 3), "profile_id", F.col("severity").asc_nulls_last(), F.desc("created_at"), "check_id").limit(18).select("check_id", "compliance_status")


# --- merges ------------------------------------------------------------------


@query(
    "decision_upsert",
    """WITH o AS (SELECT c_custkey AS id, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT o_custkey AS id, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1)
       SELECT coalesce(o.id, n.id) AS id, coalesce(n.v, o.v) AS v, CASE WHEN o.id IS NULL THEN 1 WHEN n.id IS NULL THEN 1 ELSE 2 END AS version, n.id IS NOT NULL AND o.id IS NOT NULL AND n.v <> o.v AS needs_recheck,
              CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS merge_kind FROM o FULL JOIN n ON o.id = n.id""",
)
def decision_upsert(spark: SparkSession, d: str) -> DataFrame:
    """DML1, DML2, DML4, DML5: upsert with version and re-check flag; counted as inserted, updated or kept."""
    o = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("v"))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return upsert(o, n, ["id"], {"v": F.coalesce("n.v", "o.v"), "version": F.when(F.col("o.id").isNull() | F.col("n.id").isNull(), 1).otherwise(2), "needs_recheck": F.coalesce(F.col("n.v") != F.col("o.v"), F.lit(False))}, kinds=True)


@query(
    "applicability_delta",
    """WITH w AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderpriority AS p FROM orders), e AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_orderkey % 4 = 0 THEN 'INCERTAIN' ELSE 'APPLICABLE' END AS st FROM lineitem WHERE l_quantity > 25)
       SELECT w.id, CASE WHEN e.id IS NULL THEN 'NEW' WHEN e.st = 'INCERTAIN' THEN 'RERUN_STATUS' WHEN p = '1-URGENT' THEN 'FORCED' END AS reason FROM w LEFT JOIN e ON w.id = e.id WHERE e.id IS NULL OR e.st = 'INCERTAIN' OR p = '1-URGENT'""",
)
def applicability_delta(spark: SparkSession, d: str) -> DataFrame:
    """DL1: pairs to decide: new, uncertain before, or forced."""
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    e = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 4 == 0, "INCERTAIN").otherwise("APPLICABLE").alias("st")).distinct()
    return delta(w, e, ["id"], F.when(F.col("e._known").isNull(), "NEW").when(F.col("e.st") == "INCERTAIN", "RERUN_STATUS").when(F.col("w.p") == "1-URGENT", "FORCED")).select("id", "reason")


@query(
    "compliance_delta",
    """WITH n AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_orderstatus, o_orderpriority)) AS h, o_orderstatus AS dec FROM orders), e AS (SELECT o_orderkey AS id, sha256(concat_ws('|', CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END, o_orderpriority)) AS h, o_orderkey % 11 = 0 AS recheck FROM orders WHERE o_orderkey % 7 <> 0)
       SELECT n.id, CASE WHEN e.id IS NULL THEN 'NEW' WHEN recheck THEN 'NEEDS_RECHECK' WHEN n.h <> e.h THEN 'INPUT_CHANGED' END AS reason FROM n LEFT JOIN e ON n.id = e.id WHERE e.id IS NULL OR recheck OR n.h <> e.h""",
)
def compliance_delta(spark: SparkSession, d: str) -> DataFrame:
    """DL2, HA2: checks to run again by flag or by the digest of their inputs."""
    o = table(spark, d, "orders")
    n = o.select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("h"))
    e = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority"), 256).alias("h"), (F.col("o_orderkey") % 11 == 0).alias("recheck"))
    return delta(n, e, ["id"], F.when(F.col("e._known").isNull(), "NEW").when(F.col("e.recheck"), "NEEDS_RECHECK").when(F.col("w.h") != F.col("e.h"), "INPUT_CHANGED")).select("id", "reason")


@query(
    "memory_merge",
    f"""WITH a AS (SELECT * FROM events WHERE event_id % 3 <> 0), b AS (SELECT * FROM events WHERE event_id % 2 = 0), u AS (SELECT * FROM a UNION SELECT * FROM b)
        SELECT event_type AS family, user_id AS trigger_id, count(*) AS hit_count, arg_max(props, struct_pack(l := length(props), e := -event_id)) AS longest, len(list(DISTINCT event_id // 50)) AS docs FROM u GROUP BY 1, 2""",
)
def memory_merge(spark: SparkSession, d: str) -> DataFrame:
    """DML3, AR2, STR2: two batches of signals merged into keyed state: a key seen before does not count again, the longest text wins, documents are a set."""
    e = table(spark, d, "events")
    u = e.filter("event_id % 3 <> 0").unionByName(e.filter("event_id % 2 = 0")).dropDuplicates(["event_id"])
    return u.groupBy(F.col("event_type").alias("family"), F.col("user_id").alias("trigger_id")).agg(F.count("*").alias("hit_count"), F.max_by("props", F.struct(F.length("props"), -F.col("event_id"))).alias("longest"), F.countDistinct((F.col("event_id") / 50).cast("long")).alias("docs"))


@query("delete_and_rebuild", "SELECT l_orderkey, l_linenumber, FALSE AS rebuilt FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 1, TRUE FROM orders WHERE o_orderkey % 10 = 0")
def delete_and_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """DML6: the rows of rebuilt documents are replaced."""
    keep = table(spark, d, "lineitem").filter("l_orderkey % 10 <> 0").select("l_orderkey", "l_linenumber", F.lit(False).alias("rebuilt"))
    return keep.union(table(spark, d, "orders").filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit(1), F.lit(True)))


@query("rebuild_guard", "SELECT c_custkey, count(o_orderkey) AS refs, count(o_orderkey) = 0 AS may_rebuild FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def rebuild_guard(spark: SparkSession, d: str) -> DataFrame:
    """DML7: a document with downstream references is not rebuilt."""
    n = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    r = F.coalesce("n", F.lit(0))
    return table(spark, d, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", r.alias("refs"), (r == 0).alias("may_rebuild"))


@query("deactivate_checks", "SELECT o_orderkey, o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS active FROM orders")
def deactivate_checks(spark: SparkSession, d: str) -> DataFrame:
    """DML8: checks whose decision no longer applies."""
    a = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey").distinct()
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", ((F.col("o_orderstatus") == "F") | F.col("l_orderkey").isNotNull()).alias("active"))


@query("legacy_purge", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND user_id % 2 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase'))")
def legacy_purge(spark: SparkSession, d: str) -> DataFrame:
    """DML9: legacy rows of touched requirements go."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    touched = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("u")).distinct()
    legacy = (F.col("event_type") == "view") & (F.col("user_id") % 2 == 0)
    return e.join(touched, F.col("user_id") == F.col("u"), "left").filter(~(legacy & F.col("u").isNotNull())).select("event_id")
