"""Aggregations (AG1 to AG36) over the compliance views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import AS_OF, CHECKS_SQL, REQUIREMENTS_SQL, checks, day, requirements
from ..registry import query, table


@query("count_by_key", f"WITH {REQUIREMENTS_SQL} SELECT coalesce(req_type, 'AUTRE') AS req_type, count(*) AS n FROM requirements GROUP BY 1 ORDER BY n DESC, req_type")
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    """AG1: distribution of types, null under a name of its own."""
    r = requirements(spark, d)
    return r.groupBy(F.coalesce("req_type", F.lit("AUTRE")).alias("req_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "req_type")


@query(
    "filtered_counts",
    f"""WITH {REQUIREMENTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'DRAFT') AS draft, count(*) FILTER (WHERE status = 'TO_VALIDATE') AS to_validate,
        count(*) FILTER (WHERE status = 'PROMOTED') AS promoted, count(*) FILTER (WHERE status = 'REJECT') AS rejected, round(avg(confidence), 4) AS avg_confidence FROM requirements""",
)
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG2: one pass, one count per status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return requirements(spark, d).agg(F.count("*").alias("total"), n("DRAFT").alias("draft"), n("TO_VALIDATE").alias("to_validate"), n("PROMOTED").alias("promoted"), n("REJECT").alias("rejected"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


@query("distinct_docs", f"WITH {REQUIREMENTS_SQL} SELECT status, count(DISTINCT doc_id) AS docs, count(DISTINCT article_id) AS articles FROM requirements GROUP BY status")
def distinct_docs(spark: SparkSession, d: str) -> DataFrame:
    """AG3: distinct documents of each status."""
    return requirements(spark, d).groupBy("status").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("article_id").alias("articles"))


@query(
    "daily_trend_30",
    """SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS docs, count(*) AS reqs FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30) ORDER BY day""",
)
def daily_trend_30(spark: SparkSession, d: str) -> DataFrame:
    """AG4: the last thirty days with any row, in ascending order."""
    t = table(spark, d, "events").groupBy(day("ts").alias("day")).agg(F.countDistinct("user_id").alias("docs"), F.count("*").alias("reqs"))
    return t.orderBy(F.desc("day")).limit(30).orderBy("day")


@query(
    "family_analytics",
    """SELECT d.source AS family, count(DISTINCT d.doc_id) AS docs, count(l.doc_id) AS reqs, count(*) FILTER (WHERE l.quality = 1) AS approved, count(*) FILTER (WHERE l.toxic = 1) AS flagged,
              round(avg(coalesce(l.quality, 0)), 4) AS avg_quality
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source ORDER BY docs DESC, family""",
)
def family_analytics(spark: SparkSession, d: str) -> DataFrame:
    """AG5: per family; a document without a label counts 0 in the average."""
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("l"), "quality", "toxic")
    j = table(spark, d, "documents").select("doc_id", "source").join(labelled, F.col("doc_id") == F.col("l"), "left")
    return (
        j.groupBy(F.col("source").alias("family"))
        .agg(F.countDistinct("doc_id").alias("docs"), F.count("l").alias("reqs"), F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 4).alias("avg_quality"))
        .orderBy(F.desc("docs"), "family")
    )


@query("status_avg", f"WITH {CHECKS_SQL} SELECT compliance_status, count(*) AS n, round(avg(score), 4) AS avg_score FROM checks GROUP BY compliance_status")
def status_avg(spark: SparkSession, d: str) -> DataFrame:
    """AG6."""
    return checks(spark, d).groupBy("compliance_status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"))


@query("two_key_breakdown", f"WITH {CHECKS_SQL} SELECT coalesce(severity, 'AUCUNE') AS severity, compliance_status, count(*) AS n FROM checks GROUP BY 1, 2")
def two_key_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """AG7."""
    return checks(spark, d).groupBy(F.coalesce("severity", F.lit("AUCUNE")).alias("severity"), "compliance_status").agg(F.count("*").alias("n"))


@query(
    "having_duplicates",
    "WITH g AS (SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1) SELECT sha, n, first_id, count(*) OVER () AS duplicate_groups FROM g",
)
def having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """AG8: texts held more than once, and how many such groups there are."""
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")
    total = g.agg(F.count("*").alias("duplicate_groups")).select("duplicate_groups", F.lit(1).alias("k"))
    return g.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").drop("k")


MEMORY_SQL = """memory AS (
  SELECT event_type AS family, user_id AS trigger_id, count(*) AS hit_count, list_sort(list(DISTINCT event_id // 50)) AS doc_ids, max(ts) AS last_seen FROM events GROUP BY 1, 2)"""


def memory(spark: SparkSession, d: str) -> DataFrame:
    """The error memory as a keyed state of the event log: hits, distinct documents, last hit."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("family"), F.col("user_id").alias("trigger_id")).agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_set((F.col("event_id") / 50).cast("long"))).alias("doc_ids"), F.max("ts").alias("last_seen"))


@query("memory_stats", f"WITH {MEMORY_SQL} SELECT family, count(*) AS entries, CAST(sum(hit_count) AS BIGINT) AS hits, CAST(sum(len(doc_ids)) AS BIGINT) AS doc_links, strftime(max(last_seen), '%Y-%m-%d') AS last_day FROM memory GROUP BY family")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG9: entries, hits and array cardinalities per family."""
    return memory(spark, d).groupBy("family").agg(F.count("*").alias("entries"), F.sum("hit_count").alias("hits"), F.sum(F.size("doc_ids")).alias("doc_links"), day(F.max("last_seen")).alias("last_day"))


@query(
    "rejection_stats",
    """SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS filter_band, count(*) AS n, count(DISTINCT user_id) AS docs, round(sum(value), 2) AS total_value
       FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2""",
)
def rejection_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG10: rejections by a field of the event's JSON."""
    k = (F.get_json_object("props", "$.k").cast("int") / 10).cast("int")
    return table(spark, d, "events").filter(F.col("event_type").isin("error", "view")).groupBy("event_type", k.alias("filter_band")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("docs"), F.round(F.sum("value"), 2).alias("total_value"))


@query("rejection_stats_global", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS docs, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def rejection_stats_global(spark: SparkSession, d: str) -> DataFrame:
    """AG10, global variant."""
    return table(spark, d, "events").filter(F.col("event_type").isin("error", "view")).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("docs"), day(F.max("ts")).alias("last_day"))


@query(
    "explode_group",
    f"WITH {MEMORY_SQL}, x AS (SELECT unnest(doc_ids) AS doc_id, family, last_seen FROM memory) SELECT doc_id, count(DISTINCT family) AS families, strftime(max(last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen FROM x GROUP BY doc_id ORDER BY families DESC, last_seen DESC, doc_id LIMIT 20",
)
def explode_group(spark: SparkSession, d: str) -> DataFrame:
    """AG11: documents to replay: the top twenty by families of errors, then latest hit."""
    x = memory(spark, d).select(F.explode("doc_ids").alias("doc_id"), "family", "last_seen")
    g = x.groupBy("doc_id").agg(F.countDistinct("family").alias("families"), F.date_format(F.max("last_seen"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return g.orderBy(F.desc("families"), F.desc("last_seen"), "doc_id").limit(20)


@query(
    "tenant_directory",
    """WITH docs AS (SELECT lower(lang) AS tenant_id, count(*) AS n FROM documents GROUP BY 1), prof AS (SELECT DISTINCT lower(c_mktsegment) AS tenant_id FROM customer),
       usr AS (SELECT lower(event_type) AS tenant_id, count(DISTINCT user_id) AS n FROM events GROUP BY 1),
       keys AS (SELECT tenant_id FROM docs UNION SELECT tenant_id FROM prof UNION SELECT tenant_id FROM usr)
       SELECT k.tenant_id, p.tenant_id IS NOT NULL AS has_profile, coalesce(d.n, 0) AS documents, coalesce(u.n, 0) AS users
       FROM keys k LEFT JOIN prof p USING (tenant_id) LEFT JOIN docs d USING (tenant_id) LEFT JOIN usr u USING (tenant_id)
       WHERE p.tenant_id IS NOT NULL OR coalesce(d.n, 0) > 0 OR coalesce(u.n, 0) > 0""",
)
def tenant_directory(spark: SparkSession, d: str) -> DataFrame:
    """AG12, SET1: tenants of three sources with their counts; tenants without anything go."""
    docs = table(spark, d, "documents").groupBy(F.lower("lang").alias("tenant_id")).agg(F.count("*").alias("documents"))
    prof = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("tenant_id")).distinct().withColumn("has_profile", F.lit(True))
    usr = table(spark, d, "events").groupBy(F.lower("event_type").alias("tenant_id")).agg(F.countDistinct("user_id").alias("users"))
    keys = docs.select("tenant_id").union(prof.select("tenant_id")).union(usr.select("tenant_id")).distinct()
    out = keys.join(prof, "tenant_id", "left").join(docs, "tenant_id", "left").join(usr, "tenant_id", "left")
    out = out.select("tenant_id", F.coalesce("has_profile", F.lit(False)).alias("has_profile"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("users", F.lit(0)).alias("users"))
    return out.filter("has_profile OR documents > 0 OR users > 0")


@query("headcount_rollup", "SELECT c_nationkey AS profile_id, CAST(sum(coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 100) AS BIGINT) END, 0)) AS BIGINT) AS headcount, count(*) AS sites FROM customer GROUP BY 1")
def headcount_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AG13: employees over the sites of a profile, unknown as 0."""
    n = F.when(F.col("c_acctbal") < 0, None).otherwise(F.floor(F.col("c_acctbal") / 100))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("profile_id")).agg(F.sum(F.coalesce(n, F.lit(0))).alias("headcount"), F.count("*").alias("sites"))


@query(
    "registry_summary",
    f"""WITH {REQUIREMENTS_SQL}, t AS (SELECT count(*) AS total, count(DISTINCT concat_ws('|', req_type, status, CAST(article_id AS VARCHAR))) AS keys, avg(confidence) AS conf,
          count(*) FILTER (WHERE status = 'TO_VALIDATE') AS tv, count(*) FILTER (WHERE req_type = 'OBLIGATION') AS obligations FROM requirements)
        SELECT total, tv AS to_validate, obligations, round(1 - keys * 1.0::DOUBLE / total, 4) AS duplicate_rate, round(conf, 4) AS avg_confidence,
               round(0.45::DOUBLE * (1 - (1 - keys * 1.0::DOUBLE / total)) + 0.35::DOUBLE * conf + 0.20::DOUBLE * (1 - tv * 1.0::DOUBLE / total), 4) AS proxy_score FROM t""",
)
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG14: counters and a proxy score of 0.45 uniqueness, 0.35 confidence, 0.20 validated."""
    t = requirements(spark, d).agg(
        F.count("*").alias("total"),
        F.countDistinct(F.concat_ws("|", "req_type", "status", F.col("article_id").cast("string"))).alias("keys"),
        F.avg("confidence").alias("conf"),
        F.count_if(F.col("status") == "TO_VALIDATE").alias("to_validate"),
        F.count_if(F.col("req_type") == "OBLIGATION").alias("obligations"),
    )
    dup = 1 - F.col("keys") / F.col("total")
    return t.select("total", "to_validate", "obligations", F.round(dup, 4).alias("duplicate_rate"), F.round("conf", 4).alias("avg_confidence"), F.round(0.45 * (1 - dup) + 0.35 * F.col("conf") + 0.20 * (1 - F.col("to_validate") / F.col("total")), 4).alias("proxy_score"))


THRESHOLDS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]


@query(
    "threshold_sweep",
    f"""WITH s AS (SELECT CAST(round(value) AS BIGINT) % 100 / 100.0::DOUBLE AS conf, event_type IN ('purchase', 'signup') AS ok FROM events),
        th(threshold) AS (SELECT unnest({THRESHOLDS})),
        m AS (SELECT threshold, count(*) FILTER (WHERE ok AND conf >= threshold) AS tp, count(*) FILTER (WHERE NOT ok AND conf >= threshold) AS fp, count(*) FILTER (WHERE ok AND conf < threshold) AS fn
              FROM s, th GROUP BY threshold HAVING count(*) FILTER (WHERE conf >= threshold) > 0),
        p AS (SELECT *, tp * 1.0::DOUBLE / (tp + fp) AS pr, CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) ELSE 0 END AS rc FROM m),
        f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM p)
        SELECT threshold, tp, fp, fn, round(pr, 4) AS precision, round(rc, 4) AS recall, round(f1, 4) AS f1,
               row_number() OVER (ORDER BY CASE WHEN rc >= 0.65 THEN 0 ELSE 1 END, f1 DESC, threshold) = 1 AS chosen FROM f""",
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """AG15, MA4: precision, recall and F1 at twelve thresholds; the best F1 with recall 0.65 or more is chosen, else the best F1.

    Rows are counted once per confidence value, so the thresholds meet a small histogram and not the rows.
    """
    s = table(spark, d, "events").select((F.pmod(F.round("value").cast("long"), F.lit(100)) / 100).alias("conf"), F.col("event_type").isin("purchase", "signup").alias("ok"))
    hist = s.groupBy("conf", "ok").agg(F.count("*").alias("n"))
    m = hist.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    up = F.col("conf") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    m = m.groupBy("threshold").agg(n(F.col("ok") & up).alias("tp"), n(~F.col("ok") & up).alias("fp"), n(F.col("ok") & ~up).alias("fn")).filter("tp + fp > 0")
    pr, rc = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    m = m.withColumn("pr", pr).withColumn("rc", rc).withColumn("f", F.when(F.col("pr") + F.col("rc") > 0, 2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc"))).otherwise(0.0))
    best = F.row_number().over(Window.orderBy(F.when(F.col("rc") >= 0.65, 0).otherwise(1), F.desc("f"), "threshold")) == 1
    return m.select("threshold", "tp", "fp", "fn", F.round("pr", 4).alias("precision"), F.round("rc", 4).alias("recall"), F.round("f", 4).alias("f1"), best.alias("chosen"))


@query(
    "confidence_buckets",
    "SELECT CAST(floor(CAST(round(l_discount * 100) AS BIGINT) / 2) AS BIGINT) AS bucket, count(*) FILTER (WHERE l_returnflag = 'A') AS approved, count(*) FILTER (WHERE l_returnflag <> 'A') AS other FROM lineitem GROUP BY 1",
)
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    """AG16: histogram of fixed width, approved against other."""
    b = F.floor(F.round(F.col("l_discount") * 100).cast("long") / 2)
    return table(spark, d, "lineitem").groupBy(b.alias("bucket")).agg(F.count_if(F.col("l_returnflag") == "A").alias("approved"), F.count_if(F.col("l_returnflag") != "A").alias("other"))


@query(
    "snapshot_kpis",
    f"""WITH {CHECKS_SQL}, {REQUIREMENTS_SQL}, c AS (SELECT count(*) AS checks, count(*) FILTER (WHERE compliance_status = 'CONFORME') AS ok, count(*) FILTER (WHERE compliance_status = 'NON_CONFORME') AS bad FROM checks),
        r AS (SELECT count(*) FILTER (WHERE status <> 'DRAFT') AS applicable FROM requirements)
        SELECT checks, ok, bad, applicable, CASE WHEN checks > 0 THEN round(100.0::DOUBLE * ok / checks, 2) ELSE 0 END AS compliance_rate,
               CASE WHEN applicable > 0 THEN round(100.0::DOUBLE * checks / applicable, 2) ELSE 0 END AS coverage, greatest(0, applicable - checks) AS unevaluated FROM c, r""",
)
def snapshot_kpis(spark: SparkSession, d: str) -> DataFrame:
    """AG17, MA5: rate over all checks, coverage, unevaluated requirements."""
    c = checks(spark, d).agg(F.count("*").alias("checks"), F.count_if(F.col("compliance_status") == "CONFORME").alias("ok"), F.count_if(F.col("compliance_status") == "NON_CONFORME").alias("bad")).withColumn("k", F.lit(1))
    r = requirements(spark, d).agg(F.count_if(F.col("status") != "DRAFT").alias("applicable")).withColumn("k", F.lit(1))
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 2)).otherwise(0.0)
    return c.join(F.broadcast(r), "k").select("checks", "ok", "bad", "applicable", pct("ok", "checks").alias("compliance_rate"), pct("checks", "applicable").alias("coverage"), F.greatest(F.lit(0), F.col("applicable") - F.col("checks")).alias("unevaluated"))


@query(
    "compliance_summary",
    f"""WITH {CHECKS_SQL} SELECT profile_id % 5 AS profile_id, count(*) AS checks, count(*) FILTER (WHERE severity = 'CRITIQUE') AS critical, count(*) FILTER (WHERE severity = 'MAJEURE') AS major, count(*) FILTER (WHERE severity = 'MINEURE') AS minor,
        count(*) FILTER (WHERE compliance_status = 'NON_CONFORME' AND severity IS NULL) AS unranked, round(avg(score), 4) AS avg_score FROM checks GROUP BY 1""",
)
def compliance_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG18: status and severity totals of a profile in one pass."""
    n = lambda c: F.count_if(c)
    s = F.col("severity")
    return checks(spark, d).groupBy((F.col("profile_id") % 5).alias("profile_id")).agg(F.count("*").alias("checks"), n(s == "CRITIQUE").alias("critical"), n(s == "MAJEURE").alias("major"), n(s == "MINEURE").alias("minor"), n((F.col("compliance_status") == "NON_CONFORME") & s.isNull()).alias("unranked"), F.round(F.avg("score"), 4).alias("avg_score"))


@query(
    "engine_statistics",
    f"""WITH {REQUIREMENTS_SQL} SELECT profile_id, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'PROMOTED') / count(*), 2) ELSE 0 END AS promoted_pct,
        CASE WHEN count(domain) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (WHERE domain = 'SST') / count(domain), 2) ELSE 0 END AS sst_pct FROM requirements GROUP BY profile_id""",
)
def engine_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG20: averages and percentages guarded against zero."""
    pct = lambda a, b: F.when(b > 0, F.round(100.0 * a / b, 2)).otherwise(0.0)
    return requirements(spark, d).groupBy("profile_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), pct(F.count_if(F.col("status") == "PROMOTED"), F.count("*")).alias("promoted_pct"), pct(F.count_if(F.col("domain") == "SST"), F.count("domain")).alias("sst_pct"))


@query(
    "precall_report",
    """WITH c AS (SELECT source AS case_id, count(*) AS units, count(*) FILTER (WHERE n_chars >= 600) AS kept, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1)
       SELECT CASE WHEN kept * 2 >= units THEN 'FULL' ELSE 'LIMITED' END AS mode, count(*) AS cases, CAST(sum(units) AS BIGINT) AS units, CAST(sum(kept) AS BIGINT) AS kept, round(1 - sum(kept) * 1.0::DOUBLE / sum(units), 4) AS reduction, CAST(sum(chars) AS BIGINT) AS chars FROM c GROUP BY 1""",
)
def precall_report(spark: SparkSession, d: str) -> DataFrame:
    """AG21: sums over cases and the share of calls saved, by mode."""
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("units"), F.count_if(F.col("n_chars") >= 600).alias("kept"), F.sum("n_chars").alias("chars"))
    mode = F.when(F.col("kept") * 2 >= F.col("units"), "FULL").otherwise("LIMITED")
    return c.groupBy(mode.alias("mode")).agg(F.count("*").alias("cases"), F.sum("units").alias("units"), F.sum("kept").alias("kept"), F.round(1 - F.sum("kept") / F.sum("units"), 4).alias("reduction"), F.sum("chars").alias("chars"))


@query(
    "postcall_report",
    f"""WITH {REQUIREMENTS_SQL}, g AS (SELECT doc_id, coalesce(req_type, 'AUTRE') AS req_type, count(*) AS n, avg(confidence) AS a FROM requirements GROUP BY 1, 2)
        SELECT req_type, CAST(sum(n) AS BIGINT) AS candidates, round(sum(a * n) / sum(n), 4) AS weighted_confidence, count(*) AS docs FROM g GROUP BY req_type""",
)
def postcall_report(spark: SparkSession, d: str) -> DataFrame:
    """AG22: averages of documents weighted by their candidates."""
    g = requirements(spark, d).groupBy("doc_id", F.coalesce("req_type", F.lit("AUTRE")).alias("req_type")).agg(F.count("*").alias("n"), F.avg("confidence").alias("a"))
    return g.groupBy("req_type").agg(F.sum("n").alias("candidates"), F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 4).alias("weighted_confidence"), F.count("*").alias("docs"))


@query(
    "freshness_summary",
    f"""WITH e AS (SELECT o_custkey % 50 AS requirement_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') END AS age, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 365 WHEN '2' THEN 180 ELSE 730 END AS lim FROM orders)
        SELECT requirement_id, count(*) AS total, count(*) FILTER (WHERE age <= lim) AS fresh, count(*) FILTER (WHERE age > lim) AS expired, count(*) FILTER (WHERE age IS NULL) AS undated,
               count(*) FILTER (WHERE age > lim) > 0 AND count(*) FILTER (WHERE age <= lim) = 0 AND count(*) FILTER (WHERE age IS NULL) = 0 AS only_expired, min(age) AS min_age, max(age) AS max_age FROM e GROUP BY 1""",
)
def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG23, DT3: evidence per requirement, fresh, expired (audit 365, closure 180, other 730 days) or undated."""
    p = F.substring("o_orderpriority", 1, 1)
    age = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")).cast("long"))
    e = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("requirement_id"), age.alias("age"), F.when(p == "1", 365).when(p == "2", 180).otherwise(730).alias("lim"))
    fresh, expired, undated = F.count_if(F.col("age") <= F.col("lim")), F.count_if(F.col("age") > F.col("lim")), F.count_if(F.col("age").isNull())
    return e.groupBy("requirement_id").agg(F.count("*").alias("total"), fresh.alias("fresh"), expired.alias("expired"), undated.alias("undated"), ((expired > 0) & (fresh == 0) & (undated == 0)).alias("only_expired"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))


@query(
    "proof_item_count",
    r"""SELECT conv_id, turn, len(list_distinct([lower(trim(x)) FOR x IN regexp_split_to_array(coalesce(text, ''), '[\n;|•.]') IF length(trim(x)) >= 4 AND lower(trim(x)) NOT IN ('n/a', 'none', 'aucun', 'aucune')])) AS items FROM conversations""",
)
def proof_item_count(spark: SparkSession, d: str) -> DataFrame:
    """AG24: distinct items of a list in text (lines, bullets, semicolons, here also full stops), without placeholders."""
    items = F.transform(F.split(F.coalesce("text", F.lit("")), "[\\n;|•.]"), lambda x: F.trim(x))
    items = F.filter(items, lambda x: (F.length(x) >= 4) & ~F.lower(x).isin("n/a", "none", "aucun", "aucune"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.transform(items, lambda x: F.lower(x)))).cast("long").alias("items"))


@query(
    "benchmark_aggregation",
    """WITH t AS (SELECT lower(trim(substr(text, 1, 40))) AS title, min(item_id) AS item_id, count(*) AS runs, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark GROUP BY 1)
       SELECT title, item_id, runs, chars, round(100.0::DOUBLE * chars / sum(chars) OVER (), 4) AS share FROM t""",
)
def benchmark_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """AG25: runs with one title are one; sums and shares."""
    t = table(spark, d, "benchmark").groupBy(F.lower(F.trim(F.substring("text", 1, 40))).alias("title")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"))
    total = t.agg(F.sum("chars").alias("all")).withColumn("k", F.lit(1))
    return t.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("title", "item_id", "runs", "chars", F.round(100.0 * F.col("chars") / F.col("all"), 4).alias("share"))


@query("dashboard_overview", "SELECT p_brand AS req_type, count(*) AS n, round(avg(p_retailprice), 4) AS avg_value FROM part GROUP BY 1 ORDER BY n DESC, req_type LIMIT 15")
def dashboard_overview(spark: SparkSession, d: str) -> DataFrame:
    """AG26: the fifteen most frequent types."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("req_type")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_value")).orderBy(F.desc("n"), "req_type").limit(15)


@query(
    "scope_kpis",
    """WITH s AS (SELECT c_nationkey AS scope_id, substr(o_orderpriority, 1, 1) AS sev, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT n_name AS scope, count(*) AS checks, round(100.0::DOUBLE * count(*) FILTER (WHERE st = 'F') / count(*), 2) AS rate,
              4 * count(*) FILTER (WHERE sev = '1') + 3 * count(*) FILTER (WHERE sev = '2') + 2 * count(*) FILTER (WHERE sev = '3') + count(*) FILTER (WHERE sev > '3') AS risk
       FROM s JOIN nation ON scope_id = n_nationkey GROUP BY n_name""",
)
def scope_kpis(spark: SparkSession, d: str) -> DataFrame:
    """AG27: rate and weighted risk (4, 3, 2, 1) of each scope."""
    s = table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("sev"), F.col("o_orderstatus").alias("st"))
    s = s.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("checks"), F.count_if(F.col("st") == "F").alias("ok"), F.sum(F.when(F.col("sev") == "1", 4).when(F.col("sev") == "2", 3).when(F.col("sev") == "3", 2).otherwise(1)).alias("risk"))
    return s.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("scope"), "checks", F.round(100.0 * F.col("ok") / F.col("checks"), 2).alias("rate"), "risk")


@query(
    "monthly_gap_fill",
    """WITH m AS (SELECT strftime(unnest(generate_series(DATE '1997-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
       c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
       SELECT month, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, CASE WHEN coalesce(n, 0) > 0 THEN round(100.0::DOUBLE * ok / n, 2) ELSE 0 END AS rate FROM m LEFT JOIN c USING (month)""",
)
def monthly_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """AG28, DT6: twenty-four months up to the as-of month, months without rows as 0. The month grid has a fixed size and is broadcast."""
    m = spark.range(1).select(F.explode(F.sequence(F.lit("1997-01-01").cast("date"), F.lit(AS_OF).cast("date"), F.expr("interval 1 month"))).alias("x")).select(F.date_format("x", "yyyy-MM").alias("month"))
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    c = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    z = lambda x: F.coalesce(x, F.lit(0))
    return m.join(c, "month", "left").select("month", z("n").alias("n"), z("ok").alias("ok"), F.when(z("n") > 0, F.round(100.0 * F.col("ok") / F.col("n"), 2)).otherwise(0.0).alias("rate"))


@query("top_gaps", f"WITH {CHECKS_SQL} SELECT compliance_status, coalesce(severity, 'MINEURE') AS severity, count(*) AS n FROM checks WHERE compliance_status <> 'CONFORME' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
def top_gaps(spark: SparkSession, d: str) -> DataFrame:
    """AG29: the five most frequent kinds of gap."""
    c = checks(spark, d).filter("compliance_status <> 'CONFORME'").groupBy("compliance_status", F.coalesce("severity", F.lit("MINEURE")).alias("severity")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "compliance_status", "severity").limit(5)


@query(
    "domain_heatmap",
    """WITH s AS (SELECT r_name AS domain, substr(o_orderpriority, 1, 1) AS sev FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
       g AS (SELECT domain, count(*) FILTER (WHERE sev = '1') AS critical, count(*) FILTER (WHERE sev = '2') AS major, count(*) FILTER (WHERE sev = '3') AS minor, count(*) AS total FROM s GROUP BY domain)
       SELECT *, 4 * critical + 2 * major + minor AS risk, row_number() OVER (ORDER BY 4 * critical + 2 * major + minor DESC, critical DESC, total DESC, domain) AS place FROM g""",
)
def domain_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """AG30: domain by severity, placed by risk and three further keys."""
    o = table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("sev"))
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("domain"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "domain")
    n = lambda v: F.count_if(F.col("sev") == v)
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("domain").agg(n("1").alias("critical"), n("2").alias("major"), n("3").alias("minor"), F.count("*").alias("total"))
    g = g.withColumn("risk", 4 * F.col("critical") + 2 * F.col("major") + F.col("minor"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("risk"), F.desc("critical"), F.desc("total"), "domain")).cast("long"))


@query("domain_scores", f"WITH {CHECKS_SQL} SELECT coalesce(severity, 'GENERAL') AS domain, CAST(floor(avg(score) + 0.5) AS BIGINT) AS score, count(*) AS n FROM checks WHERE score IS NOT NULL GROUP BY 1 ORDER BY score DESC, domain LIMIT 6")
def domain_scores(spark: SparkSession, d: str) -> DataFrame:
    """AG31: mean score as a whole number (half up), the best six."""
    g = checks(spark, d).filter("score IS NOT NULL").groupBy(F.coalesce("severity", F.lit("GENERAL")).alias("domain")).agg(F.floor(F.avg("score") + 0.5).alias("score"), F.count("*").alias("n"))
    return g.orderBy(F.desc("score"), "domain").limit(6)


@query(
    "alerts",
    f"WITH {REQUIREMENTS_SQL}, {CHECKS_SQL} SELECT (SELECT count(*) FROM requirements WHERE status IN ('TO_VALIDATE', 'DRAFT')) AS pending, (SELECT count(*) FROM checks WHERE upper(severity) LIKE '%CRIT%' OR upper(severity) LIKE '%MAJEURE%') AS critical",
)
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """AG32: what waits for validation, and severe gaps."""
    s = F.upper("severity")
    a = requirements(spark, d).agg(F.count_if(F.col("status").isin("TO_VALIDATE", "DRAFT")).alias("pending")).withColumn("k", F.lit(1))
    b = checks(spark, d).agg(F.count_if(s.contains("CRIT") | s.contains("MAJEURE")).alias("critical")).withColumn("k", F.lit(1))
    return a.join(F.broadcast(b), "k").drop("k")


@query(
    "proof_progress",
    """WITH p AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS expected, count(*) FILTER (WHERE role = 'assistant' AND length(text) >= 200) AS found FROM conversations GROUP BY 1)
       SELECT conv_id, expected, found, greatest(0, expected - found) AS missing, CASE WHEN expected > 0 THEN round(least(1.0::DOUBLE, found * 1.0::DOUBLE / expected), 4) ELSE 0 END AS progress FROM p""",
)
def proof_progress(spark: SparkSession, d: str) -> DataFrame:
    """AG33: expected, found and missing proofs."""
    p = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("expected"), F.count_if((F.col("role") == "assistant") & (F.length("text") >= 200)).alias("found"))
    return p.select("conv_id", "expected", "found", F.greatest(F.lit(0), F.col("expected") - F.col("found")).alias("missing"), F.when(F.col("expected") > 0, F.round(F.least(F.lit(1.0), F.col("found") / F.col("expected")), 4)).otherwise(0.0).alias("progress"))


@query(
    "top_severity",
    f"""WITH {CHECKS_SQL} SELECT profile_id, CASE coalesce(max(CASE severity WHEN 'CRITIQUE' THEN 3 WHEN 'MAJEURE' THEN 2 WHEN 'MINEURE' THEN 1 END), max(CASE compliance_status WHEN 'NON_CONFORME' THEN 2 WHEN 'NON_EVALUE' THEN 1 ELSE 0 END))
        WHEN 3 THEN 'CRITIQUE' WHEN 2 THEN 'MAJEURE' WHEN 1 THEN 'MINEURE' ELSE 'AUCUNE' END AS severity, count(severity) AS gaps FROM checks GROUP BY profile_id""",
)
def top_severity(spark: SparkSession, d: str) -> DataFrame:
    """AG34: the highest severity of a row's gaps, from the status where there is none."""
    s = F.col("severity")
    rank = F.max(F.when(s == "CRITIQUE", 3).when(s == "MAJEURE", 2).when(s == "MINEURE", 1))
    other = F.max(F.when(F.col("compliance_status") == "NON_CONFORME", 2).when(F.col("compliance_status") == "NON_EVALUE", 1).otherwise(0))
    r = F.coalesce("r", "o")
    g = checks(spark, d).groupBy("profile_id").agg(rank.alias("r"), other.alias("o"), F.count("severity").alias("gaps"))
    return g.select("profile_id", F.when(r == 3, "CRITIQUE").when(r == 2, "MAJEURE").when(r == 1, "MINEURE").otherwise("AUCUNE").alias("severity"), "gaps")


ACTIONS_SQL = """actions AS (SELECT l_orderkey AS gap_id, l_linenumber AS action_no, CASE l_shipdate > TIMESTAMP '1998-06-01' WHEN TRUE THEN CASE WHEN l_linestatus = 'O' THEN 'PLANIFIEE' ELSE 'EN_COURS' END ELSE CASE WHEN l_returnflag = 'R' THEN 'ANNULEE' WHEN l_returnflag = 'A' THEN 'REALISEE' ELSE 'clôturée' END END AS state,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_shipdate END AS due FROM lineitem)"""


def actions(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz")
    state = F.when(late & (F.col("l_linestatus") == "O"), "PLANIFIEE").when(late, "EN_COURS").when(F.col("l_returnflag") == "R", "ANNULEE").when(F.col("l_returnflag") == "A", "REALISEE").otherwise("clôturée")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gap_id"), F.col("l_linenumber").alias("action_no"), state.alias("state"), F.when(F.col("l_tax") == 0, None).otherwise(F.col("l_shipdate")).alias("due"))


def folded_state():
    """State without accents, so that both spellings of the closed state are one."""
    return F.translate(F.upper("state"), "ÉÈÊÀÂÎÔÛÇ", "EEEAAIOUC")


@query("executive_summary", f"WITH {ACTIONS_SQL}, s AS (SELECT strip_accents(upper(state)) AS st FROM actions) SELECT count(*) FILTER (WHERE st IN ('PLANIFIEE', 'EN_COURS', 'A_FAIRE', 'OUVERTE')) AS open_actions, count(*) AS actions FROM s")
def executive_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG35: open actions by the list of open states."""
    return actions(spark, d).agg(F.count_if(folded_state().isin("PLANIFIEE", "EN_COURS", "A_FAIRE", "OUVERTE")).alias("open_actions"), F.count("*").alias("actions"))


@query(
    "action_plan_summary",
    f"WITH {ACTIONS_SQL}, s AS (SELECT strip_accents(upper(state)) AS st, due FROM actions) SELECT st AS state, count(*) AS n, count(*) FILTER (WHERE st NOT IN ('REALISEE', 'CLOTUREE', 'ANNULEE')) AS open, count(due) AS dated FROM s GROUP BY st",
)
def action_plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG36: open actions by exclusion of the closed states."""
    return actions(spark, d).groupBy(folded_state().alias("state")).agg(F.count("*").alias("n"), F.count_if(~folded_state().isin("REALISEE", "CLOTUREE", "ANNULEE")).alias("open"), F.count("due").alias("dated"))
