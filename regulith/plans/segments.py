"""Segmentation, order-dependent dedup and grouping over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import articles, citations, grouping, rewriting, segment
from ..registry import query, spread, table
from .postcall import stated
from .texts import LINES_SQL, lines


@query(
    "page_offsets",
    "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS end_char FROM conversations",
)
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    """SG1."""
    return segment.page_offsets(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start_char", "end_char")


def headed(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines have article headers: every third line, with a number that falls back at every seventh."""
    ls = F.split("text", "\n")
    body = F.array_join(F.transform(ls, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("Article "), F.when(i % 7 == 6, F.lit(1)).otherwise(i + 1).cast("string"), F.lit(" - "), x)).otherwise(x)), "\n")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", body.alias("text"))


ARTICLES_SQL = f"""{LINES_SQL}, h AS (SELECT doc_id, line_no, text, CASE WHEN (line_no - 1) % 3 = 0 THEN CASE WHEN (line_no - 1) % 7 = 6 THEN 1 ELSE line_no END END AS number FROM lines),
 o AS (SELECT *, max(number) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM h),
 a AS (SELECT *, sum(CASE WHEN number IS NOT NULL AND (seen IS NULL OR number >= seen) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS article_no FROM o),
 articles AS (SELECT doc_id, article_no, min(line_no) AS number, trim(string_agg(CASE WHEN number IS NULL THEN text ELSE 'Article ' || CAST(number AS VARCHAR) || ' - ' || text END, chr(10) ORDER BY line_no)) AS text FROM a GROUP BY 1, 2)"""


@query("article_split", f"WITH {ARTICLES_SQL} SELECT doc_id, CAST(article_no AS BIGINT) AS article_no, number, sha256(text) AS sha FROM articles WHERE length(text) >= 10")
def article_split(spark: SparkSession, d: str) -> DataFrame:
    """SG3, SG4: numbers that fall back open no article."""
    a = segment.split_articles(headed(spark, d))
    return a.select("doc_id", "article_no", F.col("number").cast("long").alias("number"), F.sha2(F.regexp_replace("text", r"^[ ]+|[ ]+$|\n$", ""), 256).alias("sha"))


@query("legal_articles")
def legal_articles(spark: SparkSession, d: str) -> DataFrame:
    """SG2, SG3, SG4, SG6: articles of whole documents with headers, trimmed and repaired (checked on each way an article ends)."""
    a = articles.articles(headed(spark, d))
    return a.select("doc_id", "act_title", "article_no", "header", "number", "start_char", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query("heading_of_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, last_value(CASE WHEN length(text) BETWEEN 1 AND 30 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM lines")
def heading_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """SG5: the last short line as heading."""
    return segment.heading_of(lines(spark, d), "doc_id", "line_no", F.when(F.length("text").between(1, 30), F.col("text"))).select("doc_id", "line_no", "heading")


@query("chunks")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """CH1, CH2, CH3 (tested: no chunk above the limit, all words covered in order)."""
    c = segment.with_overlap(segment.chunks(table(spark, d, "documents")), ["doc_id"])
    return c.select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.length("with_overlap").alias("n_overlap"), F.sha2("chunk", 256).alias("sha"))


@query("legal_units")
def legal_units(spark: SparkSession, d: str) -> DataFrame:
    """UN1, UN6: units by the way they were found, with their lengths."""
    u = segment.units(table(spark, d, "documents"))
    return u.groupBy("doc_id", "source").agg(F.count("*").alias("units"), F.max(F.length("unit")).alias("longest"), F.min(F.length("unit")).alias("shortest"))


@query(
    "data_rows",
    rf"""WITH {LINES_SQL}, r AS (SELECT doc_id, line_no, trim(regexp_replace(text, '^\s*(?:[-*•]|\d+[).])\s+', '')) AS raw FROM lines), s AS (SELECT doc_id, line_no, regexp_extract(raw, '^([^:|\t]{{2,80}}?)\s*[:|\t]\s*(.+)$', 1) AS label, regexp_extract(raw, '^([^:|\t]{{2,80}}?)\s*[:|\t]\s*(.+)$', 2) AS value FROM r)
        SELECT doc_id, line_no, label, regexp_extract(value, '-?\d+(?:[.,]\d+)?\s*(%|[\p{{L}}]+)', 1) AS unit FROM s WHERE label <> ''""",
)
def data_rows(spark: SparkSession, d: str) -> DataFrame:
    """LD1."""
    return segment.data_rows(table(spark, d, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "label", "unit")


@query("data_objects")
def data_objects(spark: SparkSession, d: str) -> DataFrame:
    """LD1: nested objects per document and kind."""
    return segment.data_objects(segment.data_rows(table(spark, d, "documents"))).select("doc_id", "kind", F.size("rows").alias("n"), F.element_at("rows", 1)["label"].alias("first_label"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter(F.length(F.trim("text")) > 0).select("doc_id", F.col("line_no").alias("seq"), "text", F.when(F.col("text").contains(","), "OBLIGATION").otherwise("CONDITION").alias("kind"))


def items() -> Column:
    """A document's lines with content as its statements, in its row."""
    every = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct((i + 1).cast("long").alias("seq"), F.when(t.contains(","), "OBLIGATION").otherwise("CONDITION").alias("kind"), t.alias("text"), F.when(F.length(t) > 200, "PROMOTED").when(F.length(t) > 80, "DRAFT").otherwise("TO_VALIDATE").alias("status"), F.round(F.least(F.length(t) / 500, F.lit(1.0)), 4).alias("confidence")))
    return F.filter(every, lambda x: F.length(F.trim(x["text"])) > 0)


@query("document_dedup")
def document_dedup(spark: SparkSession, d: str) -> DataFrame:
    """DD2, DD3, SIM7, SIM8."""
    return grouping.keep_first(spread(table(spark, d, "documents").select("doc_id", "text")), items())


@query("candidate_groups")
def candidate_groups(spark: SparkSession, d: str) -> DataFrame:
    """GR7."""
    return grouping.resolve_groups(spread(table(spark, d, "documents").select("doc_id", "text")), items())


@query("char_ratios")
def char_ratios(spark: SparkSession, d: str) -> DataFrame:
    """SIM4: ratio of neighbouring lines with content of a document, paired within its row."""
    lines_of = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.length(F.trim(t)) > 0)
    p = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", lines_of.alias("t")).filter(F.size("t") > 1)
    p = p.select("doc_id", F.posexplode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))).alias("pair_no", "p"))
    return p.select("doc_id", "pair_no", grouping.char_ratio("p.a", "p.b").alias("ratio"))


@query("subject_scores")
def subject_scores(spark: SparkSession, d: str) -> DataFrame:
    """GR3 over statements that the line items' keys choose (checked on each kind of statement)."""
    from .requirements import statements_of

    s = statements_of(spark, d).withColumn("score", grouping.subject_consistency("r", "other"))
    return s.groupBy("score", (F.col("score") >= 0.6).alias("consistent")).agg(F.count("*").alias("n"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    x = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n")[0].alias("requirement"), F.lit("").alias("snippet"), F.col("text").alias("chunk"))
    return citations.best_citation(x)


@query("grounding_verdicts")
def grounding_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """GR1: a document's first line as requirement, grounded in its text by the sentence that cites it best (checked on each verdict)."""
    g = _cited(spark, d).withColumn("g", grouping.grounding("requirement", "citation", "chunk"))
    return g.select("doc_id", "g.score", "g.verdict", F.array_join("g.reasons", ",").alias("reasons"))


@query("snippets")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """CF3: the part of a document that best cites its first line (checked against a plain loop)."""
    return _cited(spark, d).select("doc_id", F.col("citation").alias("snippet"), F.col("citation_score").alias("snippet_score"))


@query("statement_citations")
def statement_citations(spark: SparkSession, d: str) -> DataFrame:
    """CF3: statements cited from their source and chunk."""
    x = stated(spark, d).groupBy("requirement", "snippet", "chunk").agg(F.sum("n").alias("n"))
    return citations.best_citation(x).groupBy("citation", "citation_score").agg(F.sum("n").alias("n"))


@query("chained_statements")
def chained_statements(spark: SparkSession, d: str) -> DataFrame:
    """CF4: the actions of a statement under one subject, each a statement (checked on each kind of chain)."""
    x = stated(spark, d).groupBy("requirement").agg(F.sum("n").alias("n"))
    x = x.select("n", F.posexplode_outer(citations.chained_actions(F.col("requirement"))).alias("place", "statement"))
    return x.groupBy("place", "statement").agg(F.sum("n").alias("n")).filter("statement IS NOT NULL")


@query("unit_fallbacks")
def unit_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """CF5: what units without extracted statements fall back to, by cue: a norm that was left out, a supervisor that no statement names."""
    x = stated(spark, d).groupBy(F.concat("requirement", F.lit(" "), "snippet").alias("unit"), F.array("chunk").alias("existing")).agg(F.sum("n").alias("n"))
    # units are read once each: those with a statement that does not say it, and all
    bare = x.withColumn("covered", citations._here(citations.covered(F.col("existing")))).filter("NOT covered").groupBy("unit").agg(F.sum("n").alias("n")).withColumn("existing", F.array().cast("array<string>"))
    empty, missed = citations.empty_fallback(x.groupBy("unit").agg(F.sum("n").alias("n"))), citations.supervision_fallback(bare)
    both = empty.select(F.lit("EMPTY").alias("cue"), "fallback_text", "fallback_type", "n").unionByName(missed.select(F.lit("SUPERVISION").alias("cue"), "fallback_text", "fallback_type", "n"))
    return both.groupBy("cue", "fallback_type", "fallback_text").agg(F.sum("n").alias("n"))


@query("fixed_statements")
def fixed_statements(spark: SparkSession, d: str) -> DataFrame:
    """EM5, CF4, CF5: fixes of the error memory applied to statements."""
    s = statements(spark, d).withColumn("action", F.element_at(F.array(*map(F.lit, grouping.FIXES)), (F.col("seq") % len(grouping.FIXES)).cast("int") + 1))
    return grouping.apply_fixes(s).select("doc_id", "seq", "action", F.sha2("fixed", 256).alias("sha"))


@query("structure_review", f"WITH {LINES_SQL} SELECT contains(text, ',') AS has_condition, regexp_matches(text, '[.!?]$') AS has_end, count(*) AS n FROM lines GROUP BY 1, 2")
def structure_review(spark: SparkSession, d: str) -> DataFrame:
    """RV1: markers of a statement's structure."""
    return lines(spark, d).groupBy(F.col("text").contains(",").alias("has_condition"), F.col("text").rlike(r"[.!?]\z").alias("has_end")).agg(F.count("*").alias("n"))


@query("split_statements")
def split_statements(spark: SparkSession, d: str) -> DataFrame:
    """CF4: statements with several obligations, one row for each obligation, by the rule that split them (checked on each rule)."""
    x = stated(spark, d).groupBy("requirement", "kind").agg(F.sum("n").alias("n"))
    p = rewriting.split_statements(x).select("n", F.explode_outer("parts").alias("p"))
    return p.groupBy("p.rule", F.col("p.text").alias("statement")).agg(F.sum("n").alias("n")).filter("rule IS NOT NULL")
