"""Scalar functions, similarities, rule cascades and evidence over the tables' texts.

The cascades run with the test lexicon, whose words the tables hold; the
domain's own French rules are covered by the unit tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import AS_OF, CHECKS_SQL, REQUIREMENTS_SQL, checks, requirements
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import cascades as ca
from ..operators.ranking import first_per
from ..registry import query, spread, table
from ..rules import test_lexicon

LINES_SQL = """lines AS (SELECT doc_id, lang, source, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS text FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))"""


def lines(spark: SparkSession, d: str, deal=lambda x: x) -> DataFrame:
    """Lines of the documents as the register's texts; ``deal`` is what is done with the documents before."""
    x = deal(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")))
    return x.select("doc_id", "lang", "source", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("text"))


@query(
    "page_quality",
    r"""SELECT page_id, length(html) AS n, round(length(regexp_replace(html, '[^\p{L}]', '', 'g')) * 1.0::DOUBLE / length(html), 4) AS alpha, round(length(regexp_replace(html, '[^0-9]', '', 'g')) * 1.0::DOUBLE / length(html), 4) AS digit,
        round(length(regexp_replace(html, '[^ \n\t]', '', 'g')) * 1.0::DOUBLE / length(html), 4) AS space FROM pages""",
)
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """SRC3: shares of letters, digits and blanks of a page."""
    share = lambda p: F.round(F.length(F.regexp_replace("html", p, "")) / F.length("html"), 4)
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n"), share(r"[^\p{L}]").alias("alpha"), share("[^0-9]").alias("digit"), share("[^ \n\t]").alias("space"))


SUSPICIOUS_SQL = r"""raw AS (SELECT doc_id, line_no, source, CASE (doc_id + line_no) % 7 WHEN 1 THEN repeat(chr(61489), 50 + CAST(length(text) AS INT) % 100) WHEN 2 THEN repeat('* ', 70) WHEN 3 THEN '. - . - .' WHEN 4 THEN repeat('_', 60) ELSE text END AS text FROM lines),
 metrics AS (SELECT doc_id, line_no, source, length(text) AS n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 1.0::DOUBLE / greatest(length(text), 1) AS alpha, length(regexp_replace(text, '[^0-9]', '', 'g')) * 1.0::DOUBLE / greatest(length(text), 1) AS digit,
   (length(text) - length(replace(text, chr(61489), ''))) * 1.0::DOUBLE / greatest(length(text), 1) AS unmapped FROM raw),
 flags AS (SELECT *, CASE WHEN n = 0 THEN true WHEN n < 40 THEN alpha < 0.20 WHEN n < 120 THEN alpha <= 0.05 AND digit <= 0.35 ELSE unmapped >= 0.35 OR (alpha <= 0.01 AND digit <= 0.35) END AS suspicious FROM metrics)"""


def suspicious_text(text: str | Column) -> Column:
    """SRC4: an empty page, or one with few letters for its length, or with glyphs of unmapped fonts."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    share = lambda p: F.length(F.regexp_replace(text, p, "")) / F.greatest(n, F.lit(1))
    alpha, digit, unmapped = share(r"[^\p{L}]"), share("[^0-9]"), share("[^\ue000-\uf8ff]")
    return F.when(n == 0, True).when(n < 40, alpha < 0.20).when(n < 120, (alpha <= 0.05) & (digit <= 0.35)).otherwise((unmapped >= 0.35) | ((alpha <= 0.01) & (digit <= 0.35)))


def spoiled(text: Column, n: Column) -> Column:
    """Pages as a scan may spoil them, one way for each number."""
    r = lambda x, k: F.expr(f"repeat('{x}', {k})")
    return F.when(n % 7 == 1, F.expr("repeat('\uf031', 50 + length(text) % 100)")).when(n % 7 == 2, r("* ", 70)).when(n % 7 == 3, F.lit(". - . - .")).when(n % 7 == 4, r("_", 60)).otherwise(text)


def suspicious(spark: SparkSession, d: str) -> DataFrame:
    """SRC4 over lines as pages, some of them spoiled."""
    p = lines(spark, d).withColumn("text", spoiled(F.col("text"), F.col("doc_id") + F.col("line_no")))
    return p.select("doc_id", "line_no", "source", suspicious_text("text").alias("suspicious"))


@query("suspicious_pages", f"WITH {LINES_SQL}, {SUSPICIOUS_SQL} SELECT source, count(*) AS pages, count(*) FILTER (WHERE suspicious) AS suspicious FROM flags GROUP BY source")
def suspicious_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC4."""
    return suspicious(spark, d).groupBy("source").agg(F.count("*").alias("pages"), F.count_if("suspicious").alias("suspicious"))


@query("unreadable_documents", f"WITH {LINES_SQL}, {SUSPICIOUS_SQL} SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE suspicious) AS bad, count(*) FILTER (WHERE suspicious) >= ceil(0.60 * count(*)) AS unreadable FROM flags GROUP BY doc_id")
def unreadable_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRC5: a document fails if suspicious pages reach ceil(0.60 pages)."""
    g = suspicious(spark, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("suspicious").alias("bad"))
    return g.withColumn("unreadable", F.col("bad") >= F.ceil(F.lit(0.60).cast("decimal(3,2)") * F.col("pages")))


@query("ingest_dedup", "WITH known AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE source < 'src15') SELECT doc_id, sha256(text) AS sha, CASE WHEN sha256(text) IN (SELECT sha FROM known) THEN 'REUSE' ELSE 'INGEST' END AS decision FROM documents WHERE source >= 'src15'")
def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: what has been ingested (some sources) is reused by what comes in (the others), by digest of the content."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    known = docs.filter("source < 'src15'").select(F.col("sha").alias("k")).distinct()
    return docs.filter("source >= 'src15'").join(known, F.col("sha") == F.col("k"), "left").select("doc_id", "sha", F.when(F.col("k").isNotNull(), "REUSE").otherwise("INGEST").alias("decision"))


@query("scope_text_fold", "SELECT doc_id, sha256(trim(regexp_replace(strip_accents(lower(text)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS folded FROM documents")
def scope_text_fold(spark: SparkSession, d: str) -> DataFrame:
    """ST2, ST4."""
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.fold("text"), 256).alias("folded"))


@query("requirement_keys", f"WITH {LINES_SQL} SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(lower(text), '\\bl[''’]', '', 'g'), '[^\\p{{L}}0-9]+', ' ', 'g')) AS key FROM lines")
def requirement_keys(spark: SparkSession, d: str) -> DataFrame:
    """ST3."""
    return lines(spark, d).select("doc_id", "line_no", tx.requirement_key("text").alias("key"))


@query(
    "ocr_scores",
    r"""SELECT doc_id, 2 * len(regexp_extract_all(text, '[A-Za-z]\|[A-Za-z]')) + 2 * len(regexp_extract_all(text, '[A-Za-z][0-9]+[A-Za-z]')) + len(regexp_extract_all(text, '-\n')) + len(regexp_extract_all(text, '(?:^| )[b-df-hj-xzB-DF-HJ-XZ](?: |$)')) + len(regexp_extract_all(text, '[.,;:]{2,}')) AS score FROM documents""",
)
def ocr_scores(spark: SparkSession, d: str) -> DataFrame:
    """ST5."""
    return table(spark, d, "documents").select("doc_id", tx.ocr_score("text").cast("long").alias("score"))


@query("ocr_shares")
def ocr_shares(spark: SparkSession, d: str) -> DataFrame:
    """ST5: share of suspicious tokens and the heavy flag (a part said twice is a back reference, which the oracle's engine lacks)."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.ocr_share("text").alias("share"), tx.ocr_heavy("text").alias("heavy"))


@query("sanitized_text")
def sanitized_text(spark: SparkSession, d: str) -> DataFrame:
    """ST6 (its patterns look behind, which the oracle's engine does not)."""
    s = tx.sanitize("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length(s).cast("long").alias("n"), F.sha2(s, 256).alias("sha"))


@query("legal_normaliser")
def legal_normaliser(spark: SparkSession, d: str) -> DataFrame:
    """ST1 with NFKC first, and its counters."""
    n = tx.legal_normal("text", compose=True)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(n, 256).alias("sha"), tx.legal_counts("text", compose=True).alias("c")).select("doc_id", "sha", "c.*")


@query("html_text", r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS chars FROM pages""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """ST7: entities of a page's text decoded."""
    return table(spark, d, "pages").select("page_id", F.length(tx.spaces(tx.entities(F.regexp_replace("html", "<[^>]*>", " ")))).cast("long").alias("chars"))


@query("article_codes", r"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) || '-bis' WHEN p_size % 4 = 1 THEN '1' WHEN p_size % 4 = 2 THEN '6-' || CAST(p_size AS VARCHAR) ELSE '' END AS code FROM part""")
def article_codes(spark: SparkSession, d: str) -> DataFrame:
    """ST9 over labels made of part sizes."""
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    label = F.when(k == 0, F.concat(F.lit("Article "), n, F.lit(" (bis)"))).when(k == 1, "ARTICLE premier").when(k == 2, F.concat(F.lit("art. 6."), n)).otherwise("Annexe")
    return table(spark, d, "part").select("p_partkey", tx.article_code(label).alias("code"))


@query("import_coercions", "SELECT o_orderkey, o_custkey AS as_int, round(o_totalprice, 2) AS as_float, strftime(o_orderdate, '%Y-%m-%d') AS as_date, o_orderstatus = 'F' AS as_bool, o_orderpriority AS first_item FROM orders")
def import_coercions(spark: SparkSession, d: str) -> DataFrame:
    """ST10: typed values read back from text in the formats of the registers."""
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    raw = table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" no. "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("i"),
        F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")).alias("f"),
        form.alias("dt"),
        F.when(F.col("o_orderstatus") == "F", "Oui").otherwise("non").alias("b"),
        F.concat(F.col("o_orderpriority"), F.lit(" | ; , "), F.col("o_orderstatus")).alias("l"),
    )
    return raw.select("o_orderkey", tx.to_int("i").alias("as_int"), tx.to_float("f").alias("as_float"), F.date_format(tx.to_date("dt"), "yyyy-MM-dd").alias("as_date"), tx.to_bool("b").alias("as_bool"), F.element_at(tx.to_list("l"), 1).alias("first_item"))


@query("sentence_truncation", r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])(?:\s|$)', 1) ELSE substr(text, 1, 200) END AS head FROM documents")
def sentence_truncation(spark: SparkSession, d: str) -> DataFrame:
    """ST11."""
    return table(spark, d, "documents").select("doc_id", tx.truncate_sentence("text", 200).alias("head"))


@query("slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || ' 5%'), '%', 'pct', 'g'), '[^a-z0-9]+', '_', 'g') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """ST12, SRC9."""
    return table(spark, d, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand", F.lit("5%"))).alias("slug"))


@query("citations", "SELECT l_orderkey, l_linenumber, l_partkey, 'Art. ' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_tax = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN ', p. ' || CAST(l_linenumber AS VARCHAR) ELSE ', pp. ' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_linenumber + 2 AS VARCHAR) END AS citation FROM lineitem")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """ST13."""
    li = table(spark, d, "lineitem")
    first = F.when(F.col("l_tax") == 0, None).otherwise(F.col("l_linenumber"))
    last = F.when(F.col("l_suppkey") % 2 == 0, first).otherwise(first + 2)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", tx.citation(F.concat(F.lit("Art. "), F.col("l_partkey").cast("string")), first, last).alias("citation"))


# --- similarities -------------------------------------------------------------

PAIRS_SQL = r"""p AS (SELECT source, lang, doc_id, text, lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS other, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS other_id FROM documents),
 t AS (SELECT doc_id, other_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}0-9'']+')) AS a, list_distinct(regexp_extract_all(lower(other), '[\p{L}0-9'']+')) AS b FROM p WHERE other IS NOT NULL)"""
#: Words of a passage that make its key.
INNER = 7
STOP = ("the", "and", "der", "die", "und", "les", "des", "que", "los", "las")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring documents of a family and language. Only ids are put in order; texts follow by id."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    docs = table(spark, d, "documents")
    ids = docs.select("doc_id", F.lead("doc_id").over(w).alias("other_id")).filter("other_id IS NOT NULL")
    other = docs.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other"))
    return ids.join(docs.select("doc_id", "text"), "doc_id").join(other, "other_id").select("doc_id", "text", "other", "other_id")


@query("lexical_overlap", f"WITH {PAIRS_SQL} SELECT doc_id, other_id, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) * 1.0::DOUBLE / len(list_distinct(list_concat(a, b))), 4) END AS overlap FROM t")
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SIM1, SET3."""
    return pairs(spark, d).select("doc_id", "other_id", sim.jaccard(sim.tokens("text"), sim.tokens("other")).alias("overlap"))


@query(
    "content_overlap",
    f"""WITH {PAIRS_SQL}, c AS (SELECT doc_id, other_id, [x FOR x IN a IF length(x) >= 3 AND x NOT IN {STOP} AND NOT regexp_full_match(x, '[0-9]+')] AS a, [x FOR x IN b IF length(x) >= 3 AND x NOT IN {STOP} AND NOT regexp_full_match(x, '[0-9]+')] AS b FROM t)
        SELECT doc_id, other_id, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) * 1.0::DOUBLE / len(list_distinct(list_concat(a, b))), 4) END AS overlap FROM c""",
)
def content_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SIM2."""
    return pairs(spark, d).select("doc_id", "other_id", sim.jaccard(sim.content_tokens("text", STOP), sim.content_tokens("other", STOP)).alias("overlap"))


@query("token_containment", f"WITH {PAIRS_SQL} SELECT doc_id, other_id, CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) * 1.0::DOUBLE / least(len(a), len(b)), 4) END AS containment FROM t")
def token_containment(spark: SparkSession, d: str) -> DataFrame:
    """SIM3, QA5."""
    return pairs(spark, d).select("doc_id", "other_id", sim.containment(sim.tokens("text"), sim.tokens("other")).alias("containment"))


@query(
    "contamination",
    """WITH w AS (SELECT doc_id, lower(text) AS t FROM documents), b AS (SELECT item_id, lower(text) AS t FROM benchmark) SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc FROM b JOIN w ON contains(w.t, b.t) GROUP BY item_id""",
)
def contamination(spark: SparkSession, d: str) -> DataFrame:
    """SIM3's strictest case: documents that hold a reference passage word for word.

    Words are cut at non-letters. A passage's words but the first and the last, which may be parts of a document's words,
    stand whole in every document that holds it, so it is met by the hash of the first of these (INNER at most) at every
    word of a document. Only passages without such words, of two words at most, meet all documents.
    """
    b = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("b")).filter("b IS NOT NULL")
    w = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    words = lambda c: F.split(c, r"[^\p{L}]+")
    key = lambda ws, i, n: F.xxhash64(F.array_join(F.slice(ws, i, n), " "))
    b = b.withColumn("n", F.least(F.size(words("b")) - 2, F.lit(INNER)))
    lengths = sorted(r.n for r in b.select("n").distinct().collect())
    ws = F.col("ws")  # split once, not for every position
    at = lambda n: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: key(ws, i, n))).otherwise(F.array().cast("array<bigint>"))
    found = []
    if long := [n for n in lengths if n > 0]:
        keys = F.array_distinct(F.flatten(F.array(*[at(n) for n in long])))
        k = w.withColumn("ws", words("t")).select("doc_id", F.explode(keys).alias("key"))
        items = b.filter("n > 0").withColumn("key", key(words("b"), F.lit(2), F.col("n")))
        met = k.join(F.broadcast(items.select("key", "item_id", "b")), "key").select("doc_id", "item_id", "b")
        found.append(met.join(w, "doc_id").filter(F.contains("t", "b")).select("doc_id", "item_id"))
    if len(long) < len(lengths) or not lengths:
        found.append(w.join(F.broadcast(b.filter("n <= 0").select("item_id", "b")), F.contains("t", "b")).select("doc_id", "item_id"))
    return reduce(DataFrame.unionByName, found).groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


# --- cascades over lines ------------------------------------------------------


def _score_sql() -> tuple[str, str, str, str, str]:
    lex = test_lexicon
    cond = lambda p: f"regexp_matches(lower(text), '{p}')"
    up = " + ".join(f"CASE WHEN {cond(p)} THEN {w}::DOUBLE ELSE 0 END" for _, p, w in lex.NORMATIVE) + " + CASE WHEN contains(text, ':') AND contains(text, ';') THEN 0.1::DOUBLE ELSE 0 END"
    down = " + ".join(f"CASE WHEN {cond(p)} THEN {w}::DOUBLE ELSE 0 END" for _, p, w in lex.DESCRIPTIVE)
    strong = " OR ".join(cond(p) for n, p, _ in lex.NORMATIVE if n in lex.STRONG_NORMATIVE)
    effect = " OR ".join(cond(p) for n, p, _ in lex.NORMATIVE if n == "EFFECT_LEGAL")
    mixed = " OR ".join(cond(p) for n, p, _ in lex.DESCRIPTIVE if n in lex.MIXED_DESCRIPTIVE)
    return up, down, strong, effect, mixed


def _units_sql() -> str:
    up, down, strong, effect, mixed = _score_sql()
    return f"""{LINES_SQL}, s0 AS (SELECT *, {up} AS up, {down} AS down, ({strong}) AS strong, ({effect}) AS effect, ({mixed}) AS mixed FROM lines),
 s1 AS (SELECT *, round(1 / (1 + exp(-(up - down))), 4) AS score FROM s0),
 s2 AS (SELECT *, CASE WHEN down > 0 AND up <= 0 AND score < 0.32 THEN 'DROP' WHEN strong AND score >= 0.27 THEN 'HIGH' WHEN score >= 0.68 THEN 'HIGH' WHEN score >= 0.32 THEN 'LOW' ELSE 'DROP' END AS base FROM s1),
 units AS (SELECT doc_id, line_no, lang, source, text, CASE WHEN trim(text) = '' THEN 'DROP' WHEN base = 'DROP' AND effect AND mixed AND (score >= 0.24 OR up >= 0.9) THEN 'LOW' ELSE base END AS priority, CASE WHEN trim(text) = '' THEN 0 ELSE score END AS score, strong AND trim(text) <> '' AS strong FROM s2)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    return ca.classify_units(lines(spark, d, spread), out="u", lex=test_lexicon).select("doc_id", "line_no", "lang", "source", "text", "u.priority", "u.score", "u.strong", "u.rules")


@query("unit_classes", f"WITH {_units_sql()} SELECT doc_id, line_no, priority, score, strong FROM units")
def unit_classes(spark: SparkSession, d: str) -> DataFrame:
    """UN2 with the test lexicon."""
    return units(spark, d).select("doc_id", "line_no", "priority", "score", "strong")


@query("unit_rules")
def unit_rules(spark: SparkSession, d: str) -> DataFrame:
    """UN2: how often each rule hits."""
    return units(spark, d).select(F.explode("rules").alias("rule"), "priority").groupBy("rule", "priority").agg(F.count("*").alias("n"))


@query(
    "skip_decisions",
    f"""WITH {_units_sql()} SELECT source, count(*) FILTER (WHERE NOT risky AND priority = 'DROP') AS skipped, count(*) FILTER (WHERE risky) AS kept_risk, count(*) FILTER (WHERE NOT risky AND priority <> 'DROP') AS kept
        FROM (SELECT *, contains(lower(text), 'license') AS risky FROM units) GROUP BY source""",
)
def skip_decisions(spark: SparkSession, d: str) -> DataFrame:
    """UN3 in conservative mode; a risk marker keeps a unit."""
    s = ca.skip_unit("CONSERVATIVE", F.col("priority"), F.lower("text").contains("license"))
    n = lambda v: F.count_if(F.col("s") == v)
    return units(spark, d).withColumn("s", s).groupBy("source").agg(n("SKIP").alias("skipped"), n("KEEP_RISK").alias("kept_risk"), n("KEEP").alias("kept"))


@query("fallback_units", f"WITH {_units_sql()}, has AS (SELECT DISTINCT doc_id FROM units WHERE priority = 'HIGH') SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM has) AND length(text) >= 140")
def fallback_units(spark: SparkSession, d: str) -> DataFrame:
    """UN7: documents of 140 characters or more from which no unit survives are sent whole."""
    has = units(spark, d).filter("priority = 'HIGH'").select("doc_id").distinct()
    return table(spark, d, "documents").join(has, "doc_id", "left_anti").filter(F.length("text") >= 140).select("doc_id", F.length("text").cast("long").alias("n"))


@query(
    "unit_dedup",
    f"WITH {LINES_SQL}, k AS (SELECT doc_id, line_no, source, lower(trim(text)) AS key FROM lines WHERE length(trim(text)) >= 20) SELECT source, sha256(key) AS key, min(struct_pack(d := doc_id, l := line_no)).d AS doc_id, min(struct_pack(d := doc_id, l := line_no)).l AS line_no, count(*) AS n FROM k GROUP BY source, key",
)
def unit_dedup(spark: SparkSession, d: str) -> DataFrame:
    """UN4, DD1, DD3 (exact key): first occurrence of a unit per scope and normalised text."""
    k = lines(spark, d).filter(F.length(F.trim("text")) >= 20)
    g = k.groupBy("source", F.sha2(F.lower(F.trim("text")), 256).alias("key")).agg(F.min(F.struct("doc_id", "line_no")).alias("x"), F.count("*").alias("n"))
    return g.select("source", "key", "x.doc_id", "x.line_no", "n")


@query(
    "budget_guard",
    "SELECT doc_id, source, spent FROM (SELECT doc_id, source, CAST(sum(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM documents) WHERE spent <= 20000",
)
def budget_guard(spark: SparkSession, d: str) -> DataFrame:
    """UN5, MA6: calls of a family while its token budget lasts. Sums run within stretches of ids, on top of the sums of the stretches before."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 4).alias("cost"), F.floor(F.col("doc_id") / 4096).alias("stretch"))
    before = Window.partitionBy("source").orderBy("stretch")
    sums = docs.groupBy("source", "stretch").agg(F.sum("cost").alias("cost"))
    sums = sums.select("source", "stretch", (F.sum("cost").over(before) - F.col("cost")).alias("before")).filter("before <= 20000")
    inside = Window.partitionBy("source", "stretch").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return docs.join(sums, ["source", "stretch"]).select("doc_id", "source", (F.col("before") + F.sum("cost").over(inside)).alias("spent")).filter("spent <= 20000")


@query(
    "confidence_heuristic",
    f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, text, round(least(0.97, greatest(0.20, 0.58::DOUBLE + CASE WHEN length(text) >= 80 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{test_lexicon.NORMATIVE[0][1]}') THEN 0.18::DOUBLE ELSE 0 END
          + CASE WHEN length(text) < 25 THEN -0.25::DOUBLE ELSE 0 END + CASE WHEN contains(text, '|') THEN -0.1::DOUBLE ELSE 0 END)), 2) AS confidence FROM lines)
        SELECT doc_id, line_no, confidence, CASE WHEN contains(text, '|') THEN 'TO_VALIDATE' WHEN length(text) > 2000 THEN 'TO_VALIDATE' WHEN confidence >= 0.86 THEN 'DRAFT' ELSE 'TO_VALIDATE' END AS status FROM c""",
)
def confidence_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """CF1, CF2 with the test lexicon."""
    t = F.col("text")
    conf = ca.confidence([(F.length(t) >= 80, 0.12), (ca.hit(F.lower(t), test_lexicon.NORMATIVE[0][1]), 0.18), (F.length(t) < 25, -0.25), (t.contains("|"), -0.1)])
    return lines(spark, d).select("doc_id", "line_no", conf.alias("confidence"), ca.status_of(conf, [t.contains("|"), F.length(t) > 2000]).alias("status"))


@query(
    "completeness_scores",
    f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no, NOT contains(text, ',') AS c, NOT regexp_matches(text, '[.!?]$') AS t, length(text) < 40 AS o, length(text) > 900 AS f FROM lines)
        SELECT doc_id, line_no, round(least(1, greatest(0, 1 - (CASE WHEN c THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN o THEN 0.42::DOUBLE ELSE 0 END + CASE WHEN t THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN f THEN 0.22::DOUBLE ELSE 0 END))), 4) AS score,
               CASE CAST(c AS INT) + CAST(o AS INT) + CAST(t AS INT) WHEN 0 THEN 'PASS' WHEN 1 THEN 'SOFT' ELSE 'HARD' END AS decision FROM m""",
)
def completeness_scores(spark: SparkSession, d: str) -> DataFrame:
    """GR2."""
    t = F.col("text")
    s = ca.completeness({"condition": ~t.contains(","), "object": F.length(t) < 40, "tail": ~t.rlike(r"[.!?]\z")}, F.length(t) > 900)
    return lines(spark, d).select("doc_id", "line_no", s.alias("s")).select("doc_id", "line_no", "s.*")


@query(
    "quality_scores",
    f"""WITH {REQUIREMENTS_SQL}, q AS (SELECT requirement_id, article_id, profile_id, least(1, greatest(0, 0.22::DOUBLE * confidence + 0.30::DOUBLE * (page / 50) + 0.18::DOUBLE * CASE WHEN req_type = 'CONDITION' THEN 0.6::DOUBLE ELSE 1 END + 0.18::DOUBLE * (article_id % 10 / 10.0::DOUBLE) + 0.12::DOUBLE * 0.85::DOUBLE - CASE WHEN status = 'TO_VALIDATE' THEN 0.05::DOUBLE ELSE 0 END)) AS raw FROM requirements)
        SELECT CASE WHEN round(raw, 4) >= 0.78 THEN 'DRAFT' WHEN round(raw, 4) >= 0.50 THEN 'TO_VALIDATE' ELSE 'REJECT' END AS decision, count(*) AS n, round(avg(raw), 3) AS mean FROM q GROUP BY 1""",
)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """GR4."""
    q = ca.quality(F.col("confidence"), F.col("page") / 50, F.when(F.col("req_type") == "CONDITION", 0.6).otherwise(1.0), F.col("article_id") % 10 / 10, F.lit(0.85), F.when(F.col("status") == "TO_VALIDATE", 0.05).otherwise(0.0))
    return requirements(spark, d).select(q.alias("q")).groupBy("q.decision").agg(F.count("*").alias("n"), F.round(F.avg("q.score"), 3).alias("mean"))


@query("risk_scores", f"WITH {REQUIREMENTS_SQL} SELECT round(least(1, CASE WHEN domain = 'SST' THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN req_type = 'INTERDICTION' THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN confidence < 0.3 THEN 0.3::DOUBLE ELSE 0 END), 4) AS risk, count(*) AS n FROM requirements GROUP BY 1")
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """GR5."""
    r = ca.risk([(F.coalesce(F.col("domain") == "SST", F.lit(False)), 0.45), (F.coalesce(F.col("req_type") == "INTERDICTION", F.lit(False)), 0.4), (F.col("confidence") < 0.3, 0.3)])
    return requirements(spark, d).groupBy(r.alias("risk")).agg(F.count("*").alias("n"))


@query(
    "promotion_decisions",
    f"""WITH {REQUIREMENTS_SQL}, p AS (SELECT status, CASE WHEN coalesce(req_type, 'AUTRE') NOT IN ('OBLIGATION', 'INTERDICTION', 'CONDITION', 'EXCEPTION', 'DECLARATION', 'REGISTRE') THEN 'TYPE_NOT_ALLOWED' WHEN confidence < 0.2 THEN 'LOW_CONFIDENCE' WHEN page < 5 THEN 'SHORT_TEXT' WHEN domain IS NULL THEN 'NO_DOMAIN' ELSE 'PROMOTED' END AS reason FROM requirements)
        SELECT CASE WHEN reason = 'PROMOTED' THEN 'DRAFT' ELSE status END AS status, reason, count(*) AS n FROM p GROUP BY 1, 2""",
)
def promotion_decisions(spark: SparkSession, d: str) -> DataFrame:
    """PR1: the first blocker counts."""
    p = ca.promotion(F.col("status"), F.coalesce("req_type", F.lit("AUTRE")), [(F.col("confidence") < 0.2, "LOW_CONFIDENCE"), (F.col("page") < 5, "SHORT_TEXT"), (F.col("domain").isNull(), "NO_DOMAIN")])
    return requirements(spark, d).select(p.alias("p")).groupBy("p.status", "p.reason").agg(F.count("*").alias("n"))


@query(
    "trigger_signatures",
    f"WITH {LINES_SQL}, t AS (SELECT lang, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS t FROM lines) SELECT lang || '|' || array_to_string(list_slice(string_split(t, ' '), 1, 3), ' ') AS signature, count(*) AS n, count(DISTINCT lang || '|' || substr(t, 1, 220)) AS keys FROM t GROUP BY 1",
)
def trigger_signatures(spark: SparkSession, d: str) -> DataFrame:
    """EM1: exact keys behind each signature."""
    k = lines(spark, d).select(ca.trigger_keys(F.col("lang"), F.col("text")).alias("k"))
    return k.groupBy("k.signature").agg(F.count("*").alias("n"), F.countDistinct("k.exact").alias("keys"))


@query(
    "feedback_signals",
    "WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'REJECT' WHEN 'click' THEN 'EDIT' WHEN 'view' THEN 'FLAG' ELSE 'APPROVE' END AS decision FROM events) SELECT decision, CASE WHEN decision IN ('EDIT', 'REJECT') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS n FROM f WHERE decision <> 'APPROVE' GROUP BY 1, 2",
)
def feedback_signals(spark: SparkSession, d: str) -> DataFrame:
    """EM4."""
    e = F.col("event_type")
    dec = F.when(e == "error", "REJECT").when(e == "click", "EDIT").when(e == "view", "FLAG").otherwise("APPROVE")
    f = table(spark, d, "events").select(dec.alias("decision")).withColumn("s", ca.feedback(F.col("decision"))).filter("s IS NOT NULL")
    return f.groupBy("decision", F.col("s.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(
    "deterministic_rules",
    """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2000 END AS low, CASE WHEN c_custkey % 3 = 1 THEN 5000 END AS high, CAST(floor(c_acctbal) AS BIGINT) AS n FROM customer)
       SELECT c_custkey, CASE WHEN n < low OR n > high THEN 'NON_APPLICABLE' ELSE 'APPLICABLE' END AS status, CASE WHEN low IS NOT NULL THEN 0.96::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM x WHERE low IS NOT NULL OR high IS NOT NULL""",
)
def deterministic_rules(spark: SparkSession, d: str) -> DataFrame:
    """RU1: rules that decide without a model; rows that no rule decides go to the provider."""
    k, n = F.col("c_custkey") % 3, F.floor("c_acctbal")
    r = ca.headcount_rule(F.when(k == 0, 2000), F.when(k == 1, 5000), n)
    return table(spark, d, "customer").select("c_custkey", r.alias("r")).filter("r IS NOT NULL").select("c_custkey", "r.status", "r.confidence")


@query(
    "gated_decisions",
    f"""WITH {REQUIREMENTS_SQL}, g AS (SELECT CASE WHEN domain IS NULL OR confidence < CASE req_type WHEN 'INTERDICTION' THEN 0.5 ELSE 0.3 END THEN 'INCERTAIN' WHEN created_at > TIMESTAMP '{AS_OF}' THEN 'APPLICABLE_FUTUR' ELSE 'APPLICABLE' END AS status,
          CASE WHEN domain IS NULL OR confidence < CASE req_type WHEN 'INTERDICTION' THEN 0.5 ELSE 0.3 END THEN least(confidence, 0.55) ELSE confidence END AS c FROM requirements) SELECT status, count(*) AS n, round(avg(c), 4) AS confidence FROM g GROUP BY status""",
)
def gated_decisions(spark: SparkSession, d: str) -> DataFrame:
    """RU2, RU3, AG19: uncertain below the floor of its type, of the future after the as-of day."""
    floor = F.when(F.col("req_type") == "INTERDICTION", 0.5).otherwise(0.3)
    g = requirements(spark, d).withColumn("g", ca.quality_gate(F.lit("APPLICABLE"), F.col("confidence"), F.col("domain").isNull(), floor))
    g = g.select(ca.future_gate(F.col("g.status"), F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz")).alias("status"), F.col("g.confidence").alias("c"))
    return g.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("c"), 4).alias("confidence"))


@query(
    "gap_severities",
    f"""WITH {REQUIREMENTS_SQL}, s AS (SELECT *, CASE WHEN req_type = 'INTERDICTION' THEN 'IMPERATIF' WHEN req_type = 'CONDITION' THEN 'CONDITIONNEL' WHEN req_type = 'OBLIGATION' THEN 'IMPERATIF' ELSE 'NON_PRECISE' END AS strength FROM requirements),
        p AS (SELECT CASE strength WHEN 'IMPERATIF' THEN 3 WHEN 'CONDITIONNEL' THEN 1 ELSE 0 END + CASE req_type WHEN 'INTERDICTION' THEN 3 WHEN 'OBLIGATION' THEN 2 ELSE 0 END + CASE WHEN domain = 'SST' THEN 2 ELSE 0 END + CASE WHEN page > 40 THEN 2 ELSE 0 END + CASE WHEN date_diff('day', CAST(created_at AS DATE), DATE '{AS_OF}') > 365 THEN 1 ELSE 0 END AS points FROM s)
        SELECT points, CASE WHEN points >= 7 THEN 'CRITIQUE' WHEN points >= 4 THEN 'MAJEURE' ELSE 'MINEURE' END AS severity, CASE WHEN points >= 7 THEN 'URGENTE' ELSE 'HAUTE' END AS priority, count(*) AS n FROM p GROUP BY 1, 2, 3""",
)
def gap_severities(spark: SparkSession, d: str) -> DataFrame:
    """PO1, PO2, PO3 (the given priority is HAUTE)."""
    r = requirements(spark, d)
    strength = ca.normative_strength(F.col("req_type"), F.lit(""), "peut", "si", "doit")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("created_at").cast("date"))
    g = r.select(ca.gap_severity(strength, F.col("req_type"), F.col("domain"), F.col("page") > 40, age).alias("g")).select("g.points", "g.severity")
    return g.withColumn("priority", ca.merged_priority(F.lit("HAUTE"), F.col("severity"))).groupBy("points", "severity", "priority").agg(F.count("*").alias("n"))


@query(
    "evidence_age_policy",
    f"""WITH e AS (SELECT o_custkey AS id, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age FROM orders), x AS (SELECT id, min(age) > 730 AS only_expired FROM e GROUP BY id), {CHECKS_SQL}
        SELECT CASE WHEN only_expired AND compliance_status = 'CONFORME' THEN 'PARTIELLEMENT_CONFORME' ELSE compliance_status END AS status, count(*) AS n, round(avg(CASE WHEN only_expired AND compliance_status = 'CONFORME' THEN least(coalesce(score, 0) / 100, 0.59) ELSE coalesce(score, 0) / 100 END), 4) AS score
        FROM checks JOIN x ON profile_id = id GROUP BY 1""",
)
def evidence_age_policy(spark: SparkSession, d: str) -> DataFrame:
    """PO4."""
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.min(F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date"))) > 730).alias("only_expired"))
    p = checks(spark, d).join(e, F.col("profile_id") == F.col("id")).select(ca.age_policy(F.col("compliance_status"), F.coalesce("score", F.lit(0.0)) / 100, F.col("only_expired")).alias("p"))
    return p.groupBy("p.status").agg(F.count("*").alias("n"), F.round(F.avg("p.score"), 4).alias("score"))


@query(
    "search_terms",
    r"""WITH t AS (SELECT item_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[\p{L}0-9]{4,}') IF x NOT IN ('with', 'from', 'this', 'that') AND NOT regexp_full_match(x, '[0-9]+')]) AS s, regexp_extract_all(lower(text), '[\p{L}0-9]{4,}') AS w FROM benchmark)
        SELECT item_id, len(s) AS distinct_terms, least(12, len(s)) AS used FROM t""",
)
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """EV1: words of four characters or more that are no stop words or numbers, the first twelve."""
    t = evidence_terms(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("distinct_terms"), F.size(F.slice(t, 1, 12)).cast("long").alias("used"))


def evidence_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}0-9]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("with", "from", "this", "that") & ~x.rlike("^[0-9]+$")))


@query(
    "best_excerpt",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM lines), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM p WHERE text <> ''),
        s AS (SELECT doc_id, place, text, len([w FOR w IN ['the', 'der', 'les', 'los', 'license'] IF contains(lower(text), w)]) + least(length(text) // 300, 2) AS score FROM n WHERE place <= 20)
        SELECT doc_id, place, substr(text, 1, 420) AS excerpt, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rn FROM s) WHERE rn = 1""",
)
def best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """EV2: the best of the first twenty paragraphs by term hits and whole steps of 300 characters, the first of equals, within the row."""
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))  # the tables' lines stand as paragraphs
    b = table(spark, d, "documents").select("doc_id", excerpt(paragraphs, ("the", "der", "les", "los", "license")).alias("x"))
    return b.filter("x IS NOT NULL").select("doc_id", "x.place", "x.excerpt", "x.score")


def excerpt(text: Column, terms: tuple[str, ...], most: int = 420) -> Column:
    """EV2: ``struct<place, excerpt, score>`` of the paragraph between blank lines that fits the terms best; null without any."""
    parts = F.slice(F.filter(F.transform(F.split(text, r"\n\s*\n"), tx.spaces), lambda x: x != ""), 1, 20)
    hits = lambda x: sum((F.when(F.lower(x).contains(w), 1).otherwise(0) for w in terms[1:]), F.when(F.lower(x).contains(terms[0]), 1).otherwise(0))
    scored = F.transform(parts, lambda x, i: F.struct((hits(x) + F.least(F.floor(F.length(x) / 300), F.lit(2))).alias("score"), (-i).alias("back"), F.substring(x, 1, most).alias("excerpt")))
    best = F.array_max(scored)
    return F.when(F.size(parts) > 0, F.struct((1 - best["back"]).cast("long").alias("place"), best["excerpt"].alias("excerpt"), best["score"].alias("score")))


@query(
    "evidence_scores",
    """SELECT req, evidence, score FROM (SELECT s_suppkey AS req, c_custkey AS evidence, CASE WHEN s_suppkey = c_custkey THEN 10 ELSE 0 END + 6 + CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END AS score,
       row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE WHEN s_suppkey = c_custkey THEN 10 ELSE 0 END + 6 + CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END DESC, c_custkey) AS rn FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE rn <= 5""",
)
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV3: +10 for the same requirement, +6 for the same scope, +2 for the organisation; five best."""
    from ..operators.ranking import top_per

    # of a scope's evidence only its five best, and the requirement's own, can be among a requirement's five best
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("evidence"), F.col("c_nationkey").alias("scope"), F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(0).alias("more"))
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("req"), F.col("s_nationkey").alias("scope"))
    best = top_per(c, ["scope"], [F.desc("more"), F.col("evidence")], 5).drop("place")
    own = r.join(c.withColumnRenamed("scope", "at"), (F.col("req") == F.col("evidence")) & (F.col("scope") == F.col("at"))).drop("at", "scope")
    j = r.join(best, "scope").select("req", "evidence", "more").unionByName(own.select("req", "evidence", "more")).distinct()
    j = j.select("req", "evidence", (F.when(F.col("req") == F.col("evidence"), 10).otherwise(0) + 6 + F.col("more")).alias("score"))
    return top_per(j, ["req"], [F.desc("score"), F.col("evidence")], 5).drop("place")


@query(
    "question_depths",
    r"SELECT CASE WHEN regexp_matches(lower(text), '\b(article|loi|art\.)\s*\d+') OR len(regexp_split_to_array(trim(text), '\s+')) <= 6 THEN 4 ELSE 12 END AS k, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
)
def question_depths(spark: SparkSession, d: str) -> DataFrame:
    """QA1."""
    return table(spark, d, "conversations").filter("role = 'user'").groupBy(ca.question_depth(F.col("text")).alias("k")).agg(F.count("*").alias("n"))


INTENTS = tuple((n, test_lexicon.W.format(p)) for n, p in (("COMPLIANCE_RATE", "the|la"), ("NC_COUNT", "und|et"), ("MISSING_PROOF", "of|de")))


@query(
    "kpi_answers",
    rf"""WITH i AS (SELECT CASE WHEN regexp_matches(lower(text), '{INTENTS[0][1]}') THEN 'COMPLIANCE_RATE' WHEN regexp_matches(lower(text), '{INTENTS[1][1]}') THEN 'NC_COUNT' WHEN regexp_matches(lower(text), '{INTENTS[2][1]}') THEN 'MISSING_PROOF' END AS intent FROM conversations WHERE role = 'user'), {CHECKS_SQL},
        k AS (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE compliance_status = 'CONFORME') / count(*), 2) AS rate, count(*) FILTER (WHERE compliance_status = 'NON_CONFORME') AS nc, count(*) FILTER (WHERE severity IS NULL) AS missing FROM checks)
        SELECT intent, count(*) AS questions, max(CASE intent WHEN 'COMPLIANCE_RATE' THEN rate WHEN 'NC_COUNT' THEN nc WHEN 'MISSING_PROOF' THEN missing END) AS answer FROM i, k GROUP BY intent""",
)
def kpi_answers(spark: SparkSession, d: str) -> DataFrame:
    """QA2, QA3: intents answered from one row of figures; other questions have no figure."""
    i = table(spark, d, "conversations").filter("role = 'user'").select(ca.kpi_intent(F.col("text"), INTENTS).alias("intent")).groupBy("intent").agg(F.count("*").alias("questions")).withColumn("k", F.lit(1))
    s = F.col("compliance_status")
    k = checks(spark, d).agg(F.round(100.0 * F.count_if(s == "CONFORME") / F.count("*"), 2).alias("rate"), F.count_if(s == "NON_CONFORME").cast("double").alias("nc"), F.count_if(F.col("severity").isNull()).cast("double").alias("missing")).withColumn("k", F.lit(1))
    a = F.when(F.col("intent") == "COMPLIANCE_RATE", F.col("rate")).when(F.col("intent") == "NC_COUNT", F.col("nc")).when(F.col("intent") == "MISSING_PROOF", F.col("missing"))
    return i.join(F.broadcast(k), "k").select("intent", "questions", a.alias("answer"))


@query(
    "missing_proof_answer",
    f"""WITH {CHECKS_SQL}, a AS (SELECT 1 AS part, check_id AS id FROM checks WHERE compliance_status = 'NON_EVALUE' ORDER BY check_id LIMIT 5), b AS (SELECT 2 AS part, check_id AS id FROM checks WHERE severity = 'CRITIQUE' ORDER BY check_id LIMIT 5)
        SELECT part, id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY part, id LIMIT 5""",
)
def missing_proof_answer(spark: SparkSession, d: str) -> DataFrame:
    """QA4: rows of checks, then of gaps, the first five."""
    c = checks(spark, d)
    part = lambda n, cond: c.filter(cond).select(F.lit(n).alias("part"), F.col("check_id").alias("id")).orderBy("id").limit(5)
    return part(1, "compliance_status = 'NON_EVALUE'").union(part(2, "severity = 'CRITIQUE'")).orderBy("part", "id").limit(5)


@query(
    "site_match",
    r"""WITH q AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}0-9'']+')) AS w FROM conversations WHERE role = 'user'), s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}0-9'']+')) AS w FROM benchmark),
        j AS (SELECT conv_id, turn, item_id, len(list_intersect(q.w, s.w)) AS n FROM q, s) SELECT conv_id, turn, arg_min(item_id, struct_pack(a := -n, b := item_id)) AS site, max(n) AS shared FROM j WHERE n > 0 GROUP BY 1, 2""",
)
def site_match(spark: SparkSession, d: str) -> DataFrame:
    """QA6: the site whose words the question shares most, the first of equals, none without any. Words meet words in an equi join."""
    q = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(sim.tokens("text")).alias("w"))
    s = table(spark, d, "benchmark").select("item_id", F.explode(sim.tokens("text")).alias("w"))
    j = q.join(s, "w").groupBy("conv_id", "turn", "item_id").agg(F.count("*").alias("n"))
    return j.groupBy("conv_id", "turn").agg(F.max_by("item_id", F.struct("n", -F.col("item_id"))).alias("site"), F.max("n").alias("shared"))


@query("rag_chunks", "SELECT doc_id, sha256('[' || source || '] [' || lang || '] ' || text) AS chunk FROM documents")
def rag_chunks(spark: SparkSession, d: str) -> DataFrame:
    """QA7."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("["), "source", F.lit("] ["), "lang", F.lit("] "), "text"), 256).alias("chunk"))


@query("log_errors", "SELECT CASE WHEN props LIKE '%42%' OR props LIKE '%29%' THEN 'QUOTA' ELSE 'UNKNOWN' END AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def log_errors(spark: SparkSession, d: str) -> DataFrame:
    """JB2: class of an error's text, here over a log line made of the event."""
    p = F.col("props")
    log = F.when(p.contains("42") | p.contains("29"), F.concat(F.lit("HTTP 429 rate limit "), p)).otherwise(F.concat(F.lit("oops "), F.col("event_type")))
    return table(spark, d, "events").filter("event_type = 'error'").groupBy(ca.log_error(log).alias("error")).agg(F.count("*").alias("n"))


@query("distinct_strings", "SELECT user_id, len(list_distinct([lower(trim(x)) FOR x IN [event_type, upper(event_type), CAST(event_id % 3 AS VARCHAR), ' ' || event_type || ' ']])) AS n, event_id FROM events")
def distinct_strings(spark: SparkSession, d: str) -> DataFrame:
    """AR1: blind to case, in order."""
    x = F.array("event_type", F.upper("event_type"), (F.col("event_id") % 3).cast("string"), F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return table(spark, d, "events").select("user_id", "event_id", F.size(tx.distinct_strings(x, 10)).cast("long").alias("n"))


@query("canonical_hash", "SELECT o_orderkey, sha256('{\"custkey\":' || CAST(o_custkey AS VARCHAR) || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS h FROM orders")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """HA2: digest of JSON with sorted keys."""
    j = F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(j, 256).alias("h"))


@query("fenced_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """JS1: a model's answer with code fences around its JSON."""
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), "props", F.lit(" Done.")))
    return table(spark, d, "events").select("event_id", F.get_json_object(tx.clean_json(answer), "$.k").cast("long").alias("k"))


@query("effective_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS effective, CASE o_orderkey % 3 WHEN 0 THEN 3 * 30 WHEN 1 THEN 2 * 365 ELSE 15 END AS delay FROM orders")
def effective_dates(spark: SparkSession, d: str) -> DataFrame:
    """DT1, DT2: dates and delays read from sentences."""
    from ..rules.fr import MONTHS

    k = F.col("o_orderkey") % 3
    when = F.when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate").cast("string")))
    text = F.concat(F.lit("Entre en vigueur le "), when, F.lit(" dans un délai de "), F.when(k == 0, "3 mois").when(k == 1, "2 ans").otherwise("15 jours"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(tx.effective_date(text, MONTHS), "yyyy-MM-dd").alias("effective"), tx.delay_days(text).alias("delay"))


@query("document_gate")
def document_gate(spark: SparkSession, d: str) -> DataFrame:
    """DG1, DG3 with the domain's rules: policy of each document by its first line, its text, and its number of lines (checked on the golden cases)."""
    t = F.col("text")
    g = ca.with_document_gate(spread(table(spark, d, "documents").select("doc_id", "text")), F.split(t, "\n")[0], t, F.size(F.split(t, "\n")))
    return g.select("doc_id", "g.policy", "g.document_type", "g.confidence", ca.limited_status(F.col("g.policy"), F.lit("DRAFT")).alias("status"))


@query("last_per_type", "SELECT user_id, event_type, arg_max(props, struct_pack(t := ts, e := event_id)) AS payload FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def last_per_type(spark: SparkSession, d: str) -> DataFrame:
    """SRC16, STR3."""
    return table(spark, d, "events").filter("props IS NOT NULL").groupBy("user_id", "event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("payload"))


@query(
    "cache_prune",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-20') WHERE rn <= 100",
)
def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    """SRC19, STR5: entries within their time to live, the newest hundred of each kind."""
    e = table(spark, d, "events").filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    from ..operators.ranking import top_per

    return top_per(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 100).select("event_id")


@query(
    "cache_lookup",
    "WITH c AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE source < 'src15') SELECT d.doc_id, c.k IS NOT NULL AS hit FROM documents d LEFT JOIN c ON sha256(d.text) = c.k",
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """SRC19: hits and misses by key of what is cached (here: the texts of some sources)."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    c = docs.filter("source < 'src15'").select(F.col("h").alias("k")).distinct()
    return docs.join(c, F.col("h") == F.col("k"), "left").select("doc_id", F.col("k").isNotNull().alias("hit"))


@query(
    "grounding_scores",
    f"""WITH {PAIRS_SQL}, g AS (SELECT doc_id, other_id, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) * 1.0::DOUBLE / len(list_distinct(list_concat(a, b))), 4) END AS o, CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) * 1.0::DOUBLE / least(len(a), len(b)), 4) END AS c FROM t),
        s AS (SELECT doc_id, other_id, (0.25::DOUBLE * o + 0.15::DOUBLE * c) / (0.25::DOUBLE + 0.15::DOUBLE) AS score FROM g)
        SELECT CASE WHEN score >= 0.48 THEN 'PASS' WHEN score >= 0.28 THEN 'SOFT' ELSE 'FAIL' END AS decision, count(*) AS n, round(avg(score), 3) AS mean FROM s GROUP BY 1""",
)
def grounding_scores(spark: SparkSession, d: str) -> DataFrame:
    """GR1, MA3: mean of the similarities that are present; a missing semantic part drops out."""
    p = pairs(spark, d)
    a, b = sim.tokens("text"), sim.tokens("other")
    s = p.select(tx.weighted_mean([(sim.jaccard(a, b), 0.25), (sim.containment(a, b), 0.15), (F.lit(None).cast("double"), 0.35)]).alias("score"))
    return s.groupBy(ca.grounding_class(F.col("score")).alias("decision")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"))


@query("few_lines_first", f"WITH {LINES_SQL} SELECT doc_id, min(line_no) AS line_no FROM lines WHERE length(trim(text)) > 0 GROUP BY doc_id")
def few_lines_first(spark: SparkSession, d: str) -> DataFrame:
    """RES11: the first line of each document that is not empty."""
    return first_per(lines(spark, d).filter(F.length(F.trim("text")) > 0), ["doc_id"], [F.col("line_no")]).select("doc_id", "line_no")


@query("article_gate")
def article_gate(spark: SparkSession, d: str) -> DataFrame:
    """DG2 with the domain's rules over chat texts as articles (checked on sentences of each branch)."""
    t = F.coalesce("text", F.lit(""))
    g = table(spark, d, "conversations").select("conv_id", "turn", ca.article_gate(F.col("role"), F.concat(F.lit("Article "), F.col("turn").cast("string")), t, F.when(F.col("conv_id") % 2 == 0, "EXTRACT_LIMITED").otherwise("EXTRACT_FULL")).alias("g"))
    return g.select("conv_id", "turn", "g.policy", "g.document_type", "g.confidence")


@query(
    "scope_contexts",
    """WITH s AS (SELECT n_nationkey AS site_id, n_name AS site, coalesce(nullif(r_name, ''), 'ORGANIZATION') AS organisation FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
       p AS (SELECT c_nationkey AS site_id, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS processes, count(*) AS people FROM customer GROUP BY 1), e AS (SELECT s_nationkey AS site_id, count(*) AS equipment FROM supplier GROUP BY 1)
       SELECT s.site_id, organisation, site, coalesce(processes, '') AS processes, coalesce(people, 0) AS people, coalesce(equipment, 0) AS equipment FROM s LEFT JOIN p USING (site_id) LEFT JOIN e USING (site_id)""",
)
def scope_contexts(spark: SparkSession, d: str) -> DataFrame:
    """SC1: context of each site: labels with fall-backs, processes as a set, counts of what belongs to it."""
    s = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    s = s.select(F.col("n_nationkey").alias("site_id"), F.coalesce(F.nullif("r_name", F.lit("")), F.lit("ORGANIZATION")).alias("organisation"), F.col("n_name").alias("site"))
    p = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("site_id")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("processes"), F.count("*").alias("people"))
    e = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("site_id")).agg(F.count("*").alias("equipment"))
    j = s.join(p, "site_id", "left").join(e, "site_id", "left")
    return j.select("site_id", "organisation", "site", F.coalesce("processes", F.lit("")).alias("processes"), F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("equipment", F.lit(0)).alias("equipment"))


@query(
    "scope_routing",
    f"""WITH {REQUIREMENTS_SQL} SELECT CASE WHEN req_type = 'INTERDICTION' THEN 'SITE,ACTIVITY' WHEN domain = 'SST' THEN 'ACTIVITY' WHEN domain = 'ENVIRONNEMENT' THEN 'SITE,PROCESS' ELSE 'ALL' END AS levels, count(*) AS n FROM requirements GROUP BY 1""",
)
def scope_routing(spark: SparkSession, d: str) -> DataFrame:
    """SC2."""
    levels = ca.routed_levels(F.col("req_type"), F.col("domain"), F.lit(""), {"INTERDICTION": ("SITE", "ACTIVITY")}, {"SST": ("ACTIVITY",), "ENVIRONNEMENT": ("SITE", "PROCESS")})
    return requirements(spark, d).groupBy(F.coalesce(F.array_join(levels, ","), F.lit("ALL")).alias("levels")).agg(F.count("*").alias("n"))


@query(
    "sector_rules",
    """WITH r AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 THEN 3 END AS k FROM part)
       SELECT p_partkey, CASE k WHEN 1 THEN CASE WHEN p_type = 'ECONOMY' THEN 'APPLICABLE' ELSE 'NON_APPLICABLE' END WHEN 2 THEN 'APPLICABLE' ELSE 'NON_APPLICABLE' END AS status, CASE k WHEN 1 THEN 'SECTOR' WHEN 2 THEN 'CHEMICAL' ELSE 'INSTITUTIONAL' END AS rule FROM r WHERE k IS NOT NULL""",
)
def sector_rules(spark: SparkSession, d: str) -> DataFrame:
    """RU1, rules two to five."""
    k = F.col("p_size") % 4
    r = ca.applicability_rules(F.array("p_type"), F.lit("ECONOMY"), k == 0, k == 1, F.lit(True), F.lit(False), F.lit(False), k == 2)
    return table(spark, d, "part").select("p_partkey", r.alias("r")).filter("r IS NOT NULL").select("p_partkey", "r.status", "r.rule")


@query(
    "job_states",
    """WITH j AS (SELECT user_id AS job, count(*) FILTER (WHERE event_type = 'error') > 8 AS failed, count(*) FILTER (WHERE event_type = 'view') > 0 AS running, count(*) FILTER (WHERE event_type = 'signup') > 10 AS a1, count(*) FILTER (WHERE event_type = 'click') > 14 AS a2, count(*) FILTER (WHERE event_type = 'purchase') > 14 AS a3 FROM events GROUP BY 1)
       SELECT job, CASE WHEN failed THEN 'FAILED' WHEN a3 THEN 'DONE' WHEN running THEN 'RUNNING' ELSE 'QUEUED' END AS state, CASE WHEN a3 THEN 'A3' WHEN a2 THEN 'A2' WHEN a1 THEN 'A1' ELSE 'NONE' END AS stage FROM j""",
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """JB1 over counts of a job's events."""
    n = lambda e: F.count_if(F.col("event_type") == e)
    j = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg((n("error") > 8).alias("failed"), (n("view") > 0).alias("running"), (n("signup") > 10).alias("a1"), (n("click") > 14).alias("a2"), (n("purchase") > 14).alias("a3"))
    s = ca.job_state(F.col("failed"), F.col("running"), [("A1", F.col("a1")), ("A2", F.col("a2")), ("A3", F.col("a3"))])
    return j.select("job", s.alias("s")).select("job", "s.state", "s.stage")
