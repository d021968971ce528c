"""Registers, sinks, reports and events as files in the shared folder, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..registry import query, table
from ..sources import tabular as tb
from ..streaming.events import shared_folder
from .texts import lines, spoiled, suspicious_text

_SITES_SQL = "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS site_code, s_name AS name, CAST(s_nationkey AS VARCHAR) AS city, CAST(s_suppkey % 500 AS BIGINT) AS employee_count FROM supplier"


def sites_file(spark: SparkSession, d: str) -> str:
    """Suppliers as a register of sites, with other headers than the canonical ones, blank rows and a credential."""
    path = f"{shared_folder(spark)}/sites"
    s = table(spark, d, "supplier")
    rows = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("Site Code"),
        F.col("s_name").alias("Nom"),
        F.concat(F.lit(" "), F.col("s_nationkey").cast("string")).alias("Ville"),
        F.concat((F.col("s_suppkey") % 500).cast("string"), F.lit(" pers.")).alias("nb_employes"),
        F.lit("x").alias("admin_password"),
    )
    blank = s.select(*[F.lit(" ").alias(c) for c in rows.columns])
    rows.unionByName(blank).write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("register_scan", _SITES_SQL)
def register_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC7, SRC9, SRC10: a register under another name, sniffed, with canonical and typed columns; blank rows and credentials stay out."""
    return tb.read_register(spark, sites_file(spark, d), "Site").select("site_code", "name", "city", "employee_count")


@query("dataset_dispatch", "SELECT nature AS dataset, count(*) AS n FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'nonconformities' WHEN 1 THEN 'sites' WHEN 2 THEN 'equipment' ELSE 'company_profile' END AS nature FROM supplier) GROUP BY 1")
def dataset_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """SRC10: the canonical register of each asked name."""
    names = F.element_at(F.array(*map(F.lit, ("NC", "Site", "équipments", "Company"))), (F.col("s_suppkey") % 4).cast("int") + 1)
    known = F.create_map(*[F.lit(x) for pair in ({k: k for k in tb.DATASETS} | tb.DATASET_ALIASES).items() for x in pair])
    return table(spark, d, "supplier").groupBy(F.element_at(known, tx.slug(names)).alias("dataset")).agg(F.count("*").alias("n"))


@query("registry_sink", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def registry_sink(spark: SparkSession, d: str) -> DataFrame:
    """SRC11, SRC20: a registry written as CSV in a fixed column order, and read back."""
    path = f"{shared_folder(spark)}/registry"
    tb.write_registry(table(spark, d, "orders"), path, ["o_orderkey", "o_orderstatus", "o_orderpriority"], quote_all=True)
    return spark.read.csv(path, header=True, schema="o_orderkey long, o_orderstatus string, o_orderpriority string")


@query("registry_markdown", "SELECT CAST(n_nationkey AS VARCHAR) AS key, replace(n_name, '|', '\\|') AS name FROM nation ORDER BY n_nationkey LIMIT 200")
def registry_markdown(spark: SparkSession, d: str) -> DataFrame:
    """SRC12: a report of at most 200 rows for people, written as one text and read back."""
    path = f"{shared_folder(spark)}/markdown"
    said = tb.markdown(table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "Nations")
    spark.createDataFrame([(said,)], "value string").write.text(path)
    cells = F.split(F.regexp_replace("value", r"^\| | \|$", ""), r" \| ")
    return spark.read.text(path).filter(F.col("value").rlike(r"^\| [0-9]")).select(cells[0].alias("key"), cells[1].alias("name"))


@query("report_round_trip", "SELECT l_returnflag AS flag, count(*) AS n, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC13: a report as JSON and back."""
    path = f"{shared_folder(spark)}/report"
    tb.write_report(table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.max("l_orderkey").alias("last")), path)
    return tb.read_report(spark, path, "flag string, n long, last long")


@query("report_listing", "SELECT 'part_' || r_regionkey AS report FROM region ORDER BY 1 LIMIT 5")
def report_listing(spark: SparkSession, d: str) -> DataFrame:
    """SRC14: the newest reports of a folder by name, one for each region."""
    path = f"{shared_folder(spark)}/reports"
    table(spark, d, "region").select(F.concat(F.lit("part_"), F.col("r_regionkey").cast("string")).alias("report"), F.col("r_name").alias("value")).write.partitionBy("report").text(path)
    return tb.list_reports(spark, f"{path}/report=*", "*.txt", 5).select(F.regexp_extract("path", "report=([^/]+)/", 1).alias("report"))


@query("event_append", "SELECT event_type, count(*) * 2 AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_append(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: events appended twice, payloads as JSON."""
    path = f"{shared_folder(spark)}/log"
    e = table(spark, d, "events").select(F.lit("t").alias("tenant_id"), F.col("event_id").alias("doc_id"), "event_type", F.struct("user_id").alias("payload"), F.col("ts").alias("created_at"))
    for _ in range(2):
        tb.append_events(e, path)
    user = F.get_json_object("payload", "$.user_id")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(user).alias("users"))


@query("directory_ingest", "SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1")
def directory_ingest(spark: SparkSession, d: str) -> DataFrame:
    """SRC17: a folder of documents taken in as a stream of its files, each once."""
    folder = shared_folder(spark)
    table(spark, d, "documents").select("doc_id", "lang", "text").write.parquet(f"{folder}/incoming")
    stream = spark.readStream.schema("doc_id long, lang string, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/incoming")
    out = stream.select("lang", F.length("text").alias("chars")).writeStream.format("parquet").option("path", f"{folder}/taken").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("lang string, chars int").parquet(f"{folder}/taken").groupBy("lang").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("ocr_choice")
def ocr_choice(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: of spoiled lines' native text and the clean line as OCR, which is taken (checked on each band)."""
    p = lines(spark, d).select("doc_id", F.col("text").alias("ocr"), spoiled(F.col("text"), F.col("doc_id") + F.col("line_no")).alias("native"))
    alpha = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))
    took = tb.choose_ocr(F.col("native"), F.col("ocr"), alpha("native"), alpha("ocr"), suspicious_text("native"), suspicious_text("ocr"))
    return p.groupBy((took == F.col("ocr")).alias("as_ocr"), suspicious_text("native").alias("suspicious")).agg(F.count("*").alias("n"))


@query(
    "stripped_headers",
    "SELECT o_orderkey % 4 AS kind, count(*) AS n, CASE o_orderkey % 4 WHEN 0 THEN 'Le registre est tenu par le chef du service' WHEN 1 THEN 'Sans en-tête, la règle reste telle quelle' WHEN 2 THEN 'La taxe est due par tous les exploitants du secteur concerné' ELSE 'Selon l''article 5 du code, la règle vaut pour tous sans autre mention' END AS text FROM orders GROUP BY ALL",
)
def stripped_headers(spark: SparkSession, d: str) -> DataFrame:
    """ST8: an article's own header off, and what follows a foreign header."""
    said = ("Article premier - Le registre est tenu par le chef du service", "Sans en-tête, la règle reste telle quelle", "Art. 7 - La taxe est due par tous les exploitants du secteur concerné Article 8 - Autre texte", "Selon l'article 5 du code, la règle vaut pour tous sans autre mention")
    k = (F.col("o_orderkey") % 4).cast("int")
    text = tx.strip_header(F.element_at(F.array(*map(F.lit, said)), k + 1))
    return table(spark, d, "orders").groupBy((F.col("o_orderkey") % 4).alias("kind"), text.alias("text")).agg(F.count("*").alias("n"))
