"""Registers as CSV: sniffed, canonical headers, typed columns; sinks for registries and reports."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# The registers' columns (canonical name and type).
DATASETS: dict[str, dict[str, str]] = {
    "company_profile": {"tenant_id": "string", "company_name": "string", "sector": "string", "sub_sector": "string", "country": "string", "certifications": "list", "headcount": "int", "main_activities": "string"},
    "sites": {"site_code": "string", "name": "string", "city": "string", "region": "string", "type": "string", "employee_count": "int", "main_activities": "string"},
    "processes": {"site_code": "string", "process_code": "string", "name": "string", "description": "string"},
    "activities": {"site_code": "string", "process_code": "string", "process_name": "string", "code": "string", "name": "string", "description": "string"},
    "products": {"reference": "string", "designation": "string", "family": "string", "category": "string", "product_type": "string", "nature": "string", "unit": "string", "site_name": "string", "is_active": "bool"},
    "chemicals": {"designation": "string"},
    "equipment": {"site_code": "string", "internal_code": "string", "designation": "string", "nature": "string", "equipment_type": "string", "category": "string", "location": "string", "serial_number": "string", "state": "string", "brand": "string", "model": "string", "specific_data": "string", "last_intervention": "date", "next_intervention": "date"},
    "environmental_aspects": {"site_code": "string", "aspect_code": "string", "designation": "string", "domain": "string", "sub_domain": "string", "description": "string"},
    "sst_risks": {"site_code": "string", "risk_code": "string", "risk_type": "string", "designation": "string", "domain": "string", "dangers": "string", "activities": "string", "dangerous_situations": "string", "damages": "string", "description": "string"},
    "sst_significant_risks": {"site_code": "string", "risk_code": "string", "year": "int", "activities": "string", "domain": "string", "risk_type": "string", "dangers": "string", "appreciation": "string", "score": "int", "date_start": "date", "date_end": "date", "obligations": "string", "exposure": "string", "prevention_efficiency": "float", "rpn_efficiency": "float"},
    "strategic_objectives": {"objective_text": "string", "process_name": "string", "indicator": "string", "indicator_type": "string", "frequency": "string", "calculation_method": "string", "system_scope": "string", "unit": "string", "strategic_axis": "string"},
    "nonconformities": {"site_code": "string", "reference": "string", "year": "int", "nature": "string", "process_name": "string", "title": "string", "source": "string", "audit_type": "string", "responsible_service": "string", "detected_at": "date", "state": "string", "severity": "string", "nc_type": "string", "frequency": "string", "nc_category": "string", "gravity": "string", "priority": "string", "closed_at": "date", "system_scope": "string", "progress_pct": "float", "closure_rate": "float"},
    "audit_reports_metadata": {"reference": "string", "audit_type": "string", "category": "string", "nature": "string", "system_scope": "string", "date_planned_start": "date", "date_planned_end": "date", "date_real_start": "date", "date_real_end": "date", "state": "string", "objectives": "string", "locations_visited": "string", "auditor_names": "string", "source_file": "string", "scope_level": "string", "site_code": "string", "process_code": "string", "activity_code": "string"},
    "compliance_evidence_manifest": {"title": "string", "file_name": "string", "storage_path": "string", "evidence_type": "string", "source_type": "string", "requirement_reference": "string", "scope_level": "string", "site_code": "string", "process_code": "string", "activity_code": "string", "issued_at": "date", "created_by": "string", "linked_audit_reference": "string"},
}
#: Other names under which a register is asked for.
DATASET_ALIASES = {"profile": "company_profile", "company": "company_profile", "site": "sites", "process": "processes", "activity": "activities", "product": "products", "chemical": "chemicals", "equipments": "equipment", "nc": "nonconformities", "audits": "audit_reports_metadata", "evidence": "compliance_evidence_manifest"}
#: Other headers for a canonical column.
HEADER_ALIASES = {"raison_sociale": "company_name", "societe": "company_name", "effectif": "headcount", "nb_employes": "employee_count", "site": "site_code", "ville": "city", "nom": "name", "actif": "is_active", "gravite": "gravity", "priorite": "priority", "avancement_pct": "progress_pct"}
#: Never read on.
SECRET = ("admin_username", "admin_password", "admin_display_name", "admin_role")

_TYPED = {"string": lambda c: F.nullif(F.trim(c), F.lit("")), "int": tx.to_int, "float": tx.to_float, "date": tx.to_date, "bool": tx.to_bool, "list": tx.to_list}


def canonical_header(name: str) -> str:
    """SRC9: folded, lower, ``%`` as pct, everything else as single underscores, then the alias."""
    out = _plain_name(name)
    return HEADER_ALIASES.get(out, out)


def _plain_name(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name.lstrip("﻿")).encode("ascii", "ignore").decode().lower().replace("%", " pct ")
    return "_".join("".join(c if c.isalnum() else " " for c in plain).split())


def dataset(name: str) -> str:
    """SRC10."""
    key = _plain_name(name)
    key = DATASET_ALIASES.get(key, key)
    if key not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    return key


def sniff(spark: SparkSession, path: str, sample: int = 2048) -> tuple[str, str]:
    """Encoding and separator, from the file's first bytes (read by Spark, so any store will do)."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample).alias("h")).first().h)
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            line = head.decode(encoding, "strict" if len(head) < sample else "ignore").splitlines()[0] if head else ""
            if encoding == "utf-8" and len(head) >= sample:
                head[: sample - 4].decode("utf-8")
            break
        except UnicodeDecodeError:
            continue
    return encoding, max(",;\t", key=line.count)


#: What Windows writes where Latin-1 has control characters; Spark reads Latin-1 only.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace").replace("\ufffd", "?")


def _decoded(c: Column, encoding: str) -> Column:
    return F.translate(c, _C1, _WINDOWS) if encoding == "cp1252" else c


def read_register(spark: SparkSession, path: str, name: str) -> DataFrame:
    """SRC7, SRC9, SRC10, ST10: a register with canonical, typed columns; missing ones are null, all-blank rows go, credentials are not read."""
    schema = DATASETS[dataset(name)]
    encoding, sep = sniff(spark, path)
    raw = spark.read.csv(path, header=True, sep=sep, encoding="utf-8" if encoding == "utf-8" else "iso-8859-1", multiLine=True, quote='"', escape='"')
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]), [canonical_header(c) for c in raw.columns]
    df, names = raw
    at: dict[str, Column] = {}
    for i, n in enumerate(names):
        if n not in SECRET:
            at.setdefault(n, _decoded(F.col(f"c{i}"), encoding))
    df = df.filter(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in df.columns]).isNotNull())
    return df.select(*[(_TYPED[t](at[n]) if n in at else F.lit(None).cast({"int": "bigint", "float": "double", "date": "date", "bool": "boolean", "list": "array<string>"}.get(t, "string"))).alias(n) for n, t in schema.items()])


def write_registry(df: DataFrame, path: str, columns: list[str], quote_all: bool = False) -> None:
    """SRC11, SRC20: CSV with a fixed column order, as many files as partitions."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quoteAll=quote_all)


def write_report(df: DataFrame, path: str) -> None:
    """SRC13."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """SRC12: a report of at most ``most`` rows for people to read."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *body]) + "\n"


def list_reports(spark: SparkSession, path: str, pattern: str, most: int) -> DataFrame:
    """SRC14: the newest files of a folder, without their content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")
    return f.orderBy(F.desc("modificationTime"), "path").limit(most)


def append_events(df: DataFrame, path: str) -> None:
    """SRC15: append ``tenant_id, doc_id, event_type, payload struct, created_at`` with the payload as JSON."""
    df.withColumn("payload", F.to_json("payload")).write.mode("append").parquet(path)


def choose_ocr(native: Column, ocr: Column, native_alpha: Column, ocr_alpha: Column, suspicious: Column, ocr_suspicious: Column) -> Column:
    """SRC2: take the OCR text of a suspicious page if it is clean or has half as many letters again."""
    return F.when(suspicious & (~ocr_suspicious | (ocr_alpha >= 1.5 * native_alpha)), ocr).otherwise(native)
