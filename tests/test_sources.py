"""Registers, sinks and merges on small files."""

import pytest
from pyspark.sql import functions as F

from regulith.operators.merge import delta, upsert
from regulith.sources import tabular as t


def test_headers_and_datasets():
    assert t.canonical_header("﻿Raison Sociale") == "company_name" and t.canonical_header("Avancement %") == "progress_pct" and t.canonical_header("N° série") == "n_serie"
    assert t.dataset("NC") == "nonconformities"
    with pytest.raises(ValueError, match="unknown"):
        t.dataset("nothing")


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8-sig", ","), ("utf-8", ";"), ("cp1252", "\t")])
def test_register(spark, tmp_path, encoding, sep):
    p = tmp_path / "sites.csv"
    rows = [["Site Code", "Nom", "Ville", "employee_count", "admin_password"], ["S1", "Usine é", "Tunis", "1 250", "x"], ["", "", "", "", ""], ["S2", "Dépôt", "", "n/a", "y"]]
    p.write_bytes("\n".join(sep.join(r) for r in rows).encode(encoding))
    got = t.read_register(spark, str(p), "site")
    assert got.columns == list(t.DATASETS["sites"])
    a, b = got.orderBy("site_code").collect()
    assert (a.site_code, a.name, a.city, a.employee_count, a.region) == ("S1", "Usine é", "Tunis", 1250, None)
    assert (b.name, b.city, b.employee_count) == ("Dépôt", None, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, name string")
    t.write_registry(df, str(tmp_path / "csv"), ["name", "id"], quote_all=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["name", "id"]
    t.write_report(df, str(tmp_path / "json"))
    assert t.read_report(spark, str(tmp_path / "json"), "id int, name string").count() == 2
    assert "| 1 | a\\|b |" in t.markdown(df, "T")
    assert t.list_reports(spark, str(tmp_path / "json"), "*.json", 5).count() >= 1
    e = spark.createDataFrame([("t", 1, "X", (5,))], "tenant_id string, doc_id int, event_type string, payload struct<k:int>").withColumn("created_at", F.current_timestamp())
    for _ in range(2):
        t.append_events(e, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


def test_upsert_and_delta(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id int, v string")
    got = {r.id: (r.v, r.merge_kind) for r in upsert(old, new, ["id"], {"v": F.coalesce("n.v", "o.v")}, kinds=True).collect()}
    assert got == {1: ("a", "kept"), 2: ("B", "updated"), 3: ("C", "inserted"), None: ("N", "updated")}
    # what has been decided is not selected again
    reason = F.when(F.col("e._known").isNull(), "NEW")
    first = delta(new.filter("id IS NOT NULL"), old, ["id"], reason)
    assert [r.id for r in first.collect()] == [3]
    assert delta(new.filter("id IS NOT NULL"), old.union(first.select("id", "v")), ["id"], reason).count() == 0
