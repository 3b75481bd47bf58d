"""Landed JSON pages with rejects, and activity tables with differing columns."""

import json

import pytest
from pyspark.sql import functions as F

from funnelspark.sources import landed as L
from funnelspark.sources import payloads as P

LINKS = "activity_type string, activity_id string, contact_id string, type string"


def _write(folder, *lines):
    folder.mkdir(parents=True)
    (folder / "pages.json").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_broken_pages_are_set_aside_whole(spark, tmp_path):
    page = json.dumps({"results": [{"id": "1", "email": "a@x"}, {"id": "2", "firstName": "Bo", "archived": True}]})
    folder = _write(tmp_path / "o", page, page[:40], "", "not json", '{"status": "error"}', '{"results": "text"}', '{"results": []}', "[1]", "null",
                    page[:-1] + ', "paging": {"next": 3}}')
    good, bad = L.read_landed_pages(spark, folder, P.OWNER_PAGE_SCHEMA)
    owners = sorted((r["owner_id"], r["salesman_name"], r["archived"]) for r in P.flatten_owners(good).collect())
    assert owners == [("1", "a@x", False), ("1", "a@x", False), ("2", "Bo", True), ("2", "Bo", True)]
    rejects = bad.collect()
    assert sorted((r["reject_reason"], r["page"]) for r in rejects if r["page"] in ("", page[:40], "not json", '{"status": "error"}')) == [
        ("broken", "not json"), ("broken", page[:40]), ("empty", ""), ("no results", '{"status": "error"}')]
    assert {r["page"] for r in rejects} >= {'{"results": "text"}', "[1]", "null"} and all(r["file"].endswith("pages.json") for r in rejects)
    assert good.count() + len(rejects) == 10
    counts = {(r["kind"], r["reject_reason"]): r["pages"] for r in L.reject_counts({"owners": bad}).collect()}
    assert sum(counts.values()) == len(rejects) and counts["owners", "empty"] == 1


def test_union_of_tables_with_private_and_conflicting_columns(spark, tmp_path):
    spark.createDataFrame([("1", 5, "t")], "hs_object_id string, hs_timestamp long, title string").write.parquet(str(tmp_path / "calls"))
    spark.createDataFrame([("1", "x", (1, "a")), (" ", None, None), ("3", "y", (2, "b"))],
                          "hs_object_id string, hs_timestamp string, place struct<n:int,s:string>").write.parquet(str(tmp_path / "meetings"))
    spark.createDataFrame([(7,)], "id long").write.parquet(str(tmp_path / "notes"))
    frames = L.landed_tables(spark, str(tmp_path), ["calls", "emails", "meetings", "notes"])
    assert list(frames) == ["calls", "meetings", "notes"]  # e-mails were never landed
    links = spark.createDataFrame([("calls", "1", "c1", "Primary"), ("calls", "1", "c2", None), ("meetings", "3", "c3", "4"), ("notes", "7", "c7", "x"),
                                   ("emails", "1", "c9", "x"), ("meetings", "8", "c1", "x")], LINKS)
    out = L.union_activities(frames, links)
    assert dict(out.dtypes)["hs_timestamp"] == "string" and dict(out.dtypes)["place"] == "struct<n:int,s:string>"
    rows = sorted((r["activity_type"], r["activity_id"] or "", r["contact_id"] or "", r["association_type"] or "", r["hs_timestamp"], r["title"]) for r in out.collect())
    assert rows == [("calls", "1", "c1", "Primary", "5", "t"), ("calls", "1", "c2", "", "5", "t"), ("meetings", "", "", "", None, None),
                    ("meetings", "1", "", "", "x", None), ("meetings", "3", "c3", "4", "y", None), ("notes", "7", "c7", "x", None, None)]
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == 1  # the links are joined once for all types


def test_union_without_tables_and_with_clashing_columns(spark):
    links = spark.createDataFrame([("calls", "1", "c1", "x")], LINKS)
    assert L.union_activities({}, links).collect() == []
    clash = spark.createDataFrame([("1", "c")], "hs_object_id string, contact_id string")
    with pytest.raises(ValueError, match="contact_id"):
        L.union_activities({"calls": clash}, links)


def test_a_schema_that_grew_is_merged_over_the_files(spark, tmp_path):
    spark.range(2).select(F.col("id").alias("hs_object_id")).write.parquet(str(tmp_path / "calls"))
    spark.range(2, 3).select(F.col("id").alias("hs_object_id"), F.lit("new").alias("later")).write.mode("append").parquet(str(tmp_path / "calls"))
    out = L.union_activities(L.landed_tables(spark, str(tmp_path), ["calls"]), spark.createDataFrame([], LINKS))
    assert sorted((r["activity_id"], r["later"]) for r in out.collect()) == [("0", None), ("1", None), ("2", "new")]
