"""Payload flatteners, storage round trip, freshness and the streaming landing job."""

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from funnelspark.sources import payloads as P
from funnelspark.sources import storage as S
from funnelspark.streaming.landing import land_object_pages


def _pages(tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    for i in range(3):
        page = {"results": [{"id": str(i * 10 + j), "createdAt": "2026-01-01T00:00:00Z", "updatedAt": "2026-01-02T00:00:00Z",
                             "archived": False, "properties": {"email": f"p{i}{j}@x", "hs_object_id": None}}
                            for j in range(4)]}
        (src / f"page{i}.json").write_text(json.dumps(page))
    return src


def test_flatten_objects_owners_links(spark, tmp_path):
    src = _pages(tmp_path)
    objs = P.flatten_crm_objects(P.read_pages(spark, str(src), P.OBJECT_PAGE_SCHEMA), ["email", "hs_object_id"])
    rows = objs.collect()
    assert len(rows) == 12 and all(r.hs_object_id == r.id for r in rows)
    owners = spark.createDataFrame([([("1", "u", "a@x", "Ana", " ", None), ("2", "v", "b@x", None, None, True), ("3", "w", None, None, None, False)],)],
                                   P.OWNER_PAGE_SCHEMA)
    names = {r.owner_id: r.salesman_name for r in P.flatten_owners(owners).collect()}
    assert names == {"1": "Ana", "2": "b@x", "3": "3"}
    links = spark.createDataFrame([([(("c1",), None, [("d1", None, [("HUBSPOT_DEFINED", 4, "")]), ("d1", "old", [("X", 4, "Primary")])]),
                                     (None, " c2 ", [(None, "d2", None), (" ", None, None)]), (("c3",), None, None)],)],
                                  P.LINK_PAGE_SCHEMA)
    got = sorted((r.contact_id, r.deal_id, r.association_type) for r in P.flatten_contact_deal_links(links).collect())
    assert got == [("c1", "d1", "4"), ("c1", "d1", "Primary"), ("c2", "d2", None)]


def test_storage_round_trip_and_freshness(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    S.save_tables({"t": df}, str(tmp_path / "store"))
    loaded = S.load_tables(spark, str(tmp_path / "store"), {"t": "id long, x long", "missing": "a string"})
    assert loaded["t"].count() == 5 and loaded["missing"].count() == 0
    (tmp_path / "store" / "broken").mkdir()
    (tmp_path / "store" / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017 - a broken table is no empty table
        S.load_tables(spark, str(tmp_path / "store"), {"broken": "not a schema"})
    log = S.refresh_log_row(spark, dt.datetime(2026, 6, 9, 12, 0, 0))
    f = S.table_freshness(log, loaded, "2026-06-10 18:00:00").first()
    assert f.age_hours == 30.0 and f.stale is True and f.empty_tables == ["missing"] and f.has_cache is True


def test_streaming_landing_available_now(spark, tmp_path):
    src = _pages(tmp_path)
    q = land_object_pages(spark, str(src), str(tmp_path / "bronze"), str(tmp_path / "ckpt"), ["email"])
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 12
    (src / "page9.json").write_text(json.dumps({"results": [{"id": "99", "createdAt": "x", "updatedAt": "x", "archived": False,
                                                             "properties": {"email": "n@x"}}]}))
    q2 = land_object_pages(spark, str(src), str(tmp_path / "bronze"), str(tmp_path / "ckpt"), ["email"])
    q2.awaitTermination(120)
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    assert bronze.count() == 13  # only the new file is processed
    (src / "page10.json").write_text(json.dumps({"results": [{"id": "99", "createdAt": "x", "updatedAt": "y", "archived": False,
                                                              "properties": {"email": "changed@x"}}]}))
    land_object_pages(spark, str(src), str(tmp_path / "bronze"), str(tmp_path / "ckpt"), ["email"]).awaitTermination(120)
    newest = P.newest_objects(spark.read.parquet(str(tmp_path / "bronze")))
    assert newest.columns == bronze.columns and newest.count() == 13
    assert newest.where("id = '99'").first()["email"] == "changed@x"


def test_newest_objects_of_awkward_rows(spark):
    rows = spark.createDataFrame([("1", None, "a"), ("1", "2", "b"), ("1", "2", "b"), (None, "9", "c"), ("2", None, None)], "id string, updatedAt string, x string")
    assert sorted((r["id"], r["x"]) for r in P.newest_objects(rows).collect()) == [("1", "b"), ("2", None)]
