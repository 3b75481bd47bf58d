"""Relabelling in one pass (both ways), published baselines, pivots of several sheets, source coverage."""

import pytest
from pyspark.sql import functions as F

from funnelspark.operators import privacy as PR
from funnelspark.operators import quality as Q
from funnelspark.sources import versions as V

FRAME = "id int, owner string, udr string, other string"
ROWS = [(1, "Ana", "Bo", "Ana"), (2, " Ana ", None, "x"), (3, "", "Ana", None), (4, "nobody", "Bo", "Bo"), (4, "nobody", "Bo", "Bo")]
WANT = [(1, "UDR 01", "UDR 02", "Ana"), (2, "UDR 01", None, "x"), (3, "", "UDR 01", None), (4, "nobody", "UDR 02", "Bo"), (4, "nobody", "UDR 02", "Bo")]


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("inline", [10, 1])
def test_labels_are_replaced_alike_inline_and_joined(spark, inline):
    df = spark.createDataFrame(ROWS, FRAME)
    names = spark.createDataFrame([("Ana", "UDR 01"), ("Bo", "UDR 02"), ("Bo", "UDR 09"), ("Cy", "UDR 03")], "label string, pseudonym string")
    out = PR.apply_label_map(df, names, ["owner", "udr", "owner", "absent"], inline)
    assert out.columns == df.columns and _sorted(out) == sorted(WANT, key=repr)
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == (0 if inline == 10 else 2)  # looked up in a constant, or joined once and brought back
    assert _sorted(PR.apply_label_map(df, names.limit(0), ["owner"], inline)) == sorted(ROWS, key=repr)
    assert PR.apply_label_map(df, names, ["absent"], inline) is df


def test_many_labels_in_a_constant(spark):
    n = 5000
    names = spark.range(n).select(F.concat(F.lit("o"), "id").alias("label"), F.concat(F.lit("p"), "id").alias("pseudonym"))
    df = spark.range(0, n + 100, 7).select(F.concat(F.lit("o"), "id").alias("owner"))
    got = {r["owner"] for r in PR.apply_label_map(df, names, ["owner"]).collect()}
    assert got == {f"p{i}" for i in range(0, n, 7)} | {f"o{i}" for i in range(0, n + 100, 7) if i >= n}


def _baseline(spark, root, leads, **more):
    names = spark.createDataFrame([("Ana", "UDR 01")], "label string, pseudonym string")
    return PR.publish_baseline(spark, root, {"leads": leads} | more, names, spark.range(1))


def test_an_aborted_publication_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "baseline")
    leads = spark.createDataFrame([("Ana", "a@x", "New")], "contact_owner string, email string, lead_status string")
    bad = leads.withColumn("lead_status", F.when(F.col("contact_owner") == "Ana", F.raise_error(F.lit("aborted")).cast("string")))
    with pytest.raises(Exception, match="aborted"):
        _baseline(spark, root, leads, more=bad)
    assert V.version_numbers(spark, root) == [] and V.read_tables(spark, root) == {}
    assert _baseline(spark, root, leads) == 1
    held = V.read_tables(spark, root)
    assert set(held) == {"leads", "metadata"} and held["leads"].columns == ["contact_owner", "lead_status"]  # no e-mail
    assert held["leads"].first()["contact_owner"] == "UDR 01"
    with pytest.raises(Exception, match="aborted"):
        _baseline(spark, root, bad)
    assert V.read_tables(spark, root)["leads"].count() == 1
    with pytest.raises(ValueError):
        _baseline(spark, root, leads, metadata=leads)


def test_pivot_sheets_from_one_scan(spark):
    leads = spark.createDataFrame([("1", "Ana", "New", "Paid"), ("2", "Ana", "Old", "Organic"), ("", "Bo", "New", "Paid"), ("3", " ", "New", "Paid"),
                                   ("4", "Cy", None, "Organic")], "record_id string, owner string, status string, lead_type string")
    pivots = [Q.Pivot("all", "owner", "status"), Q.Pivot("paid", "owner", "status", "Paid")]
    counts = Q.pivot_counts(leads, pivots)
    rows = Q.pivot_sheet_rows(Q.pivot_cells(counts), ["grand_total"])
    assert sorted((r["sheet"], r["row_label"], r["grand_total"]) for r in rows.collect()) == [("all", "Ana", "2"), ("all", "Cy", "1"), ("paid", "Ana", "1")]
    out = sorted((r["pivot_name"], r["group"], r["raw_total"], r["pivot_total"], r["difference"]) for r in Q.pivot_reconciliation(counts, rows).collect())
    assert out == [("all", "Ana", 2, 2, 0), ("all", "Bo", 1, 0, 1), ("all", "Cy", 1, 1, 0), ("all", "Unmapped", 1, 0, 1),
                   ("paid", "Ana", 1, 1, 0), ("paid", "Bo", 1, 0, 1), ("paid", "Unmapped", 1, 0, 1)]
    paid = leads.where("lead_type = 'Paid'")
    one = Q.compare_pivot_totals(paid, rows.where("sheet = 'paid'"), "owner", "paid")
    assert sorted((r["pivot_name"], r["group"], r["raw_total"], r["pivot_total"], r["difference"]) for r in one.collect()) == [o for o in out if o[0] == "paid"]


def test_source_coverage_without_joins(spark):
    leads = spark.createDataFrame([("Google",), ("Only CRM",), (None,), ("Unmapped",)], "normalized_source string")
    alloc = spark.createDataFrame([("Google",), ("Only budget",)], "source string")
    enr = spark.createDataFrame([("Google",), ("Only tracker",), ("Only CRM",)], "normalized_source string")
    out = Q.source_coverage(leads, enr, alloc)
    assert sorted(tuple(r) for r in out.collect()) == [
        ("Budget source not found in HubSpot", "Only budget"), ("HubSpot source not found in budget", "Only CRM"),
        ("Tracker source not found in budget", "Only CRM"), ("Tracker source not found in budget", "Only tracker")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
