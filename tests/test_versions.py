"""Versioned tables: atomic commits, failed and competing writers, pruning, freshness without scans."""

import pytest
from pyspark.sql import functions as F

from funnelspark.sources import versions as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_versions_carry_tables_on_and_stay_readable(spark, root):
    a, b = spark.range(3), spark.range(2).withColumn("x", F.lit("é"))
    assert V.commit_tables(spark, root, {"a": a, "b": b}, at="2026-06-09 12:00:00") == 1
    assert V.commit_tables(spark, root, {"a": spark.range(10)}) == 2
    now = V.read_tables(spark, root)
    assert now["a"].count() == 10 and rows(now["b"]) == [(0, "é"), (1, "é")]
    assert rows(V.read_tables(spark, root, ["a"], version=1)["a"]) == [(0,), (1,), (2,)]
    assert rows(V.stored_tables(spark, root)) == [("a", 10, 2, ""), ("b", 2, 1, "")]
    empty = V.read_tables(spark, root, {"b": "id long, x string", "c": "y int"})
    assert empty["c"].columns == ["y"] and empty["c"].count() == 0 and empty["b"].count() == 2
    with pytest.raises(KeyError):
        V.read_tables(spark, root, ["c"])
    with pytest.raises(KeyError):
        V.manifest(spark, root, 9)
    with pytest.raises(ValueError):
        V.commit_tables(spark, root, {"_commits": a})


def test_a_failed_save_changes_nothing(spark, root):
    V.commit_tables(spark, root, {"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(5).withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        V.commit_tables(spark, root, {"a": spark.range(100), "b": broken})
    assert V.version_numbers(spark, root) == [1]
    now = V.read_tables(spark, root)
    assert now["a"].count() == 3 and now["b"].count() == 4
    assert V.commit_tables(spark, root, {"b": spark.range(6)}) == 2  # and the next one goes on from there


def test_two_writers_of_one_version(spark, root, monkeypatch):
    V.commit_tables(spark, root, {"a": spark.range(1)})
    first = V.manifest

    def meanwhile(s, r, version=None):
        out = first(s, r, version)
        monkeypatch.setattr(V, "manifest", first)
        V.commit_tables(s, r, {"a": s.range(2)})  # another save, after this one has read version 1
        return out

    monkeypatch.setattr(V, "manifest", meanwhile)
    with pytest.raises(V.CommitConflict):
        V.commit_tables(spark, root, {"a": spark.range(3)})
    assert V.read_tables(spark, root)["a"].count() == 2 and V.version_numbers(spark, root) == [1, 2]


def test_a_dead_writers_claim_is_passed_over_after_a_while(spark, root, tmp_path, monkeypatch):
    V.commit_tables(spark, root, {"a": spark.range(1)})
    (tmp_path / "store/_commits/0000000002.claim").touch()
    with pytest.raises(V.CommitConflict):
        V.commit_tables(spark, root, {"a": spark.range(2)})
    monkeypatch.setattr(V, "CLAIM_SECONDS", 0)
    assert V.commit_tables(spark, root, {"a": spark.range(2)}) == 2


def test_a_month_is_read_without_the_others(spark, root):
    days = spark.range(90).select("id", F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("at"))
    days = days.unionByName(spark.createDataFrame([(99, None)], "id long, at timestamp")).withColumn("month", V.month_of(F.col("at")))
    V.commit_tables(spark, root, {"days": days}, partitions={"days": ["month"]})
    read = V.read_tables(spark, root)["days"]
    assert read.columns == days.columns and read.count() == 91
    feb = read.where("month = '2026-02'")
    plan = feb._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2026-02" in plan
    assert feb.count() == 28 and {f.split("month=")[1].split("/")[0] for f in feb.inputFiles()} >= {"2026-02"}
    assert read.where("month = 'none'").first()["id"] == 99


def test_freshness_reads_no_column(spark, root, tmp_path):
    never = V.stored_freshness(spark, root, "2026-06-10 18:00:00", ["a"]).first()
    assert (never["last_refresh"], never["stale"], never["empty_tables"], never["has_cache"]) == (None, True, ["a"], False)
    V.commit_tables(spark, root, {"a": spark.range(3), "none": spark.range(0)}, at="2026-06-09 12:00:00")
    late = V.stored_freshness(spark, root, "2026-06-10 18:00:00", ["a", "gone"]).first()
    assert (late["age_hours"], late["stale"], late["empty_tables"], late["has_cache"]) == (30.0, True, ["gone", "none"], True)
    assert V.stored_freshness(spark, root, "2026-06-10 11:00:00").first()["stale"] is False
    spark.range(7).write.parquet(str(tmp_path / "plain"))
    plain = V.folder_freshness(spark, {"plain": str(tmp_path / "plain")}, "2100-01-01 00:00:00")
    assert "ReadSchema: struct<>" in plain._jdf.queryExecution().executedPlan().toString()
    row = plain.first()
    assert row["rows"] == 7 and row["age_hours"] > 24 and row["last_written"].year >= 2024


def test_old_versions_go_with_the_files_only_they_used(spark, root, tmp_path):
    V.commit_tables(spark, root, {"a": spark.range(1), "b": spark.range(1)})
    V.commit_tables(spark, root, {"a": spark.range(2)})
    V.commit_tables(spark, root, {"a": spark.range(3)})
    assert V.expire_versions(spark, root, 5) == [] and V.expire_versions(spark, root, 1) == [1, 2]
    now = V.read_tables(spark, root)
    assert now["a"].count() == 3 and now["b"].count() == 1
    assert len(list((tmp_path / "store/a").iterdir())) == 1
    with pytest.raises(KeyError):
        V.read_tables(spark, root, version=1)


def test_a_folders_version_follows_its_files(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t/x"))
    before = V.folder_version(spark, str(tmp_path / "t"))
    assert V.folder_version(spark, str(tmp_path / "t")) == before
    spark.range(1).write.mode("append").parquet(str(tmp_path / "t/x"))
    assert V.folder_version(spark, str(tmp_path / "t")) != before
