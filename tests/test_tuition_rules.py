"""Tuition rules as tables: joined like folded, landed overrides, refreshed prices, price pages read whole."""

from pyspark.sql import functions as F

from funnelspark.functions import tuition as TU
from funnelspark.operators import textjobs as T

PROGRAMS = [("MBA",), ("Certificate in AI",), ("dba",), (None,), ("cooking",), ("BSBA",), ("Associate of Arts",)]


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_joined_rules_give_what_folded_ones_give(spark):
    df = spark.createDataFrame(PROGRAMS, "program string").withColumn("revenue_attributed", F.lit(1200.0))
    folded = TU.add_program_revenue_fields(df)
    joined = TU.add_program_revenue_fields(df, config=TU.tuition_table(spark))
    assert joined.columns == folded.columns and _sorted(joined) == _sorted(folded)


def test_a_level_without_a_rule_has_no_values(spark):
    df = spark.createDataFrame(PROGRAMS, "program string")
    rules = TU.tuition_table(spark).where("program_degree_level <> 'Master'")
    row = {r["program"]: r for r in TU.add_program_tuition_fields(df, config=rules).collect()}
    assert row["MBA"]["program_degree_level"] == "Master" and row["MBA"]["tuition_per_credit"] is None and row["MBA"]["duration_note"] == ""
    assert row["cooking"]["duration_note"].startswith("Program missing") and row["dba"]["credits_required"] == 61


def test_overrides_merge_field_by_field_and_the_newest_counts(spark):
    rules = TU.tuition_table(spark)
    over = spark.createDataFrame([("Master", 1, 900.0, "old"), ("Master", 3, None, "new"), ("Master", 2, 950.0, None), ("Executive", 1, 5.0, None),
                                  ("_comment", 9, 1.0, "x"), (None, 9, 1.0, "x")],
                                 "program_degree_level string, refreshed_at long, tuition_per_credit double, note string")
    got = {r["program_degree_level"]: r for r in TU.overridden(rules, over).collect()}
    assert set(got) == {"Certificate", "Associate", "Bachelor", "Master", "Doctoral", "Executive"}
    assert (got["Master"]["tuition_per_credit"], got["Master"]["note"], got["Master"]["credits_required"]) == (950.0, "new", 39.0)
    assert got["Executive"]["tuition_per_credit"] == 5.0 and got["Executive"]["duration_years"] is None
    assert _sorted(TU.overridden(rules, over.limit(0))) == _sorted(rules)
    assert _sorted(TU.overridden(rules, over.select("program_degree_level"))) == _sorted(rules)  # nothing to merge


def test_prices_of_the_newest_page(spark):
    prices = spark.createDataFrame([(1, "Master", 1, 2, 3, 4), (9, "Master", 5, 6, 7, 8), (3, "Doctoral", 9, 9, 9, 9)],
                                   "page_id int, program_degree_level string, tuition_per_credit long, credits_required long, estimated_total_tuition long, estimated_annual_tuition long")
    got = {r["program_degree_level"]: r for r in TU.refreshed_tuition(TU.tuition_table(spark), prices).collect()}
    assert [got["Master"][f] for f in TU.PRICE_FIELDS] == [5, 6, 7, 8] and got["Master"]["duration_months"] == 24
    assert got["Doctoral"]["tuition_per_credit"] == 9 and got["Bachelor"]["tuition_per_credit"] == 585


def test_pages_are_read_whole(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("Doctoral Degree\nPrograms\n$1,000\n10\n$10,000 $5,000\n")
    (tmp_path / "none.txt").write_text("Prices on request.\n")
    rows = T.extract_price_table(T.read_text_pages(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in rows] == [("a.b", "Doctoral", 1000, 10, 10000, 5000)]
