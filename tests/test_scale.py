"""What keeps the shared steps in proportion to their input: spread small files, rules on distinct values only."""

import os

from pyspark.sql import functions as F

from funnelspark.functions import classify
from funnelspark.functions.expr import clean_text, number_column, strip_ws, with_parsed_datetimes
from funnelspark.functions.numbering import numbered
from funnelspark.functions.tuition import add_program_tuition_fields
from funnelspark.operators import budget, fact, journey
from funnelspark.plans import process, registry
from funnelspark.sources import crm_view, landed


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _customers(spark, tmp_path, n=40):
    rows = spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")


def test_source_rules_run_on_distinct_values(spark):
    df = spark.createDataFrame([("Google",), (" google ",), (None,), ("",), ("x  y",)], "normalized_source string")
    out = classify.source_set(df)
    assert {r.source for r in out.collect()} == {r.s for r in df.where("normalized_source is not null").select(
        classify.normalize_source_value(F.col("normalized_source")).alias("s")).distinct().collect()} - {classify.R.UNKNOWN_SOURCE}
    plan = _plan(out)
    per_row = plan[plan.rindex("Aggregate"):].splitlines()[1:]  # below the first distinct
    assert "regexp_replace" not in "".join(per_row)


def test_small_customer_file_is_spread(spark, tmp_path):
    _customers(spark, tmp_path)
    contacts = crm_view.contacts(spark, str(tmp_path))
    assert contacts.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.hs_object_id) for r in contacts.collect()) == list(range(40))


def test_small_customer_file_is_spread_for_leads(spark, tmp_path):
    _customers(spark, tmp_path)
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.lit("x").alias("n_name")).write.parquet(f"{tmp_path}/nation.parquet")
    leads = crm_view.leads(spark, str(tmp_path))
    assert leads.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert leads.count() == 40


def test_price_pages_are_written_by_many_tasks(spark, tmp_path):
    n = 40 * landed.PARTS_PER_PAGE
    spark.range(n).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice")).coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet")
    folder = landed.land_price_pages(spark, str(tmp_path), f"{tmp_path}/prices")
    files = [f for _, _, names in os.walk(folder) for f in names if f.startswith("part-")]
    assert len(files) == 40 and len({f[:10] for f in files}) > 1


def test_texts_are_stripped_without_regular_expressions(spark):
    df = spark.createDataFrame([(" \t\n\x0b\f\ra b\n ",), ("",), (" \n",), (None,), (" x",)], "t string")
    assert [r.s for r in df.select(strip_ws(F.col("t")).alias("s")).collect()] == ["a b", "", "", None, " x"]
    assert "regexp_replace" not in _plan(df.select(clean_text(F.col("t"), "na")))


def test_times_are_never_cast_to_numbers(spark):
    df = spark.createDataFrame([("2001-01-02T03:04:05.000Z", "996710400000"), (" 2001-01-02 03:04:05", " 1e12 "), (None, "x"), ("", "996710400000")], "a string, b string")
    got = with_parsed_datetimes(df, ["a", "b"]).select(F.unix_seconds("a").alias("a"), F.unix_seconds("b").alias("b")).collect()
    assert [tuple(r) for r in got] == [(978404645, 996710400), (978404645, 1000000000), (None, None), (None, 996710400)]
    assert "contains(" in _plan(with_parsed_datetimes(df, ["a"])).lower()


def test_level_text_is_cleaned_once_per_row(spark):
    df = spark.createDataFrame([("  MBA ",), ("Doctor of x",), (None,), ("nan",)], "program string")
    out = add_program_tuition_fields(df)
    assert [r.program_degree_level for r in out.collect()] == ["Master", "Doctoral", None, None]
    assert _plan(out).lower().count("lower(trim(program") == 1


def test_events_are_made_when_asked_for():
    made = []
    tables = process._Silver({"links": 1}, lambda: made.append(1) or "events")
    assert tables["links"] == 1 and not made
    assert tables["activity_events"] == tables["activity_events"] == "events" and made == [1]


def test_ledger_is_grouped_by_owner_before_keys_are_made(spark):
    leads = spark.createDataFrame([("Ann B", "", "", "", "", "Paid", None)],
                                  "contact_owner string, lead_status string, lifecycle_stage string, record_id string, email string, lead_type string, last_activity_date timestamp")
    enr = spark.createDataFrame([("Ann B", "s1", 10.1, 4.0, "t"), ("ann  c", "s2", 0.2, None, "t"), ("UDR 7", "s3", 5.0, 1.0, "u"), (None, "s4", None, None, "u"), (" ", "s5", 2.0, 3.0, "u")],
                                "udr string, student string, revenue double, days_to_enroll double, term_label string")
    terms = spark.createDataFrame([], "budget_name string, term string, term_metric string, term_value double")
    allocations = spark.createDataFrame([], "budget_name string, planned_budget double")
    out = budget.udr_performance(leads, enr, terms, allocations)
    got = {r._udr_key: (r.udr, r.actual_enrollments, r.revenue, r.average_days_to_enroll, r.leads) for r in out.collect()}
    assert got == {"ann": ("Ann B", 2.0, 10.3, 4.0, 1.0), "udr 7": ("UDR 7", 1.0, 5.0, 1.0, 0.0), "missing": ("Missing", 2.0, 2.0, 3.0, 0.0)}
    ledger = [part for part in _plan(out).split("Aggregate") if "student" in part]
    assert any(part.lstrip().startswith("[udr#") for part in ledger)


def test_numbering_sorts_its_rows_once(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("x")).repartition(5)
    out = numbered(df, ["x", "k"], "n")
    assert out.columns == ["k", "x", "n"]
    rows = out.collect()
    want = sorted(rows, key=lambda r: (r.x is not None, r.x or "", r.k))
    assert [r.n for r in want] == list(range(1, 1001))
    assert "row_number" not in _plan(out)


def _fact_inputs(spark):
    contacts = spark.createDataFrame([("1", 1, "7", "MBA", None, None, "ea signed", 0.0), ("2", 2, None, "", None, None, "", 100.0), ("3", 3, "8", "DBA", None, None, None, 0.0)],
                                     "contact_id string, _seq long, contact_owner_id string, program string, degree_level string, revenue_confidence string, "
                                     "enrollment_status string, program_total_tuition double")
    contacts = contacts.selectExpr("*", "'x' as salesman_name", "contact_owner_id as salesman_id",
                                   "timestamp'2001-01-01' as contact_created_at", "cast(50 as double) as estimated_total_tuition", "'c' as city")
    deals = spark.createDataFrame([("a", 1, "8", "Closed Won", 10.0, True, False), ("b", 2, None, "Open", 5.0, False, False), ("z", 3, "9", "Closed Won", 4.0, True, False)],
                                  "deal_id string, _deal_seq long, deal_owner_id string, deal_stage string, revenue double, is_won boolean, is_lost boolean")
    deals = deals.selectExpr("*", "timestamp'2001-01-02' as deal_created_at", "timestamp'2001-01-11' as close_date")
    links = spark.createDataFrame([("1", "a", "t"), ("2", "a", "t"), ("none", "b", "t")], "contact_id string, deal_id string, association_type string")
    owners = spark.createDataFrame([("7", "Ann", ""), ("8", "Bob", "")], "owner_id string, salesman_name string, email string")
    return contacts, deals, links, owners


def test_program_rules_run_once_per_contact(spark):
    out = fact.lead_deal_fact(*_fact_inputs(spark))
    got = {(r.contact_id, r.deal_id): r for r in out.collect()}
    assert set(got) == {("1", "a"), ("2", "a"), ("none", "b"), ("3", None), (None, "z")}
    assert [got[k].salesman_name for k in [("1", "a"), ("2", "a"), ("none", "b"), ("3", None), (None, "z")]] == ["Ann", "Bob", "Unassigned", "Bob", "Unassigned"]
    assert got["1", "a"].program_degree_level == "Master" and got["1", "a"].enrolled_revenue == got["1", "a"].potential_program_revenue > 0
    assert got["1", "a"].program_revenue_input == 10.0 and got["1", "a"].program_revenue_source == "deal_revenue" and got["1", "a"].days_to_close == 10
    assert got["2", "a"].program_revenue_input == 0.0 and got["2", "a"].city == "c" and got["none", "b"].city is None
    for key in [("none", "b"), (None, "z")]:  # rows without a contact have what a contact without a program has
        assert (got[key].revenue_confidence, got[key].tuition_estimate_source, got[key].potential_program_revenue) == ("Low", "unmatched_program", 0.0)
        assert got[key].duration_note.startswith("Program missing") and got[key].program_degree_level is None
    plan = _plan(out)
    assert "mscis" in plan and "mscis" not in plan[:plan.index("Join")].lower()
    widths = [line.split("[", 1)[1].count("#") for line in plan.splitlines() if line.strip(" :+-").startswith("Project [")]
    assert "__contact" in plan and sum(w > 80 for w in widths) <= 1


def test_numbers_are_not_read_from_their_text(spark):
    df = spark.createDataFrame([(1.5, 3, "2.5"), (None, None, "x"), (-0.5, -1, " 7 ")], "a double, b long, c string")
    out = df.select(*[number_column(df, c, floor_zero=True, fill=0).alias(c) for c in df.columns])
    assert [tuple(r) for r in out.collect()] == [(1.5, 3.0, 2.5), (0.0, 0.0, 0.0), (0.0, 0.0, 7.0)]
    assert "cast(a" not in _plan(out) and "as string" not in _plan(out)


def test_empty_text_is_no_number_and_is_not_cast(spark):
    df = spark.createDataFrame([("",), ("996710400000",), ("996710400000",)], "t string")
    out = with_parsed_datetimes(df, ["t"])
    assert [r.t is None for r in out.collect()] == [True, False, False]
    assert "NOT (t#" in _plan(out).replace("((", "(")


def test_owner_map_takes_rows_that_are_not_landed_as_they_are(spark, tmp_path, monkeypatch):
    spark.range(1).write.parquet(f"{tmp_path}/x.parquet")
    landed_rows, rows, folder = spark.range(2), spark.range(3), str(tmp_path)
    monkeypatch.setattr(registry, "_LANDED", {})
    make = lambda s, d: rows
    assert registry._landed_or(spark, folder, "t", make) is rows and not registry._LANDED
    registry._landed(spark, folder, "t", lambda: landed_rows)
    assert registry._landed_or(spark, folder, "t", make) is landed_rows
    spark.range(1).write.parquet(f"{tmp_path}/y.parquet")
    assert registry._landed_or(spark, folder, "t", make) is rows


def _journey_inputs(spark):
    dates = ["owner_assigned_date", "first_outreach_date", "first_engagement_date", "application_date", "enrollment_date", "last_sales_activity_timestamp",
             "last_activity_date", "next_activity_date"]
    contacts = spark.createDataFrame([("1",), ("1",), ("2",), ("4",), (None,)], "contact_id string").selectExpr(
        "*", "'Ann' as salesman_name", "if(contact_id = '4', null, timestamp'2001-01-01') as contact_created_at", "'hot' as lead_temperature", "false as has_open_deal",
        "3.0D as num_notes", *[f"cast(null as timestamp) as {c}" for c in dates], "'' as start_term", "cast(null as double) as time_to_first_engagement")
    deals = spark.createDataFrame([("1", "a"), ("none", "b"), (None, "c"), (" ", "d")], "contact_id string, deal_id string").selectExpr(
        "*", "'Bo' as salesman_name", "'Open' as deal_stage", "false as is_won", "false as is_lost", "timestamp'2001-01-05 00:00:30' as deal_created_at",
        "cast(null as timestamp) as close_date")
    events = spark.createDataFrame([("1", "2001-01-05 00:00:10"), ("1", "2001-01-05 00:00:50"), ("1", "2001-01-09 00:00:30"), ("1", None), ("none", "2001-01-02"), (None, "2001-01-03"),
                                    ("4", "2001-02-01"), ("4", "2001-02-04")], "contact_id string, at string").selectExpr(
        "contact_id", "cast(at as timestamp) as event_date", "'Call' as event_type", "'Cy' as owner", "'' as description", "'' as outcome")
    return contacts, deals, events


def test_journeys_make_no_list_of_contacts_to_broadcast(spark):
    inputs = _journey_inputs(spark)
    out = journey.journey_events(*inputs)
    rows = sorted((r.contact_id, str(r.event_date), r.event_type, r.days_since_previous_event) for r in out.collect())
    assert rows == [("1", "2001-01-01 00:00:00", "Contact created", 0), ("1", "2001-01-01 00:00:00", "Contact created", 0), ("1", "2001-01-05 00:00:10", "Call", 4),
                    ("1", "2001-01-05 00:00:30", "Deal created", 0), ("1", "2001-01-05 00:00:50", "Call", 0), ("1", "2001-01-09 00:00:30", "Call", 3),
                    ("1", "None", "Call", 0), ("2", "2001-01-01 00:00:00", "Contact created", 0), ("4", "2001-02-01 00:00:00", "Call", 0), ("4", "2001-02-04 00:00:00", "Call", 3)]
    assert "Join" not in _plan(out) and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    metrics = journey.journey_metrics(*inputs, "2001-03-01 00:00:00")
    got = sorted((r.contact_id, r.number_of_calls, r.number_of_sales_touches, r.days_from_lead_creation_to_deal_creation) for r in metrics.collect())
    assert got == [("1", 4, 4, 4), ("1", 4, 4, 4), ("2", 0, 3, None), ("4", 2, 2, None)]
    assert "LeftSemi" not in _plan(metrics)
