"""KPIs, pipeline health, cohorts, journeys, uploaded leads and budget grids on hand-made frames."""

import datetime as dt


from funnelspark.operators import budget as B
from funnelspark.operators import cohorts as C
from funnelspark.operators import enrollment as E
from funnelspark.operators import journey as J
from funnelspark.operators import kpi as K
from funnelspark.operators import pipeline as P

NOW = dt.datetime(2026, 6, 10)
CONTACT = ("contact_id string, _seq long, salesman_name string, paid_lead_flag boolean, lead_temperature string, "
           "has_open_deal boolean, has_won_deal boolean, has_lost_deal boolean, days_since_last_activity long, lead_age_days long, "
           "never_contacted boolean, open_pipeline_potential_revenue double, potential_program_revenue double, "
           "potential_revenue double, enrolled_revenue double, revenue_confidence string, contact_created_at timestamp, "
           "last_activity_date timestamp, next_activity_date timestamp, num_notes double, lead_status string, "
           "enrollment_status string, lifecycle_stage string, cohort string, start_term string, program string, "
           "paid_vendor string, time_to_first_engagement double")
FACT = ("contact_id string, deal_id string, salesman_name string, deal_countable boolean, is_won boolean, is_lost boolean, "
        "paid_lead_flag boolean, revenue_attributed double, total_program_revenue double, days_to_close long, "
        "close_date timestamp, closed_won_date timestamp, deal_created_at timestamp, deal_stage string, has_won_deal boolean")


def _c(spark, rows):
    return spark.createDataFrame(rows, CONTACT)


def _f(spark, rows):
    return spark.createDataFrame(rows, FACT)


def _contacts(spark):
    d = NOW - dt.timedelta(days=40)
    return _c(spark, [
        ("1", 1, "Ana", True, "Hot", True, False, False, 2, 40, False, 30000.0, 30000.0, 30000.0, 0.0, "Medium", d, d, NOW, 3.0,
         "Responded", "", "lead", "", "", "MBA", "Meta", 3600000.0),
        ("2", 2, "Ana", True, "Dead", False, True, False, None, 40, True, 0.0, 32799.0, 0.0, 32799.0, "Low", d, None, None, 0.0,
         "", "EA Signed", "lead", "Official 2026A", "", "MBA", "Meta", None),
        ("3", 3, "Bo", False, "Cold", True, False, True, 20, 40, False, 10.0, 10.0, 10.0, 0.0, "High", d, d, None, 1.0,
         "Dead Lead", "", "", "", "2026 Fall I", "", "Google", 7200000.0),
    ])


def _fact(spark):
    return _f(spark, [
        ("2", "10", "Ana", True, True, False, True, 1000.0, 32799.0, 5, NOW, None, NOW - dt.timedelta(days=5), "Closed Won", True),
        ("3", "11", "Bo", True, False, True, False, 0.0, 0.0, None, NOW, None, NOW - dt.timedelta(days=3), "Closed Lost", False),
        (None, "12", "Bo", True, True, False, False, 500.0, 500.0, 7, NOW, None, NOW, "Closed Won", False),
    ])


def test_executive_and_salesman(spark):
    ex = K.executive_metrics(_contacts(spark), _fact(spark)).first()
    assert (ex.total_leads, ex.paid_leads, ex.organic_leads, ex.hot_leads, ex.dead_leads, ex.won_deals) == (3, 2, 1, 1, 1, 2)
    assert ex.total_program_revenue == 33299.0 and ex.median_days_to_close == 6.0 and ex.close_rate == 2 / 3
    sm = {r.salesman_name: r for r in K.salesman_metrics(_contacts(spark), _fact(spark)).collect()}
    ana = sm["Ana"]
    assert ana.paid_lead_leakage == 0 and ana.action_load == 2 and ana.actual_enrolled_revenue == 1000.0
    assert ana.estimated_enrolled_revenue == 32799.0 and ana.revenue_confidence_mix == "High: 0 / Medium: 1 / Low: 1"
    assert sm["Bo"].estimated_enrolled_revenue == 500.0  # contact-less won deal de-duplicated by deal


def test_exact_median_even_and_grouped(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("a", 20), ("b", 5)], "g string, v long")
    got = {r.g: r.median for r in K.exact_median(df, "v", ["g"]).collect()}
    assert got == {"a": 6.0, "b": 5.0}


def test_stuck_and_quality(spark):
    s = K.stuck_leads(_contacts(spark)).first()
    assert s.leads_no_activity_7_days == 2 and s.paid_leads_with_no_activity == 1


def test_pipeline_status_precedence(spark):
    p = {r.contact_id: r for r in P.pipeline_contacts(_contacts(spark), _fact(spark)).collect()}
    assert p["2"].pipeline_status == "Enrolled / Closed Won"   # enrolled overrides dead
    assert p["3"].pipeline_status == "Closed Lost / Dead"     # lost deal marks dead (T23)
    assert p["1"].pipeline_status == "Responded"
    path = {r.milestone: r.leads for r in P.enrollment_path(_contacts(spark), _fact(spark)).collect()}
    assert path == {"Lead created": 3, "Contacted": 2, "Application / deal created": 3, "Enrolled / closed won": 1,
                    "Closed lost / dead": 2}


def test_cohort_precedence(spark):
    prep = {r.contact_id: r for r in C.cohort_contacts(_contacts(spark), _fact(spark)).collect()}
    assert (prep["2"].cohort, prep["2"].cohort_source) == ("Official 2026A", "official cohort")
    assert (prep["3"].cohort, prep["3"].cohort_source) == ("2026 Fall I", "start_term")
    assert prep["3"].cohort_start_date == dt.datetime(2026, 8, 1)
    assert prep["1"].cohort_source == "contact created month" and prep["1"].cohort == (NOW - dt.timedelta(days=40)).strftime("%Y-%m")
    assert prep["1"].cohort_days_to_first_contact == 1 / 24


def test_journey_gaps_and_touches(spark):
    events = spark.createDataFrame([("1", NOW - dt.timedelta(days=30), "Call", "Ana", "c", ""),
                                    ("1", NOW - dt.timedelta(days=20), "Email", "Ana", "e", "")],
                                   "contact_id string, event_date timestamp, event_type string, owner string, description string, outcome string")
    ev = J.journey_events(_contacts(spark), _fact(spark), events).where("contact_id = '1'").orderBy("event_date", "event_type").collect()
    assert [r.days_since_previous_event for r in ev] == [0, 0, 10, 10, 20]  # created, last activity, call, email, next
    assert all(r.days_since_previous_event >= 0 for r in ev)
    m = {r.contact_id: r for r in J.journey_metrics(_contacts(spark), _fact(spark), events, "2026-06-10 00:00:00").collect()}
    assert m["1"].number_of_sales_touches == 2 and m["3"].number_of_sales_touches == 1  # num_notes when no activities
    assert m["2"].days_from_lead_creation_to_deal_creation == 35


def test_identity_column_per_subset(spark):
    leads = spark.createDataFrame([("", "a@x", "Kara Leads", "", "lead", "New"), ("", "a@x", "", "Website", "Applicant", ""),
                                   ("7", "b@x", "", "", "lead", "Dead Lead"), ("7", "", "", "", "lead", "")],
                                  "record_id string, email string, paid_lead_list string, organic_lead_list string, "
                                  "lifecycle_stage string, lead_status string")
    s = E.lead_summary(E.standardize_leads(leads, "t")).first()
    # total: record_id has a value -> distinct record ids = 1; paid subset has no record id -> distinct emails = 1
    assert (s.total_leads, s.paid_leads, s.organic_leads, s.applicants, s.bad_leads) == (1, 1, 1, 1, 1)


def test_budget_grid(spark):
    grid = [["", "UDR", "Budget", "SP2-A", "SP2-G", "SU2 -A", "SU2- G"],
            ["", "UDR 01", "42", "7", "10", "11", "14"],
            ["", "Total", "42", "7", "10", "11", "14"],
            ["", "Starts", "", "5", "", "8", ""],
            ["", "Start%", "", "0.7", "", "0.73", ""],
            ["", "Ignored", "99", "1", "1", "1", "1"],
            ["", "Budget", "42"]]
    cells = spark.createDataFrame([("S", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)],
                                  "sheet string, row int, col int, value string")
    alloc = B.budget_allocations(cells).collect()
    assert [(a.budget_name, a.planned_budget) for a in alloc] == [("UDR 01", 42.0)]
    terms = B.budget_term_allocations(cells)
    assert terms.where("budget_name = 'Ignored'").count() == 0
    su2 = B.roundup_term_stats(terms, ["Summer 2"]).first()
    assert (su2.goal, su2.actual, su2.starts) == (14.0, 11.0, 8.0) and abs(su2.start_rate - 8 / 11) < 1e-12
    annual = B.udr_budget_summary(terms, B.budget_allocations(cells)).first()
    assert (annual.budget_goal, annual.budget_sheet_actual) == (42.0, 18.0)
    summ = B.budget_summary_rows(cells)
    assert summ.where("metric = 'Budget'").count() == 1 and summ.count() == 3
