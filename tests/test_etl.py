"""Entity build and revenue fact: owner attribution, no double counting, tuition base, closed flags."""

from pyspark.sql import functions as F

from funnelspark.operators.entities import association_links, contacts_base, deals_clean
from funnelspark.operators.fact import build_contacts_clean, contact_deal_summary, lead_deal_fact

TODAY = "2026-06-10 00:00:00"
MAPPING = {"contact": {"contact_id": "hs_object_id", "contact_created_at": "createdate", "program": "program",
                       "enrollment_status": "enrollment_status", "email": "email", "lead_status": "hs_lead_status"},
           "deal": {"deal_id": "hs_object_id", "deal_created_at": "createdate", "deal_stage": "dealstage",
                    "close_date": "closedate", "deal_amount": "amount"}}
CONTACT_SCHEMA = ("hs_object_id string, createdate string, hubspot_owner_id string, email string, hs_lead_status string, "
                  "program string, enrollment_status string, standard_tuition_total string, utm_source string")
DEAL_SCHEMA = "hs_object_id string, createdate string, hubspot_owner_id string, dealstage string, closedate string, amount string"


def _build(spark, contacts, deals, links, owners=None, deal_schema=DEAL_SCHEMA):
    c = spark.createDataFrame(contacts, CONTACT_SCHEMA)
    d = spark.createDataFrame(deals, deal_schema)
    a = spark.createDataFrame(links, "contact_id string, deal_id string, association_type string")
    o = spark.createDataFrame(owners or [("o1", "Ana", "ana@x"), ("o2", "", "bo@x")], "owner_id string, salesman_name string, email string")
    base = contacts_base(c, o, MAPPING)
    dc = deals_clean(d, MAPPING)
    ln = association_links(a)
    cc = build_contacts_clean(base, dc, ln, o, TODAY)
    return cc, dc, lead_deal_fact(cc, dc, ln, o)


def test_owner_from_contact_else_deal(spark):
    contacts = [("1", "2026-01-01T00:00:00Z", "o1", "a@x", "", "", "", "0", ""),
                ("2", "2026-01-01T00:00:00Z", "", "b@x", "", "", "", "0", "")]
    deals = [("10", "2026-02-01T00:00:00Z", "o2", "Open", "", "100"), ("11", "2026-02-01T00:00:00Z", "o2", "Open", "", "100")]
    _, _, fact = _build(spark, contacts, deals, [("1", "10", None), ("2", "11", None)])
    rows = {r.contact_id: r for r in fact.collect()}
    assert rows["1"].attribution_type == "contact_owner" and rows["1"].salesman_name == "Ana"
    assert rows["2"].attribution_type == "fallback_to_deal_owner" and rows["2"].salesman_name == "bo@x"


def test_shared_won_deal_counted_once(spark):
    contacts = [("1", "2026-01-01T00:00:00Z", "o1", "a@x", "", "", "", "0", ""),
                ("2", "2026-01-01T00:00:00Z", "o1", "b@x", "", "", "", "0", "")]
    deals = [("10", "2026-02-01T00:00:00Z", "o1", "Closed Won", "2026-03-01T00:00:00Z", "1000")]
    _, _, fact = _build(spark, contacts, deals, [("1", "10", None), ("2", "10", None)])
    won = fact.where("deal_id = '10'")
    assert won.agg(F.sum("revenue_attributed")).first()[0] == 1000
    assert won.where("revenue_countable").count() == 1
    assert won.where("unclear_revenue_attribution").count() == 2
    countable = won.where("revenue_countable").first()
    assert countable.contact_id == "1"  # first link in association order carries the revenue


def test_fact_shape_and_record_types(spark):
    contacts = [("1", "2026-01-01T00:00:00Z", "o1", "", "", "", "", "0", ""),
                ("3", "2026-01-01T00:00:00Z", "o1", "", "", "", "", "0", "")]
    deals = [("10", "2026-02-01T00:00:00Z", "o1", "Open", "", "5"), ("12", "2026-02-01T00:00:00Z", "o1", "Open", "", "5")]
    _, _, fact = _build(spark, contacts, deals, [("1", "10", None), ("missing", "10", None)])
    types = {(r.fact_record_type, r.contact_id, r.deal_id) for r in fact.collect()}
    assert ("contact_without_deal", "3", None) in types
    assert ("deal_without_contact", None, "12") in types
    assert ("associated", "missing", "10") in types  # link to an unknown contact keeps its id
    assert fact.count() == 2 + 1 + 1


def test_contact_tuition_is_program_revenue_base(spark):
    contacts = [("1", "2026-01-01T00:00:00Z", "o1", "", "", "Bachelor of Science", "", "48000", "")]
    deals = [("10", "2026-02-01T00:00:00Z", "o1", "Closed Won", "2026-03-01T00:00:00Z", "500")]
    _, _, fact = _build(spark, contacts, deals, [("1", "10", None)])
    r = fact.first()
    assert r.program_revenue_source == "contact_program_total_tuition"
    assert r.program_duration_months == 48 and r.monthly_program_revenue == 1000
    assert r.twelve_month_revenue == 12000 and r.revenue_confidence == "Medium"


def test_mba_ea_signed_is_enrolled_revenue(spark):
    contacts = [("1", "2026-01-01T00:00:00Z", "o1", "", "", "MBA", "EA Signed", "0", "")]
    cc, _, _ = _build(spark, contacts, [("10", "2026-02-01T00:00:00Z", "o1", "Open", "", "5")], [])
    r = cc.first()
    assert r.enrolled_revenue == 32799 and r.potential_revenue == 0


def test_closed_flags_decide_when_present(spark):
    schema = DEAL_SCHEMA + ", hs_is_closed_won string, hs_is_closed string"
    deals = [("10", "2026-02-01T00:00:00Z", "o1", "appointmentscheduled", "", "5", "true", "true"),
             ("11", "2026-02-01T00:00:00Z", "o1", "closedwon", "", "5", "false", "true"),
             ("12", "2026-02-01T00:00:00Z", "o1", "x", "", "5", "", "")]
    d = deals_clean(spark.createDataFrame(deals, schema), MAPPING)
    got = {r.deal_id: (r.is_won, r.is_lost) for r in d.collect()}
    assert got == {"10": (True, False), "11": (False, True), "12": (False, False)}


def test_deal_summary_latest_stage_and_fallback_owner(spark):
    deals = spark.createDataFrame([("10", "o2", "Stage A", "2026-01-01 00:00:00", False, False),
                                   ("11", None, "Stage B", "2026-02-01 00:00:00", True, False),
                                   ("12", "o1", "  ", None, False, True)],
                                  "deal_id string, deal_owner_id string, deal_stage string, deal_created_at string, is_won boolean, is_lost boolean")
    deals = deals.withColumn("deal_created_at", F.col("deal_created_at").cast("timestamp"))
    links = spark.createDataFrame([("1", "10", None), ("1", "11", None), ("1", "12", None)],
                                  "contact_id string, deal_id string, association_type string")
    r = contact_deal_summary(links, deals).first()
    assert (r.has_open_deal, r.has_won_deal, r.has_lost_deal) == (True, True, True)
    assert r.fallback_deal_owner_id == "o2" and r.latest_deal_stage == "Stage B"
