"""SURVEY §5 invariants over the CRM view of the driver tables (whole tables, sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

from funnelspark.operators.journey import journey_events
from funnelspark.plans.process import silver

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def s(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return silver(spark, SF)


def test_revenue_conserved(s):
    fact, deals = s["lead_deal_fact"], s["deals_clean"]
    attributed = fact.agg(F.sum("revenue_attributed")).first()[0]
    won = deals.where("is_won").dropDuplicates(["deal_id"]).agg(F.sum("revenue")).first()[0]
    assert round(attributed, 2) == round(won, 2)


def test_each_deal_countable_once(s):
    fact = s["lead_deal_fact"].where(F.col("deal_id").isNotNull())
    per_deal = fact.groupBy("deal_id").agg(F.count_if("revenue_countable").alias("n"))
    assert per_deal.where("n <> 1").count() == 0


def test_fact_rows_are_links_plus_anti_sets(s):
    fact, links, contacts, deals = s["lead_deal_fact"], s["links"], s["contacts_clean"], s["deals_clean"]
    anti_c = contacts.select("contact_id").distinct().join(links.select("contact_id").distinct(), "contact_id", "left_anti").count()
    anti_d = deals.select("deal_id").distinct().join(links.select("deal_id").distinct(), "deal_id", "left_anti").count()
    assert fact.count() == links.count() + anti_c + anti_d


def test_journey_gaps_non_negative(s):
    ev = journey_events(s["contacts_clean"], s["lead_deal_fact"], s["activity_events"])
    assert ev.where("days_since_previous_event < 0").count() == 0


def test_temperature_partitions_contacts(s):
    c = s["contacts_clean"]
    temps = {r[0] for r in c.select("lead_temperature").distinct().collect()}
    assert temps <= {"Hot", "Warm", "Cold", "Dead"}
    assert c.where(F.col("lead_temperature").isNull()).count() == 0
