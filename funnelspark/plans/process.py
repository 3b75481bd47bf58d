"""The CRM DAG as one lazy plan, plus a silver-table cache.

raw contacts/deals/owners/links/activities -> contacts_base, deals_clean, activity_events
-> contact_deal_summary (links ⋈ deals) -> enriched + scored contacts_clean -> lead_deal_fact.

``silver(spark, sf_dir)`` materialises contacts_clean, deals_clean and the fact (and, when asked for, the events) once
per session as Parquet below ``spark.checkpoint.dir`` (shared storage on a cluster; survives
executor loss), so every gold query reads only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as R
from ..operators.cohorts import cohort_contacts, cohort_fields
from ..operators.entities import activity_events, association_links, contacts_base, deals_clean
from ..operators.fact import build_contacts_clean, lead_deal_fact
from ..operators.journey import student_journey_fact
from ..operators.kpi import paid_vendor_performance, salesman_metrics, vendor_costs
from ..session import cut_lineage
from ..sources import crm_view
from ..sources.versions import folder_version

_CACHE: dict[tuple, tuple[str, dict[str, DataFrame]]] = {}


def process_crm(raw: dict[str, DataFrame], today, mapping=None, materialize=None) -> dict[str, DataFrame]:
    """The full DAG.  ``materialize`` (e.g. ``cut_lineage``) is applied at stage boundaries so each
    stage is planned over a short lineage and no stage is recomputed by the next one."""
    mapping = R.DEFAULT_MAPPING if mapping is None else mapping
    cut = materialize or (lambda df: df)
    owners = raw["owners"]
    deals = cut(deals_clean(raw["deals"], mapping))
    links = cut(association_links(raw["associations"]))
    base = contacts_base(raw["contacts"], owners, mapping)
    contacts = cut(build_contacts_clean(base, deals, links, owners, today))
    fact = cut(lead_deal_fact(contacts, deals, links, owners))
    out = {"contacts_clean": contacts, "deals_clean": deals, "lead_deal_fact": fact, "links": links, "owners": owners}
    if "activities" in raw:
        out["activity_events"] = cut(activity_events(raw["activities"], owners))
    return out


def gold_facts(tables: dict[str, DataFrame], costs: DataFrame, today) -> dict[str, DataFrame]:
    """The facts built on ``process_crm``'s tables: journeys, cohorts, vendors, salesmen."""
    contacts, fact, events = tables["contacts_clean"], tables["lead_deal_fact"], tables["activity_events"]
    return {
        "student_journey_fact": student_journey_fact(contacts, fact, events),
        "cohort_fact": cohort_fields(cohort_contacts(contacts, fact)),
        "vendor_fact": paid_vendor_performance(contacts.where("paid_lead_flag"), fact, vendor_costs(costs)),
        "salesman_revenue_fact": salesman_metrics(contacts, fact),
    }


class _Silver(dict):
    """Tables by name; the events are made when first asked for, as only journeys read them."""

    def __init__(self, tables: dict[str, DataFrame], events: Callable[[], DataFrame]):
        super().__init__(tables)
        self._events = events

    def __missing__(self, name: str) -> DataFrame:
        if name != "activity_events":
            raise KeyError(name)
        self[name] = self._events()
        return self[name]


def silver(spark: SparkSession, sf_dir: str, materialize: bool = True) -> dict[str, DataFrame]:
    """Silver tables for the CRM view over ``sf_dir`` (cached per session and folder, until a file below it changes)."""
    key, version = (spark.sparkContext.applicationId, sf_dir, materialize), folder_version(spark, sf_dir)
    if _CACHE.get(key, ("", {}))[0] != version:
        raw, cut = crm_view.raw_crm(spark, sf_dir), cut_lineage if materialize else None
        activities = raw.pop("activities")
        tables = process_crm(raw, crm_view.TODAY, materialize=cut)
        _CACHE[key] = version, _Silver(tables, lambda: (cut or (lambda df: df))(activity_events(activities, raw["owners"])))
    return _CACHE[key][1]


def clear_cache() -> None:
    _CACHE.clear()
