"""Pipeline health.

Contacts are joined once to a per-contact aggregate of the fact (actual revenue, has a deal row,
has a won row) — a grouped aggregate with map-side combine, so a contact with many fact rows
is collapsed before the shuffle.  Milestone and issue tables are one aggregate each, turned
into rows with ``stack``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import as_bool, clean_text, has_text, sum_money
from .kpi import grouped_distinct


def _pattern(terms) -> str:
    """Alternation of literal terms (the fixed terms hold no regex metacharacters)."""
    assert all(re.escape(t).replace("\\ ", " ") == t for t in terms)
    return "|".join(terms)


def enrolled_mask(df: DataFrame) -> Column:
    mask = (as_bool(F.col("has_won_deal")) if "has_won_deal" in df.columns else F.lit(False))
    if "is_won" in df.columns:
        mask = mask | as_bool(F.col("is_won"))
    pat = _pattern(R.PIPELINE_ENROLLED_TERMS)
    for c in R.PIPELINE_STATUS_COLUMNS:
        if c in df.columns:
            mask = mask | F.lower(clean_text(F.col(c), "na")).rlike(pat)
    if "enrolled_revenue" in df.columns:
        mask = mask | (F.coalesce(F.col("enrolled_revenue").cast("double"), F.lit(0.0)) > 0)
    return mask


def dead_mask(df: DataFrame) -> Column:
    mask = as_bool(F.col("has_lost_deal")) if "has_lost_deal" in df.columns else F.lit(False)
    if "lead_temperature" in df.columns:
        mask = mask | (F.lower(clean_text(F.col("lead_temperature"), "na")) == "dead")
    pat = _pattern(R.PIPELINE_DEAD_TERMS)
    for c in R.PIPELINE_DEAD_COLUMNS:
        if c in df.columns:
            mask = mask | F.lower(clean_text(F.col(c), "na")).rlike(pat)
    return mask


def first_available_status(df: DataFrame) -> Column:
    parts = [F.nullif(clean_text(F.col(c), "na"), F.lit("")) for c in R.PIPELINE_STATUS_COLUMNS if c in df.columns]
    temp = clean_text(F.col("lead_temperature"), "na") if "lead_temperature" in df.columns else F.lit("")
    parts.append(F.when(temp != "", F.concat(temp, F.lit(" Lead"))))
    return F.coalesce(*parts, F.lit("Missing Status"))


def formal_status_missing(df: DataFrame) -> Column:
    out = F.lit(True)
    for c in R.PIPELINE_STATUS_COLUMNS:
        if c in df.columns:
            out = out & ~has_text(F.col(c), "na")
    return out


def fact_by_contact(fact: DataFrame) -> DataFrame:
    """Per contact: actual revenue, has a deal row, has a won row."""
    cid = clean_text(F.col("contact_id"))
    has_deal = clean_text(F.col("deal_id")) != ""
    return (fact.where(cid != "").groupBy(cid.alias("contact_id")).agg(
        sum_money(F.col("revenue_attributed")).alias("__actual"),
        F.bool_or(has_deal).alias("__fact_deal"),
        F.bool_or(as_bool(F.col("is_won"))).alias("__fact_won")))


def pipeline_contacts(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    """Adds pipeline_status (dead then enrolled override), actual and potential revenue, masks."""
    out = contacts.where(F.col("contact_id").isNotNull())  # D4
    out = out.withColumns({"is_enrolled_pipeline": enrolled_mask(out), "is_dead_pipeline": dead_mask(out),
                           "formal_status_missing": formal_status_missing(out)})
    status = (F.when(F.col("is_enrolled_pipeline"), F.lit("Enrolled / Closed Won"))
              .when(F.col("is_dead_pipeline"), F.lit("Closed Lost / Dead"))
              .otherwise(first_available_status(out)))
    pot = "potential_revenue" if "potential_revenue" in out.columns else "open_pipeline_potential_revenue"
    out = out.withColumns({
        "pipeline_status": status,
        "pipeline_potential_revenue": F.coalesce(F.col(pot).cast("double"), F.lit(0.0)) if pot in out.columns else F.lit(0.0),
    })
    out = out.join(fact_by_contact(fact), "contact_id", "left")
    return out.withColumns({
        "actual_revenue": F.coalesce(F.col("__actual"), F.lit(0.0)),
        "__fact_deal": F.coalesce(F.col("__fact_deal"), F.lit(False)),
        "__fact_won": F.coalesce(F.col("__fact_won"), F.lit(False)),
    }).drop("__actual")


def _ids(cond: Column) -> Column:
    return F.countDistinct(F.when(cond, F.col("contact_id")))


def lead_status_summary(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    p = pipeline_contacts(contacts, fact).withColumn("status", F.col("pipeline_status"))
    paid = as_bool(F.col("paid_lead_flag"))
    stale = F.coalesce(F.col("days_since_last_activity").cast("double"), F.lit(9999.0)) >= 14
    g = grouped_distinct(p, ["status"], "contact_id", {
        "total leads": F.lit(True), "paid leads": paid, "hot leads": F.col("lead_temperature") == "Hot",
        "stale leads": stale, "dead leads": F.col("is_dead_pipeline"), "enrolled": F.col("is_enrolled_pipeline")},
        sums={"actual revenue": F.col("actual_revenue"), "potential revenue": F.col("pipeline_potential_revenue")})
    return g.orderBy(F.desc("total leads"), "status")


def bottleneck_action(status: Column, stuck_30: Column, stuck_14: Column) -> Column:
    low = F.lower(status)
    dead = None
    for t in R.PIPELINE_DEAD_TERMS:
        dead = low.contains(t) if dead is None else dead | low.contains(t)
    return (F.when(low.contains("missing"), "Assign a meaningful lead status.")
            .when(dead, "Confirm dead/lost reason and archive or nurture.")
            .when(stuck_30 > 0, "Manager review: clear next step or close out.")
            .when(stuck_14 > 0, "Schedule follow-up and update next activity.")
            .otherwise("Monitor normal movement."))


def stage_bottlenecks(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    p = pipeline_contacts(contacts, fact).withColumn("stage/status", F.col("pipeline_status"))
    inactive = F.coalesce(F.col("days_since_last_activity").cast("double"), F.lit(9999.0))
    open_ = ~F.col("is_enrolled_pipeline") & ~F.col("is_dead_pipeline")
    g = grouped_distinct(p, ["stage/status"], "contact_id", {
        "leads stuck 7+ days": open_ & (inactive >= 7), "leads stuck 14+ days": open_ & (inactive >= 14),
        "leads stuck 30+ days": open_ & (inactive >= 30)},
        means={"average age": F.coalesce(F.col("lead_age_days").cast("double"), F.lit(0.0))})
    g = g.withColumn("recommended action", bottleneck_action(F.col("stage/status"), F.col("leads stuck 30+ days"),
                                                             F.col("leads stuck 14+ days")))
    return g.orderBy(F.desc("leads stuck 30+ days"), F.desc("leads stuck 14+ days"), F.desc("leads stuck 7+ days"), "stage/status")


def _stacked(p: DataFrame, label: str, items: list[tuple[str, Column, str | None]]) -> DataFrame:
    """Distinct-contact counts per item from one two-stage aggregate, then ``stack`` into rows."""
    paid = as_bool(F.col("paid_lead_flag"))
    flags, sums = {}, {}
    for i, (_, mask, _) in enumerate(items):
        m = F.coalesce(mask, F.lit(False))
        flags[f"l{i}"], flags[f"p{i}"] = m, m & paid
        sums[f"r{i}"] = F.when(m, F.col("pipeline_potential_revenue"))
    agg = grouped_distinct(p.withColumn("__all", F.lit(0)), ["__all"], "contact_id", flags, sums=sums)
    with_action = any(a is not None for _, _, a in items)
    rows = []
    for i, (name, _, action) in enumerate(items):
        vals = [F.lit(i), F.lit(name), F.col(f"l{i}"), F.col(f"p{i}"), F.col(f"r{i}")]
        if with_action:
            vals.append(F.lit(action))
        rows.extend(vals)
    names = ["__order", label, "leads", "paid leads", "potential revenue"] + (["recommended action"] if with_action else [])
    args = ", ".join(f"`c{i}`" for i in range(len(rows)))
    return agg.select(*[v.alias(f"c{i}") for i, v in enumerate(rows)]).selectExpr(
        f"stack({len(items)}, {args}) AS ({', '.join('`' + n + '`' for n in names)})")


def enrollment_path(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    """Five non-exclusive milestones."""
    p = pipeline_contacts(contacts, fact)
    contacted = F.col("last_activity_date").isNotNull() | (F.coalesce(F.col("num_notes").cast("double"), F.lit(0.0)) > 0)
    has_deal = (F.col("__fact_deal") | as_bool(F.col("has_open_deal")) | as_bool(F.col("has_won_deal"))
                | as_bool(F.col("has_lost_deal")))
    items = [
        ("Lead created", F.lit(True), None),
        ("Contacted", contacted, None),
        ("Application / deal created", has_deal, None),
        ("Enrolled / closed won", F.col("is_enrolled_pipeline") | F.col("__fact_won"), None),
        ("Closed lost / dead", F.col("is_dead_pipeline"), None),
    ]
    return _stacked(p, "milestone", items).orderBy("__order").drop("__order")


def cleanup_needed(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    """Five issue masks with counts, value, action."""
    p = pipeline_contacts(contacts, fact)
    open_ = ~F.col("is_enrolled_pipeline") & ~F.col("is_dead_pipeline")
    age = F.coalesce(F.col("lead_age_days").cast("double"), F.lit(0.0))
    inactive = F.coalesce(F.col("days_since_last_activity").cast("double"), F.lit(9999.0))
    owner_missing = clean_text(F.col("salesman_name")).isin("", "Unassigned")
    items = [
        ("missing status", F.col("formal_status_missing"), "Populate lead/final/enrollment status."),
        ("invalid status", F.lower(F.col("pipeline_status")).rlike(R.CLEANUP_INVALID_PATTERN), "Clean invalid/test/duplicate statuses."),
        ("old open leads", open_ & (age >= 30), "Review open leads older than 30 days."),
        ("inactive owner with open leads", open_ & owner_missing, "Assign an active owner."),
        ("no next activity", (open_ & F.col("next_activity_date").isNull()) | (open_ & (inactive >= 14)),
         "Set next activity or close the lead."),
    ]
    return _stacked(p, "cleanup issue", items).orderBy(F.desc("leads"), "__order").drop("__order")
