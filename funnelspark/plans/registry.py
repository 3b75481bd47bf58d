"""Query registry: ``queries()`` (Spark) and ``oracle_sql()`` (DuckDB) keyed by operator name.

Every Spark query reads the driver tables through the CRM view (or tables Spark derives from
them), over whole tables.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpi
from . import oracle as O
from .process import silver

CONTACT_CHECK_COLUMNS = [
    "contact_id", "salesman_id", "salesman_name", "contact_attribution_type", "source_text", "paid_lead_flag",
    "source_group", "vendor", "vendor_confidence", "vendor_source_field", "program", "program_degree_level",
    "revenue_confidence", "potential_revenue", "enrolled_revenue", "open_pipeline_potential_revenue",
    "has_open_deal", "has_won_deal", "has_lost_deal", "latest_deal_stage", "lead_age_days",
    "days_since_last_activity", "lead_score", "dead_reason", "lead_temperature",
]
FACT_CHECK_COLUMNS = [
    "contact_id", "deal_id", "fact_record_type", "salesman_id", "salesman_name", "attribution_type",
    "deal_contact_count", "revenue_countable", "is_won", "is_lost", "revenue", "revenue_attributed",
    "program_revenue_input", "program_revenue_source", "total_program_revenue", "six_month_revenue",
    "annualized_program_revenue", "potential_revenue", "enrolled_revenue", "unclear_revenue_attribution",
    "days_to_close",
]


def _s(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return silver(spark, sf_dir)


def q_contacts_clean(spark, sf_dir):
    return _s(spark, sf_dir)["contacts_clean"].select(*CONTACT_CHECK_COLUMNS)


def q_lead_deal_fact(spark, sf_dir):
    return _s(spark, sf_dir)["lead_deal_fact"].select(*FACT_CHECK_COLUMNS)


def q_executive_metrics(spark, sf_dir):
    s = _s(spark, sf_dir)
    return kpi.executive_metrics(s["contacts_clean"], s["lead_deal_fact"])


def q_salesman_metrics(spark, sf_dir):
    s = _s(spark, sf_dir)
    return kpi.salesman_metrics(s["contacts_clean"], s["lead_deal_fact"])


def q_paid_leads_by_source(spark, sf_dir):
    return kpi.paid_leads_by_source(_s(spark, sf_dir)["contacts_clean"])


def q_paid_leads_by_campaign(spark, sf_dir):
    return kpi.paid_leads_by_campaign(_s(spark, sf_dir)["contacts_clean"])


def q_stuck_leads(spark, sf_dir):
    return kpi.stuck_leads(_s(spark, sf_dir)["contacts_clean"])


def q_data_quality_metrics(spark, sf_dir):
    s = _s(spark, sf_dir)
    return kpi.data_quality_metrics(s["contacts_clean"], s["deals_clean"], s["lead_deal_fact"])


def q_monthly_leads(spark, sf_dir):
    return kpi.monthly_leads(_s(spark, sf_dir)["contacts_clean"])


def q_monthly_revenue(spark, sf_dir):
    return kpi.monthly_revenue(_s(spark, sf_dir)["lead_deal_fact"])


def q_revenue_by_source_group(spark, sf_dir):
    won = kpi.countable_won(_s(spark, sf_dir)["lead_deal_fact"])
    return kpi.revenue_by(won, "source_group", kpi.REVENUE_COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "contacts_clean": q_contacts_clean,
    "lead_deal_fact": q_lead_deal_fact,
    "executive_metrics": q_executive_metrics,
    "salesman_metrics": q_salesman_metrics,
    "paid_leads_by_source": q_paid_leads_by_source,
    "paid_leads_by_campaign": q_paid_leads_by_campaign,
    "stuck_leads": q_stuck_leads,
    "data_quality_metrics": q_data_quality_metrics,
    "monthly_leads": q_monthly_leads,
    "monthly_revenue": q_monthly_revenue,
    "revenue_by": q_revenue_by_source_group,
}

# ---------------------------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------------------------

REV = kpi.REVENUE_COLUMNS
POT = kpi.POTENTIAL_REVENUE_COLUMNS + kpi.PIPELINE_REVENUE_COLUMNS
WON = "won AS (SELECT * FROM lead_deal_fact WHERE deal_countable AND is_won)"


def _sql(select: str, extra: list[str] | None = None) -> str:
    ctes = O.silver_ctes() + (extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + select


def sql_executive():
    c = ", ".join([
        "count(DISTINCT contact_id) AS total_leads",
        "count(DISTINCT CASE WHEN paid_lead_flag THEN contact_id END) AS paid_leads",
        "count_if(lead_temperature = 'Hot') AS hot_leads", "count_if(lead_temperature = 'Dead') AS dead_leads",
        *[f"{O.money_sum(x)} AS {x}" for x in POT]])
    f = ", ".join([
        "count(DISTINCT deal_id) AS won_deals",
        "count(DISTINCT CASE WHEN paid_lead_flag THEN deal_id END) AS paid_won_deals",
        "coalesce(avg(days_to_close), 0.0) AS average_days_to_close",
        "coalesce(CAST(median(days_to_close) AS DOUBLE), 0.0) AS median_days_to_close",
        *[f"{O.money_sum(x)} AS {x}" for x in REV]])
    sel = ", ".join([
        "total_leads", "paid_leads", "greatest(total_leads - paid_leads, 0) AS organic_leads", "hot_leads", "dead_leads",
        "won_deals", *REV, *POT, "total_program_revenue AS revenue",
        f"{O.safe_div('won_deals', 'total_leads')} AS close_rate",
        f"{O.safe_div('paid_won_deals', 'paid_leads')} AS paid_close_rate",
        "average_days_to_close", "median_days_to_close",
        f"{O.safe_div('total_program_revenue', 'total_leads')} AS revenue_per_lead",
        f"{O.safe_div('total_program_revenue', 'paid_leads')} AS revenue_per_paid_lead"])
    return _sql(f"SELECT {sel} FROM (SELECT {c} FROM contacts_clean) c, (SELECT {f} FROM won) f", [WON])


def sql_salesman():
    extra = [WON,
             """paid_won_ids AS (SELECT DISTINCT salesman_name, contact_id FROM won
                 WHERE paid_lead_flag AND contact_id IS NOT NULL AND salesman_name IS NOT NULL)""",
             """leak AS (SELECT c.salesman_name, count(DISTINCT c.contact_id) AS paid_lead_leakage FROM contacts_clean c
                 WHERE c.salesman_name IS NOT NULL AND c.paid_lead_flag
                   AND NOT EXISTS (SELECT 1 FROM paid_won_ids p WHERE p.salesman_name = c.salesman_name AND p.contact_id = c.contact_id)
                   AND (coalesce(CAST(c.days_since_last_activity AS DOUBLE), 9999.0) >= 7 OR NOT c.has_open_deal)
                 GROUP BY 1)""",
             f"""cagg AS (SELECT salesman_name, count(DISTINCT contact_id) AS total_leads_assigned,
                 count(DISTINCT CASE WHEN paid_lead_flag THEN contact_id END) AS paid_leads_assigned,
                 count_if(lead_temperature = 'Hot') AS hot_leads, count_if(lead_temperature = 'Warm') AS warm_leads,
                 count_if(lead_temperature = 'Cold') AS cold_leads, count_if(lead_temperature = 'Dead') AS dead_leads,
                 count_if(has_open_deal) AS open_leads,
                 count_if(coalesce(nullif(revenue_confidence, ''), 'Low') = 'High') AS n_high,
                 count_if(coalesce(nullif(revenue_confidence, ''), 'Low') = 'Medium') AS n_med,
                 count_if(coalesce(nullif(revenue_confidence, ''), 'Low') = 'Low') AS n_low,
                 {', '.join(f'{O.money_sum(x)} AS {x}' for x in POT)},
                 {O.money_sum("CASE WHEN lead_temperature = 'Hot' THEN open_pipeline_potential_revenue END")} AS hot_lead_potential_revenue,
                 {O.money_sum("CASE WHEN paid_lead_flag THEN open_pipeline_potential_revenue END")} AS paid_lead_potential_revenue
               FROM contacts_clean WHERE salesman_name IS NOT NULL GROUP BY 1)""",
             f"""fagg AS (SELECT salesman_name, count(DISTINCT deal_id) AS won_deals,
                 count(DISTINCT CASE WHEN paid_lead_flag THEN deal_id END) AS paid_won,
                 avg(days_to_close) AS average_days_to_close, CAST(median(days_to_close) AS DOUBLE) AS median_days_to_close,
                 {O.money_sum('revenue_attributed')} AS actual_enrolled_revenue,
                 {', '.join(f'{O.money_sum(x)} AS {x}' for x in REV)}
               FROM won WHERE salesman_name IS NOT NULL GROUP BY 1)""",
             """est_c AS (SELECT salesman_name, contact_id, max(v) AS v FROM (
                   SELECT salesman_name, contact_id, CAST(enrolled_revenue AS DOUBLE) AS v FROM contacts_clean
                    WHERE salesman_name IS NOT NULL AND coalesce(CAST(enrolled_revenue AS DOUBLE), 0) > 0
                   UNION ALL
                   SELECT salesman_name, contact_id, coalesce(CAST(total_program_revenue AS DOUBLE), 0.0) FROM won
                    WHERE salesman_name IS NOT NULL AND regexp_replace(coalesce(contact_id, ''), '^\\s+|\\s+$', '', 'g') <> ''
                 ) GROUP BY 1, 2)""",
             f"""est_n AS (SELECT salesman_name, {O.money_sum('v')} AS n_rev FROM (
                   SELECT salesman_name, deal_id, first(coalesce(CAST(total_program_revenue AS DOUBLE), 0.0)) AS v FROM won
                    WHERE salesman_name IS NOT NULL AND regexp_replace(coalesce(contact_id, ''), '^\\s+|\\s+$', '', 'g') = ''
                    GROUP BY 1, 2) GROUP BY 1)""",
             f"""est AS (SELECT coalesce(a.salesman_name, b.salesman_name) AS salesman_name,
                 coalesce(a.c_rev, 0.0) + coalesce(b.n_rev, 0.0) AS estimated_enrolled_revenue,
                 coalesce(a.c_n, 0) + CASE WHEN coalesce(b.n_rev, 0.0) > 0 THEN 1 ELSE 0 END AS enrolled_students
               FROM (SELECT salesman_name, {O.money_sum('v')} AS c_rev, count(*) AS c_n FROM est_c GROUP BY 1) a
               FULL OUTER JOIN est_n b ON a.salesman_name = b.salesman_name)""",
             """names AS (SELECT salesman_name FROM contacts_clean WHERE salesman_name IS NOT NULL
                 UNION SELECT salesman_name FROM lead_deal_fact WHERE salesman_name IS NOT NULL)"""]

    def z(x, d="0"):
        return f"coalesce({x}, {d})"

    total, paid = z("total_leads_assigned"), z("paid_leads_assigned")
    sel = ", ".join([
        "n.salesman_name",
        f"{z('hot_leads')} + {z('open_leads')} + {z('paid_lead_leakage')} AS action_load",
        f"{z('paid_lead_leakage')} AS paid_lead_leakage",
        f"{total} AS total_leads_assigned", f"{paid} AS paid_leads_assigned",
        f"greatest({total} - {paid}, 0) AS organic_leads_assigned",
        *[f"{z(x)} AS {x}" for x in ["hot_leads", "warm_leads", "cold_leads", "dead_leads", "open_leads", "won_deals"]],
        f"{O.safe_div(z('won_deals'), total)} AS close_rate",
        f"{O.safe_div(z('paid_won'), paid)} AS paid_close_rate",
        f"{z('average_days_to_close', '0.0')} AS average_days_to_close",
        f"{z('median_days_to_close', '0.0')} AS median_days_to_close",
        f"{O.safe_div(z('total_program_revenue', '0.0'), total)} AS revenue_per_lead",
        f"{O.safe_div(z('total_program_revenue', '0.0'), paid)} AS revenue_per_paid_lead",
        f"{z('actual_enrolled_revenue', '0.0')} AS actual_enrolled_revenue",
        f"{z('estimated_enrolled_revenue', '0.0')} AS estimated_enrolled_revenue",
        f"{z('hot_lead_potential_revenue', '0.0')} AS hot_lead_potential_revenue",
        f"{z('paid_lead_potential_revenue', '0.0')} AS paid_lead_potential_revenue",
        f"{O.safe_div(z('potential_program_revenue', '0.0'), total)} AS average_estimated_revenue_per_lead",
        f"{O.safe_div(z('estimated_enrolled_revenue', '0.0'), z('enrolled_students'))} AS average_estimated_revenue_per_enrolled_student",
        f"'High: ' || {z('n_high')} || ' / Medium: ' || {z('n_med')} || ' / Low: ' || {z('n_low')} AS revenue_confidence_mix",
        *[f"{z(x, '0.0')} AS {x}" for x in REV + POT],
        f"{z('total_program_revenue', '0.0')} AS revenue"])
    return _sql(f"""SELECT {sel} FROM names n LEFT JOIN cagg USING (salesman_name) LEFT JOIN fagg USING (salesman_name)
        LEFT JOIN est USING (salesman_name) LEFT JOIN leak USING (salesman_name)""", extra)


def sql_paid_lead_metrics():
    c = ", ".join(["count(DISTINCT contact_id) AS paid_leads", *[f"{O.money_sum(x)} AS {x}" for x in POT]])
    f = ", ".join(["count(DISTINCT deal_id) AS paid_won_deals",
                   "coalesce(avg(days_to_close), 0.0) AS average_paid_days_to_close",
                   *[f"{O.money_sum(x)} AS {x}" for x in REV]])
    sel = ", ".join(["paid_leads", "total_program_revenue AS paid_revenue", *REV, *POT, "total_program_revenue AS revenue",
                     f"{O.safe_div('paid_won_deals', 'paid_leads')} AS paid_close_rate", "average_paid_days_to_close",
                     f"{O.safe_div('total_program_revenue', 'paid_leads')} AS revenue_per_paid_lead"])
    return _sql(f"SELECT {sel} FROM (SELECT {c} FROM contacts_clean WHERE paid_lead_flag) c, "
                f"(SELECT {f} FROM won WHERE paid_lead_flag) f", [WON])


def sql_stuck():
    def no_act(d):
        return (f"coalesce(days_since_last_activity >= {d} OR (never_contacted AND lead_age_days >= {d}), false)")
    return _sql(f"""SELECT
        count(DISTINCT CASE WHEN {no_act(7)} THEN contact_id END) AS leads_no_activity_7_days,
        count(DISTINCT CASE WHEN {no_act(14)} THEN contact_id END) AS leads_no_activity_14_days,
        count(DISTINCT CASE WHEN {no_act(30)} THEN contact_id END) AS leads_no_activity_30_days,
        count(DISTINCT CASE WHEN paid_lead_flag AND {no_act(7)} THEN contact_id END) AS paid_leads_with_no_activity,
        count(DISTINCT CASE WHEN paid_lead_flag AND coalesce(lead_age_days > 30, false) AND NOT has_open_deal THEN contact_id END)
          AS paid_leads_older_30_days_no_open_deal
      FROM contacts_clean""")


def sql_quality():
    return _sql(f"""SELECT
        (SELECT count(DISTINCT CASE WHEN {O.txt('salesman_id')} = '' THEN contact_id END) FROM contacts_clean) AS records_missing_owner,
        (SELECT count(DISTINCT CASE WHEN coalesce(source_group, 'Unknown') = 'Unknown' OR {O.txt('source_text')} = ''
                THEN contact_id END) FROM contacts_clean) AS records_missing_source,
        (SELECT count_if(contact_created_at IS NULL) FROM contacts_clean) AS records_missing_contact_created_date,
        (SELECT count_if(close_date IS NULL) FROM deals_clean) AS records_missing_close_date,
        (SELECT count_if(coalesce(revenue, 0.0) <= 0) FROM deals_clean) AS records_missing_revenue,
        (SELECT count_if(deal_countable AND is_won AND coalesce(total_program_revenue, 0.0) <= 0) FROM lead_deal_fact)
          AS won_records_missing_program_revenue,
        (SELECT count(DISTINCT CASE WHEN fact_record_type = 'contact_without_deal' THEN contact_id END) FROM lead_deal_fact)
          AS contacts_without_deals,
        (SELECT count(DISTINCT CASE WHEN fact_record_type = 'deal_without_contact' THEN deal_id END) FROM lead_deal_fact)
          AS deals_without_contacts,
        (SELECT count_if(attribution_type = 'fallback_to_deal_owner') FROM lead_deal_fact) AS deal_owner_fallback_used,
        (SELECT count(DISTINCT CASE WHEN unclear_revenue_attribution THEN deal_id END) FROM lead_deal_fact) AS unclear_revenue_attribution""")


ORACLE: dict[str, Callable[[], str]] = {
    "contacts_clean": lambda: _sql("SELECT " + ", ".join(CONTACT_CHECK_COLUMNS) + " FROM contacts_clean"),
    "lead_deal_fact": lambda: _sql("SELECT " + ", ".join(FACT_CHECK_COLUMNS) + " FROM lead_deal_fact"),
    "executive_metrics": sql_executive,
    "salesman_metrics": sql_salesman,
    "paid_leads_by_source": lambda: _sql("SELECT source_group, count(DISTINCT contact_id) AS paid_leads FROM contacts_clean "
                                         "WHERE paid_lead_flag GROUP BY 1"),
    "paid_leads_by_campaign": lambda: _sql(f"SELECT utm_campaign, count(DISTINCT contact_id) AS paid_leads FROM contacts_clean "
                                           f"WHERE paid_lead_flag AND {O.txt('utm_campaign')} <> '' GROUP BY 1 ORDER BY 2 DESC"),
    "stuck_leads": sql_stuck,
    "data_quality_metrics": sql_quality,
    "monthly_leads": lambda: _sql("SELECT strftime(contact_created_at, '%Y-%m') AS month, count(DISTINCT contact_id) AS leads "
                                  "FROM contacts_clean WHERE contact_created_at IS NOT NULL GROUP BY 1"),
    "monthly_revenue": lambda: _sql(f"SELECT strftime(close_date, '%Y-%m') AS month, {O.money_sum('total_program_revenue')} AS revenue "
                                    "FROM won WHERE close_date IS NOT NULL GROUP BY 1", [WON]),
    "revenue_by": lambda: _sql("SELECT source_group, " + ", ".join(f"{O.money_sum(x)} AS {x}" for x in REV)
                               + " FROM won GROUP BY 1", [WON]),
}


def _utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """CRM timestamps are UTC: pin the session time zone before planning."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import registry_filters, registry_landed  # which import this module
    return {name: _utc(fn) for name, fn in (QUERIES | registry_filters.QUERIES | registry_landed.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    from . import registry_filters, registry_landed
    return {k: f() for k, f in (ORACLE | registry_filters.ORACLE | registry_landed.ORACLE).items()}


# ---- pipeline health -------------------------------------------------------------------------
from ..functions import rules as _R  # noqa: E402
from ..operators import pipeline as _P  # noqa: E402

_PIPE_CONTACT_COLS = ["enrollment_status", "final_lead_status", "lead_status", "lifecycle_stage", "latest_deal_stage"]


def _pipe_cte() -> list[str]:
    enrolled_pat = "|".join(_R.PIPELINE_ENROLLED_TERMS)
    dead_pat = "|".join(_R.PIPELINE_DEAD_TERMS)
    enrolled = " OR ".join(["coalesce(has_won_deal, false)"] + [
        f"regexp_matches(lower({O.txt_na(c)}), {O.q(enrolled_pat)})" for c in _PIPE_CONTACT_COLS]
        + ["coalesce(CAST(enrolled_revenue AS DOUBLE), 0.0) > 0"])
    dead = " OR ".join(["coalesce(has_lost_deal, false)", f"lower({O.txt_na('lead_temperature')}) = 'dead'"] + [
        f"regexp_matches(lower({O.txt_na(c)}), {O.q(dead_pat)})" for c in _PIPE_CONTACT_COLS if c != "enrollment_status"])
    first = "coalesce(" + ", ".join([f"nullif({O.txt_na(c)}, '')" for c in _PIPE_CONTACT_COLS]
                                    + [f"CASE WHEN {O.txt_na('lead_temperature')} <> '' THEN {O.txt_na('lead_temperature')} || ' Lead' END",
                                       "'Missing Status'"]) + ")"
    missing = " AND ".join(f"{O.txt_na(c)} = ''" for c in _PIPE_CONTACT_COLS)
    fa = f"""fa AS (SELECT {O.txt('contact_id')} AS contact_id, {O.money_sum('revenue_attributed')} AS actual,
        bool_or({O.txt('deal_id')} <> '') AS fact_deal, bool_or(coalesce(is_won, false)) AS fact_won
      FROM lead_deal_fact WHERE {O.txt('contact_id')} <> '' GROUP BY 1)"""
    pc0 = f"""pc0 AS (SELECT c.*, ({enrolled}) AS is_enrolled_pipeline, ({dead}) AS is_dead_pipeline,
        ({missing}) AS formal_status_missing, {first} AS __first_status,
        coalesce(CAST(potential_revenue AS DOUBLE), 0.0) AS pipeline_potential_revenue
      FROM contacts_clean c WHERE contact_id IS NOT NULL)"""
    pc = """pc AS (SELECT pc0.*, CASE WHEN is_enrolled_pipeline THEN 'Enrolled / Closed Won'
             WHEN is_dead_pipeline THEN 'Closed Lost / Dead' ELSE __first_status END AS pipeline_status,
        coalesce(fa.actual, 0.0) AS actual_revenue, coalesce(fa.fact_deal, false) AS fact_deal,
        coalesce(fa.fact_won, false) AS fact_won
      FROM pc0 LEFT JOIN fa USING (contact_id))"""
    return [fa, pc0, pc]


def sql_lead_status_summary():
    return _sql(f"""SELECT pipeline_status AS status, count(DISTINCT contact_id) AS "total leads",
        count(DISTINCT CASE WHEN paid_lead_flag THEN contact_id END) AS "paid leads",
        count(DISTINCT CASE WHEN lead_temperature = 'Hot' THEN contact_id END) AS "hot leads",
        count(DISTINCT CASE WHEN coalesce(CAST(days_since_last_activity AS DOUBLE), 9999.0) >= 14 THEN contact_id END) AS "stale leads",
        count(DISTINCT CASE WHEN is_dead_pipeline THEN contact_id END) AS "dead leads",
        count(DISTINCT CASE WHEN is_enrolled_pipeline THEN contact_id END) AS enrolled,
        {O.money_sum('actual_revenue')} AS "actual revenue", {O.money_sum('pipeline_potential_revenue')} AS "potential revenue"
      FROM pc GROUP BY 1 ORDER BY 2 DESC, 1""", _pipe_cte())


def sql_stage_bottlenecks():
    dead_any = " OR ".join(f"contains(lower(s), {O.q(t)})" for t in _R.PIPELINE_DEAD_TERMS)
    inner = """SELECT pipeline_status AS s,
        count(DISTINCT CASE WHEN NOT is_enrolled_pipeline AND NOT is_dead_pipeline AND coalesce(CAST(days_since_last_activity AS DOUBLE), 9999.0) >= 7 THEN contact_id END) AS s7,
        count(DISTINCT CASE WHEN NOT is_enrolled_pipeline AND NOT is_dead_pipeline AND coalesce(CAST(days_since_last_activity AS DOUBLE), 9999.0) >= 14 THEN contact_id END) AS s14,
        count(DISTINCT CASE WHEN NOT is_enrolled_pipeline AND NOT is_dead_pipeline AND coalesce(CAST(days_since_last_activity AS DOUBLE), 9999.0) >= 30 THEN contact_id END) AS s30,
        avg(coalesce(CAST(lead_age_days AS DOUBLE), 0.0)) AS age FROM pc GROUP BY 1"""
    return _sql(f"""SELECT s AS "stage/status", s7 AS "leads stuck 7+ days", s14 AS "leads stuck 14+ days",
        s30 AS "leads stuck 30+ days", age AS "average age",
        CASE WHEN contains(lower(s), 'missing') THEN 'Assign a meaningful lead status.'
             WHEN {dead_any} THEN 'Confirm dead/lost reason and archive or nurture.'
             WHEN s30 > 0 THEN 'Manager review: clear next step or close out.'
             WHEN s14 > 0 THEN 'Schedule follow-up and update next activity.'
             ELSE 'Monitor normal movement.' END AS "recommended action"
      FROM ({inner}) ORDER BY s30 DESC, s14 DESC, s7 DESC, s""", _pipe_cte())


def _sql_stacked(label: str, items: list[tuple[str, str, str | None]], order: str) -> str:
    parts = []
    for i, (name, mask, action) in enumerate(items):
        act = f", {O.q(action)} AS \"recommended action\"" if action is not None else ""
        parts.append(f"""SELECT {i} AS __order, {O.q(name)} AS "{label}",
            count(DISTINCT CASE WHEN {mask} THEN contact_id END) AS leads,
            count(DISTINCT CASE WHEN ({mask}) AND paid_lead_flag THEN contact_id END) AS "paid leads",
            {O.money_sum(f'CASE WHEN {mask} THEN pipeline_potential_revenue END')} AS "potential revenue"{act} FROM pc""")
    return _sql(f"SELECT * EXCLUDE (__order) FROM ({' UNION ALL '.join(parts)}) ORDER BY {order}", _pipe_cte())


def sql_enrollment_path():
    items = [("Lead created", "true", None),
             ("Contacted", "(last_activity_date IS NOT NULL OR coalesce(CAST(num_notes AS DOUBLE), 0.0) > 0)", None),
             ("Application / deal created", "(fact_deal OR has_open_deal OR has_won_deal OR has_lost_deal)", None),
             ("Enrolled / closed won", "(is_enrolled_pipeline OR fact_won)", None),
             ("Closed lost / dead", "is_dead_pipeline", None)]
    return _sql_stacked("milestone", items, "__order")


def sql_cleanup_needed():
    open_ = "(NOT is_enrolled_pipeline AND NOT is_dead_pipeline)"
    items = [("missing status", "formal_status_missing", "Populate lead/final/enrollment status."),
             ("invalid status", f"regexp_matches(lower(pipeline_status), {O.q(_R.CLEANUP_INVALID_PATTERN)})",
              "Clean invalid/test/duplicate statuses."),
             ("old open leads", f"({open_} AND coalesce(CAST(lead_age_days AS DOUBLE), 0.0) >= 30)", "Review open leads older than 30 days."),
             ("inactive owner with open leads", f"({open_} AND {O.txt('salesman_name')} IN ('', 'Unassigned'))", "Assign an active owner."),
             ("no next activity", f"(({open_} AND next_activity_date IS NULL) OR ({open_} AND coalesce(CAST(days_since_last_activity AS DOUBLE), 9999.0) >= 14))",
              "Set next activity or close the lead.")]
    return _sql_stacked("cleanup issue", items, "leads DESC, __order")


def _two(fn):
    def run(spark, sf_dir):
        s = _s(spark, sf_dir)
        return fn(s["contacts_clean"], s["lead_deal_fact"])
    return run


QUERIES.update({
    "lead_status_summary": _two(_P.lead_status_summary),
    "stage_bottlenecks": _two(_P.stage_bottlenecks),
    "enrollment_path": _two(_P.enrollment_path),
    "cleanup_needed": _two(_P.cleanup_needed),
})
ORACLE.update({
    "lead_status_summary": sql_lead_status_summary,
    "stage_bottlenecks": sql_stage_bottlenecks,
    "enrollment_path": sql_enrollment_path,
    "cleanup_needed": sql_cleanup_needed,
})


# ---- cohorts ---------------------------------------------------------------------------------
from ..operators import cohorts as _C  # noqa: E402


def _avg_exact_sql(x: str) -> str:
    return f"(CAST(sum(CAST(CAST({x} AS DOUBLE) AS DECIMAL(28,9))) AS DOUBLE) / count({x}))"


def _term_start_sql(t: str) -> str:
    low = f"lower({t})"
    month = "(CASE " + " ".join(f"WHEN contains({low}, {O.q(s)}) THEN {m}" for s, m in _R.SEASON_START_MONTH) + " ELSE 1 END)"
    year = f"regexp_extract({t}, '(20\\d{{2}})', 1)"
    built = f"(CASE WHEN {year} <> '' THEN make_timestamp(CAST({year} AS BIGINT), {month}, 1, 0, 0, 0) END)"
    return f"(CASE WHEN {t} <> '' THEN coalesce(TRY_CAST({t} AS TIMESTAMP), {built}) END)"


def _cohort_ctes() -> list[str]:
    off, st = O.txt_na("cohort"), O.txt_na("start_term")
    wd = "__won_date"
    return [
        """wdates AS (SELECT coalesce(contact_id, '') AS contact_id, min(coalesce(closed_won_date, close_date, enrollment_date)) AS __won_date
            FROM lead_deal_fact WHERE (coalesce(is_won, false) OR coalesce(has_won_deal, false))
              AND coalesce(closed_won_date, close_date, enrollment_date) IS NOT NULL GROUP BY 1)""",
        f"""crev AS (SELECT coalesce(contact_id, '') AS contact_id, {O.money_sum('revenue_attributed')} AS cohort_actual_revenue
            FROM lead_deal_fact WHERE coalesce(contact_id, '') <> '' GROUP BY 1)""",
        """cc0 AS (SELECT * EXCLUDE (__rn) FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY _seq NULLS LAST) AS __rn
            FROM contacts_clean WHERE coalesce(contact_id, '') <> '') WHERE __rn = 1)""",
        f"""cp AS (SELECT cc0.* EXCLUDE (cohort), w.__won_date,
            coalesce(nullif(CASE WHEN {off} <> '' THEN {off} WHEN {st} <> '' THEN {st} WHEN {wd} IS NOT NULL THEN strftime({wd}, '%Y-%m')
                 ELSE coalesce(strftime(contact_created_at, '%Y-%m'), 'Unknown') END, ''), 'Unknown') AS cohort,
            CASE WHEN {off} <> '' THEN 'official cohort' WHEN {st} <> '' THEN 'start_term' WHEN {wd} IS NOT NULL THEN 'enrollment date'
                 ELSE 'contact created month' END AS cohort_source,
            CASE WHEN {off} <> '' THEN {_term_start_sql(off)} WHEN {st} <> '' THEN {_term_start_sql(st)}
                 WHEN {wd} IS NOT NULL THEN date_trunc('month', {wd}) ELSE date_trunc('month', contact_created_at) END AS cohort_start_date,
            coalesce(r.cohort_actual_revenue, 0.0) AS cohort_actual_revenue,
            coalesce(CAST(enrolled_revenue AS DOUBLE), 0.0) AS cohort_estimated_revenue,
            coalesce(CAST(potential_revenue AS DOUBLE), 0.0) AS cohort_potential_revenue,
            paid_lead_flag AS cohort_is_paid,
            (coalesce(has_won_deal, false) OR coalesce(CAST(enrolled_revenue AS DOUBLE), 0.0) > 0
               OR regexp_matches(lower({O.txt_na('enrollment_status')}), {O.q(_R.COHORT_ENROLLED_PATTERN)})) AS cohort_is_enrolled,
            CASE WHEN (CASE WHEN time_to_first_engagement IS NOT NULL THEN time_to_first_engagement / 86400000.0
                            ELSE (epoch_us(coalesce(first_engagement_date, first_outreach_date, last_sales_activity_timestamp, last_activity_date))
                                  - epoch_us(contact_created_at)) / 86400000000.0 END) >= 0
                 THEN (CASE WHEN time_to_first_engagement IS NOT NULL THEN time_to_first_engagement / 86400000.0
                            ELSE (epoch_us(coalesce(first_engagement_date, first_outreach_date, last_sales_activity_timestamp, last_activity_date))
                                  - epoch_us(contact_created_at)) / 86400000000.0 END) END AS cohort_days_to_first_contact,
            (epoch_us({wd}) - epoch_us(contact_created_at)) / 86400000000.0 AS cohort_days_to_enroll
          FROM cc0 LEFT JOIN wdates w USING (contact_id) LEFT JOIN crev r USING (contact_id))""",
        f"""cpp AS (SELECT cp.*, CASE WHEN cohort_is_enrolled THEN CAST(num_notes AS DOUBLE) END AS cohort_sales_touches_to_enroll,
            (cohort_is_paid AND NOT cohort_is_enrolled AND ({O.txt_na('salesman_name')} IN ('', 'Unassigned') OR next_activity_date IS NULL
              OR coalesce(CAST(days_since_last_activity AS DOUBLE), 9999.0) >= 14 OR NOT has_open_deal)) AS cohort_paid_leakage
          FROM cp)""",
    ]


def _mode_sql(src: str, out: str, table: str = "cpp", key: str = "cohort") -> str:
    v = f"CASE WHEN {O.txt_na(src)} = '' THEN 'Unknown' ELSE {O.txt_na(src)} END"
    return f"""(SELECT {key}, v AS "{out}" FROM (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, v) AS rn
        FROM (SELECT {key}, {v} AS v, count(*) AS n FROM {table} GROUP BY 1, 2)) WHERE rn = 1)"""


def _cohort_summary_sql() -> str:
    agg = f"""SELECT cohort, count(DISTINCT contact_id) AS leads, count_if(cohort_is_paid) AS "paid leads",
        count_if(cohort_is_enrolled) AS "enrolled students",
        {O.money_sum('cohort_actual_revenue')} AS "actual revenue", {O.money_sum('cohort_estimated_revenue')} AS "estimated revenue",
        {O.money_sum('cohort_potential_revenue')} AS "potential revenue",
        coalesce({_avg_exact_sql('cohort_days_to_first_contact')}, 0.0) AS "avg days to first contact",
        coalesce({_avg_exact_sql('cohort_days_to_enroll')}, 0.0) AS "avg days to enroll",
        coalesce({_avg_exact_sql('cohort_sales_touches_to_enroll')}, 0.0) AS "avg touches to enroll",
        min(cohort_start_date) AS __start FROM cpp GROUP BY 1"""
    return f"""SELECT a.cohort, m1."cohort source", a.leads, a."paid leads", {O.safe_div('a."paid leads"', 'a.leads')} AS "paid %",
        a."enrolled students", {O.safe_div('a."enrolled students"', 'a.leads')} AS "enrollment rate",
        a."actual revenue", a."estimated revenue", a."potential revenue", a."avg days to first contact", a."avg days to enroll",
        a."avg touches to enroll", m2."top vendor", m3."top program", m4."top salesman", a.__start
      FROM ({agg}) a LEFT JOIN {_mode_sql('cohort_source', 'cohort source')} m1 USING (cohort)
        LEFT JOIN {_mode_sql('paid_vendor', 'top vendor')} m2 USING (cohort)
        LEFT JOIN {_mode_sql('program', 'top program')} m3 USING (cohort)
        LEFT JOIN {_mode_sql('salesman_name', 'top salesman')} m4 USING (cohort)"""


def sql_cohort_summary():
    return _sql(f"SELECT * EXCLUDE (__start) FROM ({_cohort_summary_sql()})", _cohort_ctes())


def sql_cohort_fields():
    ren = ", ".join(f'"{old}" AS {new}' for old, new in _C.FIELD_RENAMES)
    return _sql(f"""SELECT s.cohort, {ren}, s.__start AS cohort_start_date,
        {O.safe_div("h.hot", "h.n")} AS cohort_hot_lead_share, {O.safe_div("h.dead", "h.n")} AS cohort_dead_lead_share
      FROM ({_cohort_summary_sql()}) s LEFT JOIN (SELECT cohort, count_if(lead_temperature = 'Hot') AS hot,
        count_if(lead_temperature = 'Dead') AS dead, count(DISTINCT contact_id) AS n FROM cpp GROUP BY 1) h USING (cohort)""",
                _cohort_ctes())


def sql_cohort_comparison():
    rev = 'CASE WHEN s."estimated revenue" <> 0 THEN s."estimated revenue" ELSE s."actual revenue" END'
    return _sql(f"""SELECT s.cohort, s."enrollment rate", {O.safe_div(rev, 's.leads')} AS "revenue per lead",
        s."avg days to enroll", s."avg touches to enroll", e."paid lead leakage", e."dead lead rate"
      FROM ({_cohort_summary_sql()}) s LEFT JOIN (SELECT cohort, count_if(cohort_paid_leakage) AS "paid lead leakage",
        {O.safe_div("count_if(lead_temperature = 'Dead')", "count(DISTINCT contact_id)")} AS "dead lead rate" FROM cpp GROUP BY 1) e
        USING (cohort)""", _cohort_ctes())


def sql_top_table(column: str, label: str):
    v = f"CASE WHEN {O.txt_na(column)} = '' THEN 'Unknown' ELSE {O.txt_na(column)} END"
    return _sql(f"""SELECT {v} AS "{label}", count(DISTINCT contact_id) AS leads, count_if(paid_lead_flag) AS "paid leads",
        count_if(cohort_is_enrolled) AS "enrolled students" FROM cpp GROUP BY 1""", _cohort_ctes())


def sql_mix_table(column: str, label: str):
    v = f"CASE WHEN {O.txt_na(column)} = '' THEN 'Unknown' ELSE {O.txt_na(column)} END"
    return _sql(f"""SELECT "{label}", leads, {O.safe_div('leads', 'sum(leads) OVER ()')} AS share FROM (
        SELECT {v} AS "{label}", count(DISTINCT contact_id) AS leads FROM cpp GROUP BY 1)""", _cohort_ctes())


def sql_paid_mix():
    return _sql(f"""SELECT * FROM (SELECT 'Paid' AS "paid vs organic", count_if(cohort_is_paid) AS leads,
          {O.safe_div('count_if(cohort_is_paid)', 'count(*)')} AS share FROM cpp
        UNION ALL SELECT 'Organic', count_if(NOT cohort_is_paid), {O.safe_div('count_if(NOT cohort_is_paid)', 'count(*)')} FROM cpp)""",
                _cohort_ctes())


def _prepared(spark, sf_dir):
    """Prepared cohort contacts (the gold input of every cohort table), materialised once."""
    def build():
        s = _s(spark, sf_dir)
        return cut_lineage(_C.cohort_contacts(s["contacts_clean"], s["lead_deal_fact"]))
    return _landed(spark, sf_dir, "cohorts", build)


QUERIES.update({
    "cohort_summary": lambda spark, d: _C.summary_only(_prepared(spark, d)),
    "cohort_fields": lambda spark, d: _C.cohort_fields(_prepared(spark, d)),
    "cohort_comparison": lambda spark, d: _C.cohort_comparison(_prepared(spark, d)),
    "top_table": lambda spark, d: _C.top_table(_prepared(spark, d), "program", "program"),
    "mix_table": lambda spark, d: _C.mix_table(_prepared(spark, d), "lead_temperature", "lead temperature"),
    "paid_mix": lambda spark, d: _C.paid_mix(_prepared(spark, d)),
    "enrollment_inputs": lambda spark, d: _C.enrollment_inputs(_prepared(spark, d)),
    "status_before_enrollment": lambda spark, d: _C.status_before_enrollment(_prepared(spark, d)),
})
ORACLE.update({
    "cohort_summary": sql_cohort_summary,
    "cohort_fields": sql_cohort_fields,
    "cohort_comparison": sql_cohort_comparison,
    "top_table": lambda: sql_top_table("program", "program"),
    "mix_table": lambda: sql_mix_table("lead_temperature", "lead temperature"),
    "paid_mix": sql_paid_mix,
})


# ---- journeys --------------------------------------------------------------------------------
from ..operators import journey as _J  # noqa: E402
from ..sources import crm_view as _V  # noqa: E402


def _journey_ctes() -> list[str]:
    owner = f"coalesce(nullif({O.txt('salesman_name')}, ''), 'Unassigned')"
    specs = [("contact_created_at", "Contact created", "'HubSpot contact record created'", "''"),
             ("owner_assigned_date", "Owner assigned", "'Contact owner assigned'", "''"),
             ("first_outreach_date", "First outreach", "'First outreach date from HubSpot summary'", "''"),
             ("first_engagement_date", "First engagement", "'First engagement date from HubSpot summary'", "''"),
             ("application_date", "Application", "'Application date'", "''"),
             ("enrollment_date", "Enrollment", "'Enrollment date'", "''"),
             ("last_sales_activity_timestamp", "Last sales activity", "'Last sales activity timestamp'", "''"),
             ("last_activity_date", "Last activity", "'Last activity date'", "''"),
             ("next_activity_date", "Next activity", "'Next scheduled activity'", "''")]
    cev = " UNION ALL ".join(
        f"SELECT contact_id, {c} AS event_date, {O.q(t)} AS event_type, {owner} AS owner, {d} AS description, {o} AS outcome, false AS act "
        f"FROM contacts_clean WHERE contact_id IS NOT NULL AND {c} IS NOT NULL" for c, t, d, o in specs)
    fo = f"coalesce(nullif({O.txt('f.salesman_name')}, ''), 'Unassigned')"
    fd = f"trim('Deal ' || {O.txt('f.deal_id')})"
    fs = f"{O.txt('f.deal_stage')}"
    fbase = f"FROM lead_deal_fact f WHERE {O.txt('f.contact_id')} <> '' AND {O.txt('f.contact_id')} IN (SELECT contact_id FROM contacts_clean)"
    dev = " UNION ALL ".join([
        f"SELECT {O.txt('f.contact_id')}, f.deal_created_at, 'Deal created', {fo}, {fd}, {fs}, false {fbase} AND f.deal_created_at IS NOT NULL",
        f"SELECT {O.txt('f.contact_id')}, f.close_date, 'Deal close date', {fo}, {fd}, {fs}, false {fbase} AND f.close_date IS NOT NULL",
        f"SELECT {O.txt('f.contact_id')}, CASE WHEN f.is_won THEN coalesce(f.closed_won_date, f.close_date) WHEN f.is_lost THEN f.close_date END, "
        f"CASE WHEN f.is_won THEN 'Closed won' ELSE 'Closed lost' END, {fo}, {fd}, {fs}, false {fbase} "
        f"AND (CASE WHEN f.is_won THEN coalesce(f.closed_won_date, f.close_date) WHEN f.is_lost THEN f.close_date END) IS NOT NULL"])
    aev = ("SELECT contact_id, event_date, event_type, owner, description, outcome, true FROM activity_events "
           "WHERE contact_id IN (SELECT contact_id FROM contacts_clean)")
    return O.activity_ctes() + [f"jev AS ({cev} UNION ALL {dev} UNION ALL {aev})"]


def sql_journey_events():
    gap = ("CAST(floor((epoch_us(event_date) - epoch_us(lag(event_date) OVER (PARTITION BY contact_id ORDER BY event_date, event_type, description, owner, outcome)))"
           " / 86400000000.0) AS BIGINT)")
    return _sql(f"""SELECT contact_id, event_date, event_type, owner, description, outcome,
        greatest(coalesce({gap}, 0), 0) AS days_since_previous_event FROM jev""", _journey_ctes())


def sql_journey_metrics():
    today = O.TODAY_TS
    det = "event_type IN (" + ", ".join(O.q(t) for t in _R.DETAILED_EVENT_TYPES) + ")"
    ev = f"""ev AS (SELECT contact_id, count_if({det}) AS detailed, count_if(event_type = 'Call') AS number_of_calls,
        count_if(event_type = 'Email') AS number_of_emails, count_if(event_type = 'Meeting') AS number_of_meetings,
        min(CASE WHEN {det} THEN event_date END) AS first_detailed,
        max(CASE WHEN event_type NOT IN ('Contact created', 'Deal created') THEN event_date END) AS last_event,
        min(CASE WHEN contains(lower(event_type), 'enrollment') THEN event_date END) AS enroll_event,
        bool_or(act) AS has_acts FROM jev GROUP BY 1)"""
    fd = f"""fd AS (SELECT {O.txt('contact_id')} AS contact_id, min(deal_created_at) AS first_deal FROM lead_deal_fact
        WHERE {O.txt('contact_id')} <> '' GROUP BY 1)"""
    m0 = f"""m0 AS (SELECT c.*, ev.* EXCLUDE (contact_id), fd.first_deal,
        coalesce(ev.first_detailed, least(first_outreach_date, first_engagement_date, last_sales_activity_timestamp, last_activity_date),
          CASE WHEN time_to_first_engagement >= 0 THEN make_timestamp(epoch_us(contact_created_at) + CAST(time_to_first_engagement * 1000 AS BIGINT)) END)
          AS first_contact,
        coalesce(least(enrollment_date, TRY_CAST({O.strip('start_term')} AS TIMESTAMP)), ev.enroll_event) AS enrollment,
        coalesce(ev.last_event, least(last_activity_date, last_sales_activity_timestamp)) AS last_act,
        CASE WHEN coalesce(ev.has_acts, false) THEN coalesce(ev.detailed, 0) ELSE CAST(trunc(coalesce(CAST(num_notes AS DOUBLE), 0.0)) AS BIGINT) END AS touches
      FROM contacts_clean c LEFT JOIN ev USING (contact_id) LEFT JOIN fd USING (contact_id) WHERE c.contact_id IS NOT NULL)"""

    def between(a, b):
        d = O.days_floor(a, b)
        return f"CASE WHEN {d} >= 0 THEN {d} END"

    ds = O.days_floor("last_act", today)
    return _sql(f"""SELECT contact_id, {between('contact_created_at', 'first_contact')} AS days_from_lead_creation_to_first_contact,
        touches AS number_of_sales_touches, coalesce(number_of_calls, 0) AS number_of_calls,
        coalesce(number_of_emails, 0) AS number_of_emails, coalesce(number_of_meetings, 0) AS number_of_meetings,
        {between('contact_created_at', 'first_deal')} AS days_from_lead_creation_to_deal_creation,
        {between('contact_created_at', 'enrollment')} AS days_from_lead_creation_to_enrollment,
        {between('first_deal', 'enrollment')} AS days_from_deal_creation_to_enrollment,
        {ds} AS days_since_last_activity,
        coalesce(nullif({O.txt('lead_temperature')}, ''), 'Unknown') AS current_lead_temperature,
        CASE WHEN lower({O.txt('lead_temperature')}) = 'hot' AND ({ds} IS NULL OR {ds} >= 1) THEN 'Call today and schedule the next enrollment step.'
             WHEN has_open_deal AND ({ds} IS NULL OR {ds} >= 3) THEN 'Follow up on the open deal and confirm next action.'
             WHEN touches = 0 THEN 'Make first contact attempt and log the outcome.'
             WHEN coalesce({ds} >= 7, false) THEN 'Re-engage with a call and email sequence.'
             ELSE 'Continue normal follow-up cadence.' END AS recommended_next_action
      FROM m0""", _journey_ctes() + [ev, fd, m0])


JOURNEY_CHECK = ["contact_id", "salesman_name", "contact_created_at", "first_activity_date", "last_activity_date",
                 "program", "cohort", "lead_temperature", "deal_created_at", "deal_stage", "close_date", "actual_revenue",
                 "estimated_enrolled_revenue", "potential_revenue"]


def sql_student_journey_fact():
    first = lambda c: (f"""(SELECT cid, {c} FROM (SELECT {O.txt('contact_id')} AS cid, {c}, row_number() OVER (PARTITION BY {O.txt('contact_id')}
        ORDER BY coalesce(TRY_CAST(deal_id AS BIGINT), 9223372036854775807), coalesce(deal_id, '')) AS rn
        FROM lead_deal_fact WHERE {O.txt('contact_id')} <> '' AND {c} IS NOT NULL) WHERE rn = 1) {c}_t""")  # noqa: E731
    return _sql(f"""SELECT c.contact_id, c.salesman_name, c.contact_created_at,
        coalesce(c.first_activity_date, e.amin) AS first_activity_date, coalesce(c.last_activity_date, e.amax) AS last_activity_date,
        c.program, c.cohort, c.lead_temperature, deal_created_at_t.deal_created_at, deal_stage_t.deal_stage, close_date_t.close_date,
        coalesce(r.actual_revenue, 0.0) AS actual_revenue, coalesce(CAST(c.enrolled_revenue AS DOUBLE), 0.0) AS estimated_enrolled_revenue,
        c.potential_revenue
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY _seq NULLS LAST) AS __rn FROM contacts_clean
            WHERE contact_id IS NOT NULL) WHERE __rn = 1) c
      LEFT JOIN (SELECT {O.txt('contact_id')} AS cid, {O.money_sum('revenue_attributed')} AS actual_revenue FROM lead_deal_fact
                 WHERE {O.txt('contact_id')} <> '' GROUP BY 1) r ON r.cid = c.contact_id
      LEFT JOIN {first('deal_created_at')} ON deal_created_at_t.cid = c.contact_id
      LEFT JOIN {first('deal_stage')} ON deal_stage_t.cid = c.contact_id
      LEFT JOIN {first('close_date')} ON close_date_t.cid = c.contact_id
      LEFT JOIN (SELECT coalesce(contact_id, '') AS cid, min(event_date) AS amin, max(event_date) AS amax FROM activity_events GROUP BY 1) e
        ON e.cid = c.contact_id""", O.activity_ctes())


SEARCH_QUERY = "c12"


def sql_search_students():
    cond = " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), {O.q(SEARCH_QUERY)})"
                       for c in ["student_name", "email", "phone", "contact_id"])
    return _sql(f"""SELECT contact_id, student_name, email, contact_created_at FROM contacts_clean WHERE {cond}""")


def _events(spark, d):
    s = _s(spark, d)
    return s["contacts_clean"], s["lead_deal_fact"], s["activity_events"]


QUERIES.update({
    "journey_events": lambda spark, d: _J.journey_events(*_events(spark, d)),
    "journey_metrics": lambda spark, d: _J.journey_metrics(*_events(spark, d), _V.TODAY),
    "student_journey_fact": lambda spark, d: _J.student_journey_fact(*_events(spark, d)).select(*JOURNEY_CHECK),
    "search_students": lambda spark, d: _J.search_students(_s(spark, d)["contacts_clean"], SEARCH_QUERY).select(
        "contact_id", "student_name", "email", "contact_created_at"),
    "student_profile": lambda spark, d: _J.student_profile(_s(spark, d)["contacts_clean"], _s(spark, d)["lead_deal_fact"]),
})
ORACLE.update({
    "journey_events": sql_journey_events,
    "journey_metrics": sql_journey_metrics,
    "student_journey_fact": sql_student_journey_fact,
    "search_students": sql_search_students,
})


# ---- paid vendor performance -----------------------------------------------------------------

def q_paid_vendor_performance(spark, d):
    s = _s(spark, d)
    paid = s["contacts_clean"].where(F.col("paid_lead_flag"))
    return kpi.paid_vendor_performance(paid, s["lead_deal_fact"], kpi.vendor_costs(_V.vendor_costs_raw(spark, d)))


def q_vendor_costs(spark, d):
    return kpi.vendor_costs(_V.vendor_costs_raw(spark, d))


def _vendor_cost_cte() -> str:
    cyc = O.cycle("s_suppkey", _V.VENDOR_COST_CYCLE)
    return f"""costs AS (SELECT * FROM (SELECT {O.txt(cyc)} AS vendor, '2001-0' || CAST((s_suppkey % 9) + 1 AS VARCHAR) AS month,
        coalesce(TRY_CAST(CAST(s_acctbal AS VARCHAR) AS DOUBLE), 0.0) AS spend, '' AS notes FROM supplier)
      WHERE vendor <> '' AND spend > 0)"""


def sql_paid_vendor_performance():
    t = O.txt
    flags = ("vflags AS (SELECT coalesce(max(" + t('vendor') + " <> ''), false) AS v, coalesce(max(" + t('paid_vendor')
             + " <> ''), false) AS p FROM contacts_clean WHERE paid_lead_flag)")
    src_expr = O.strip("coalesce(CAST(source_group AS VARCHAR), 'Unknown')")
    fallback = f"CASE WHEN {t('utm_source')} <> '' THEN {t('utm_source')} ELSE {src_expr} END"
    chosen = (f"CASE WHEN (SELECT v FROM vflags) THEN {t('vendor')} WHEN (SELECT p FROM vflags) THEN {t('paid_vendor')} "
              f"ELSE {fallback} END")
    unk = lambda x, dflt: f"CASE WHEN coalesce(CAST({x} AS VARCHAR), '{dflt}') = '' THEN '{dflt}' ELSE coalesce(CAST({x} AS VARCHAR), '{dflt}') END"
    contacted = " OR ".join([f"({c} IS NOT NULL AND {t(c)} <> '')" for c in
                             ["last_activity_date", "last_sales_activity_timestamp", "first_outreach_date", "first_engagement_date"]]
                            + ["coalesce(CAST(num_notes AS DOUBLE), 0.0) > 0"])
    vc = f"""vc AS (SELECT *, CASE WHEN ({chosen}) = '' THEN 'Unknown' ELSE ({chosen}) END AS g_vendor,
        {unk('source_group', 'Unknown')} AS g_source, {unk('utm_campaign', 'Unknown')} AS g_campaign,
        {unk('vendor_confidence', 'Low')} AS g_conf, coalesce(CAST(vendor_source_field AS VARCHAR), '') AS g_field,
        ({contacted}) AS g_contacted FROM contacts_clean WHERE paid_lead_flag)"""
    keys = "g_vendor, g_source, g_campaign"
    memb = f"memb AS (SELECT DISTINCT contact_id, {keys} FROM vc WHERE contact_id IS NOT NULL)"
    rel = f"rel AS (SELECT f.*, m.g_vendor, m.g_source, m.g_campaign FROM lead_deal_fact f JOIN memb m ON m.contact_id = f.contact_id)"
    g = f"""g AS (SELECT {keys}, count(DISTINCT contact_id) AS paid_leads,
        count(DISTINCT CASE WHEN g_contacted THEN contact_id END) AS contacted_leads,
        count_if(lead_temperature = 'Hot') AS hot_leads, count_if(lead_temperature = 'Dead') AS dead_leads,
        {O.money_sum('open_pipeline_potential_revenue')} AS open_potential_revenue,
        {_avg_exact_sql('time_to_first_engagement')} / 3600000.0 AS resp,
        {_avg_exact_sql("CASE WHEN coalesce(CAST(enrolled_revenue AS DOUBLE), 0.0) > 0 THEN CAST(num_notes AS DOUBLE) END")} AS touch,
        count_if(g_conf = 'High') AS h, count_if(g_conf = 'Medium') AS m, count_if(g_conf = 'Low') AS l,
        array_to_string(list_sort(list_distinct(list(CASE WHEN g_field <> '' THEN g_field END))), ', ') AS fields
      FROM vc GROUP BY {keys})"""
    fq = f"fq AS (SELECT {keys}, count(DISTINCT deal_id) AS deals_created FROM rel GROUP BY {keys})"
    wq = f"""wq AS (SELECT {keys}, {O.money_sum('revenue_attributed')} AS actual_revenue, count(DISTINCT deal_id) AS won_deals,
        avg(days_to_close) AS days FROM rel WHERE deal_countable AND is_won GROUP BY {keys})"""
    est_c = f"""est_c AS (SELECT {keys}, contact_id, max(v) AS v FROM (
        SELECT {keys}, contact_id, CAST(enrolled_revenue AS DOUBLE) AS v FROM vc WHERE coalesce(CAST(enrolled_revenue AS DOUBLE), 0) > 0
        UNION ALL SELECT {keys}, contact_id, coalesce(CAST(total_program_revenue AS DOUBLE), 0.0) FROM rel
          WHERE deal_countable AND is_won AND {t('contact_id')} <> '') GROUP BY ALL)"""
    est = f"""est AS (SELECT {keys}, {O.money_sum('v')} AS estimated_enrolled_revenue, count(*) AS enrolled_students FROM est_c GROUP BY {keys})"""
    sp = "sp AS (SELECT vendor AS g_vendor, sum(spend) AS spend FROM costs GROUP BY 1)"
    vl = "vl AS (SELECT g_vendor, count(DISTINCT contact_id) AS vendor_leads FROM vc GROUP BY 1)"
    j = f"""j AS (SELECT g.*, coalesce(fq.deals_created, 0) AS deals_created, coalesce(wq.actual_revenue, 0.0) AS actual_revenue,
        coalesce(wq.won_deals, 0) AS won_deals, coalesce(wq.days, 0.0) AS days,
        coalesce(est.estimated_enrolled_revenue, 0.0) AS estimated_enrolled_revenue, coalesce(est.enrolled_students, 0) AS enrolled_students,
        coalesce(sp.spend, 0.0) * {O.safe_div('g.paid_leads', 'coalesce(vl.vendor_leads, 0)')} AS alloc
      FROM g LEFT JOIN fq USING ({keys}) LEFT JOIN wq USING ({keys}) LEFT JOIN est USING ({keys})
        LEFT JOIN sp USING (g_vendor) LEFT JOIN vl USING (g_vendor))"""
    roi = "CASE WHEN estimated_enrolled_revenue <> 0 THEN estimated_enrolled_revenue ELSE actual_revenue END"
    unc = "greatest(paid_leads - contacted_leads, 0)"
    sel = f"""SELECT g_vendor AS vendor, g_source AS source_group, g_campaign AS campaign, paid_leads AS leads, paid_leads,
        contacted_leads, {unc} AS uncontacted_leads, hot_leads, dead_leads, deals_created, enrolled_students, actual_revenue,
        estimated_enrolled_revenue, open_potential_revenue, {O.safe_div('won_deals', 'paid_leads')} AS close_rate,
        {O.safe_div('enrolled_students', 'paid_leads')} AS enrollment_rate, coalesce(resp, 0.0) AS average_response_time,
        days AS average_days_to_enroll, coalesce(touch, 0.0) AS average_sales_touches_before_enrollment,
        {O.safe_div('alloc', 'paid_leads')} AS cost_per_lead, {O.safe_div(roi, 'paid_leads')} AS revenue_per_lead,
        {O.safe_div(f'({roi}) - alloc', 'alloc')} AS estimated_roi,
        least({O.safe_div(f'{unc} + dead_leads', 'paid_leads')} * 100, 100.0) AS leakage_score,
        'High: ' || h || ' / Medium: ' || m || ' / Low: ' || l AS vendor_confidence,
        coalesce(nullif(fields, ''), 'Unknown') AS vendor_source_field FROM j"""
    return _sql(sel, [_vendor_cost_cte(), flags, vc, memb, rel, g, fq, wq, est_c, est, sp, vl, j])


QUERIES.update({"paid_vendor_performance": q_paid_vendor_performance, "vendor_costs": q_vendor_costs})
ORACLE.update({
    "paid_vendor_performance": sql_paid_vendor_performance,
    "vendor_costs": lambda: _sql("SELECT * FROM costs", [_vendor_cost_cte()]),
})


# ---- uploaded leads, enrollments, budget -----------------------------------------------------
from ..operators import budget as _B  # noqa: E402
from ..operators import enrollment as _E  # noqa: E402
from ..session import cut_lineage  # noqa: E402
from ..sources.versions import folder_version  # noqa: E402
from . import oracle_uploaded as U  # noqa: E402

SELECTED_TERMS = ["Summer 2"]


_LANDED: dict = {}


def _landed(spark, d, name, build):
    """Uploaded spreadsheets are landed once per session (Parquet below the shared folder), like files, and again
    when a file below ``d`` has changed."""
    key, version = (spark.sparkContext.applicationId, d, name), folder_version(spark, d)
    if _LANDED.get(key, ("", None))[0] != version:
        _LANDED[key] = version, build()
    return _LANDED[key][1]


def _lead_rows(spark, d):
    return _E.standardize_leads(_V.leads(spark, d), "HubSpot leads view")


def _enr_rows(spark, d):
    return _E.standardize_enrollments(_V.enrollments(spark, d))


def _leads(spark, d):
    return _landed(spark, d, "leads", lambda: cut_lineage(_lead_rows(spark, d)))


def _enr(spark, d):
    return _landed(spark, d, "enr", lambda: cut_lineage(_enr_rows(spark, d)))


def _landed_or(spark, d, name, rows):
    """What is landed already, else the rows themselves: for a pass over few columns, for which no whole table is written."""
    version, held = _LANDED.get((spark.sparkContext.applicationId, d, name), ("", None))
    return held if held is not None and version == folder_version(spark, d) else rows(spark, d)


def _grid(spark, d):
    """The budget workbook's cells, landed, and what is read from them: summary, allocations, terms, roundup rows."""
    def build():
        cells = cut_lineage(_V.budget_cells(spark, d))
        return tuple(cut_lineage(x) for x in (_B.budget_summary_rows(cells), *_B.budget_tables(cells)))
    return _landed(spark, d, "grid", build)


def _usql(select: str, extra: list[str] | None = None, grid: bool = False, leads: bool = False, enr: bool = False) -> str:
    ctes = (U.leads_ctes() if leads else []) + (U.enr_ctes() if enr else []) + (U.grid_ctes() if grid else []) + (extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + select


def sql_lead_summary():
    return _usql(f"""SELECT total AS total_leads, paid AS paid_leads, organic AS organic_leads, contacted AS contacted_leads,
        applicants, crm_enrolled, bad AS bad_leads, greatest(total - contacted, 0) AS uncontacted_leads,
        {O.safe_div('contacted', 'total')} AS lead_to_contact_rate, {O.safe_div('applicants', 'total')} AS lead_to_applicant_rate,
        {O.safe_div('crm_enrolled', 'total')} AS lead_to_crm_enrolled_rate, {O.safe_div('bad', 'total')} AS bad_lead_rate
      FROM (SELECT {U.lead_metric_select([])} FROM leads_f)""", leads=True)


def sql_lead_performance_by(dim: str):
    lab = f"CASE WHEN {O.txt(dim)} = '' THEN 'Unmapped' ELSE {O.txt(dim)} END"
    return _usql(f"""SELECT {U.lead_perf_cols(dim)} FROM (SELECT {lab} AS {dim}, {U.lead_metric_select([])}
        FROM leads_f GROUP BY 1)""", leads=True)


def sql_enrollment_by(dim: str):
    lab = f"CASE WHEN {O.txt(dim)} = '' THEN 'Missing' ELSE {O.txt(dim)} END"
    return _usql(f"""SELECT {lab} AS {dim}, count(student) AS actual_enrollments, {O.money_sum('revenue')} AS revenue,
        {_avg_exact_sql('days_to_enroll')} AS average_days_to_enroll FROM enr GROUP BY 1""", enr=True)


def sql_program_mix():
    parts = []
    for d in _E.MIX_DIMENSIONS:
        lab = f"CASE WHEN {O.txt(d)} = '' THEN 'Missing' ELSE {O.txt(d)} END"
        parts.append(f"""SELECT {O.q(d)} AS dimension, {lab} AS value, count(student) AS actual_enrollments,
            {O.money_sum('revenue')} AS revenue, {_avg_exact_sql('days_to_enroll')} AS average_days_to_enroll FROM enr GROUP BY 1, 2""")
    return _usql(" UNION ALL ".join(parts), enr=True)


def _roundup_sql(metric: str) -> str:
    return (f"(SELECT numeric_value FROM summary WHERE lower({O.txt('metric')}) = {O.q(metric.lower())} ORDER BY sheet, _seq LIMIT 1)")


def sql_enrollment_summary():
    g = f"coalesce(CAST({_roundup_sql('Budget')} AS DOUBLE), 0.0)"
    s = f"coalesce(CAST({_roundup_sql('Starts')} AS DOUBLE), 0.0)"
    return _usql(f"""SELECT actual_enrollments, {g} AS enrollment_goal, {O.safe_div('actual_enrollments', g)} AS percent_of_goal,
        greatest({g} - actual_enrollments, 0.0) AS remaining_enrollments, {s} AS starts,
        {O.safe_div(s, 'actual_enrollments')} AS start_rate, revenue, {O.safe_div('revenue', 'actual_enrollments')} AS revenue_per_enrollment,
        average_days_to_enroll FROM (SELECT count(*) AS actual_enrollments, {O.money_sum('revenue')} AS revenue,
        coalesce({_avg_exact_sql('days_to_enroll')}, 0.0) AS average_days_to_enroll FROM enr)""", enr=True, grid=True)


def sql_funnel():
    return _usql(f"""SELECT stage, "count" FROM (SELECT total, contacted, applicants, crm_enrolled, (SELECT count(*) FROM enr) AS act
        FROM (SELECT {U.lead_metric_select([])} FROM leads_f)) UNPIVOT ("count" FOR stage IN (total AS 'Leads', contacted AS 'Contacted',
        applicants AS 'Applicants', crm_enrolled AS 'CRM enrolled', act AS 'Actual enrollments'))""", leads=True, enr=True)


def sql_weekly(table: str, col: str, name: str, **kw):
    return _usql(f"SELECT date_trunc('week', {col}) AS week, count(*) AS {name} FROM {table} WHERE {col} IS NOT NULL GROUP BY 1", **kw)


ALLOC_COLS = ["sheet", "budget_dimension", "budget_name", "normalized_budget_name", "source", "planned_budget", "budget_metric", "_row"]
TERM_COLS = ["sheet", "budget_dimension", "budget_name", "source", "raw_term", "term", "term_label", "term_metric", "term_value",
             "term_budget", "planned_budget", "_row", "_col"]


def _udr_budget_sql(selected: bool) -> list[str]:
    names = f"lower({O.txt('budget_name')}) NOT IN ('total', 'starts', 'start%')"
    sel = " AND term IN ('SU2')" if selected else ""
    bym = f"""bym AS (SELECT budget_name, {O.money_sum("CASE WHEN lower(coalesce(term_metric, '')) = 'actual' THEN coalesce(term_value, 0.0) END")} AS budget_sheet_actual,
        {O.money_sum("CASE WHEN lower(coalesce(term_metric, '')) = 'goal' THEN coalesce(term_value, 0.0) END")} AS term_goal
      FROM term_allocations WHERE {names}{sel} AND lower(coalesce(term_metric, '')) IN ('actual', 'goal') GROUP BY 1)"""
    if selected:
        merged = "merged AS (SELECT budget_name, term_goal AS budget_goal, budget_sheet_actual FROM bym)"
    else:
        merged = f"""merged AS (SELECT coalesce(a.budget_name, b.budget_name) AS budget_name, coalesce(a.budget_goal, 0.0) AS budget_goal,
            coalesce(b.budget_sheet_actual, 0.0) AS budget_sheet_actual
          FROM (SELECT budget_name, {O.money_sum('planned_budget')} AS budget_goal FROM allocations GROUP BY 1) a
          FULL OUTER JOIN bym b ON a.budget_name = b.budget_name)"""
    bs = f"""bsum AS (SELECT {U.udr_key_sql('budget_name')} AS _udr_key, min({O.txt('budget_name')}) AS budget_udr,
        {O.money_sum('budget_goal')} AS budget_goal, {O.money_sum('budget_sheet_actual')} AS budget_sheet_actual FROM merged GROUP BY 1)"""
    return [bym, merged, bs]


def sql_udr_budget_summary(selected: bool = False):
    return _usql(f"""SELECT _udr_key, budget_udr, budget_goal, budget_sheet_actual,
        greatest(budget_goal - budget_sheet_actual, 0.0) AS budget_remaining, {O.safe_div('budget_sheet_actual', 'budget_goal')} AS budget_pct_goal
      FROM bsum""", _udr_budget_sql(selected), grid=True)


def sql_roundup_term_stats():
    names = f"lower({O.txt('budget_name')})"
    m = "lower(coalesce(term_metric, ''))"
    s = lambda cond: f"(CASE WHEN count(CASE WHEN {cond} THEN term_value END) > 0 THEN sum(CASE WHEN {cond} THEN term_value END) END)"
    named = f"{names} NOT IN ('total', 'starts', 'start%')"
    return _usql(f"""SELECT goal, actual, starts, CASE WHEN starts IS NOT NULL AND coalesce(actual <> 0, false) THEN starts / actual ELSE rate END AS start_rate
      FROM (SELECT coalesce(gt, gn) AS goal, coalesce(a_t, an) AS actual, starts, rate FROM (SELECT
        {s(f"{names} = 'total' AND {m} = 'goal'")} AS gt, {s(f"{names} = 'total' AND {m} = 'actual'")} AS a_t,
        {s(f"{m} = 'starts'")} AS starts, {s(f"{named} AND {m} = 'goal'")} AS gn, {s(f"{named} AND {m} = 'actual'")} AS an,
        avg(CASE WHEN {m} = 'start_rate' THEN term_value END) AS rate FROM term_allocations WHERE term IN ('SU2')))""", grid=True)


def sql_udr_performance(selected: bool = False):
    lab = f"CASE WHEN {O.txt('contact_owner')} = '' THEN 'Unmapped' ELSE {O.txt('contact_owner')} END"
    lp0 = f"lp0 AS (SELECT {U.lead_perf_cols('contact_owner')} FROM (SELECT {lab} AS contact_owner, {U.lead_metric_select([])} FROM leads_f GROUP BY 1))"
    lp = f"""lp AS (SELECT {U.udr_key_sql('contact_owner')} AS _udr_key, min({O.txt('contact_owner')}) AS lead_udr,
        sum(leads) AS leads, sum(contacted_progressed) AS contacted_progressed, sum(applicants) AS applicants,
        sum(crm_enrolled) AS crm_enrolled, sum(bad_leads) AS bad_leads, sum(uncontacted_leads) AS uncontacted_leads,
        {O.safe_div('sum(contacted_progressed)', 'sum(leads)')} AS l2c, {O.safe_div('sum(applicants)', 'sum(leads)')} AS l2a,
        {O.safe_div('sum(crm_enrolled)', 'sum(leads)')} AS l2e, {O.safe_div('sum(bad_leads)', 'sum(leads)')} AS bad_lead_rate
      FROM lp0 GROUP BY 1)"""
    lab2 = f"CASE WHEN {O.txt('udr')} = '' THEN 'Missing' ELSE {O.txt('udr')} END"
    ep0 = f"ep0 AS (SELECT * REPLACE ({lab2} AS udr) FROM enr)"
    ep = f"""ep AS (SELECT {U.udr_key_sql('udr')} AS _udr_key, min(udr) AS tracker_udr, count(student) AS actual_enrollments,
        {O.money_sum('revenue')} AS revenue, {_avg_exact_sql('days_to_enroll')} AS average_days_to_enroll FROM ep0 GROUP BY 1)"""
    bp = f"""bp AS (SELECT _udr_key, budget_udr, budget_goal, budget_sheet_actual, greatest(budget_goal - budget_sheet_actual, 0.0) AS budget_remaining,
        {O.safe_div('budget_sheet_actual', 'budget_goal')} AS budget_pct_goal FROM bsum)"""
    z = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    nums = ["budget_goal", "budget_sheet_actual", "budget_pct_goal", "actual_enrollments", "budget_remaining", "leads",
            "contacted_progressed", "applicants", "crm_enrolled", "bad_leads", "l2c", "l2a", "l2e", "bad_lead_rate", "revenue",
            "average_days_to_enroll"]
    udr = ("coalesce(" + ", ".join(f"nullif({O.txt(c)}, '')" for c in ["budget_udr", "tracker_udr", "lead_udr"]) + ", 'Unassigned')")
    sel = ", ".join([f"{udr} AS udr"] + [f"{z(c)} AS {c}" for c in nums]
                    + [f"{O.safe_div(z('actual_enrollments'), z('budget_goal'))} AS tracker_vs_budget_goal"])
    return _usql(f"""SELECT _udr_key, {sel} FROM (SELECT coalesce(lp._udr_key, ep._udr_key, bp._udr_key) AS _udr_key, * EXCLUDE (_udr_key)
        FROM lp FULL OUTER JOIN ep ON lp._udr_key = ep._udr_key FULL OUTER JOIN bp ON coalesce(lp._udr_key, ep._udr_key) = bp._udr_key)""",
                 _udr_budget_sql(selected) + [lp0, lp, ep0, ep, bp], leads=True, enr=True, grid=True)


def sql_roundup_allocations():
    cols = ["sheet", "budget_dimension", "budget_name", "source", "raw_term", "term", "term_label", "term_metric", "term_value",
            "term_budget", "planned_budget", "_row", "_col"]
    return _usql(f"""SELECT {', '.join(cols)} FROM (SELECT * REPLACE (
            CASE WHEN budget_dimension = 'roundup_metric' THEN budget_dimension ELSE 'UDR' END AS budget_dimension, budget_name AS source)
          FROM term_allocations)
        UNION ALL SELECT sheet, 'UDR', budget_name, budget_name, NULL, 'Total', 'Total', 'total', planned_budget, planned_budget,
          planned_budget, _row, NULL FROM allocations""", grid=True)


def sql_budget_performance():
    total = f"(SELECT coalesce(sum(numeric_value), 0.0) FROM summary WHERE lower({O.txt('metric')}) = 'budget')"
    appl = f"(SELECT {U.identity_sql('is_applicant')} FROM leads_f)"
    return _usql(f"""SELECT {total} AS total_budget, actual_enrollments, {O.safe_div('actual_enrollments', total)} AS budget_variance,
        {O.safe_div(total, '(SELECT count(*) FROM leads_f)')} AS cost_per_lead, {O.safe_div(total, appl)} AS cost_per_applicant,
        {O.safe_div(total, 'actual_enrollments')} AS cost_per_enrollment FROM (SELECT count(*) AS actual_enrollments FROM enr)""",
                 leads=True, enr=True, grid=True)


def sql_source_performance():
    lab = f"CASE WHEN {O.txt('normalized_source')} = '' THEN 'Unmapped' ELSE {O.txt('normalized_source')} END"
    lab2 = f"CASE WHEN {O.txt('normalized_source')} = '' THEN 'Missing' ELSE {O.txt('normalized_source')} END"
    lp = f"lp AS (SELECT {U.lead_perf_cols('normalized_source')} FROM (SELECT {lab} AS normalized_source, {U.lead_metric_select([])} FROM leads_f GROUP BY 1))"
    ep = f"""ep AS (SELECT {lab2} AS normalized_source, count(student) AS actual_enrollments, {O.money_sum('revenue')} AS revenue,
        {_avg_exact_sql('days_to_enroll')} AS average_days_to_enroll FROM enr GROUP BY 1)"""
    bp = f"bp AS (SELECT source AS normalized_source, {O.money_sum('planned_budget')} AS planned_budget FROM allocations GROUP BY 1)"
    z = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    return _usql(f"""SELECT normalized_source, {z('leads')} AS leads, paid_leads, organic_leads, contacted_progressed, {z('applicants')} AS applicants,
        crm_enrolled, bad_leads, uncontacted_leads, l2c, l2a, l2e, bad_lead_rate, {z('actual_enrollments')} AS actual_enrollments,
        {z('revenue')} AS revenue, average_days_to_enroll, {z('planned_budget')} AS planned_budget,
        {O.safe_div(z('planned_budget'), z('leads'))} AS cost_per_lead, {O.safe_div(z('planned_budget'), z('applicants'))} AS cost_per_applicant,
        {O.safe_div(z('planned_budget'), z('actual_enrollments'))} AS cost_per_enrollment
      FROM (SELECT coalesce(lp.normalized_source, ep.normalized_source, bp.normalized_source) AS normalized_source, * EXCLUDE (normalized_source)
        FROM lp FULL OUTER JOIN ep ON lp.normalized_source = ep.normalized_source
        FULL OUTER JOIN bp ON coalesce(lp.normalized_source, ep.normalized_source) = bp.normalized_source)""",
                 [lp, ep, bp], leads=True, enr=True, grid=True)


QUERIES.update({
    "lead_summary": lambda s, d: _E.lead_summary(_leads(s, d)),
    "lead_performance_by": lambda s, d: _E.lead_performance_by(_leads(s, d), "normalized_source"),
    "enrollment_summary": lambda s, d: _E.enrollment_summary(_enr(s, d), _B.roundup_value(_grid(s, d)[0], "Budget"),
                                                             _B.roundup_value(_grid(s, d)[0], "Starts")),
    "enrollment_by": lambda s, d: _E.enrollment_by(_enr(s, d), "udr"),
    "program_mix": lambda s, d: _E.program_mix(_enr(s, d)),
    "funnel_counts": lambda s, d: _E.funnel_counts(_leads(s, d), _enr(s, d).agg(F.count(F.lit(1))).scalar()),
    "weekly_counts": lambda s, d: _E.weekly_counts(_enr(s, d), "enrolled_date", "enrollments"),
    "weekly_leads": lambda s, d: _E.weekly_counts(_leads(s, d), "create_date", "leads"),
    "budget_summary_rows": lambda s, d: _grid(s, d)[0],
    "budget_allocations": lambda s, d: _grid(s, d)[1],
    "budget_term_allocations": lambda s, d: _grid(s, d)[2],
    "udr_budget_summary": lambda s, d: _B.udr_budget_summary(_grid(s, d)[2], _grid(s, d)[1]),
    "udr_budget_summary_term": lambda s, d: _B.udr_budget_summary(_grid(s, d)[2], _grid(s, d)[1], SELECTED_TERMS),
    "roundup_term_stats": lambda s, d: _B.roundup_term_stats(_grid(s, d)[2], SELECTED_TERMS),
    "udr_performance": lambda s, d: _B.udr_performance(_leads(s, d), _enr(s, d), _grid(s, d)[2], _grid(s, d)[1]),
    "udr_performance_term": lambda s, d: _B.udr_performance(_leads(s, d), _enr(s, d), _grid(s, d)[2].limit(0), _grid(s, d)[1],
                                                            SELECTED_TERMS, tracker_terms=_grid(s, d)[2]),
    "roundup_allocations": lambda s, d: _grid(s, d)[3],
    "budget_performance": lambda s, d: _B.budget_performance(_leads(s, d), _enr(s, d), _grid(s, d)[0]),
    "source_performance": lambda s, d: _E.source_performance(_leads(s, d), _enr(s, d), _grid(s, d)[1]),
})
ORACLE.update({
    "lead_summary": sql_lead_summary,
    "lead_performance_by": lambda: sql_lead_performance_by("normalized_source"),
    "enrollment_summary": sql_enrollment_summary,
    "enrollment_by": lambda: sql_enrollment_by("udr"),
    "program_mix": sql_program_mix,
    "funnel_counts": sql_funnel,
    "weekly_counts": lambda: sql_weekly("enr", "enrolled_date", "enrollments", enr=True),
    "weekly_leads": lambda: sql_weekly("leads_f", "create_date", "leads", leads=True),
    "budget_summary_rows": lambda: _usql("SELECT sheet, _seq, metric, value, numeric_value FROM summary", grid=True),
    "budget_allocations": lambda: _usql("SELECT " + ", ".join(ALLOC_COLS) + " FROM allocations", grid=True),
    "budget_term_allocations": lambda: _usql("SELECT " + ", ".join(TERM_COLS) + " FROM term_allocations", grid=True),
    "udr_budget_summary": lambda: sql_udr_budget_summary(False),
    "udr_budget_summary_term": lambda: sql_udr_budget_summary(True),
    "roundup_term_stats": sql_roundup_term_stats,
    "udr_performance": sql_udr_performance,
    "udr_performance_term": lambda: sql_udr_performance(True),
    "roundup_allocations": sql_roundup_allocations,
    "budget_performance": sql_budget_performance,
    "source_performance": sql_source_performance,
})


# ---- text jobs, privacy, profiling, payloads, audit, QA ---------------------------------------
from ..operators import privacy as _PR  # noqa: E402
from ..operators import profile as _PF  # noqa: E402
from ..operators import quality as _Q  # noqa: E402
from ..operators import textjobs as _T  # noqa: E402
from ..sources import payloads as _PL  # noqa: E402
from ..sources import storage as _ST  # noqa: E402

RE2_LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _read(spark, d, name):
    return _V.read_table(spark, d, name)


def q_extract_data_lines(spark, d):
    pages = _T.html_to_text(_read(spark, d, "pages"))
    landed = pages.select("page_id", F.concat_ws("\n", "url", "text").alias("text"))
    return _T.extract_data_lines(landed, key="page_id")


def sql_extract_data_lines():
    pat = O.q(RE2_LINE_BREAKS)
    kw = O.q("(?i)" + _R.DATA_LINE_KEYWORDS)
    return f"""WITH landed AS (SELECT p.page_id, concat_ws(chr(10), p.url, t.text) AS text FROM pages p
                  JOIN ({sql_html_to_text()}) t ON t.page_id = p.page_id),
        l AS (SELECT page_id, unnest(string_split_regex(text, {pat})) AS raw,
                  unnest(generate_series(1, len(string_split_regex(text, {pat})))) AS pos FROM landed),
        f AS (SELECT page_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM l
              WHERE regexp_matches(raw, '\\p{{Nd}}') AND regexp_matches(raw, {kw}))
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS line_no, line FROM f WHERE line <> ''"""


_KEEP_SQL = ", ".join(O.q(x) for x in _R.PUBLIC_KEEP_VALUES)


def sql_label_pseudonyms():
    return _usql(f"""SELECT label, printf('UDR %02d', row_number() OVER (ORDER BY label)) AS pseudonym FROM (
        SELECT DISTINCT label FROM (SELECT {O.txt('contact_owner')} AS label FROM leads_f UNION ALL SELECT {O.txt('udr')} FROM enr)
        WHERE lower(label) NOT IN ({_KEEP_SQL}, 'unassigned'))""", leads=True, enr=True)


RAW_CONTACT_COLUMNS = ["hs_object_id", "createdate", "hubspot_owner_id", "hubspot_owner_assigneddate", "firstname", "lastname",
                       "email", "phone", "lifecyclestage", "hs_lead_status", "utm_source", "utm_medium", "utm_campaign", "program",
                       "degree_level", "enrollment_status", "enrollment_date", "application_date", "session_start", "cohort",
                       "campus_location", "modality", "standard_tuition_total", "hs_first_outreach_date", "notes_last_updated",
                       "notes_next_activity_date", "num_notes", "hs_time_to_first_engagement"]


RAW_DEAL_COLUMNS = ["hs_object_id", "createdate", "hubspot_owner_id", "dealstage", "pipeline", "closedate", "amount"]


def q_profile_fields(spark, d):
    parts = [_PF.profile_fields(raw.withColumn("__o", F.col("hs_object_id").try_cast("long")), kind, order_col="__o")
             for kind, raw in (("contact", _V.contacts(spark, d)), ("deal", _V.deals(spark, d)))]
    return parts[0].unionByName(parts[1])


PROFILED = [("contact", "raw_contacts", RAW_CONTACT_COLUMNS), ("deal", "raw_deals", RAW_DEAL_COLUMNS)]


def _profile_values_sql(kind: str, table: str, columns: list[str]) -> str:
    return (f"""u_{kind} AS (SELECT __o, property_name, {O.txt('v')} AS v FROM (UNPIVOT (SELECT CAST(hs_object_id AS BIGINT) AS __o,
            {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}
            FROM {table}) ON COLUMNS(* EXCLUDE (__o)) INTO NAME property_name VALUE v) WHERE {O.txt('v')} <> '')""")


def _profile_select_sql(kind: str, table: str, columns: list[str]) -> str:
    u = f"u_{kind}"
    return f"""SELECT '{kind}' AS object_type, m.property_name, m.property_name AS label, CAST(NULL AS VARCHAR) AS data_type,
        coalesce(c.n, 0) AS non_null_count,
        CASE WHEN t.total > 0 THEN round(coalesce(c.n, 0) / t.total * 100, 2) ELSE 0.0 END AS percent_filled,
        coalesce(s.sample_values, '') AS sample_values, coalesce(c.n, 0) > 0 AS usable
      FROM (SELECT unnest({columns}) AS property_name) m
      CROSS JOIN (SELECT count(*) AS total FROM {table}) t
      LEFT JOIN (SELECT property_name, count(*) AS n FROM {u} GROUP BY 1) c USING (property_name)
      LEFT JOIN (SELECT property_name, string_agg(v, ' | ' ORDER BY rn) AS sample_values FROM (
          SELECT property_name, v, row_number() OVER (PARTITION BY property_name ORDER BY f, v) AS rn
          FROM (SELECT property_name, v, min(__o) AS f FROM {u} GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1) s USING (property_name)"""


def sql_profile_fields():
    return _sql(" UNION ALL ".join(f"({_profile_select_sql(*p)})" for p in PROFILED), [_profile_values_sql(*p) for p in PROFILED])


def q_flatten_crm_objects(spark, d):
    raw = _V.contacts(spark, d)
    return _PL.flatten_crm_objects(_PL.contact_pages(raw), raw.columns)


def sql_flatten_crm_objects():
    props = ", ".join(c for c in RAW_CONTACT_COLUMNS if c != "hs_object_id")
    return _sql(f"""SELECT hs_object_id AS id, createdate AS "createdAt", createdate AS "updatedAt", false AS archived, {props},
        hs_object_id FROM raw_contacts""")


def q_flatten_links(spark, d):
    return _PL.flatten_contact_deal_links(_PL.link_pages(_V.associations(spark, d)))


def q_refresh_audit(spark, d):
    s = _s(spark, d)
    tables = {k: s[k] for k in ["contacts_clean", "deals_clean", "lead_deal_fact", "links", "owners", "activity_events"]}
    return _ST.refresh_audit(tables, {"contacts": 0, "deals": 0}, _V.TODAY, True)


def sql_refresh_audit():
    counts = ", ".join(f"(SELECT count(*) FROM {t}) AS {n}_rows" for t, n in [
        ("contacts_clean", "contacts_clean"), ("deals_clean", "deals_clean"), ("lead_deal_fact", "lead_deal_fact"),
        ("links", "links"), ("raw_owners", "owners"), ("activity_events", "activity_events")])
    return _sql(f"SELECT {counts}, 0 AS max_contacts, 0 AS max_deals, true AS include_activities, "
                f"{O.TODAY_TS} AS refreshed_at", O.activity_ctes())


PIVOTS = [_Q.Pivot("Paid PLS", "paid_lead_list", "lead_status", "Paid"), _Q.Pivot("Paid PLC", "paid_lead_list", "lifecycle_stage", "Paid"),
          _Q.Pivot("UDR L2C", "contact_owner", "lead_status"), _Q.Pivot("UDR L2A", "contact_owner", "lifecycle_stage")]


def q_pivot_reconciliation(spark, d):
    counts = cut_lineage(_Q.pivot_counts(_leads(spark, d), PIVOTS))
    return _Q.pivot_reconciliation(counts, _Q.pivot_sheet_rows(cut_lineage(_Q.pivot_cells(counts)), ["grand_total"]))


def _pivot_select_sql() -> str:
    parts = []
    for pivot in PIVOTS:
        name, group = pivot.name, pivot.group
        rows = "(SELECT * FROM leads_f WHERE lead_type = 'Paid')" if pivot.lead_type else "leads_f"
        parts.append(f"""SELECT {O.q(name)} AS pivot_name, coalesce(r.g, p.g, 'Unmapped') AS "group", coalesce(r.n, 0.0) AS raw_total,
            coalesce(p.n, 0.0) AS pivot_total, coalesce(r.n, 0.0) - coalesce(p.n, 0.0) AS difference
          FROM (SELECT CASE WHEN {O.txt(group)} = '' THEN 'Unmapped' ELSE {group} END AS g, CAST(count(*) AS DOUBLE) AS n FROM {rows} GROUP BY 1) r
          FULL OUTER JOIN (SELECT {O.txt(group)} AS g, CAST(count(*) AS DOUBLE) AS n FROM {rows}
                           WHERE {O.txt('record_id')} <> '' AND {O.txt(group)} <> '' GROUP BY 1) p ON r.g = p.g""")
    return " UNION ALL ".join(f"({p})" for p in parts)


def sql_pivot_reconciliation():
    return _usql(_pivot_select_sql(), leads=True)


def q_qa_checks(spark, d):
    leads, enr = _leads(spark, d), _enr(spark, d)
    diffs = q_pivot_reconciliation(spark, d)
    return _Q.qa_checks(leads, enr, _grid(spark, d)[1], diffs, {"token_present": False})


def q_field_mapping(spark, d):
    inv = q_profile_fields(spark, d)
    return _PF.choose_field_mapping(inv, _PF.wanted_fields(spark))


QUERIES.update({
    "html_to_text": lambda s, d: _T.html_to_text(_read(s, d, "pages")).select("page_id", "text"),
    "extract_data_lines": q_extract_data_lines,
    "label_pseudonyms": lambda s, d: _PR.label_pseudonyms([(_leads(s, d), ["contact_owner"]), (_enr(s, d), ["udr"])], "UDR",
                                                          keep=["Unassigned"]),
    "profile_fields": q_profile_fields,
    "choose_field_mapping": q_field_mapping,
    "flatten_crm_objects": q_flatten_crm_objects,
    "flatten_contact_deal_links": q_flatten_links,
    "refresh_audit": q_refresh_audit,
    "pivot_reconciliation": q_pivot_reconciliation,
    "qa_checks": q_qa_checks,
})
ORACLE.update({
    "extract_data_lines": sql_extract_data_lines,
    "label_pseudonyms": sql_label_pseudonyms,
    "profile_fields": sql_profile_fields,
    "flatten_crm_objects": sql_flatten_crm_objects,
    "flatten_contact_deal_links": lambda: _sql("SELECT contact_id, deal_id, association_type FROM links"),
    "refresh_audit": sql_refresh_audit,
    "pivot_reconciliation": sql_pivot_reconciliation,
})


def _executive_overview(spark, d, selected=None):
    summ, _, terms, _ = _grid(spark, d)
    return _B.executive_overview(_leads(spark, d), None, _enr(spark, d), summ, terms, selected=selected, today=_V.TODAY)


def q_executive_overview(spark, d):
    return _executive_overview(spark, d)


def q_executive_overview_term(spark, d):
    return _executive_overview(spark, d, SELECTED_TERMS)


def q_executive_overview_terms(spark, d):
    return _executive_overview(spark, d, ["Summer 2", "Spring 1"])


QUERIES.update({"executive_overview": q_executive_overview, "executive_overview_term": q_executive_overview_term,
                "executive_overview_terms": q_executive_overview_terms})


def sql_executive_overview(tokens: tuple[str, ...] = ()):
    def first(metric):
        return _roundup_sql(metric)

    def orc(*vals):
        parts = " ".join(f"WHEN ({v}) IS NOT NULL AND ({v}) <> 0 THEN ({v})" for v in vals[:-1])
        return f"(CASE {parts} ELSE {vals[-1]} END)"

    names = f"lower({O.txt('budget_name')})"
    m = "lower(coalesce(term_metric, ''))"
    s = lambda cond: f"(CASE WHEN count(CASE WHEN {cond} THEN term_value END) > 0 THEN sum(CASE WHEN {cond} THEN term_value END) END)"
    named = f"{names} NOT IN ('total', 'starts', 'start%')"
    tfilter = f"term IN ({', '.join(map(O.q, tokens))})" if tokens else "false"
    bts = f"""bts AS (SELECT coalesce(gt, gn) AS goal FROM (SELECT {s(f"{names} = 'total' AND {m} = 'goal'")} AS gt,
        {s(f"{named} AND {m} = 'goal'")} AS gn FROM term_allocations WHERE {tfilter}))"""
    goal = f"coalesce((SELECT goal FROM bts), {orc(first('Budget'), '0.0')})"
    starts = orc(first("Starts"), "0.0")
    enrolled = orc(first("Enrolled"), "0.0")
    start_pct = orc(first("Start%"), "CAST(NULL AS DOUBLE)")
    start_rate = f"(CASE WHEN {start_pct} IS NOT NULL THEN {start_pct} WHEN {enrolled} <> 0 THEN {starts} / {enrolled} ELSE 0.0 END)"
    ls = f"ls AS (SELECT {U.lead_metric_select([])} FROM leads_f)"
    ps = f"ps AS (SELECT {U.lead_metric_select([])} FROM leads_f WHERE lead_type = 'Paid')"
    es = f"""es AS (SELECT count(*) AS act, {O.money_sum('revenue')} AS revenue,
        coalesce({_avg_exact_sql('days_to_enroll')}, 0.0) AS avg_days, max(term) AS last_term FROM enr)"""
    g, st = f"CAST({goal} AS DOUBLE)", f"CAST({starts} AS DOUBLE)"
    rem = f"greatest({g} - es.act, 0.0)"
    days = f"greatest({O.days_floor(O.TODAY_TS, 'es.last_term')}, 1)"
    pace = f"(CASE WHEN {rem} <= 0 OR es.last_term IS NULL THEN 0.0 ELSE {rem} / greatest({days} / 7.0, 1.0) END)"
    sel = f"""SELECT ls.total AS total_leads, {orc('ps.total', 'ls.paid')} AS paid_leads, {orc('ls.organic', 'ps.organic')} AS organic_leads,
        ls.applicants, ls.crm_enrolled, es.act AS actual_enrollments, {g} AS enrollment_goal, {st} AS starts, es.revenue,
        ls.bad AS bad_leads, {goal} AS total_budget, greatest(coalesce({goal}, 0.0) - es.act, 0.0) AS budget_remaining,
        ls.contacted AS contacted_leads, {O.safe_div('ls.contacted', 'ls.total')} AS lead_to_contact_rate,
        {O.safe_div('ls.applicants', 'ls.total')} AS lead_to_applicant_rate, {O.safe_div('ls.crm_enrolled', 'ls.total')} AS lead_to_crm_enrolled_rate,
        {O.safe_div('es.act', g)} AS percent_of_goal, {rem} AS remaining_enrollments, {pace} AS weekly_pace_required,
        {start_rate} AS start_rate, {O.safe_div('es.revenue', 'es.act')} AS revenue_per_enrollment, es.avg_days AS average_days_to_enroll,
        {O.safe_div('ls.bad', 'ls.total')} AS bad_lead_rate, {O.safe_div(goal, 'ls.total')} AS cost_per_lead,
        {O.safe_div(goal, 'ls.applicants')} AS cost_per_applicant, {O.safe_div(goal, 'es.act')} AS cost_per_enrollment
      FROM ls, ps, es"""
    return _usql(sel, [bts, ls, ps, es], leads=True, enr=True, grid=True)


ORACLE.update({"executive_overview": sql_executive_overview,
               "executive_overview_term": lambda: sql_executive_overview(("SU2",)),
               "executive_overview_terms": lambda: sql_executive_overview(("SP1", "SU2"))})


def _qa_status_sql(severity: str, count: str) -> str:
    if severity == "Info":
        return "'Info'"
    return f"CASE WHEN ({count}) = 0 THEN 'Pass' ELSE 'Review' END"


def sql_qa_checks():
    t = O.txt

    def miss(c):
        return f"count_if({t(c)} = '')"

    def dup(c):
        v = f"nullif({c}, '')"
        return f"(count({v}) - count(DISTINCT {v}))"

    def srcs(table, col):
        return (f"SELECT DISTINCT s FROM (SELECT {U.norm_source(col)} AS s FROM {table} WHERE {col} IS NOT NULL) "
                f"WHERE s <> {O.q(_R.UNKNOWN_SOURCE)}")

    def diff(name, a, b):
        return f"{name} AS (SELECT count(*) AS n FROM ({a}) x WHERE s NOT IN ({b}))"

    la = f"""la AS (SELECT {dup(t('record_id'))} AS dup_id, {dup(f"lower({t('email')})")} AS dup_email, {miss('email')} AS m_email,
        {miss('contact_owner')} AS m_owner, {miss('lead_status')} AS m_status, {miss('lifecycle_stage')} AS m_life,
        {miss('create_date')} AS m_create, {miss('degree')} AS m_degree,
        count_if(coalesce(normalized_source, {O.q(_R.UNKNOWN_SOURCE)}) = {O.q(_R.UNKNOWN_SOURCE)}) AS m_lsource,
        count_if(lower({t('lifecycle_stage')}) = 'enrolled') AS crm_enrolled FROM leads_f)"""
    ea = f"""ea AS (SELECT {miss('term')} AS m_term, {miss('enrolled_date')} AS m_date, {miss('source')} AS m_esource,
        count_if(TRY_CAST(CAST(revenue AS VARCHAR) AS DOUBLE) IS NULL) AS m_rev, {miss('payment_funding')} AS m_pay,
        count_if({t('enrolled_date')} <> '' AND TRY_CAST({t('enrolled_date')} AS TIMESTAMP) IS NULL) AS bad_date,
        count_if(CAST(days_to_enroll AS DOUBLE) < 0) AS neg_days, count(*) AS actual FROM enr)"""
    pv = f"pv AS (SELECT count_if(coalesce(CAST(difference AS DOUBLE), 0.0) <> 0) AS pivot_n FROM ({_pivot_select_sql()}))"
    rows = [("Duplicate Record IDs", "High", "''", "la.dup_id"), ("Duplicate emails", "Medium", "''", "la.dup_email"),
            ("Missing email", "Medium", "''", "la.m_email"), ("Missing contact owner/UDR", "High", "''", "la.m_owner"),
            ("Missing lead status", "Medium", "''", "la.m_status"), ("Missing lifecycle stage", "Medium", "''", "la.m_life"),
            ("Missing create date", "Medium", "''", "la.m_create"), ("Missing Degree/Program", "Low", "''", "la.m_degree"),
            ("Missing source", "High", "''", "la.m_lsource"), ("Missing enrollment term", "High", "''", "ea.m_term"),
            ("Missing enrolled date", "High", "''", "ea.m_date"),
            ("Missing source", "Medium", "'Enrollment tracker source field.'", "ea.m_esource"),
            ("Missing revenue", "Medium", "''", "ea.m_rev"), ("Missing payment/funding", "Low", "''", "ea.m_pay"),
            ("Invalid dates", "Medium", "''", "ea.bad_date"), ("Negative days to enroll", "High", "''", "ea.neg_days"),
            ("HubSpot CRM enrolled vs tracker actual enrolled mismatch", "Medium",
             "'CRM enrolled=' || format('{:,}', la.crm_enrolled) || '; tracker actual=' || format('{:,}', ea.actual) || '.'",
             "abs(la.crm_enrolled - ea.actual)"),
            ("Budget source not found in HubSpot", "Medium", "''", "bh.n"),
            ("HubSpot source not found in budget", "Medium", "''", "hb.n"),
            ("Tracker source not found in budget", "Medium", "''", "tb.n"),
            ("Uploaded pivot totals vs recalculated raw totals", "Medium", "''", "pv.pivot_n"),
            ("HubSpot API fetch failure", "Info", "'No token configured; static uploaded baseline is in use.'", "1"),
            ("Stale data warning", "Info", "'Live HubSpot data has not been refreshed in this session.'", "1")]
    sel = " UNION ALL ".join(
        f"SELECT {O.q(chk)} AS \"check\", "
        f"{_qa_status_sql(sev, cnt)} AS status, "
        f"{O.q(sev)} AS severity, CAST(coalesce({cnt}, 0) AS BIGINT) AS \"count\", {det} AS details FROM la, ea, bh, hb, tb, pv"
        for chk, sev, det, cnt in rows)
    return _usql(sel, [la, ea, diff("bh", srcs("allocations", "source"), srcs("leads_f", "normalized_source")),
                       diff("hb", srcs("leads_f", "normalized_source"), srcs("allocations", "source")),
                       diff("tb", srcs("enr", "normalized_source"), srcs("allocations", "source")), pv],
                 leads=True, enr=True, grid=True)


ORACLE.update({"qa_checks": sql_qa_checks})


def sql_choose_field_mapping():
    rows = []
    for obj, fields in _R.DASHBOARD_FIELDS.items():
        for name, pref in fields.items():
            toks = _R.SEARCH_HINTS.get(name) or name.split("_")
            rows.append(f"({O.q(obj)}, {O.q(name)}, [{', '.join(O.q(p) for p in pref)}]::VARCHAR[], "
                        f"[{', '.join(O.q(t.lower()) for t in toks)}]::VARCHAR[], {len(toks)})")
    wanted = f"wanted AS (SELECT * FROM (VALUES {', '.join(rows)}) w(object_type, logical_name, preferred, tokens, n_tokens))"
    inv = "inv AS (SELECT * FROM prof WHERE usable)"
    prof_ctes = [f"prof AS ({' UNION ALL '.join(f'({_profile_select_sql(*p)})' for p in PROFILED)})"]
    hay = "replace(lower(i.property_name || ' ' || coalesce(i.label, '')), '_', ' ')"
    return _sql(f"""SELECT w.object_type, w.logical_name, coalesce(p.prop, a.prop) AS selected_property,
        array_to_string(w.preferred, ', ') AS preferred_candidates
      FROM wanted w
      LEFT JOIN (SELECT object_type, logical_name, prop FROM (SELECT w.object_type, w.logical_name, i.property_name AS prop,
            row_number() OVER (PARTITION BY w.object_type, w.logical_name ORDER BY list_position(w.preferred, i.property_name)) AS rn
          FROM wanted w JOIN inv i ON i.object_type = w.object_type AND list_position(w.preferred, i.property_name) > 0) WHERE rn = 1) p
        ON p.object_type = w.object_type AND p.logical_name = w.logical_name
      LEFT JOIN (SELECT object_type, logical_name, prop FROM (SELECT w.object_type, w.logical_name, i.property_name AS prop,
            row_number() OVER (PARTITION BY w.object_type, w.logical_name
              ORDER BY len(list_filter(list_distinct(w.tokens), lambda t: contains({hay}, t))) DESC,
                       coalesce(i.percent_filled, 0.0) DESC, i.property_name DESC) AS rn
          FROM wanted w JOIN inv i ON i.object_type = w.object_type
          WHERE len(list_filter(list_distinct(w.tokens), lambda t: contains({hay}, t))) >= least(2, w.n_tokens)) WHERE rn = 1) a
        ON a.object_type = w.object_type AND a.logical_name = w.logical_name""",
                [*[_profile_values_sql(*p) for p in PROFILED], *prof_ctes, wanted, inv])


ORACLE.update({"choose_field_mapping": sql_choose_field_mapping})


def sql_status_before_enrollment():
    parts = []
    for col, label in [("lead_status", "lead status"), ("final_lead_status", "final lead status"),
                       ("lifecycle_stage", "lifecycle stage"), ("enrollment_status", "enrollment status")]:
        v = f"CASE WHEN {O.txt_na(col)} = '' THEN 'Unknown' ELSE {O.txt_na(col)} END"
        parts.append(f"""(SELECT {O.q(label)} AS "status field", status, leads, share,
              CAST(row_number() OVER (ORDER BY leads DESC, status) AS INTEGER) AS rank FROM (
            SELECT status, leads, {O.safe_div('leads', 'sum(leads) OVER ()')} AS share FROM (
              SELECT {v} AS status, count(DISTINCT contact_id) AS leads FROM cpp WHERE cohort_is_enrolled GROUP BY 1)))""")
    return _sql(" UNION ALL ".join(parts), _cohort_ctes())


ORACLE.update({"status_before_enrollment": sql_status_before_enrollment})


def sql_enrollment_inputs():
    meds = [("cohort_days_to_first_contact", "median days to first contact"),
            ("cohort_sales_touches_to_enroll", "median number of touches"),
            ("cohort_days_to_enroll", "median days to enrollment")]
    parts = [f"SELECT {O.q(label)} AS metric, CAST(CAST(median({c}) AS DOUBLE) AS VARCHAR) AS value FROM cpp "
             f"WHERE cohort_is_enrolled HAVING count({c}) > 0" for c, label in meds]
    for c, label in [("source_group", "most common source"), ("paid_vendor", "most common vendor"),
                     ("program", "most common program"), ("salesman_name", "most common salesman path")]:
        v = f"CASE WHEN {O.txt_na(c)} = '' THEN 'Unknown' ELSE {O.txt_na(c)} END"
        parts.append(f"""SELECT {O.q(label)} AS metric, v AS value FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS rn
            FROM (SELECT {v} AS v, count(*) AS n FROM cpp WHERE cohort_is_enrolled GROUP BY 1)) WHERE rn = 1""")
    return _sql(" UNION ALL ".join(parts), _cohort_ctes())


ORACLE.update({"enrollment_inputs": sql_enrollment_inputs})


def sql_student_profile():
    src = {"degree_level": "degree_level_resolved"}
    money = {"estimated_total_tuition", "actual_revenue", "potential_revenue"}
    parts = []
    for col, label in _R.PROFILE_FIELDS:
        c = src.get(col, col)
        if col in money:
            v = f"'$' || format('{{:,.0f}}', coalesce(CAST({c} AS DOUBLE), 0.0))"
        elif col == "paid_lead_flag":
            v = f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
        else:
            v = O.txt(c)
        parts.append(f"SELECT contact_id, {O.q(label)} AS \"Field\", {v} AS \"Value\" FROM pc")
    pc = f"""pc AS (SELECT c.*, coalesce(r.actual_revenue, 0.0) AS actual_revenue FROM contacts_clean c
        LEFT JOIN (SELECT {O.txt('contact_id')} AS cid, {O.money_sum('revenue_attributed')} AS actual_revenue FROM lead_deal_fact
                   WHERE {O.txt('contact_id')} <> '' GROUP BY 1) r ON r.cid = c.contact_id WHERE c.contact_id IS NOT NULL)"""
    return _sql(" UNION ALL ".join(parts), [pc])


ORACLE.update({"student_profile": sql_student_profile})


# Named entities spelled out for the SQL side of html_to_text (the Spark side unescapes every
# HTML entity); the driver pages use only these.  '&amp;' is replaced last so that '&amp;quot;'
# becomes '&quot;', as a single left-to-right unescape does.
SQL_HTML_ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
                     ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def sql_html_to_text():
    t = "regexp_replace(regexp_replace(html, '<(br|p|div|li|tr|h[1-6])[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
    for ent, ch in SQL_HTML_ENTITIES:
        t = f"replace({t}, {O.q(ent)}, {O.q(ch)})"
    # HTML5 also decodes the legacy '&amp' without a semicolon (e.g. a truncated title).
    t = f"regexp_replace({t}, '&amp([^;]|$)', '&\\1', 'g')"
    return f"SELECT page_id, {t} AS text FROM pages"


ORACLE.update({"html_to_text": sql_html_to_text})


PUBLISHED_LEADS = ["contact_owner", "lead_status", "lifecycle_stage", "create_date", "last_activity_date", "paid_lead_list",
                   "organic_lead_list", "degree", "utm_source", "normalized_source", "lead_type"]
PUBLISHED_ENROLLMENTS = ["row_key", "student", "udr", "program", "modality", "enrolled_date", "student_type", "payment_funding",
                         "new_roll", "term", "source", "days_to_enroll", "revenue", "normalized_source"]


# row_key repeats in the driver tables; the further columns order its rows
STUDENT_ORDER = ["row_key", "revenue", "udr", "program", "source", "enrolled_date", "modality", "new_roll", "payment_funding"]


def _owner_map(spark, d):
    def build():
        _, alloc, terms, _ = _grid(spark, d)
        leads, enr = _landed_or(spark, d, "leads", _lead_rows), _landed_or(spark, d, "enr", _enr_rows)
        frames = [(x, _R.OWNER_LABEL_COLUMNS) for x in (leads, enr, alloc, terms)]
        return cut_lineage(_PR.label_pseudonyms(frames, "UDR"))
    return _landed(spark, d, "owner map", build)


def _published(name, columns):
    def query(spark, d):
        df = {"leads": lambda: _leads(spark, d), "enrollments": lambda: _enr(spark, d), "allocations": lambda: _grid(spark, d)[1]}[name]()
        clean = _PR.sanitize_frame(df, _owner_map(spark, d), STUDENT_ORDER if name == "enrollments" else None)
        return clean.select(*columns) if columns else clean
    return query


def q_public_baseline(spark, d):
    leads = _leads(spark, d)
    return _PR.public_metadata(leads, leads.where(F.col("lead_type") == "Paid"), _enr(spark, d), _grid(spark, d)[1])


def _owner_map_sql() -> str:
    parts = [("contact_owner", "leads_f"), ("udr", "enr"), ("budget_name", "allocations"), ("normalized_budget_name", "allocations"),
             ("budget_name", "term_allocations")]
    labels = " UNION ALL ".join(f"SELECT {O.txt(c)} AS label FROM {t}" for c, t in parts)
    return (f"owner_map AS (SELECT label, printf('UDR %02d', row_number() OVER (ORDER BY label)) AS pseudonym FROM (SELECT DISTINCT label "
            f"FROM ({labels}) WHERE lower(label) NOT IN ({_KEEP_SQL})))")


def _sql_published(table: str, columns: list[str]) -> str:
    renamed = {*_R.OWNER_LABEL_COLUMNS, *_R.SOURCE_LABEL_COLUMNS}
    sel, joins = [], []
    for c in columns:
        if c in renamed:
            joins.append(f"LEFT JOIN owner_map m_{c} ON m_{c}.label = {O.txt(f't.{c}')}")
            sel.append(f"coalesce(m_{c}.pseudonym, t.{c}) AS {c}")
        elif c == "student":
            sel.append("printf('Student %04d', row_number() OVER (ORDER BY " + ", ".join(f"t.{x}" for x in STUDENT_ORDER) + ")) AS student")
        else:
            sel.append(f"t.{c}")
    return _usql(f"SELECT {', '.join(sel)} FROM {table} t {' '.join(joins)}", [_owner_map_sql()], leads=True, enr=True, grid=True)


def q_enrollment_bad_dates(spark, d):
    """Ledger rows whose date is no date: kept, with a NULL date, and counted."""
    raw = _V.enrollments(spark, d)
    bad = F.floor(F.col("days_to_enroll")) % 7 == 0
    raw = raw.withColumn("enrolled_date", F.when(bad, F.lit("TBD")).otherwise(F.date_format("enrolled_date", "yyyy-MM-dd")))
    enr = _E.standardize_enrollments(raw)
    return enr.groupBy("udr").agg(F.count(F.lit(1)).alias("rows"), _Q.invalid_date_count(F.col("enrolled_date_text")).alias("invalid_dates"),
                                  F.count("enrolled_date").alias("dated_rows"))


def sql_enrollment_bad_dates():
    return _usql("""SELECT udr, count(*) AS "rows", count_if(days_to_enroll % 7 = 0) AS invalid_dates,
        count(*) - count_if(days_to_enroll % 7 = 0) AS dated_rows FROM enr GROUP BY 1""", enr=True)


def q_source_coverage(spark, d):
    return _Q.source_coverage(_leads(spark, d), _enr(spark, d), _grid(spark, d)[1])


def sql_source_coverage():
    def sources(table, col):
        return (f"SELECT DISTINCT s FROM (SELECT {U.norm_source(col)} AS s FROM {table} WHERE {col} IS NOT NULL) "
                f"WHERE s <> {O.q(_R.UNKNOWN_SOURCE)}")
    crm, budget, tracker = sources("leads_f", "normalized_source"), sources("allocations", "source"), sources("enr", "normalized_source")
    parts = [f"SELECT {O.q(check)} AS \"check\", s AS source FROM ({a}) WHERE s NOT IN ({b})" for check, a, b in [
        ("Budget source not found in HubSpot", budget, crm), ("HubSpot source not found in budget", crm, budget),
        ("Tracker source not found in budget", tracker, budget)]]
    return _usql(" UNION ALL ".join(parts), leads=True, enr=True, grid=True)


ALLOCATION_COLUMNS = ["sheet", "budget_dimension", "budget_name", "normalized_budget_name", "source", "planned_budget", "budget_metric", "_row"]

QUERIES.update({
    "public_baseline": q_public_baseline,
    "sanitize_leads": _published("leads", PUBLISHED_LEADS),
    "sanitize_enrollments": _published("enrollments", PUBLISHED_ENROLLMENTS),
    "sanitize_budget": _published("allocations", ALLOCATION_COLUMNS),
    "enrollment_bad_dates": q_enrollment_bad_dates,
    "source_coverage": q_source_coverage,
})
ORACLE.update({
    "public_baseline": lambda: _usql(f"""SELECT (SELECT count(*) FROM leads_f WHERE lead_type = 'Paid') AS paid_rows,
        (SELECT count(*) FROM leads_f) AS udr_rows, count(*) AS enrollment_rows, coalesce({O.money_sum('revenue')}, 0.0) AS tracker_revenue,
        (SELECT count(*) FROM allocations) AS budget_allocation_rows, '' AS workbook_term FROM enr""", leads=True, enr=True, grid=True),
    "sanitize_leads": lambda: _sql_published("leads_f", PUBLISHED_LEADS),
    "sanitize_enrollments": lambda: _sql_published("enr", PUBLISHED_ENROLLMENTS),
    "sanitize_budget": lambda: _sql_published("allocations", ALLOCATION_COLUMNS),
    "enrollment_bad_dates": sql_enrollment_bad_dates,
    "source_coverage": sql_source_coverage,
})


# ---- filters, owners, newest records, contact flags ---------------------------------------------

def q_lead_filters(spark, d):
    leads = _E.apply_filters(_leads(spark, d), {"lifecycle_stage": ["lead", "Applicant"], "degree": [], "contact_owner": ["NATION_1", "NATION_2", "NATION_3"]})
    return _E.filter_date_range(leads, "create_date", "1996-01-01", "2001-06-30").select("record_id", "contact_owner", "lifecycle_stage", "create_date")


def sql_lead_filters():
    return _usql("""SELECT record_id, contact_owner, lifecycle_stage, create_date FROM leads_f WHERE lifecycle_stage IN ('lead', 'Applicant')
        AND coalesce(contact_owner, '') IN ('NATION_1', 'NATION_2', 'NATION_3') AND create_date >= DATE '1996-01-01' AND create_date < DATE '2001-07-01'""", leads=True)


def q_filter_options(spark, d):
    return _E.filter_options([_leads(spark, d), _enr(spark, d)], "normalized_source")


def sql_filter_options():
    return _usql(f"""SELECT DISTINCT normalized_source FROM (SELECT {O.txt('normalized_source')} AS normalized_source FROM leads_f
        UNION ALL SELECT {O.txt('normalized_source')} FROM enr) WHERE normalized_source <> ''""", leads=True, enr=True)


CONTACT_FLAGS = ["contact_id", "lead_temperature", "dead_reason", "reviveable_flag", "archive_remove_flag"]


def sql_contact_flags():
    has = " OR ".join(f"{O.txt_na(c)} <> ''" for c in ("program", "email", "phone"))
    archive = " OR ".join(f"contains(coalesce(dead_reason, ''), {O.q(t.replace(' ', '_'))})" for t in _R.ARCHIVE_TERMS)
    return _sql(f"""SELECT contact_id, lead_temperature, dead_reason,
        lead_temperature = 'Dead' AND coalesce(dead_reason, '') IN ('inactive_60_days_no_open_deal', 'never_contacted_30_days', 'low_score')
          AND (paid_lead_flag OR {has} OR last_activity_date IS NOT NULL) AS reviveable_flag, ({archive}) AS archive_remove_flag FROM contacts_clean""")


QUERIES.update({
    "lead_filters": q_lead_filters,
    "filter_options": q_filter_options,
    "contact_flags": lambda s, d: _s(s, d)["contacts_clean"].select(*CONTACT_FLAGS),
    "latest_records": lambda s, d: _PL.latest_records(_V.deals(s, d), 100).select("hs_object_id", "createdate"),
})
ORACLE.update({
    "lead_filters": sql_lead_filters,
    "filter_options": sql_filter_options,
    "contact_flags": sql_contact_flags,
    "latest_records": lambda: _sql("SELECT hs_object_id, createdate FROM raw_deals ORDER BY createdate DESC NULLS LAST, hs_object_id DESC NULLS LAST LIMIT 100"),
})
