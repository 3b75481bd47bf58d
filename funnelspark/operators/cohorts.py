"""Cohorts.

Cohort assignment is a ``coalesce`` ladder (official -> start_term -> first won date month ->
created month).  Per-cohort modes use a two-step grouped count (no group is collected whole);
means use exact decimal sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import (MS_PER_DAY, as_bool, avg_exact, clean_text, elapsed_days_fractional, mode_by_group,
                              safe_div, sum_money)
from .fact import dedupe_by_key

SUMMARY_COLUMNS = [
    "cohort", "cohort source", "leads", "paid leads", "paid %", "enrolled students", "enrollment rate",
    "actual revenue", "estimated revenue", "potential revenue", "avg days to first contact", "avg days to enroll",
    "avg touches to enroll", "top vendor", "top program", "top salesman",
]
FIELD_RENAMES = [
    ("cohort source", "cohort_source"), ("leads", "cohort_size"), ("paid leads", "cohort_paid_leads"),
    ("paid %", "cohort_paid_share"), ("enrolled students", "cohort_enrolled_students"),
    ("enrollment rate", "cohort_enrollment_rate"), ("actual revenue", "cohort_actual_revenue"),
    ("estimated revenue", "cohort_estimated_revenue"), ("potential revenue", "cohort_potential_revenue"),
    ("avg days to first contact", "cohort_avg_days_to_first_contact"), ("avg days to enroll", "cohort_avg_days_to_enroll"),
    ("avg touches to enroll", "cohort_avg_sales_touches_to_enroll"), ("top vendor", "cohort_top_vendor"),
    ("top program", "cohort_top_program"), ("top salesman", "cohort_top_salesman"),
]


def parse_term_start(c: Column) -> Column:
    """Date parse, else year 20dd + season month (spring 1, summer 5, fall/autumn 8, winter 12, none 1)."""
    text = clean_text(c, "na")
    low = F.lower(text)
    year = F.regexp_extract(text, r"(20\d{2})", 1)
    month = F.lit(1)
    for season, m in reversed(R.SEASON_START_MONTH):
        month = F.when(low.contains(season), F.lit(m)).otherwise(month)
    built = F.when(year != "", F.make_timestamp(year.cast("int"), month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.when(text != "", F.coalesce(F.try_to_timestamp(text), built))


def first_won_date(fact: DataFrame) -> DataFrame:
    """Earliest coalesce(closed_won, close, enrollment) over won rows per contact."""
    won = as_bool(F.col("is_won")) | (as_bool(F.col("has_won_deal")) if "has_won_deal" in fact.columns else F.lit(False))
    dates = [F.col(c) for c in ("closed_won_date", "close_date", "enrollment_date") if c in fact.columns]
    d = F.coalesce(*dates)
    return (fact.where(won & d.isNotNull()).groupBy(F.coalesce(F.col("contact_id"), F.lit("")).alias("contact_id"))
            .agg(F.min(d).alias("__won_date")))


def contact_revenue(fact: DataFrame, column: str, out: str) -> DataFrame:
    cid = F.coalesce(F.col("contact_id"), F.lit(""))
    return fact.where(cid != "").groupBy(cid.alias("contact_id")).agg(sum_money(F.col(column)).alias(out))


def first_contact_days(df: DataFrame) -> Column:
    """ms field / 8.64e7, else fractional days created -> first activity; negative -> NULL."""
    ms = F.col("time_to_first_engagement").cast("double") if "time_to_first_engagement" in df.columns else F.lit(None).cast("double")
    firsts = [F.col(c) for c in ("first_engagement_date", "first_outreach_date", "last_sales_activity_timestamp",
                                 "last_activity_date") if c in df.columns]
    from_date = elapsed_days_fractional(F.col("contact_created_at"), F.coalesce(*firsts)) if firsts else F.lit(None)
    out = F.when(ms.isNotNull(), ms / F.lit(float(MS_PER_DAY))).otherwise(from_date)
    return F.when(out >= 0, out)


def cohort_contacts(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    """De-duplicated contacts (first kept) with cohort, revenues, enrolled flag, days, touches, leakage."""
    c = contacts.withColumn("contact_id", F.coalesce(F.col("contact_id"), F.lit(""))).where(F.col("contact_id") != "")
    c = dedupe_by_key(c, "contact_id", "_seq", keep="first") if "_seq" in c.columns else c.dropDuplicates(["contact_id"])
    c = (c.join(first_won_date(fact), "contact_id", "left")
         .join(contact_revenue(fact, "revenue_attributed", "cohort_actual_revenue"), "contact_id", "left"))
    official = clean_text(F.col("cohort"), "na")
    start_term = clean_text(F.col("start_term"), "na")
    won_date = F.col("__won_date")
    created = F.col("contact_created_at")
    cohort = (F.when(official != "", official).when(start_term != "", start_term)
              .when(won_date.isNotNull(), F.date_format(won_date, "yyyy-MM"))
              .otherwise(F.coalesce(F.date_format(created, "yyyy-MM"), F.lit("Unknown"))))
    source = (F.when(official != "", "official cohort").when(start_term != "", "start_term")
              .when(won_date.isNotNull(), "enrollment date").otherwise("contact created month"))
    start = (F.when(official != "", parse_term_start(official)).when(start_term != "", parse_term_start(start_term))
             .when(won_date.isNotNull(), F.date_trunc("month", won_date)).otherwise(F.date_trunc("month", created)))
    enrolled_rev = F.coalesce(F.col("enrolled_revenue").cast("double"), F.lit(0.0))
    enrolled = (as_bool(F.col("has_won_deal")) | (enrolled_rev > 0)
                | F.lower(clean_text(F.col("enrollment_status"), "na")).rlike(R.COHORT_ENROLLED_PATTERN))
    paid = as_bool(F.col("paid_lead_flag"))
    c = c.withColumns({
        "cohort": F.coalesce(F.nullif(cohort, F.lit("")), F.lit("Unknown")),
        "cohort_source": source,
        "cohort_start_date": start,
        "cohort_actual_revenue": F.coalesce(F.col("cohort_actual_revenue"), F.lit(0.0)),
        "cohort_estimated_revenue": enrolled_rev,
        "cohort_potential_revenue": F.coalesce(F.col("potential_revenue").cast("double"), F.lit(0.0)),
        "cohort_open_potential_revenue": F.coalesce(F.col("open_pipeline_potential_revenue").cast("double"), F.lit(0.0)),
        "cohort_is_paid": paid,
        "cohort_is_enrolled": enrolled,
        "cohort_days_to_first_contact": first_contact_days(c),
        "cohort_enrollment_date": won_date,
        "cohort_days_to_enroll": elapsed_days_fractional(created, won_date),
    })
    inactive = F.coalesce(F.col("days_since_last_activity").cast("double"), F.lit(9999.0))
    leakage = paid & ~enrolled & (
        clean_text(F.col("salesman_name"), "na").isin("", "Unassigned") | F.col("next_activity_date").isNull()
        | (inactive >= 14) | ~as_bool(F.col("has_open_deal")))
    return c.withColumns({
        "cohort_sales_touches_to_enroll": F.when(enrolled, F.col("num_notes").cast("double")),
        "cohort_paid_leakage": leakage,
    }).drop("__won_date")


def _text_or_unknown(col: str) -> Column:
    t = clean_text(F.col(col), "na")
    return F.when(t == "", F.lit("Unknown")).otherwise(t)


def cohort_summary(prepared: DataFrame) -> DataFrame:
    """16 columns per cohort, newest start first."""
    g = prepared.groupBy("cohort").agg(
        F.countDistinct("contact_id").alias("leads"),
        F.count_if(F.col("cohort_is_paid")).alias("paid leads"),
        F.count_if(F.col("cohort_is_enrolled")).alias("enrolled students"),
        sum_money(F.col("cohort_actual_revenue")).alias("actual revenue"),
        sum_money(F.col("cohort_estimated_revenue")).alias("estimated revenue"),
        sum_money(F.col("cohort_potential_revenue")).alias("potential revenue"),
        F.coalesce(avg_exact(F.col("cohort_days_to_first_contact")), F.lit(0.0)).alias("avg days to first contact"),
        F.coalesce(avg_exact(F.col("cohort_days_to_enroll")), F.lit(0.0)).alias("avg days to enroll"),
        F.coalesce(avg_exact(F.col("cohort_sales_touches_to_enroll")), F.lit(0.0)).alias("avg touches to enroll"),
        F.min("cohort_start_date").alias("__start"),
    )
    modes = [mode_by_group(prepared, ["cohort"], _text_or_unknown(src), out)
             for src, out in [("cohort_source", "cohort source"), ("paid_vendor", "top vendor"),
                              ("program", "top program"), ("salesman_name", "top salesman")]]
    for m in modes:
        g = g.join(m, "cohort", "left")
    g = g.withColumns({"paid %": safe_div(F.col("paid leads"), F.col("leads")),
                       "enrollment rate": safe_div(F.col("enrolled students"), F.col("leads"))})
    return g.orderBy(F.col("__start").desc_nulls_last(), F.col("cohort").desc()).select(*SUMMARY_COLUMNS, "__start")


def cohort_fields(prepared: DataFrame) -> DataFrame:
    """cohort_fact: renamed summary + start date, hot share, dead share."""
    s = cohort_summary(prepared)
    for old, new in FIELD_RENAMES:
        s = s.withColumnRenamed(old, new)
    shares = prepared.groupBy("cohort").agg(
        safe_div(F.count_if(F.col("lead_temperature") == "Hot"), F.countDistinct("contact_id")).alias("cohort_hot_lead_share"),
        safe_div(F.count_if(F.col("lead_temperature") == "Dead"), F.countDistinct("contact_id")).alias("cohort_dead_lead_share"))
    return s.withColumnRenamed("__start", "cohort_start_date").join(shares, "cohort", "left")


def summary_only(prepared: DataFrame) -> DataFrame:
    return cohort_summary(prepared).drop("__start")


def cohort_comparison(prepared: DataFrame) -> DataFrame:
    s = cohort_summary(prepared)
    extra = prepared.groupBy("cohort").agg(
        F.count_if(F.col("cohort_paid_leakage")).alias("paid lead leakage"),
        safe_div(F.count_if(F.col("lead_temperature") == "Dead"), F.countDistinct("contact_id")).alias("dead lead rate"))
    rev = F.when(F.col("estimated revenue") != 0, F.col("estimated revenue")).otherwise(F.col("actual revenue"))
    return (s.join(extra, "cohort", "left")
            .select("cohort", "enrollment rate", safe_div(rev, F.col("leads")).alias("revenue per lead"),
                    "avg days to enroll", "avg touches to enroll", "paid lead leakage", "dead lead rate", "__start")
            .orderBy(F.col("__start").desc_nulls_last(), F.col("cohort").desc()).drop("__start"))


def top_table(df: DataFrame, column: str, label: str, limit: int | None = None) -> DataFrame:
    """Values of a column by falling leads with leads, paid leads, enrolled students; all of them, or the first ``limit``."""
    out = (df.groupBy(_text_or_unknown(column).alias(label)).agg(
        F.countDistinct("contact_id").alias("leads"),
        F.count_if(as_bool(F.col("paid_lead_flag"))).alias("paid leads"),
        F.count_if(F.col("cohort_is_enrolled")).alias("enrolled students"))
        .orderBy(F.desc("leads"), F.col(label)))
    return out if limit is None else out.limit(limit)


def mix_table(df: DataFrame, column: str, label: str) -> DataFrame:
    """Leads and share per value; the total is a scalar subquery over the grouped rows."""
    rows = df.groupBy(_text_or_unknown(column).alias(label)).agg(F.countDistinct("contact_id").alias("leads"))
    total = rows.agg(F.sum("leads")).scalar()
    return rows.withColumn("share", safe_div(F.col("leads"), total)).orderBy(F.desc("leads"), F.col(label))


def paid_mix(df: DataFrame) -> DataFrame:
    agg = df.agg(F.count_if(F.col("cohort_is_paid")).alias("p"), F.count_if(~F.col("cohort_is_paid")).alias("o"))
    stacked = agg.selectExpr("stack(2, 'Paid', p, 'Organic', o) AS (`paid vs organic`, leads)")
    total = df.agg(F.count(F.lit(1))).scalar()
    return stacked.withColumn("share", safe_div(F.col("leads"), total))


def enrollment_inputs(df: DataFrame) -> DataFrame:
    """Enrolled only: median days to first contact / touches / days to enroll and modal source,
    vendor, program, salesman.  Values are returned unformatted (formatting is presentation)."""
    from .kpi import exact_median
    enrolled = df.where(F.col("cohort_is_enrolled")).withColumn("__g", F.lit(1))
    meds = [exact_median(enrolled, c, ["__g"], "value").select(F.lit(label).alias("metric"), F.col("value").cast("string").alias("value"))
            for c, label in [("cohort_days_to_first_contact", "median days to first contact"),
                             ("cohort_sales_touches_to_enroll", "median number of touches"),
                             ("cohort_days_to_enroll", "median days to enrollment")]]
    modes = [mode_by_group(enrolled, ["__g"], _text_or_unknown(c), "value").select(F.lit(label).alias("metric"), "value")
             for c, label in [("source_group", "most common source"), ("paid_vendor", "most common vendor"),
                              ("program", "most common program"), ("salesman_name", "most common salesman path")]]
    out = meds[0]
    for m in meds[1:] + modes:
        out = out.unionByName(m)
    return out


def status_before_enrollment(df: DataFrame) -> DataFrame:
    """Mix over four status columns among enrolled contacts, stacked with the field label; ``rank``
    counts a field's statuses by falling leads (a caller cuts where it likes)."""
    enrolled = df.where(F.col("cohort_is_enrolled"))
    parts = []
    for column, label in [("lead_status", "lead status"), ("final_lead_status", "final lead status"),
                          ("lifecycle_stage", "lifecycle stage"), ("enrollment_status", "enrollment status")]:
        if column not in enrolled.columns:
            continue
        parts.append(mix_table(enrolled, column, "status").select(F.lit(label).alias("status field"), "status", "leads", "share"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("status field").orderBy(F.desc("leads"), "status")))


def cohort_filter(df: DataFrame, filters: Mapping[str, Sequence[str]]) -> DataFrame:
    """Filters on cohort / program / vendor / salesman / campus / modality / paid-organic (empty = no filter)."""
    out = df
    for column, values in filters.items():
        values = list(values or [])
        if not values or column not in out.columns:
            continue
        out = out.where(clean_text(F.col(column), "na").isin(values))
    return out
