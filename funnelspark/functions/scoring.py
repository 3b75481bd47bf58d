"""Lead scoring: ages, score, dead reason, temperature, revive/archive flags.

Pure column arithmetic; ``today`` is always an argument, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .expr import as_bool, as_text, contains_any, elapsed_days_floor, first_matching_term, has_text, strip_ws, ts_literal

STATUS_FIELDS = ["lifecycle_stage", "lead_status", "deal_stage", "latest_deal_stage"]


def status_text(df: DataFrame) -> Column:
    """Non-blank lifecycle, lead status, deal stage and latest stage joined with ' | '."""
    if "__status_text" in df.columns:
        return F.col("__status_text")
    parts = [F.when(strip_ws(as_text(F.col(c))) != "", as_text(F.col(c))) for c in STATUS_FIELDS if c in df.columns]
    return F.concat_ws(" | ", *parts) if parts else F.lit("")


def lead_ages(df: DataFrame, today) -> DataFrame:
    now = ts_literal(today)
    return df.withColumns({
        "lead_age_days": elapsed_days_floor(F.col("contact_created_at"), now),
        "days_since_last_activity": elapsed_days_floor(F.col("last_activity_date"), now),
        "never_contacted": F.col("last_activity_date").isNull(),
    })


def lead_score(df: DataFrame) -> Column:
    age = F.col("lead_age_days")
    inactive = F.col("days_since_last_activity")
    status = F.lower(status_text(df))
    has_open = as_bool(F.col("has_open_deal")) if "has_open_deal" in df.columns else F.lit(False)
    paid = as_bool(F.col("paid_lead_flag")) if "paid_lead_flag" in df.columns else F.lit(False)
    nxt = F.col("next_activity_date").isNotNull() if "next_activity_date" in df.columns else F.lit(False)
    reach = F.lit(False)
    for c in ("email", "phone"):
        if c in df.columns:
            reach = reach | has_text(F.col(c), "na")

    def pts(cond: Column, points: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0))

    return (
        pts(age <= 7, 25) + pts(paid, 15) + pts(contains_any(status, R.QUALIFIED_TERMS), 20)
        + pts(has_open, 25) + pts(inactive <= 7, 20) + pts(nxt, 10) + pts(reach, 5)
        + pts((inactive >= 15) & (inactive <= 30), -20) + pts(inactive > 30, -40)
        + pts((age > 45) & ~has_open, -25)
    )


def dead_reason(df: DataFrame) -> Column:
    status = F.lower(status_text(df))
    age = F.col("lead_age_days")
    inactive = F.col("days_since_last_activity")
    has_open = as_bool(F.col("has_open_deal")) if "has_open_deal" in df.columns else F.lit(False)
    never = F.coalesce(F.col("never_contacted"), F.lit(False))
    term = first_matching_term(status, R.SCORING_DEAD_TERMS, lambda t: t.replace(" ", "_"))
    return F.coalesce(
        term,
        F.when((age > 60) & ~has_open & (inactive.isNull() | (inactive >= 30)), F.lit("inactive_60_days_no_open_deal"))
        .when((age > 30) & never, F.lit("never_contacted_30_days"))
        .when(F.col("lead_score") < 15, F.lit("low_score"))
        .otherwise(F.lit("")),
    )


def lead_temperature(df: DataFrame) -> Column:
    status = F.lower(status_text(df))
    score = F.col("lead_score")
    return (
        F.when((F.col("dead_reason") != "") | (score < 15), "Dead")
        .when((score >= 60) & ~contains_any(status, ["lost", "disqualified"]), "Hot")
        .when((score >= 35) & (score <= 59), "Warm")
        .otherwise("Cold")
    )


def reviveable_flag(df: DataFrame) -> Column:
    has_value = F.lit(False)
    for c in ("program", "email", "phone"):
        if c in df.columns:
            has_value = has_value | has_text(F.col(c), "na")
    has_value = has_value | F.col("last_activity_date").isNotNull()
    paid = as_bool(F.col("paid_lead_flag")) if "paid_lead_flag" in df.columns else F.lit(False)
    soft = F.col("dead_reason").isin("inactive_60_days_no_open_deal", "never_contacted_30_days", "low_score")
    return (F.col("lead_temperature") == "Dead") & soft & (paid | has_value)


def archive_remove_flag(df: DataFrame) -> Column:
    reason = F.coalesce(F.col("dead_reason"), F.lit(""))
    return contains_any(reason, [t.replace(" ", "_") for t in R.ARCHIVE_TERMS])


def score_leads(df: DataFrame, today) -> DataFrame:
    """All scoring columns; expects contact_created_at / last / next activity as timestamps."""
    for c in ("contact_created_at", "last_activity_date", "next_activity_date"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("timestamp"))
    if "has_open_deal" not in df.columns:
        df = df.withColumn("has_open_deal", F.lit(False))
    out = lead_ages(df, today)
    out = out.withColumn("has_open_deal", as_bool(F.col("has_open_deal")))
    out = out.withColumn("__status_text", status_text(out))
    out = out.withColumn("lead_score", lead_score(out))
    out = out.withColumn("dead_reason", dead_reason(out))
    out = out.withColumn("lead_temperature", lead_temperature(out))
    return out.withColumns({
        "reviveable_flag": reviveable_flag(out),
        "archive_remove_flag": archive_remove_flag(out),
    }).drop("__status_text")
