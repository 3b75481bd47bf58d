"""Typed CRM entities: contacts_clean, deals_clean, activity_events, association_links.

Logical fields are resolved at plan time against the raw schema (mapped column if it exists,
else the first existing fallback, else NULL).  Date columns are parsed with the whole-column
epoch switch (T2); the won/lost switch (T3) is a one-row scalar subquery.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.classify import add_source_classification, vendor_source_columns
from ..functions.expr import (as_bool, as_text, blank_to_null, clean_id, clean_text, first_nonempty,
                              has_text, strip_ws, to_number, with_parsed_datetimes)
from ..functions.tuition import add_program_revenue_fields

ORDER_MAX = 9223372036854775807


def _section(mapping: Mapping | None, obj: str) -> Mapping:
    mapping = mapping or {}
    return mapping.get(obj) or mapping.get(f"{obj}s") or {}


def logical(raw: DataFrame, mapping: Mapping | None, obj: str, name: str, fallbacks=None) -> Column:
    """Mapped column if it exists, else first existing fallback, else NULL (schema-level, not row)."""
    mapped = _section(mapping, obj).get(name)
    candidates = ([mapped] if mapped else []) + list(fallbacks or [])
    for cand in candidates:
        if cand and cand in raw.columns:
            return F.col(cand)
    return F.lit(None).cast("string")


def owner_names(owners: DataFrame) -> DataFrame:
    """owner_id -> display name: name, else email, else id."""
    oid = clean_id(F.col("owner_id"))
    name = F.col("salesman_name") if "salesman_name" in owners.columns else F.lit(None)
    email = F.col("email") if "email" in owners.columns else F.lit(None)
    return (owners.select(oid.alias("__owner_id"),
                          F.coalesce(F.nullif(clean_text(name), F.lit("")), F.nullif(clean_text(email), F.lit("")), oid).alias("__owner_name"))
            .where(F.col("__owner_id").isNotNull())
            .groupBy("__owner_id").agg(F.max("__owner_name").alias("__owner_name")))


def with_owner_name(df: DataFrame, id_col: str, out_col: str, owners: DataFrame, unknown: str = "Unassigned") -> DataFrame:
    """owner_name_lookup: left join the owner dimension; unknown or blank -> 'Unassigned'."""
    names = owner_names(owners)
    joined = df.join(names, clean_id(F.col(id_col)) == F.col("__owner_id"), "left")
    return joined.withColumn(out_col, F.coalesce(F.col("__owner_name"), F.lit(unknown))).drop("__owner_id", "__owner_name")


def _seq(raw: DataFrame, id_col: Column) -> Column:
    """Row order from a business key: an explicit ``_seq`` column if landed, else the numeric id."""
    if "_seq" in raw.columns:
        return F.col("_seq").cast("long")
    return as_text(id_col).try_cast("long")


def contacts_base(raw: DataFrame, owners: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """contacts_clean before deal enrichment and scoring (reference build_contacts_clean)."""
    mapping = R.DEFAULT_MAPPING if mapping is None else mapping
    fb = R.CONTACT_FALLBACKS

    def lg(name: str) -> Column:
        return logical(raw, mapping, "contact", name, fb.get(name, []))

    first, last = lg("first_name"), lg("last_name")
    generated = strip_ws(F.concat(clean_text(first), F.lit(" "), clean_text(last)))
    cols: dict[str, Column] = {
        "contact_id": clean_id(lg("contact_id")),
        "_seq": _seq(raw, clean_id(lg("contact_id"))),
        "contact_created_at": lg("contact_created_at"),
        "contact_owner_id": clean_id(lg("contact_owner_id")),
        "owner_assigned_date": lg("owner_assigned_date"),
        "first_name": first,
        "last_name": last,
    }
    cols["full_name"] = first_nonempty(lg("full_name"), generated)
    cols["student_name"] = first_nonempty(cols["full_name"], lg("student_name"))
    for name in R.CONTACT_TEXT_FIELDS:
        cols[name] = lg(name)
    cols["program_total_tuition"] = to_number(lg("program_total_tuition"), fill=0)
    # Raw vendor-ish columns not already resolved are carried so classification can see them.
    for c in vendor_source_columns(raw.columns):
        if c not in cols:
            cols[c] = F.col(c)
    df = raw.select(*[v.alias(k) for k, v in cols.items()])
    df = with_parsed_datetimes(df, ["contact_created_at", "owner_assigned_date", *R.CONTACT_DATE_FIELDS])
    df = df.withColumns({
        "first_activity_date": F.coalesce("first_activity_date", "first_outreach_date", "first_engagement_date"),
        "num_notes": to_number(F.col("num_notes"), fill=0),
        "time_to_first_engagement": to_number(F.col("time_to_first_engagement")),
        "program": F.coalesce(F.nullif(F.col("program"), F.lit("")), F.nullif(F.col("degree_program"), F.lit("")),
                              F.nullif(F.col("intended_program"), F.lit(""))),
        "degree_program": F.nullif(F.col("degree_program"), F.lit("")),
        "intended_program": F.nullif(F.col("intended_program"), F.lit("")),
    })
    df = df.withColumn("number_of_sales_activities",
                       F.coalesce(to_number(F.col("number_of_sales_activities")), F.col("num_notes")))
    df = df.withColumn("salesman_id", F.col("contact_owner_id"))
    df = with_owner_name(df, "salesman_id", "salesman_name", owners)
    df = add_source_classification(df, vendor_source_columns(df.columns))
    df = df.withColumns({
        "has_open_deal": F.lit(False),
        "has_won_deal": F.lit(False),
        "has_lost_deal": F.lit(False),
        "latest_deal_stage": F.lit(None).cast("string"),
        "contact_attribution_type": F.when(F.col("contact_owner_id").isNotNull(), "contact_owner").otherwise("missing_owner"),
    })
    return add_program_revenue_fields(df, total_col="contact_realized_revenue")


def deals_clean(raw: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Typed deals; won/lost from closed flags if any flag is populated in the table (T3)."""
    mapping = R.DEFAULT_MAPPING if mapping is None else mapping
    fb = R.DEAL_FALLBACKS

    def lg(name: str) -> Column:
        return logical(raw, mapping, "deal", name, fb.get(name, []))

    df = raw.select(
        clean_id(lg("deal_id")).alias("deal_id"),
        _seq(raw, clean_id(lg("deal_id"))).alias("_deal_seq"),
        lg("deal_created_at").alias("deal_created_at"),
        clean_id(lg("deal_owner_id")).alias("deal_owner_id"),
        lg("deal_owner_assigned_date").alias("deal_owner_assigned_date"),
        lg("deal_stage").alias("deal_stage"),
        lg("pipeline").alias("pipeline"),
        lg("close_date").alias("close_date"),
        lg("closed_won_date").alias("closed_won_date"),
        to_number(lg("deal_amount"), fill=0).alias("deal_amount"),
        to_number(lg("revenue")).alias("__mapped_revenue"),
        lg("is_closed_won").alias("__closed_won"),
        lg("is_closed").alias("__closed"),
    )
    df = with_parsed_datetimes(df, ["deal_created_at", "deal_owner_assigned_date", "close_date", "closed_won_date"])
    flags = df.agg(F.struct(
        F.coalesce(F.max(has_text(F.col("__closed_won"))), F.lit(False)).alias("won"),
        F.coalesce(F.max(has_text(F.col("__closed"))), F.lit(False)).alias("closed"))).scalar()
    df = df.withColumn("__flags", flags)  # one subquery reference for both switches
    flags = F.col("__flags")
    stage = F.lower(F.coalesce(as_text(F.col("deal_stage")), F.lit("")))
    is_won = F.when(flags.getField("won"), as_bool(F.col("__closed_won"))).otherwise(stage.contains("won"))
    df = df.withColumns({
        "revenue": F.coalesce(F.col("__mapped_revenue"), F.col("deal_amount"), F.lit(0.0)),
        "is_won": is_won,
    })
    df = df.withColumn("is_lost", F.when(flags.getField("closed"), as_bool(F.col("__closed")) & ~F.col("is_won"))
                       .otherwise(stage.contains("lost")))
    return df.drop("__mapped_revenue", "__closed_won", "__closed", "__flags")


def _first_text(raw: DataFrame, fields: list[str]) -> Column:
    present = [F.nullif(clean_text(F.col(f)), F.lit("")) for f in fields if f in raw.columns]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def activity_events(raw: DataFrame, owners: DataFrame) -> DataFrame:
    """Activity rows -> typed events (contact_id, activity_id, event_date, event_type, owner_id,
    owner, description, outcome, source); blank contact / NULL date dropped; distinct."""
    atype = F.lower(clean_text(F.col("activity_type")))
    label = None
    for key, value in R.ACTIVITY_TYPE_LABELS:
        label = F.when(atype == key, F.lit(value)) if label is None else label.when(atype == key, F.lit(value))
    label = label.when(atype != "", F.initcap(atype)).otherwise(F.lit("Activity"))

    def per_type(table) -> Column:
        out = None
        for key, fields in table:
            value = _first_text(raw, fields)
            out = F.when(atype == key, value) if out is None else out.when(atype == key, value)
        return out.otherwise(F.lit("")) if out is not None else F.lit("")

    ids = [blank_to_null(F.col(c)) for c in ("hs_object_id", "id", "activity_id") if c in raw.columns]
    dates = [blank_to_null(F.col(c)) for c in ("hs_timestamp", "createdAt") if c in raw.columns]
    df = raw.select(
        clean_text(F.col("contact_id")).alias("contact_id"),
        clean_text(F.coalesce(*ids) if ids else F.lit("")).alias("activity_id"),
        (F.coalesce(*dates) if dates else F.lit(None).cast("string")).alias("event_date"),
        label.alias("event_type"),
        clean_id(F.col("hubspot_owner_id")).alias("owner_id"),
        per_type(R.ACTIVITY_DESCRIPTION_FIELDS).alias("description"),
        per_type(R.ACTIVITY_OUTCOME_FIELDS).alias("outcome"),
        F.lit("activity_object").alias("source"),
    )
    df = with_parsed_datetimes(df, ["event_date"])
    df = with_owner_name(df, "owner_id", "owner", owners)
    df = df.where((F.col("contact_id") != "") & F.col("event_date").isNotNull())
    return df.select("contact_id", "activity_id", "event_date", "event_type", "owner_id", "owner",
                     "description", "outcome", "source").distinct()


def association_links(assoc: DataFrame) -> DataFrame:
    """Clean ids, drop blanks, distinct (contact_id, deal_id, association_type)."""
    atype = F.col("association_type") if "association_type" in assoc.columns else F.lit(None).cast("string")
    return (assoc.select(clean_id(F.col("contact_id")).alias("contact_id"), clean_id(F.col("deal_id")).alias("deal_id"),
                         atype.alias("association_type"))
            .where(F.col("contact_id").isNotNull() & F.col("deal_id").isNotNull())
            .distinct())


def link_order(prefix: str = "") -> list[Column]:
    """Association order: contact key (numeric, missing last), contact id, deal key, deal id, type."""
    return [
        F.coalesce(F.col("contact_id").try_cast("long"), F.lit(ORDER_MAX)).alias("c_num"),
        F.col("contact_id").alias("c_id"),
        F.coalesce(F.col("deal_id").try_cast("long"), F.lit(ORDER_MAX)).alias("d_num"),
        F.col("deal_id").alias("d_id"),
        F.coalesce(F.col("association_type"), F.lit("")).alias("a_type"),
    ]
