"""CRM KPIs.

Scorecards are computed per grain and then joined: contact-grain aggregates grouped by the
contact's salesman, fact-grain aggregates grouped by the fact's salesman, never contacts joined
to the fact and then counted.  One-row KPI bundles combine their aggregates through scalar
subqueries (each evaluated once), not cross joins.  Medians are exact and come from a value
histogram (``exact_median``) so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_bool, clean_text, safe_div, sum_money

REVENUE_COLUMNS = ["total_program_revenue", "six_month_revenue", "twelve_month_revenue",
                   "twenty_four_month_revenue", "annualized_program_revenue"]
POTENTIAL_REVENUE_COLUMNS = ["potential_program_revenue", "potential_six_month_revenue",
                             "potential_twelve_month_revenue", "potential_twenty_four_month_revenue",
                             "potential_annualized_program_revenue"]
PIPELINE_REVENUE_COLUMNS = ["potential_revenue", "enrolled_revenue", "open_pipeline_potential_revenue"]


def money_col(df: DataFrame, name: str) -> Column:
    """Money column with the reference's substitutes: total_program_revenue falls back to
    program_revenue_input then revenue_attributed; an absent column sums to 0."""
    candidates = [name] + (["program_revenue_input", "revenue_attributed"] if name == "total_program_revenue" else [])
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    return F.lit(0.0)


def money_aggs(df: DataFrame, names) -> list[Column]:
    return [sum_money(money_col(df, x)).alias(x) for x in names]


def countable_won(fact: DataFrame) -> DataFrame:
    return fact.where(as_bool(F.col("deal_countable")) & as_bool(F.col("is_won")))


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "median") -> DataFrame:
    """Exact median per group, fractional values included, without a group in one task.

    Values are first counted per whole unit (days, touches: few per group), whose running counts say
    which units hold the middle ranks; only the rows of those units are then counted by value."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__unit", F.floor("__v"))
    group = Window.partitionBy(*keys)
    units = rows.groupBy(*keys, "__unit").agg(F.count(F.lit(1)).alias("__cnt"))
    units = units.withColumns({
        "__before": F.coalesce(F.sum("__cnt").over(group.orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__n": F.sum("__cnt").over(group)})
    units = units.withColumns({"__lo": F.floor((F.col("__n") + 1) / 2), "__hi": F.floor(F.col("__n") / 2) + 1})
    middle = units.where("__before < __hi and __before + __cnt >= __lo").select(
        *[F.col(k).alias(f"__m_{k}") for k in keys], F.col("__unit").alias("__m_unit"), "__before", "__lo", "__hi")
    same = F.col("__unit") == F.col("__m_unit")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    hist = rows.join(middle, same).groupBy(*keys, "__unit", "__v", "__before", "__lo", "__hi").agg(F.count(F.lit(1)).alias("__cnt"))
    running = Window.partitionBy(*keys, "__unit").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("__cum", F.col("__before") + F.sum("__cnt").over(running))
    at = lambda rank: F.min(F.when(F.col("__cum") >= F.col(rank), F.col("__v")))
    middle_mean = (at("__lo") + at("__hi")) / 2
    return hist.groupBy(*keys).agg(middle_mean.alias(out)) if keys else hist.agg(middle_mean.alias(out))


def _scalar_row(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    packed = df.select(F.struct(*[F.col(n) for n in names]).alias("s")).scalar()
    return {n: packed.getField(n) for n in names}


def executive_metrics(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    """Leads, paid/organic, hot/dead rows, won deals, revenue windows, close rates, days, per-lead revenue."""
    won = countable_won(fact)
    paid = as_bool(F.col("paid_lead_flag"))
    c = grouped_distinct(contacts.withColumn("__all", F.lit(0)), ["__all"], "contact_id",
                         {"total_leads": F.lit(True), "paid_leads": paid},
                         sums={x: money_col(contacts, x) for x in POTENTIAL_REVENUE_COLUMNS + PIPELINE_REVENUE_COLUMNS},
                         row_counts={"hot_leads": F.col("lead_temperature") == "Hot",
                                     "dead_leads": F.col("lead_temperature") == "Dead"}).drop("__all")
    f = grouped_distinct(won.withColumn("__all", F.lit(0)), ["__all"], "deal_id",
                         {"won_deals": F.lit(True), "paid_won_deals": as_bool(F.col("paid_lead_flag"))},
                         sums={x: money_col(won, x) for x in REVENUE_COLUMNS},
                         means={"average_days_to_close": F.col("days_to_close")}).drop("__all")
    f = f.withColumn("average_days_to_close", F.coalesce(F.col("average_days_to_close"), F.lit(0.0)))
    med = exact_median(won, "days_to_close", out="median_days_to_close")
    fs = _scalar_row(f, ["won_deals", "paid_won_deals", "average_days_to_close", *REVENUE_COLUMNS])
    m = med.select(F.col("median_days_to_close")).scalar()
    total, paid_n = F.col("total_leads"), F.col("paid_leads")
    return c.select(
        "total_leads", "paid_leads",
        F.greatest(total - paid_n, F.lit(0)).alias("organic_leads"),
        "hot_leads", "dead_leads",
        fs["won_deals"].alias("won_deals"),
        *[fs[x].alias(x) for x in REVENUE_COLUMNS],
        *POTENTIAL_REVENUE_COLUMNS, *PIPELINE_REVENUE_COLUMNS,
        fs["total_program_revenue"].alias("revenue"),
        safe_div(fs["won_deals"], total).alias("close_rate"),
        safe_div(fs["paid_won_deals"], paid_n).alias("paid_close_rate"),
        fs["average_days_to_close"].alias("average_days_to_close"),
        F.coalesce(m, F.lit(0.0)).alias("median_days_to_close"),
        safe_div(fs["total_program_revenue"], total).alias("revenue_per_lead"),
        safe_div(fs["total_program_revenue"], paid_n).alias("revenue_per_paid_lead"),
    )


def estimated_enrolled_revenue(contacts: DataFrame, fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group: sum over contacts of max(contact enrolled revenue, won program revenue) plus
    contact-less won revenue de-duplicated by deal; students = contacts with a value + 1 if any
    contact-less revenue.  Returns keys + (estimated_enrolled_revenue, enrolled_students)."""
    keys = list(keys)
    enrolled = (contacts.where(F.coalesce(F.col("enrolled_revenue").cast("double"), F.lit(0.0)) > 0)
                .select(*keys, "contact_id", F.col("enrolled_revenue").cast("double").alias("__v")))
    won = countable_won(fact)
    has_contact = clean_text(F.col("contact_id")) != ""
    won_c = won.where(has_contact).select(*keys, "contact_id",
                                          F.coalesce(F.col("total_program_revenue").cast("double"), F.lit(0.0)).alias("__v"))
    per_contact = (enrolled.unionByName(won_c).groupBy(*keys, "contact_id").agg(F.max("__v").alias("__v"))
                   .groupBy(*keys).agg(sum_money(F.col("__v")).alias("__c_rev"), F.count(F.lit(1)).alias("__c_n")))
    no_contact = (won.where(~has_contact)
                  .groupBy(*keys, "deal_id").agg(F.first(F.coalesce(F.col("total_program_revenue").cast("double"), F.lit(0.0))).alias("__v"))
                  .groupBy(*keys).agg(sum_money(F.col("__v")).alias("__n_rev")))
    if keys:
        j = per_contact.join(no_contact, keys, "full_outer")
    else:
        j = per_contact.select("__c_rev", "__c_n", no_contact.select("__n_rev").scalar().alias("__n_rev"))
    n_rev = F.coalesce(F.col("__n_rev"), F.lit(0.0))
    return j.select(
        *keys,
        (F.coalesce(F.col("__c_rev"), F.lit(0.0)) + n_rev).alias("estimated_enrolled_revenue"),
        (F.coalesce(F.col("__c_n"), F.lit(0)) + F.when(n_rev > 0, 1).otherwise(0)).alias("enrolled_students"),
    )


def revenue_confidence_mix(counts_high: Column, counts_med: Column, counts_low: Column) -> Column:
    return F.concat(F.lit("High: "), counts_high.cast("string"), F.lit(" / Medium: "), counts_med.cast("string"),
                    F.lit(" / Low: "), counts_low.cast("string"))


def salesman_metrics(contacts: DataFrame, fact: DataFrame) -> DataFrame:
    """39-column scorecard per salesman (contacts grouped by their salesman, fact by its own)."""
    paid = as_bool(F.col("paid_lead_flag"))
    temp = F.col("lead_temperature")
    conf = F.coalesce(F.nullif(F.col("revenue_confidence").cast("string"), F.lit("")), F.lit("Low"))
    cdist = contacts.where(F.col("salesman_name").isNotNull())
    won = countable_won(fact).where(F.col("salesman_name").isNotNull())
    paid_won_ids = won.where(as_bool(F.col("paid_lead_flag"))).select("salesman_name", "contact_id").where(
        F.col("contact_id").isNotNull()).distinct()
    stale = F.coalesce(F.col("days_since_last_activity").cast("double"), F.lit(9999.0))
    leak = (cdist.where(paid).join(paid_won_ids, ["salesman_name", "contact_id"], "left_anti")
            .where((stale >= 7) | ~as_bool(F.col("has_open_deal")))
            .groupBy("salesman_name").agg(F.countDistinct("contact_id").alias("paid_lead_leakage")))
    c = grouped_distinct(cdist, ["salesman_name"], "contact_id",
                         {"total_leads_assigned": F.lit(True), "paid_leads_assigned": paid},
                         sums={**{x: money_col(cdist, x) for x in POTENTIAL_REVENUE_COLUMNS + PIPELINE_REVENUE_COLUMNS},
                               "hot_lead_potential_revenue": F.when(temp == "Hot", F.col("open_pipeline_potential_revenue")),
                               "paid_lead_potential_revenue": F.when(paid, F.col("open_pipeline_potential_revenue"))},
                         row_counts={"hot_leads": temp == "Hot", "warm_leads": temp == "Warm", "cold_leads": temp == "Cold",
                                     "dead_leads": temp == "Dead", "open_leads": as_bool(F.col("has_open_deal")),
                                     "__high": conf == "High", "__med": conf == "Medium", "__low": conf == "Low"})
    f = grouped_distinct(won, ["salesman_name"], "deal_id",
                         {"won_deals": F.lit(True), "__paid_won": as_bool(F.col("paid_lead_flag"))},
                         sums={"actual_enrolled_revenue": F.col("revenue_attributed"), **{x: money_col(won, x) for x in REVENUE_COLUMNS}},
                         means={"average_days_to_close": F.col("days_to_close")})
    med = exact_median(won, "days_to_close", ["salesman_name"], "median_days_to_close")
    est = estimated_enrolled_revenue(cdist, fact.where(F.col("salesman_name").isNotNull()), ["salesman_name"])
    names = cdist.select("salesman_name").unionByName(fact.where(F.col("salesman_name").isNotNull()).select("salesman_name")).distinct()
    j = (names.join(c, "salesman_name", "left").join(f, "salesman_name", "left").join(med, "salesman_name", "left")
         .join(est, "salesman_name", "left").join(leak, "salesman_name", "left"))
    z = lambda name, default=0: F.coalesce(F.col(name), F.lit(default))
    total, paid_n = z("total_leads_assigned"), z("paid_leads_assigned")
    action = z("hot_leads") + z("open_leads") + z("paid_lead_leakage")
    out = j.select(
        "salesman_name",
        action.alias("action_load"),
        z("paid_lead_leakage").alias("paid_lead_leakage"),
        total.alias("total_leads_assigned"), paid_n.alias("paid_leads_assigned"),
        F.greatest(total - paid_n, F.lit(0)).alias("organic_leads_assigned"),
        z("hot_leads").alias("hot_leads"), z("warm_leads").alias("warm_leads"), z("cold_leads").alias("cold_leads"),
        z("dead_leads").alias("dead_leads"), z("open_leads").alias("open_leads"),
        z("won_deals").alias("won_deals"),
        safe_div(z("won_deals"), total).alias("close_rate"),
        safe_div(z("__paid_won"), paid_n).alias("paid_close_rate"),
        z("average_days_to_close", 0.0).alias("average_days_to_close"),
        z("median_days_to_close", 0.0).alias("median_days_to_close"),
        safe_div(z("total_program_revenue", 0.0), total).alias("revenue_per_lead"),
        safe_div(z("total_program_revenue", 0.0), paid_n).alias("revenue_per_paid_lead"),
        z("actual_enrolled_revenue", 0.0).alias("actual_enrolled_revenue"),
        z("estimated_enrolled_revenue", 0.0).alias("estimated_enrolled_revenue"),
        z("hot_lead_potential_revenue", 0.0).alias("hot_lead_potential_revenue"),
        z("paid_lead_potential_revenue", 0.0).alias("paid_lead_potential_revenue"),
        safe_div(z("potential_program_revenue", 0.0), total).alias("average_estimated_revenue_per_lead"),
        safe_div(z("estimated_enrolled_revenue", 0.0), z("enrolled_students")).alias("average_estimated_revenue_per_enrolled_student"),
        revenue_confidence_mix(z("__high"), z("__med"), z("__low")).alias("revenue_confidence_mix"),
        *[z(x, 0.0).alias(x) for x in REVENUE_COLUMNS + POTENTIAL_REVENUE_COLUMNS + PIPELINE_REVENUE_COLUMNS],
        z("total_program_revenue", 0.0).alias("revenue"),
    )
    return out.orderBy(F.desc("action_load"), F.desc("open_pipeline_potential_revenue"), F.desc("paid_lead_leakage"), "salesman_name")


def paid_leads_by_source(contacts: DataFrame) -> DataFrame:
    paid = contacts.where(as_bool(F.col("paid_lead_flag")))
    return paid.groupBy("source_group").agg(F.countDistinct("contact_id").alias("paid_leads"))


def paid_leads_by_campaign(contacts: DataFrame) -> DataFrame:
    paid = contacts.where(as_bool(F.col("paid_lead_flag")) & (clean_text(F.col("utm_campaign")) != ""))
    return paid.groupBy("utm_campaign").agg(F.countDistinct("contact_id").alias("paid_leads")).orderBy(F.desc("paid_leads"), "utm_campaign")


def paid_lead_metrics(contacts: DataFrame, fact: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Paid KPI row: leads, revenue windows, potential, close rate, days, revenue per paid lead, and whether there are
    any vendor costs."""
    paid_c = contacts.where(as_bool(F.col("paid_lead_flag")))
    paid_f = countable_won(fact).where(as_bool(F.col("paid_lead_flag")))
    c = paid_c.agg(F.countDistinct("contact_id").alias("paid_leads"),
                   *money_aggs(paid_c, POTENTIAL_REVENUE_COLUMNS + PIPELINE_REVENUE_COLUMNS))
    f = paid_f.agg(F.countDistinct("deal_id").alias("paid_won_deals"),
                   F.coalesce(F.avg("days_to_close"), F.lit(0.0)).alias("average_paid_days_to_close"),
                   *money_aggs(paid_f, REVENUE_COLUMNS))
    fs = _scalar_row(f, ["paid_won_deals", "average_paid_days_to_close", *REVENUE_COLUMNS])
    return c.select(
        "paid_leads",
        fs["total_program_revenue"].alias("paid_revenue"),
        *[fs[x].alias(x) for x in REVENUE_COLUMNS],
        *POTENTIAL_REVENUE_COLUMNS, *PIPELINE_REVENUE_COLUMNS,
        fs["total_program_revenue"].alias("revenue"),
        safe_div(fs["paid_won_deals"], F.col("paid_leads")).alias("paid_close_rate"),
        fs["average_paid_days_to_close"].alias("average_paid_days_to_close"),
        safe_div(fs["total_program_revenue"], F.col("paid_leads")).alias("revenue_per_paid_lead"),
        (F.lit(False) if costs is None else costs.agg(F.count(F.lit(1)) > 0).scalar()).alias("vendor_cost_data_available"),
    )


def stuck_leads(contacts: DataFrame) -> DataFrame:
    """No activity for 7/14/30 days (inactive >= d, or never contacted and age >= d), paid variants."""
    age = F.col("lead_age_days")
    inactive = F.col("days_since_last_activity")
    never = as_bool(F.col("never_contacted"))
    paid = as_bool(F.col("paid_lead_flag"))
    has_open = as_bool(F.col("has_open_deal"))

    def no_activity(d: int) -> Column:
        return F.coalesce((inactive >= d) | (never & (age >= d)), F.lit(False))

    g = grouped_distinct(contacts.withColumn("__all", F.lit(0)), ["__all"], "contact_id", {
        "leads_no_activity_7_days": no_activity(7), "leads_no_activity_14_days": no_activity(14),
        "leads_no_activity_30_days": no_activity(30), "paid_leads_with_no_activity": paid & no_activity(7),
        "paid_leads_older_30_days_no_open_deal": paid & F.coalesce(age > 30, F.lit(False)) & ~has_open})
    return g.drop("__all")


def data_quality_metrics(contacts: DataFrame, deals: DataFrame, fact: DataFrame) -> DataFrame:
    """Ten completeness / attribution counts; distinct ids are counted in two plain passes."""
    def distinct(df: DataFrame, id_col: str, flags: dict, row_counts: dict | None = None) -> DataFrame:
        return grouped_distinct(df.withColumn("__all", F.lit(0)), ["__all"], id_col, flags, row_counts=row_counts).drop("__all")

    owner_blank = clean_text(F.col("salesman_id")) == ""
    missing_source = (F.coalesce(F.col("source_group"), F.lit("Unknown")) == "Unknown") | (clean_text(F.col("source_text")) == "")
    c = distinct(contacts, "contact_id", {"owner": owner_blank, "source": missing_source}, {"created": F.col("contact_created_at").isNull()})
    d = deals.agg(F.count_if(F.col("close_date").isNull()).alias("close"),
                  F.count_if(F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)) <= 0).alias("revenue"))
    won = as_bool(F.col("deal_countable")) & as_bool(F.col("is_won"))
    by_contact = distinct(fact, "contact_id", {"no_deal": F.col("fact_record_type") == "contact_without_deal"})
    by_deal = distinct(fact, "deal_id", {"no_contact": F.col("fact_record_type") == "deal_without_contact",
                                         "unclear": as_bool(F.col("unclear_revenue_attribution"))},
                       {"no_program": won & (F.coalesce(F.col("total_program_revenue").cast("double"), F.lit(0.0)) <= 0),
                        "fallback": F.col("attribution_type") == "fallback_to_deal_owner"})
    parts = {"c": c, "d": d, "fc": by_contact, "fd": by_deal}
    packed = {k: df.select(F.struct(*df.columns).alias("s")).scalar() for k, df in parts.items()}
    n = lambda part, name: F.coalesce(packed[part].getField(name), F.lit(0)).cast("long")
    one = deals.sparkSession.range(1)
    return one.select(
        n("c", "owner").alias("records_missing_owner"), n("c", "source").alias("records_missing_source"),
        n("c", "created").alias("records_missing_contact_created_date"), n("d", "close").alias("records_missing_close_date"),
        n("d", "revenue").alias("records_missing_revenue"), n("fd", "no_program").alias("won_records_missing_program_revenue"),
        n("fc", "no_deal").alias("contacts_without_deals"), n("fd", "no_contact").alias("deals_without_contacts"),
        n("fd", "fallback").alias("deal_owner_fallback_used"), n("fd", "unclear").alias("unclear_revenue_attribution"))


def monthly_leads(contacts: DataFrame) -> DataFrame:
    dated = contacts.where(F.col("contact_created_at").isNotNull())
    return dated.groupBy(F.date_format("contact_created_at", "yyyy-MM").alias("month")).agg(
        F.countDistinct("contact_id").alias("leads"))


def monthly_revenue(fact: DataFrame, column: str = "total_program_revenue") -> DataFrame:
    won = countable_won(fact).where(F.col("close_date").isNotNull())
    return won.groupBy(F.date_format("close_date", "yyyy-MM").alias("month")).agg(sum_money(F.col(column)).alias("revenue"))


def revenue_by(df: DataFrame, dim: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Money totals per dimension (NULL group kept)."""
    columns = list(columns or REVENUE_COLUMNS + POTENTIAL_REVENUE_COLUMNS + PIPELINE_REVENUE_COLUMNS)
    return df.groupBy(dim).agg(*money_aggs(df, columns))


# ---- paid vendor performance -----------------------------------------------------------------

def vendor_costs(raw: DataFrame) -> DataFrame:
    """Cost ledger: trimmed vendor, numeric spend; blank vendor or spend <= 0 dropped."""
    out = raw.select(clean_text(F.col("vendor")).alias("vendor"),
                     F.col("month") if "month" in raw.columns else F.lit(None).cast("string").alias("month"),
                     F.coalesce(F.col("spend").cast("string").try_cast("double"), F.lit(0.0)).alias("spend"),
                     F.col("notes") if "notes" in raw.columns else F.lit(None).cast("string").alias("notes"))
    return out.where((F.col("vendor") != "") & (F.col("spend") > 0))


def vendor_series(df: DataFrame) -> Column:
    """vendor if any row has one, else paid_vendor if any, else utm_source / source_group; blank -> Unknown.
    The table-level switch is a one-row scalar subquery."""
    def txt(c):
        return clean_text(F.col(c)) if c in df.columns else F.lit("")
    flags = df.agg(F.struct(F.coalesce(F.max(txt("vendor") != ""), F.lit(False)).alias("v"),
                            F.coalesce(F.max(txt("paid_vendor") != ""), F.lit(False)).alias("p"))).scalar()
    utm = txt("utm_source")
    src = clean_text(F.coalesce(F.col("source_group").cast("string"), F.lit("Unknown"))) if "source_group" in df.columns else F.lit("Unknown")
    fallback = F.when(utm != "", utm).otherwise(src)
    chosen = F.when(flags.getField("v"), txt("vendor")).when(flags.getField("p"), txt("paid_vendor")).otherwise(fallback)
    return F.when(chosen == "", F.lit("Unknown")).otherwise(chosen)


def contacted_mask(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in ("last_activity_date", "last_sales_activity_timestamp", "first_outreach_date", "first_engagement_date"):
        if c in df.columns:
            out = out | (F.col(c).isNotNull() & (clean_text(F.col(c)) != ""))
    if "num_notes" in df.columns:
        out = out | (F.coalesce(F.col("num_notes").cast("double"), F.lit(0.0)) > 0)
    return out


VENDOR_KEYS = ["vendor", "source_group", "campaign"]
VENDOR_COLUMNS = [
    "vendor", "source_group", "campaign", "leads", "paid_leads", "contacted_leads", "uncontacted_leads", "hot_leads",
    "dead_leads", "deals_created", "enrolled_students", "actual_revenue", "estimated_enrolled_revenue",
    "open_potential_revenue", "close_rate", "enrollment_rate", "average_response_time", "average_days_to_enroll",
    "average_sales_touches_before_enrollment", "cost_per_lead", "revenue_per_lead", "estimated_roi", "leakage_score",
    "vendor_confidence", "vendor_source_field",
]


def _unknown_if_empty(c: Column, default: str) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(default))
    return F.when(v == "", F.lit(default)).otherwise(v)


def paid_vendor_performance(paid_contacts: DataFrame, fact: DataFrame, costs: DataFrame) -> DataFrame:
    """25 columns per (vendor, source_group, campaign).  Fact rows join a group through the
    contact id (T18); spend is allocated by the group's share of the vendor's paid leads."""
    from ..functions.expr import avg_exact
    c = paid_contacts.withColumns({
        "vendor": vendor_series(paid_contacts),
        "source_group": _unknown_if_empty(F.col("source_group"), "Unknown"),
        "campaign": _unknown_if_empty(F.col("utm_campaign"), "Unknown"),
        "vendor_confidence": _unknown_if_empty(F.col("vendor_confidence"), "Low"),
        "vendor_source_field": F.coalesce(F.col("vendor_source_field").cast("string"), F.lit("")),
        "__contacted": contacted_mask(paid_contacts),
    })
    membership = c.where(F.col("contact_id").isNotNull()).select("contact_id", *VENDOR_KEYS).distinct()
    related = fact.where(F.col("contact_id").isNotNull()).drop(*[k for k in VENDOR_KEYS if k in fact.columns]).join(
        membership, "contact_id")
    won = countable_won(related)
    enrolled_rev = F.coalesce(F.col("enrolled_revenue").cast("double"), F.lit(0.0))
    conf = F.col("vendor_confidence")
    field = F.col("vendor_source_field")
    g = c.groupBy(*VENDOR_KEYS).agg(
        F.countDistinct("contact_id").alias("paid_leads"),
        F.countDistinct(F.when(F.col("__contacted"), F.col("contact_id"))).alias("contacted_leads"),
        F.count_if(F.col("lead_temperature") == "Hot").alias("hot_leads"),
        F.count_if(F.col("lead_temperature") == "Dead").alias("dead_leads"),
        sum_money(F.col("open_pipeline_potential_revenue")).alias("open_potential_revenue"),
        (avg_exact(F.col("time_to_first_engagement")) / F.lit(3600000.0)).alias("__resp"),
        avg_exact(F.when(enrolled_rev > 0, F.col("num_notes").cast("double"))).alias("__touch"),
        F.count_if(conf == "High").alias("__h"), F.count_if(conf == "Medium").alias("__m"), F.count_if(conf == "Low").alias("__l"),
        F.array_join(F.array_sort(F.collect_set(F.when(field != "", field))), ", ").alias("__fields"),
    )
    f = related.groupBy(*VENDOR_KEYS).agg(F.countDistinct("deal_id").alias("deals_created"))
    w = won.groupBy(*VENDOR_KEYS).agg(
        sum_money(F.col("revenue_attributed")).alias("actual_revenue"),
        F.countDistinct("deal_id").alias("__won_deals"),
        F.avg("days_to_close").alias("__days"))
    est = estimated_enrolled_revenue(c, related, VENDOR_KEYS)
    spend = costs.groupBy("vendor").agg(F.sum("spend").alias("__spend"))
    vendor_leads = c.groupBy("vendor").agg(F.countDistinct("contact_id").alias("__vendor_leads"))
    j = (g.join(f, VENDOR_KEYS, "left").join(w, VENDOR_KEYS, "left").join(est, VENDOR_KEYS, "left")
         .join(spend, "vendor", "left").join(vendor_leads, "vendor", "left"))
    z = lambda n, d=0: F.coalesce(F.col(n), F.lit(d))
    paid_n = F.col("paid_leads")
    unc = F.greatest(paid_n - F.col("contacted_leads"), F.lit(0))
    alloc = z("__spend", 0.0) * safe_div(paid_n, z("__vendor_leads"))
    est_rev, act = z("estimated_enrolled_revenue", 0.0), z("actual_revenue", 0.0)
    roi_rev = F.when(est_rev != 0, est_rev).otherwise(act)
    out = j.select(
        "vendor", "source_group", "campaign", paid_n.alias("leads"), paid_n.alias("paid_leads"), "contacted_leads",
        unc.alias("uncontacted_leads"), "hot_leads", "dead_leads", z("deals_created").alias("deals_created"),
        z("enrolled_students").alias("enrolled_students"), act.alias("actual_revenue"),
        est_rev.alias("estimated_enrolled_revenue"), "open_potential_revenue",
        safe_div(z("__won_deals"), paid_n).alias("close_rate"),
        safe_div(z("enrolled_students"), paid_n).alias("enrollment_rate"),
        z("__resp", 0.0).alias("average_response_time"), z("__days", 0.0).alias("average_days_to_enroll"),
        z("__touch", 0.0).alias("average_sales_touches_before_enrollment"),
        safe_div(alloc, paid_n).alias("cost_per_lead"), safe_div(roi_rev, paid_n).alias("revenue_per_lead"),
        safe_div(roi_rev - alloc, alloc).alias("estimated_roi"),
        F.least(safe_div(unc + F.col("dead_leads"), paid_n) * 100, F.lit(100.0)).alias("leakage_score"),
        revenue_confidence_mix(F.col("__h"), F.col("__m"), F.col("__l")).alias("vendor_confidence"),
        F.coalesce(F.nullif(F.col("__fields"), F.lit("")), F.lit("Unknown")).alias("vendor_source_field"),
    )
    return out.orderBy(F.desc("open_potential_revenue"), F.desc("estimated_enrolled_revenue"), F.desc("paid_leads"),
                       *VENDOR_KEYS)


# ---- distinct counts without Expand --------------------------------------------------------------

def grouped_distinct(df: DataFrame, keys: Sequence[str], id_col: str, flags: dict, sums: dict | None = None,
                     row_counts: dict | None = None, means: dict | None = None) -> DataFrame:
    """Several "distinct ids where <flag>" counts per group in two plain aggregations:
    (keys, id) -> OR of each flag, partial money sums and row counts; then keys -> count_if /
    sums.  Spark would otherwise ``Expand`` every row once per distinct aggregate (SURVEY §4
    rule 1).  NULL ids are not counted but their money and rows still are."""
    from ..functions.expr import money
    keys = list(keys)
    sums, row_counts, means = dict(sums or {}), dict(row_counts or {}), dict(means or {})
    s1 = df.groupBy(*keys, id_col).agg(
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"__f_{n}") for n, c in flags.items()],
        *[F.sum(money(c)).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"__r_{n}") for n, c in row_counts.items()],
        *[F.sum(c.cast("double").cast("decimal(28,9)")).alias(f"__ms_{n}") for n, c in means.items()],
        *[F.count(c).alias(f"__mc_{n}") for n, c in means.items()])
    has_id = F.col(id_col).isNotNull()
    return s1.groupBy(*keys).agg(
        *[F.count_if(F.col(f"__f_{n}") & has_id).alias(n) for n in flags],
        *[F.coalesce(F.sum(f"__s_{n}"), F.lit(0).cast("decimal(38,6)")).cast("double").alias(n) for n in sums],
        *[F.coalesce(F.sum(f"__r_{n}"), F.lit(0)).cast("long").alias(n) for n in row_counts],
        *[(F.sum(f"__ms_{n}").cast("double") / F.sum(f"__mc_{n}")).alias(n) for n in means])
