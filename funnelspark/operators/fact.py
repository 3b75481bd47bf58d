"""Contact x deal revenue fact.

Plan shape: links are joined to a per-deal link summary and to deals on ``deal_id`` (one
shuffle key), then to contacts on ``contact_id``; contacts-without-deals and deals-without-contacts
come from ``left_anti`` joins and everything is unioned by name.  "First row of a deal" is
decided with a per-deal ``min(struct(order))`` aggregate (partial aggregation, so a hot deal
never lands whole in one task) that is joined back, instead of a window over the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import elapsed_days_floor, number_column
from ..functions.rules import TUITION_SOURCE_LABEL as R_TUITION_SOURCE_LABEL
from ..functions.scoring import score_leads
from ..functions.tuition import NO_PROGRAM, REALIZED_FIELDS, add_potential_fields, add_program_tuition_fields, add_realized_fields, enrolled_mask
from .entities import ORDER_MAX, link_order, with_owner_name

TYPE_ASSOCIATED = "associated"
TYPE_CONTACT_ONLY = "contact_without_deal"
TYPE_DEAL_ONLY = "deal_without_contact"


def dedupe_by_key(df: DataFrame, key: str, order_col: str, keep: str = "last") -> DataFrame:
    """One row per non-NULL key, the last (or first) by ``order_col``.

    Keys are counted on their own column first.  Rows of keys that occur once pass as they are; only
    those of repeated keys are aggregated whole (``max_by``/``min_by``, combined on the map side, so a
    key with a large share of rows never reaches one task whole).
    """
    cols = [c for c in df.columns]
    keyed = df.where(F.col(key).isNotNull())
    repeated = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key)
    order = F.coalesce(F.col(order_col), F.lit(ORDER_MAX if keep == "first" else -ORDER_MAX - 1))
    row = F.struct(*[F.col(c) for c in cols])
    pick = F.max_by(row, order) if keep == "last" else F.min_by(row, order)
    picked = (keyed.join(repeated, key, "left_semi").groupBy(key).agg(pick.alias("__r"))
              .select(*[F.col(f"__r.{c}").alias(c) for c in cols]))
    return keyed.join(repeated, key, "left_anti").select(*cols).unionByName(picked)


def deal_link_stats(links: DataFrame) -> DataFrame:
    """Per deal: distinct linked contacts and the first link in association order."""
    lo = link_order()
    return links.groupBy("deal_id").agg(
        F.countDistinct("contact_id").alias("deal_contact_count"),
        F.min(F.struct(lo[0], lo[1], lo[4])).alias("__first_link"),
    )


def contact_deal_summary(links: DataFrame, deals: DataFrame) -> DataFrame:
    """Per contact: has open / won / lost deal, first non-blank deal owner (link order), last
    non-blank stage by deal create date (NULL dates first).  Built from links and deals only, so
    the fact does not have to be built twice."""
    d = deals.select("deal_id", "deal_owner_id", "deal_stage", "deal_created_at", "is_won", "is_lost")
    j = links.join(d, "deal_id", "left")
    won = F.coalesce(F.col("is_won"), F.lit(False))
    lost = F.coalesce(F.col("is_lost"), F.lit(False))
    lo = link_order()
    stage_txt = F.regexp_replace(F.coalesce(F.col("deal_stage"), F.lit("")), r"^\s+|\s+$", "")
    owner_txt = F.col("deal_owner_id")
    return j.groupBy("contact_id").agg(
        F.bool_or(~won & ~lost).alias("has_open_deal"),
        F.bool_or(won).alias("has_won_deal"),
        F.bool_or(lost).alias("has_lost_deal"),
        F.min(F.when(owner_txt.isNotNull(), F.struct(lo[2], lo[3], lo[4], owner_txt.alias("v")))).getField("v")
        .alias("fallback_deal_owner_id"),
        F.max(F.when(stage_txt != "", F.struct(F.col("deal_created_at").isNotNull().alias("has_date"),
                                               F.col("deal_created_at").alias("created"), lo[2], lo[3], lo[4],
                                               stage_txt.alias("v")))).getField("v").alias("latest_deal_stage"),
    )


def enrich_contacts(contacts: DataFrame, summary: DataFrame, owners: DataFrame) -> DataFrame:
    """Left-join the deal summary; flags override; salesman falls back to the deal owner."""
    s = summary.select(
        "contact_id",
        F.col("has_open_deal").alias("__open"), F.col("has_won_deal").alias("__won"),
        F.col("has_lost_deal").alias("__lost"), F.col("latest_deal_stage").alias("__stage"),
        "fallback_deal_owner_id")
    j = contacts.join(s, "contact_id", "left")
    fallback = F.col("contact_owner_id").isNull() & F.col("fallback_deal_owner_id").isNotNull()
    j = j.withColumns({
        "has_open_deal": F.coalesce("__open", "has_open_deal", F.lit(False)),
        "has_won_deal": F.coalesce("__won", "has_won_deal", F.lit(False)),
        "has_lost_deal": F.coalesce("__lost", "has_lost_deal", F.lit(False)),
        "latest_deal_stage": F.coalesce("__stage", "latest_deal_stage"),
        "salesman_id": F.when(fallback, F.col("fallback_deal_owner_id")).otherwise(F.col("salesman_id")),
        "__fallback": fallback,
    }).drop("__open", "__won", "__lost", "__stage", "salesman_name")
    j = with_owner_name(j, "salesman_id", "salesman_name", owners)
    return j.withColumn(
        "contact_attribution_type",
        F.when(F.col("salesman_id").isNull(), "missing_owner").when(F.col("__fallback"), "fallback_to_deal_owner")
        .otherwise("contact_owner")).drop("__fallback")


#: Contact columns that the fact's own columns are made from; the others travel as one struct, copied at one go by
#: every step, and are laid out once at the end.
STAGED = ["contact_owner_id", "contact_created_at", "program_degree_level", "program_duration_months", "program_duration_years",
          *NO_PROGRAM, "__owner", "__contact_tuition", "__published", "__enrolled"]
#: What the fact makes on its rows; a contact's column of such a name is not carried.
MADE = ["salesman_id", "salesman_name", "attribution_type", "deal_contact_count", "revenue_countable", "fact_record_type", "deal_countable",
        "revenue_attributed", "won_deal_count", "program_revenue_input", "program_revenue_source", "unclear_revenue_attribution", "days_to_close",
        *REALIZED_FIELDS]


def _contact_side(contacts: DataFrame, owners: DataFrame) -> DataFrame:
    """Contacts with all that a fact row takes from its contact alone (program, tuition, potential, owner's name),
    made once per contact and not once per deal."""
    out = contacts.withColumns({
        "__contact_tuition": number_column(contacts, "program_total_tuition", floor_zero=True, fill=0),
        "__published": number_column(contacts, "estimated_total_tuition", floor_zero=True, fill=0),
        "__enrolled": enrolled_mask(contacts)})
    out = add_potential_fields(add_program_tuition_fields(out))
    return with_owner_name(out, "contact_owner_id", "__owner", owners)


def lead_deal_fact(contacts: DataFrame, deals: DataFrame, links: DataFrame, owners: DataFrame) -> DataFrame:
    """links ⟕ contacts ⟕ deals  ∪  contacts ▷ links  ∪  deals ▷ links, plus attribution,
    countable-revenue flags, program revenue and days to close."""
    c = dedupe_by_key(contacts, "contact_id", "_seq", keep="last")
    d = dedupe_by_key(deals, "deal_id", "_deal_seq", keep="last")
    c_cols = [x for x in c.columns if x not in d.columns]
    columns = ["contact_id", "deal_id", *[x for x in links.columns if x not in ("contact_id", "deal_id")], "deal_contact_count",
               *[x for x in d.columns if x != "deal_id"], *[x for x in c_cols if x not in ("contact_id", "salesman_name")], "fact_record_type"]
    c = _contact_side(c, owners)
    packed = [x for x in c.columns if x != "contact_id" and x not in STAGED and x not in MADE and x not in d.columns]
    c = c.select("contact_id", *STAGED, *[x for x in c.columns if x in d.columns], F.struct(*packed).alias("__contact"))
    stats = deal_link_stats(links)
    lo = link_order()
    linked = (links.join(stats, "deal_id", "left")
              .withColumn("__countable", F.struct(lo[0], lo[1], lo[4]) == F.col("__first_link"))
              .drop("__first_link")
              .join(d, "deal_id", "left"))
    assoc = (with_owner_name(linked, "deal_owner_id", "__deal_owner", owners)
             .join(c.select("contact_id", *STAGED, "__contact"), "contact_id", "left")
             .withColumn("fact_record_type", F.lit(TYPE_ASSOCIATED)))
    contact_only = (c.join(links.select("contact_id").distinct(), "contact_id", "left_anti")
                    .withColumns({"fact_record_type": F.lit(TYPE_CONTACT_ONLY), "deal_contact_count": F.lit(0).cast("long"),
                                  "__countable": F.lit(False)}))
    deal_only = (with_owner_name(d.join(links.select("deal_id").distinct(), "deal_id", "left_anti"), "deal_owner_id", "__deal_owner", owners)
                 .withColumns({"fact_record_type": F.lit(TYPE_DEAL_ONLY), "deal_contact_count": F.lit(0).cast("long"),
                               "__countable": F.lit(True)}))
    fact = assoc.unionByName(contact_only, allowMissingColumns=True).unionByName(deal_only, allowMissingColumns=True)
    owned = F.col("contact_owner_id").isNotNull()
    fact = fact.withColumns({
        "salesman_id": F.coalesce("contact_owner_id", "deal_owner_id"),
        "attribution_type": F.when(owned, "contact_owner")
        .when(F.col("deal_owner_id").isNotNull(), "fallback_to_deal_owner").otherwise("missing_owner"),
        "deal_contact_count": F.coalesce(F.col("deal_contact_count"), F.lit(0).cast("long")),
        "revenue_countable": F.coalesce(F.col("__countable"), F.lit(False)) & F.col("deal_id").isNotNull(),
        "revenue": number_column(fact, "revenue", fill=0),
        "is_won": F.coalesce(F.col("is_won"), F.lit(False)),
        "is_lost": F.coalesce(F.col("is_lost"), F.lit(False)),
        "salesman_name": F.coalesce(F.when(owned, F.col("__owner")).otherwise(F.col("__deal_owner")), F.lit("Unassigned")),
        "__contact_tuition": F.coalesce("__contact_tuition", F.lit(0.0)),
        "__published": F.coalesce("__published", F.lit(0.0)),
        **{name: F.coalesce(F.col(name), F.lit(value)) for name, value in NO_PROGRAM.items()},
    })
    countable_won = F.col("revenue_countable") & F.col("is_won")
    contact_tuition = F.col("__contact_tuition")
    deal_revenue = F.greatest(F.col("revenue"), F.lit(0.0))
    published = F.col("__published")
    base = F.when(contact_tuition > 0, contact_tuition).when(deal_revenue > 0, deal_revenue).otherwise(published)
    start = F.coalesce(F.col("contact_created_at"), F.col("deal_created_at"))
    days = elapsed_days_floor(start, F.col("close_date"))
    fact = fact.withColumns({
        "deal_countable": F.col("revenue_countable"),
        "revenue_attributed": F.when(countable_won, F.col("revenue")).otherwise(F.lit(0.0)),
        "won_deal_count": F.when(countable_won, F.lit(1)).otherwise(F.lit(0)),
        "program_revenue_input": F.when(countable_won, base).otherwise(F.lit(0.0)),
        "program_revenue_source": F.when(~countable_won, "not_countable_or_not_won")
        .when(contact_tuition > 0, "contact_program_total_tuition")
        .when(deal_revenue > 0, "deal_revenue")
        .when(published > 0, R_TUITION_SOURCE_LABEL)
        .otherwise("missing_revenue"),
        "unclear_revenue_attribution": (F.col("deal_contact_count") > 1) | (F.col("attribution_type") == "missing_owner"),
        "days_to_close": F.when(days >= 0, days),
    })
    fact = add_realized_fields(fact, "program_revenue_input")
    columns += [x for x in [*fact.columns, *packed] if x not in columns and not x.startswith("__")]
    return fact.select(*[F.col(f"__contact.{x}").alias(x) if x in packed else F.col(x) for x in columns])


def build_contacts_clean(contacts_base: DataFrame, deals: DataFrame, links: DataFrame, owners: DataFrame, today) -> DataFrame:
    """Enrich with the deal summary and score (reference process steps 4-6)."""
    summary = contact_deal_summary(links, deals)
    return score_leads(enrich_contacts(contacts_base, summary, owners), today)
