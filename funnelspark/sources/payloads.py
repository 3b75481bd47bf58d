"""Landed CRM API payloads -> tables.

Pages are JSON documents: ``results[]`` with ``properties{}`` maps for objects, ``from``/``to[]``
with ``associationTypes[]`` for links.  Flattening is ``explode`` + map lookups; nothing leaves
the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clean_id, clean_text

OBJECT_PAGE_SCHEMA = ("results array<struct<id: string, createdAt: string, updatedAt: string, archived: boolean, "
                      "properties: map<string, string>>>")
OWNER_PAGE_SCHEMA = "results array<struct<id: string, userId: string, email: string, firstName: string, lastName: string, archived: boolean>>"
LINK_PAGE_SCHEMA = ("results array<struct<from: struct<id: string>, fromObjectId: string, to: array<struct<toObjectId: string, id: string, "
                    "associationTypes: array<struct<category: string, typeId: bigint, label: string>>>>>>")


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_crm_objects(pages: DataFrame, properties: Sequence[str]) -> DataFrame:
    """One row per object: id, createdAt, updatedAt, archived, each property as a column,
    hs_object_id defaulted to id."""
    o = pages.select(F.explode("results").alias("o"))
    cols = [F.col("o.id").alias("id"), F.col("o.createdAt").alias("createdAt"), F.col("o.updatedAt").alias("updatedAt"),
            F.col("o.archived").alias("archived")]
    cols += [F.col("o.properties").getItem(p).alias(p) for p in properties if p != "hs_object_id"]
    cols.append(F.coalesce(F.col("o.properties").getItem("hs_object_id"), F.col("o.id")).alias("hs_object_id"))
    return o.select(*cols)


def flatten_owners(pages: DataFrame) -> DataFrame:
    """owner_id, user_id, email, names, archived; salesman_name = full name, else email, else id."""
    o = pages.select(F.explode("results").alias("o")).select("o.*")
    full = F.trim(F.concat_ws(" ", clean_text(F.col("firstName")), clean_text(F.col("lastName"))))
    return o.select(clean_id(F.col("id")).alias("owner_id"), F.col("userId").alias("user_id"), F.col("email"),
                    F.col("firstName").alias("first_name"), F.col("lastName").alias("last_name"),
                    F.coalesce(F.nullif(full, F.lit("")), F.nullif(clean_text(F.col("email")), F.lit("")),
                               clean_id(F.col("id"))).alias("salesman_name"),
                    F.coalesce(F.col("archived"), F.lit(False)).alias("archived"))


def flatten_links(pages: DataFrame, from_name: str, to_name: str) -> DataFrame:
    """(from id, to id, first association label else typeId), distinct; ids under either of their names."""
    r = pages.select(F.explode("results").alias("r"))
    either = lambda *names: F.coalesce(*[clean_id(F.col(n)) for n in names])
    t = r.select(either("r.from.id", "r.fromObjectId").alias("f"), F.explode_outer("r.to").alias("t"))
    first = F.get(F.col("t.associationTypes"), 0)
    label = F.coalesce(F.nullif(clean_text(first.getField("label")), F.lit("")), first.getField("typeId").cast("string"))
    return (t.select(F.col("f").alias(from_name), either("t.toObjectId", "t.id").alias(to_name),
                     label.alias("association_type"))
            .where(F.col(from_name).isNotNull() & F.col(to_name).isNotNull()).distinct())


def flatten_contact_deal_links(pages: DataFrame) -> DataFrame:
    return flatten_links(pages, "contact_id", "deal_id")


def flatten_activity_links(pages: DataFrame, activity_type: str) -> DataFrame:
    return flatten_links(pages, "activity_id", "contact_id").select(
        F.lit(activity_type).alias("activity_type"), "activity_id", "contact_id", F.col("association_type").alias("type"))


def latest_records(df: DataFrame, n: int = 0, by: str = "createdate", key: str = "hs_object_id") -> DataFrame:
    """Newest objects by create date, equal dates by falling id; all, or the first ``n`` if it is not 0."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), *([F.col(key).desc_nulls_last()] if key in df.columns else []))
    return ordered.limit(n) if n else df


def newest_objects(objects: DataFrame, key: str = "id", by: str = "updatedAt") -> DataFrame:
    """One row per object: what was landed last of it (greatest ``by``; of equal ones the greatest row), for objects
    that are landed again whenever they change.  A grouped aggregate, so an object landed very often collapses
    before the shuffle; rows without a key are left out, all columns stay."""
    row = F.struct(F.col(by).alias("__by"), *[F.col(f"`{c}`") for c in objects.columns])
    newest = objects.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(row).alias("__row"))
    return newest.select(*[F.col("__row").getField(c).alias(c) for c in objects.columns])


# ---- payload view over the driver tables (pages of 100 objects) -------------------------------

def contact_pages(contacts_raw: DataFrame, page_size: int = 100) -> DataFrame:
    """Raw contacts regrouped into API-shaped pages (bounded groups of ``page_size`` objects)."""
    props = [c for c in contacts_raw.columns]
    obj = F.struct(F.col("hs_object_id").alias("id"), F.col("createdate").alias("createdAt"),
                   F.col("createdate").alias("updatedAt"), F.lit(False).alias("archived"),
                   F.map_from_arrays(F.array(*[F.lit(p) for p in props]), F.array(*[F.col(p) for p in props])).alias("properties"))
    pages = contacts_raw.agg(F.greatest(F.ceil(F.count(F.lit(1)) / page_size), F.lit(1))).scalar()
    page = F.pmod(F.xxhash64("hs_object_id"), pages)
    return contacts_raw.groupBy(page.alias("page")).agg(F.collect_list(obj).alias("results"))


def link_pages(assoc_raw: DataFrame, page_size: int = 100) -> DataFrame:
    """Raw associations as API link pages of about ``page_size`` results; a result holds one link, so a
    contact with very many deals is spread over the pages."""
    to = F.struct(F.col("deal_id").alias("toObjectId"), F.lit(None).cast("string").alias("id"), F.array(F.struct(
        F.lit("HUBSPOT_DEFINED").alias("category"), F.lit(4).cast("bigint").alias("typeId"),
        F.col("association_type").alias("label"))).alias("associationTypes"))
    res = F.struct(F.struct(F.col("contact_id").alias("id")).alias("from"), F.lit(None).cast("string").alias("fromObjectId"), F.array(to).alias("to"))
    pages = assoc_raw.agg(F.greatest(F.ceil(F.count(F.lit(1)) / page_size), F.lit(1))).scalar()
    page = F.pmod(F.xxhash64("contact_id", "deal_id", "association_type"), pages)
    return assoc_raw.groupBy(page.alias("page")).agg(F.collect_list(res).alias("results"))
