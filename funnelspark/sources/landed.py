"""CRM payload pages landed as JSON files, and activity tables landed per type.

A refresh lands every API page as one line of JSON.  Pages are read as text and parsed with a
corrupt-record column, so a page that was cut off, isn't JSON or has another shape than expected is set
aside whole, with the file it came from and the reason; the other pages of the file are kept.
No page is collected: rejects are a table like the pages.

Activity types land in tables of their own with the columns that the type happens to have.  A type
without a table (no permission to read it, or nothing landed yet) is left out; columns that
types share under one name but with different types meet as text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_id
from .crm_view import spread

_CORRUPT = "_corrupt_record"


def parse_pages(lines: DataFrame, schema: str, text_col: str = "value") -> DataFrame:
    """``lines`` plus the page's columns and ``reject_reason``: null, 'empty', 'broken' (no JSON, cut off or of
    another shape) or 'no results' (JSON without the list of results, such as an error message)."""
    wanted = T.StructType.fromDDL(schema)
    full = T.StructType([*wanted.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.withColumn("_page", F.from_json(F.col(text_col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    reason = (F.when(F.trim(F.coalesce(text_col, F.lit(""))) == "", F.lit("empty"))
              .when(F.col("_page").isNull() | F.col(f"_page.{_CORRUPT}").isNotNull(), F.lit("broken"))
              .when(F.col(f"_page.{wanted.names[0]}").isNull(), F.lit("no results")))
    return parsed.select("*", *[F.col(f"_page.{n}").alias(n) for n in wanted.names], reason.alias("reject_reason")).drop("_page")


def read_landed_pages(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good pages, rejected pages) of the JSON-lines files below ``folder``; rejects have file, reason, page text."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    pages = parse_pages(lines, schema)
    good = pages.where(F.col("reject_reason").isNull()).drop("value", "file", "reject_reason")
    bad = pages.where(F.col("reject_reason").isNotNull()).select("file", "reject_reason", F.col("value").alias("page"))
    return good, bad


def reject_counts(rejects: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, reject_reason, pages) over the rejected pages of several kinds."""
    out = None
    for kind, bad in rejects.items():
        part = bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("pages")).select(F.lit(kind).alias("kind"), "reject_reason", "pages")
        out = part if out is None else out.unionByName(part)
    return out


def landed_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The Parquet tables ``<folder>/<name>`` that exist, their files' schemas merged; missing ones are left out."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.option("mergeSchema", True).parquet(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def merged_columns(frames: Mapping[str, DataFrame]) -> dict[str, str]:
    """Column -> type over all frames, in order of appearance; 'string' where the frames disagree."""
    out: dict[str, str] = {}
    for frame in frames.values():
        for field in frame.schema.fields:
            kind = field.dataType.simpleString()
            out[field.name] = kind if out.get(field.name, kind) == kind else "string"
    return out


def _as_kind(field: T.StructField, kind: str):
    c = F.col(f"`{field.name}`")
    if field.dataType.simpleString() == kind:
        return c
    return (F.to_json(c) if isinstance(field.dataType, T.StructType | T.ArrayType | T.MapType) else c.cast(kind)).alias(field.name)


def union_activities(frames: Mapping[str, DataFrame], links: DataFrame) -> DataFrame:
    """All activity tables in one, with the type and the linked contacts.

    Columns that a type doesn't have are null; types that have the same column with different types meet as
    text.  Links (activity_type, activity_id, contact_id, type) are joined once, on type and id: an
    activity with several contacts has a row for each, one without links has a null contact.  The id
    is ``hs_object_id``, else ``id``.  Without any table the result is empty with just the added columns.
    """
    if not frames:
        return links.limit(0).select("activity_type", "activity_id", "contact_id", F.col("type").alias("association_type"))
    kinds = merged_columns(frames)
    if taken := {"activity_type", "activity_id", "contact_id", "association_type"} & set(kinds):
        raise ValueError(f"activity tables may not bring columns of their own named {sorted(taken)}")
    out = None
    for name, frame in frames.items():
        ids = [F.col(c).cast("string") for c in ("hs_object_id", "id") if c in frame.columns]
        tagged = frame.select(*[_as_kind(f, kinds[f.name]) for f in frame.schema.fields], F.lit(name).alias("activity_type"),
                              clean_id(F.coalesce(*ids) if ids else F.lit(None).cast("string")).alias("activity_id"))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    own = links.select("activity_type", "activity_id", "contact_id", F.col("type").alias("association_type"))
    return out.join(own, ["activity_type", "activity_id"], "left").select(*kinds, "activity_type", "activity_id", "contact_id", "association_type")


# ---- what a refresh lands, derived from the driver tables -----------------------------------------

PAGE_SIZE = 10
#: Every how many pages one is cut off, and one is an error message instead.
BROKEN_EVERY, ERROR_EVERY = 7, 11


def land_pages(objects: DataFrame, key: str, obj, folder: str, page_size: int = PAGE_SIZE) -> str:
    """Write the objects as JSON pages of up to ``page_size`` (by key) below ``folder``; some pages are broken off
    halfway, some are error messages."""
    page = F.floor(F.col(key) / page_size)
    pages = objects.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), obj.alias("o")))).alias("os"))
    text = F.to_json(F.struct(F.col("os.o").alias("results")))
    line = (F.when(F.col("page") % BROKEN_EVERY == 3, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
            .when(F.col("page") % ERROR_EVERY == 5, F.lit('{"status":"error","message":"try again"}')).otherwise(text))
    pages.select(line.alias("value")).write.text(folder)
    return folder


def owner_pages(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Owners from suppliers: names in two parts, some of them blank or missing, some without an e-mail."""
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet")
    k = F.col("s_suppkey")
    obj = F.struct(k.cast("string").alias("id"), (k + 100_000).cast("string").alias("userId"),
                   F.when(k % 4 != 0, F.concat(F.lit("s"), k.cast("string"), F.lit("@x.org"))).alias("email"),
                   F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.lit("Supplier")).alias("firstName"),
                   F.when(k % 5 < 2, F.substring_index("s_name", "#", -1)).alias("lastName"),
                   F.when(k % 6 == 0, F.lit(True)).alias("archived"))
    return land_pages(s, "s_suppkey", obj, folder)


#: Activity type -> the driver's event type; tasks are never landed (no permission to read them).
LANDED_TYPES = {"calls": "signup", "emails": "click", "meetings": "purchase", "notes": "view"}
NOT_LANDED = "tasks"


def activity_link_pages(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """Link pages per activity type: none, one or two contacts an activity, ids under either of the names that
    the API has used, association types with a label, without one, or missing."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    k, contact = F.col("event_id"), F.col("user_id").cast("string")
    label = F.array(F.struct(F.lit("HUBSPOT_DEFINED").alias("category"), (k % 9).alias("typeId"),
                             F.when(k % 2 == 0, F.lit("Primary")).alias("label")))
    to = lambda c, old: F.struct(F.when(~old, c).alias("toObjectId"), F.when(old, c).alias("id"),
                                 F.when(k % 6 != 0, label).alias("associationTypes"))
    first, second = to(contact, k % 8 == 0), to((F.col("user_id") + 1).cast("string"), F.lit(False))
    linked = F.when(k % 10 == 0, F.array(first, second)).when(k % 10 != 1, F.array(first))
    obj = F.struct(F.when(k % 3 != 0, F.struct(k.cast("string").alias("id"))).alias("from"),
                   F.when(k % 3 == 0, k.cast("string")).alias("fromObjectId"), linked.alias("to"))
    return {name: land_pages(e.where(F.col("event_type") == kind), "event_id", obj, f"{folder}/{name}") for name, kind in LANDED_TYPES.items()}


def activity_tables(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """A table per landed activity type with columns of its own; calls keep their time as a number, the others as text."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    k, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    own = {
        "calls": [ms.alias("hs_timestamp"), F.get_json_object("props", "$.k").alias("hs_call_title")],
        "emails": [ms.cast("string").alias("hs_timestamp"), (k % 5).cast("int").alias("hs_email_opens")],
        "meetings": [ms.cast("string").alias("hs_timestamp"), F.struct(F.lit("Room").alias("kind"), (k % 30).alias("number")).alias("hs_meeting_place"),
                     F.col("value").alias("hs_meeting_hours")],
        "notes": [ms.cast("string").alias("hs_timestamp")],
    }
    for name, kind in LANDED_TYPES.items():
        rows = e.where(F.col("event_type") == kind)
        ids = F.when(k % 40 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("hs_object_id")
        rows.select(ids, *own[name]).write.parquet(f"{folder}/{name}")
    return folder


# ---- published prices, one text file per page ------------------------------------------------------

PARTS_PER_PAGE = 100
#: Headings of the price lines by level, for even and odd credits (FIXED VALUES: what the price patterns look for).
PRICE_HEADINGS = [("Certificate", "Certificate Programs", "Certificate Programs"), ("Associate", "Associate Degree", "Associate Degree"),
                  ("Bachelor", "Bachelor's Degree", "Bachelors Degree"), ("Master", "Master's Degree Programs", "Masters Degree Programs"),
                  ("Doctoral", "Doctoral Degree Programs", "Doctoral Degree Programs")]


def land_price_pages(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Price pages from parts, a text file each: a level's price is the highest retail price among its parts of the
    page, its credits the smallest size.  Lines are spelled in two ways, some levels are missing, some
    pages are in capitals, some have no prices at all."""
    p = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    n = len(PRICE_HEADINGS)
    parts = p.select(F.floor(F.col("p_partkey") / PARTS_PER_PAGE).alias("page_id"), (F.col("p_partkey") % n).cast("int").alias("i"), "p_retailprice", "p_size")
    level = parts.groupBy("page_id", "i").agg(F.floor(F.max("p_retailprice")).cast("long").alias("price"), (F.min("p_size") + 12).cast("long").alias("credits"),
                                              F.sum("p_size").alias("size"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    total = F.col("price") * F.col("credits")
    heading = F.element_at(F.array(*[F.when(F.col("credits") % 2 == 0, F.lit(even)).otherwise(F.lit(odd)) for _, even, odd in PRICE_HEADINGS]), F.col("i") + 1)
    line = F.concat(heading, F.when(F.col("credits") % 3 != 0, F.lit("\n  ")).otherwise(F.lit("\t")), money(F.col("price")), F.lit("  "), F.col("credits").cast("string"),
                    F.lit(" "), money(total), F.lit("\t"), money(F.floor(total / F.greatest(F.floor(F.col("credits") / 30), F.lit(1)))))
    line = F.when(F.col("credits") % 7 != 0, line).otherwise(F.lit("(on request)"))
    page = level.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("lines"), F.sum("size").alias("size"))
    text = F.concat(F.lit("Tuition and fees\nAssociate Degree from $999\n"), F.array_join("lines.line", "\n"))
    text = F.when(F.col("size") % 3 == 0, F.upper(text)).otherwise(text)
    text = F.when(F.col("size") % 4 == 0, F.lit("Prices on request.\nCertificate Programs: call us.")).otherwise(text)
    # a page is a row of some hundred bytes but a file of its own: dealt over all cores, not by size
    spread(page.select("page_id", text.alias("value")), "page_id").write.partitionBy("page_id").text(folder)
    return folder
