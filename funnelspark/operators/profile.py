"""Field profiling and logical->physical mapping.

The whole bronze table is profiled (no 500-row sample): one unpivot of (property, value, row
order) feeds a grouped count and a per-(property, value) first-seen aggregate; the five sample
values per property come from a window over the *distinct* values of that property.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import clean_text


def profile_fields(df: DataFrame, object_type: str, properties: Sequence[tuple[str, str, str]] | None = None,
                   order_col: str | None = None, samples: int = 5) -> DataFrame:
    """Per property: non-blank count, % filled (2 dp), up to 5 sample values (first seen by
    ``order_col``), usable.  ``properties`` = (name, label, type); default every column."""
    props = list(properties or [(c, c, None) for c in df.columns if c != order_col])
    names = [p[0] for p in props]
    # Row order comes from a business key (O-list); without one, samples are the smallest values.
    order = F.col(order_col).cast("string").try_cast("long") if order_col else F.lit(0).cast("long")
    present = [n for n in names if n in df.columns]
    stacked = df.select(order.alias("__o"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("property_name"), clean_text(F.col(n)).alias("v")) for n in present])).alias("p"))
    stacked = stacked.select("__o", "p.property_name", "p.v").where(F.col("v") != "")
    counts = stacked.groupBy("property_name").agg(F.count(F.lit(1)).alias("non_null_count"))
    firsts = stacked.groupBy("property_name", "v").agg(F.min("__o").alias("__first"))
    top = firsts.withColumn("__rn", F.row_number().over(Window.partitionBy("property_name").orderBy("__first", "v"))) \
        .where(F.col("__rn") <= samples)
    sample = top.groupBy("property_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "v"))), lambda x: x["v"]), " | ").alias("sample_values"))
    total = df.agg(F.count(F.lit(1))).scalar()
    meta = df.sparkSession.createDataFrame([(n, lab or n, t) for n, lab, t in props],
                                           "property_name string, label string, data_type string")
    out = meta.join(counts, "property_name", "left").join(sample, "property_name", "left")
    nn = F.coalesce(F.col("non_null_count"), F.lit(0)).cast("long")
    return out.select(
        F.lit(object_type).alias("object_type"), "property_name", "label", "data_type", nn.alias("non_null_count"),
        F.when(total > 0, F.round(nn / total * 100, 2)).otherwise(F.lit(0.0)).alias("percent_filled"),
        F.coalesce(F.col("sample_values"), F.lit("")).alias("sample_values"), (nn > 0).alias("usable"))


def _tokens(logical: str) -> list[str]:
    return R.SEARCH_HINTS.get(logical) or logical.split("_")


def wanted_fields(spark, fields: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> DataFrame:
    """(object_type, logical_name, preferred array, tokens array) — the requested logical fields."""
    fields = R.DASHBOARD_FIELDS if fields is None else fields
    rows = [(obj, name, list(pref), _tokens(name)) for obj, d in fields.items() for name, pref in d.items()]
    return spark.createDataFrame(rows, "object_type string, logical_name string, preferred array<string>, tokens array<string>")


def matched_tokens(vocabulary: Sequence[str], property_name: Column, label: Column) -> Column:
    """The vocabulary's tokens found in 'name label' (lower-cased, '_' -> ' '); a field's match score is
    how many of its tokens are among them."""
    hay = F.regexp_replace(F.lower(F.concat_ws(" ", property_name, F.coalesce(label, F.lit("")))), "_", " ")
    return F.filter(F.array(*[F.lit(t) for t in vocabulary]), lambda t: hay.contains(t))


def choose_field_mapping(inventory: DataFrame, wanted: DataFrame, fields=None) -> DataFrame:
    """First usable preferred candidate; else the best alternative with score >= min(2, #tokens),
    by (score, % filled, name) descending.

    No field x property product is formed: preferred candidates are an equi-join on
    (object_type, property_name); scores come from each property's matched hint tokens (a
    ``filter`` over the fixed token vocabulary) equi-joined to the fields' tokens on the token."""
    inv = inventory.where(F.col("usable")).select("object_type", "property_name", "label", "percent_filled")
    pref = (wanted.select("object_type", "logical_name", F.posexplode("preferred").alias("__pos", "property_name"))
            .join(inv.select("object_type", "property_name"), ["object_type", "property_name"])
            .groupBy("object_type", "logical_name").agg(F.min(F.struct("__pos", "property_name")).getField("property_name").alias("__pref")))
    fields = R.DASHBOARD_FIELDS if fields is None else fields
    vocab = sorted({t.lower() for obj in fields.values() for name in obj for t in _tokens(name)})
    matched = inv.select("object_type", "property_name", F.coalesce(F.col("percent_filled").cast("double"), F.lit(0.0)).alias("p"),
                         F.explode(matched_tokens(vocab, F.col("property_name"), F.col("label"))).alias("token"))
    field_tokens = wanted.select("object_type", "logical_name", F.size("tokens").alias("n_tokens"),
                                 F.explode(F.array_distinct(F.transform("tokens", lambda t: F.lower(t)))).alias("token"))
    scored = (field_tokens.join(matched, ["object_type", "token"])
              .groupBy("object_type", "logical_name", "property_name", "p", "n_tokens").agg(F.count(F.lit(1)).alias("score")))
    alt = (scored.where(F.col("score") >= F.least(F.lit(2), F.col("n_tokens")))
           .groupBy("object_type", "logical_name")
           .agg(F.max(F.struct("score", "p", "property_name")).getField("property_name").alias("__alt")))
    out = (wanted.select("object_type", "logical_name", "preferred").join(pref, ["object_type", "logical_name"], "left")
           .join(alt, ["object_type", "logical_name"], "left"))
    return out.select("object_type", "logical_name", F.coalesce("__pref", "__alt").alias("selected_property"),
                      F.array_join("preferred", ", ").alias("preferred_candidates"))


def removed_fields(mapping: DataFrame) -> DataFrame:
    """Logical fields with no populated property."""
    return mapping.where(F.col("selected_property").isNull()).select(
        "object_type", F.col("logical_name").alias("dashboard_field"),
        F.lit("No populated HubSpot property found.").alias("reason"), "preferred_candidates")


def missing_fields(mapping: DataFrame, wanted_names: DataFrame) -> DataFrame:
    """Wanted logical fields (object_type, logical_name) that have no mapping."""
    mapped = mapping.where(F.col("selected_property").isNotNull()).select("object_type", "logical_name")
    return wanted_names.join(mapped, ["object_type", "logical_name"], "left_anti")


def vendor_candidate_fields(inventory: DataFrame, fixed: Sequence[str] = ()) -> DataFrame:
    """Usable contact fields whose name/label holds a vendor term, plus a fixed list."""
    text = F.lower(F.concat_ws(" ", F.col("property_name"), F.coalesce(F.col("label"), F.lit(""))))
    cond = F.lit(False)
    for t in R.VENDOR_FIELD_TERMS:
        cond = cond | text.contains(t)
    found = inventory.where((F.col("object_type") == "contact") & F.col("usable") & cond).select("property_name")
    if fixed:
        found = found.unionByName(inventory.sparkSession.createDataFrame([(f,) for f in fixed], "property_name string"))
    return found.distinct()
