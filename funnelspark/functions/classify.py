"""Source and vendor classification.

All classification is substring based (T9) and compiled into ``CASE WHEN`` chains over the
rule lists; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .expr import as_text, clean_text, contains_any, strip_ws

SOURCE_SEPARATOR = " | "


def vendor_source_columns(columns: Sequence[str], preferred=None, field_terms=None) -> list[str]:
    """Plan-time list: preferred fields present, then every column naming a vendor term."""
    preferred = R.PREFERRED_SOURCE_FIELDS if preferred is None else preferred
    field_terms = R.VENDOR_FIELD_TERMS if field_terms is None else field_terms
    ordered = [c for c in preferred if c in columns]
    ordered += [c for c in columns if any(t in c.lower() for t in field_terms)]
    out: list[str] = []
    for c in ordered:
        if c not in out:
            out.append(c)
    return out


def source_text(cols: Sequence[str]) -> Column:
    """All source columns joined with ' | ' (blanks kept), whitespace-stripped, then '|'-stripped."""
    if not cols:
        return F.lit("")
    joined = F.concat_ws(SOURCE_SEPARATOR, *[F.coalesce(as_text(F.col(c)), F.lit("")) for c in cols])
    return F.regexp_replace(strip_ws(joined), r"^\|+|\|+$", "")


def paid_lead_flag(text: Column, paid_terms=None) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), R.PAID_TERMS if paid_terms is None else paid_terms)


def source_group(text: Column, social=None, search=None) -> Column:
    """Paid Social -> Paid Search -> Organic Search -> Referral -> Email -> Direct -> Other."""
    return _source_group_lower(F.lower(strip_ws(F.coalesce(text, F.lit("")))), social, search)


def _alias_vendor(text_lower: Column, aliases) -> Column:
    out = None
    for vendor, terms in aliases:
        cond = contains_any(text_lower, terms)
        out = F.when(cond, F.lit(vendor)) if out is None else out.when(cond, F.lit(vendor))
    return out if out is not None else F.lit(None).cast("string")


def first_pipe_part(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: strip_ws(p))
    return F.get(F.filter(parts, lambda p: p != ""), 0)


def add_source_classification(df: DataFrame, cols: Sequence[str] | None = None, aliases=None,
                              paid_terms=None, social_terms=None, search_terms=None) -> DataFrame:
    """source_text, paid_lead_flag, source_group, vendor, vendor_confidence, vendor_source_field, paid_vendor.

    Each source column's cleaned text and first '|' part are staged once as columns, so the
    alias rules and the fallback run over column references, not re-derived text."""
    aliases = R.VENDOR_ALIASES if aliases is None else aliases
    cols = vendor_source_columns(df.columns) if cols is None else [c for c in cols if c in df.columns]
    out = df.withColumn("source_text", source_text(cols))
    staged = {f"__vt{i}": clean_text(F.col(c)) for i, c in enumerate(cols)}
    staged["__sg"] = F.lower(strip_ws(F.coalesce(F.col("source_text"), F.lit(""))))
    out = out.withColumns(staged)
    out = out.withColumns({f"__vl{i}": F.lower(F.col(f"__vt{i}")) for i in range(len(cols))})
    out = out.withColumns({f"__vp{i}": first_pipe_part(F.col(f"__vt{i}")) for i in range(len(cols))})
    out = out.withColumns({f"__va{i}": F.when(F.col(f"__vt{i}") != "", _alias_vendor(F.col(f"__vl{i}"), aliases))
                           for i in range(len(cols))})
    high_v = F.coalesce(*[F.col(f"__va{i}") for i in range(len(cols))]) if cols else F.lit(None).cast("string")
    med_v = F.coalesce(*[F.col(f"__vp{i}") for i in range(len(cols))]) if cols else F.lit(None).cast("string")
    high_f = None
    med_f = None
    for i, c in enumerate(cols):
        high_f = (F.when(F.col(f"__va{i}").isNotNull(), F.lit(c)) if high_f is None
                  else high_f.when(F.col(f"__va{i}").isNotNull(), F.lit(c)))
        med_f = (F.when(F.col(f"__vp{i}").isNotNull(), F.lit(c)) if med_f is None
                 else med_f.when(F.col(f"__vp{i}").isNotNull(), F.lit(c)))
    out = out.withColumns({"__hv": high_v, "__mv": med_v,
                           "__hf": high_f if high_f is not None else F.lit(None).cast("string"),
                           "__mf": med_f if med_f is not None else F.lit(None).cast("string")})
    sg = F.col("__sg")
    out = out.withColumns({
        "paid_lead_flag": contains_any(sg, R.PAID_TERMS if paid_terms is None else paid_terms),
        "source_group": _source_group_lower(sg, social_terms, search_terms),
        "vendor": F.coalesce(F.col("__hv"), F.col("__mv"), F.lit("Unknown")),
        "vendor_confidence": F.when(F.col("__hv").isNotNull(), "High").when(F.col("__mv").isNotNull(), "Medium").otherwise("Low"),
        "vendor_source_field": F.coalesce(F.col("__hf"), F.col("__mf"), F.lit("")),
    })
    out = out.withColumn("paid_vendor", F.col("vendor"))
    drop = [f"__{k}{i}" for i in range(len(cols)) for k in ("vt", "vl", "vp", "va")] + ["__sg", "__hv", "__mv", "__hf", "__mf"]
    return out.drop(*drop)


def _source_group_lower(t: Column, social=None, search=None) -> Column:
    return (
        F.when(t == "", "Unknown")
        .when(contains_any(t, R.PAID_SOCIAL_TERMS if social is None else social), "Paid Social")
        .when(contains_any(t, R.PAID_SEARCH_TERMS if search is None else search), "Paid Search")
        .when(contains_any(t, ["organic", "seo"]), "Organic Search")
        .when(contains_any(t, ["referral", "refer"]), "Referral")
        .when(contains_any(t, ["email", "newsletter"]), "Email")
        .when(t.contains("direct"), "Direct")
        .otherwise("Other")
    )


# ---- uploaded-lead source mapping (modules flavour, T1 "collapse") ----------------------------

def _alias_case(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(text == "", F.lit(R.UNKNOWN_SOURCE))
    for key, value in R.SOURCE_ALIASES:
        out = out.when(low == key, F.lit(value))
    return out.otherwise(text)


def normalize_source_value(c: Column) -> Column:
    """Clean text; blank/(blank)/nan/none -> Unmapped; alias table; else the cleaned text."""
    return _alias_case(clean_text(c, "collapse"))


def with_normalized_source_value(df: DataFrame, src: Column, out: str) -> DataFrame:
    """``normalize_source_value`` with the cleaned text staged once as a column."""
    return df.withColumn("__nsv", clean_text(src, "collapse")).withColumn(out, _alias_case(F.col("__nsv"))).drop("__nsv")


def _first_source(df: DataFrame, fields=None) -> Column:
    fields = R.SOURCE_PRIORITY if fields is None else fields
    present = [f for f in fields if f in df.columns]
    cleaned = [F.nullif(clean_text(F.col(f), "collapse"), F.lit("")) for f in present]
    return F.coalesce(*cleaned, F.lit("")) if cleaned else F.lit("")


def normalized_source(df: DataFrame, fields=None) -> Column:
    return normalize_source_value(_first_source(df, fields))


def lead_type(df: DataFrame, source_col: Column | None = None) -> Column:
    """paid list -> Paid; organic list -> Organic; Unmapped -> Unknown; paid hints; organic hints."""
    paid = clean_text(F.col("paid_lead_list"), "collapse") if "paid_lead_list" in df.columns else F.lit("")
    organic = clean_text(F.col("organic_lead_list"), "collapse") if "organic_lead_list" in df.columns else F.lit("")
    src = F.lower(normalized_source(df) if source_col is None else source_col)
    return (
        F.when(paid != "", "Paid")
        .when(organic != "", "Organic")
        .when(src == R.UNKNOWN_SOURCE.lower(), "Unknown")
        .when(contains_any(src, R.PAID_HINTS), "Paid")
        .when(contains_any(src, R.ORGANIC_HINTS), "Organic")
        .otherwise("Unknown")
    )


def add_source_columns(df: DataFrame) -> DataFrame:
    out = df.withColumn("__first_src", _first_source(df))
    out = with_normalized_source_value(out, F.col("__first_src"), "normalized_source").drop("__first_src")
    out = out.withColumn("__src_low", F.lower(F.col("normalized_source")))
    return out.withColumn("lead_type", lead_type(df, F.col("__src_low"))).drop("__src_low")


def source_set(df: DataFrame, column: str = "normalized_source") -> DataFrame:
    """Distinct normalised sources excluding Unmapped (one column ``source``); the alias rules run on the column's
    distinct values only.  The one-element ``explode`` keeps the filter above them: moved below the distinct, it
    would run the rules, each with a cleaned text of its own, on every row."""
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    sources = with_normalized_source_value(values, F.col("v"), "s").select(F.explode(F.array("s")).alias("source"))
    return sources.where(F.col("source") != R.UNKNOWN_SOURCE).distinct()
