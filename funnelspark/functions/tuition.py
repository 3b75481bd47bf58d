"""Degree level, tuition lookup and program revenue fields.

The fixed tuition table has five rows, so its lookup is folded into ``CASE`` expressions (no join,
nothing to broadcast).  Rules that are a table of their own (``tuition_table``, ``refreshed_tuition``, or landed
overrides) are joined on the level; programs are matched to levels first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as R
from .expr import as_text, as_bool, contains_any, number_column, strip_ws

TUITION_FIELDS = [
    "degree_level", "program_degree_level", "tuition_per_credit", "credits_required",
    "estimated_total_tuition", "estimated_annual_tuition", "program_duration_years",
    "program_duration_months", "duration_note", "tuition_estimate_source", "revenue_confidence",
]
REVENUE_WINDOWS = [("six_month_revenue", 6), ("twelve_month_revenue", 12), ("twenty_four_month_revenue", 24)]
POTENTIAL_WINDOWS = [
    ("potential_six_month_revenue", 6), ("potential_twelve_month_revenue", 12),
    ("potential_twenty_four_month_revenue", 24),
]


NO_LEVEL_NOTE, NO_LEVEL_SOURCE, NO_LEVEL_CONFIDENCE = "Program missing or not matched to a configured degree level.", "unmatched_program", "Low"


def degree_level(program: Column) -> Column:
    """Ordered substring rules (T8); NULL when blank or unmatched."""
    return _level_of(_level_text(program))


def _level_text(program: Column) -> Column:
    return F.lower(strip_ws(as_text(program)))


def _level_of(text: Column) -> Column:
    """The rules over ``_level_text``, which they read many times: a column that is staged first."""
    master = contains_any(text, ["master", "mba", "mscis", "msai", "ms "]) | text.startswith("ms")
    return (
        F.when(text.isNull() | (text == "") | text.isin("nan", "nat", "<na>", "none"), F.lit(None))
        .when(text.contains("certificate"), "Certificate")
        .when(text.contains("associate"), "Associate")
        .when(contains_any(text, ["bachelor", "bsba", "bsbt"]), "Bachelor")
        .when(master, "Master")
        .when(contains_any(text, ["doctoral", "doctorate", "doctor", "dba"]), "Doctoral")
        .otherwise(F.lit(None)).cast("string")
    )


TUITION_FIELDS = ["tuition_per_credit", "credits_required", "estimated_total_tuition", "estimated_annual_tuition",
                  "duration_years", "duration_months", "note"]


def tuition_rows(overrides: Mapping | None = None) -> dict[str, dict]:
    """The fixed tuition table with overrides per level merged in (keys that start with '_' are comments)."""
    rows = {r[0]: dict(zip(TUITION_FIELDS, r[1:], strict=True)) for r in R.DEGREE_TUITION}
    for level, values in (overrides or {}).items():
        if not str(level).startswith("_") and isinstance(values, Mapping):
            rows[level] = {**rows.get(level, {}), **values}
    return rows


def _lookup(level: Column, field: str, rows: Mapping[str, Mapping]) -> Column:
    """A level's value as a folded CASE; levels without the field have NULL."""
    cast = "string" if field == "note" else "double"
    out = F.when(F.lit(False), F.lit(None).cast(cast))
    for name, values in rows.items():
        out = out.when(level == name, F.lit(values.get(field)).cast(cast))
    return out


def _with_level_values(df: DataFrame, config: Mapping | DataFrame | None) -> DataFrame:
    """A struct column ``__tuition`` with the values of the row's ``__level``: joined from a rules table, else folded."""
    if isinstance(config, DataFrame):
        note = F.coalesce(F.col("note"), F.lit(""))
        rules = config.select(F.col("program_degree_level").alias("__rule"), F.struct(*[(note if f == "note" else F.col(f).cast("double")).alias(f) for f in TUITION_FIELDS]).alias("__tuition"))
        return df.join(rules, F.col("__level") == F.col("__rule"), "left").drop("__rule")
    rows = tuition_rows(config)
    return df.withColumn("__tuition", F.struct(*[_lookup(F.col("__level"), f, rows).alias(f) for f in TUITION_FIELDS]))


def add_program_tuition_fields(df: DataFrame, program_col: str = "program", degree_col: str = "degree_level",
                               config: Mapping | DataFrame | None = None) -> DataFrame:
    """Adds the 11 tuition columns; an explicit level is honoured only when revenue_confidence is
    absent or 'High' (second pass on the fact).  ``config`` overrides the fixed table: a mapping per level, or
    a table of rules, one row per level, that takes its place.  Intermediate texts are staged as columns so the
    ordered rules are evaluated once per row, not once per looked-up field."""
    program = F.col(program_col) if program_col in df.columns else F.lit(None).cast("string")
    explicit = F.col(degree_col) if degree_col in df.columns else F.lit(None).cast("string")
    if "revenue_confidence" in df.columns:
        explicit = F.when(F.coalesce(as_text(F.col("revenue_confidence")), F.lit("")) == "High", explicit)
    out = df.withColumns({"__ex_txt": _level_text(explicit), "__pg_txt": _level_text(program)})
    out = out.withColumns({"__explicit": _level_of(F.col("__ex_txt")), "__inferred": _level_of(F.col("__pg_txt"))})
    out = out.withColumn("__level", F.coalesce(F.col("__explicit"), F.col("__inferred")))
    level = F.col("__level")
    out = _with_level_values(out, config)
    matched = level.isNotNull()
    confidence = F.when(F.col("__explicit").isNotNull(), "High").when(F.col("__inferred").isNotNull(), "Medium").otherwise(NO_LEVEL_CONFIDENCE)
    out = out.withColumns({
        "degree_level": level,
        "program_degree_level": level,
        "tuition_per_credit": F.col("__tuition.tuition_per_credit"),
        "credits_required": F.col("__tuition.credits_required"),
        "estimated_total_tuition": F.col("__tuition.estimated_total_tuition"),
        "estimated_annual_tuition": F.col("__tuition.estimated_annual_tuition"),
        "program_duration_years": F.col("__tuition.duration_years"),
        "program_duration_months": F.col("__tuition.duration_months"),
        "duration_note": F.when(matched, F.coalesce(F.col("__tuition.note"), F.lit("")))
        .otherwise(NO_LEVEL_NOTE),
        "tuition_estimate_source": F.when(matched, F.lit(R.TUITION_SOURCE_LABEL)).otherwise(NO_LEVEL_SOURCE),
        "revenue_confidence": confidence,
    })
    return out.drop("__ex_txt", "__pg_txt", "__explicit", "__inferred", "__level", "__tuition")


def _per(total: Column, divisor: Column) -> Column:
    return F.when(divisor > 0, total / divisor).otherwise(F.lit(0.0))


def _window(monthly: Column, total: Column, months: int) -> Column:
    # T4: coalesce before least(); monthly is 0 when the duration is unknown.
    return F.least(F.coalesce(monthly, F.lit(0.0)) * F.lit(float(months)), total)


def _flag(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col(name), F.lit(False)) if df.schema[name].dataType.typeName() == "boolean" else as_bool(F.col(name))


def enrolled_mask(df: DataFrame) -> Column:
    """Enrollment status that means enrolled; a staged ``__enrolled`` stands for it."""
    if "__enrolled" in df.columns:
        return F.coalesce(F.col("__enrolled"), F.lit(False))
    status = F.lower(F.coalesce(as_text(F.col("enrollment_status")), F.lit(""))) if "enrollment_status" in df.columns else F.lit("")
    return status.rlike(R.REVENUE_ENROLLED_PATTERN)


def revenue_status_masks(df: DataFrame):
    """(enrolled_or_won, is_lost, open_pipeline) per T5."""
    stage = F.lower(F.coalesce(as_text(F.col("deal_stage")), F.lit(""))) if "deal_stage" in df.columns else F.lit("")
    is_won = _flag(df, "is_won")
    is_lost = _flag(df, "is_lost") | stage.rlike(R.REVENUE_LOST_PATTERN)
    enrolled_or_won = enrolled_mask(df) | is_won | stage.contains("won")
    open_pipeline = ~enrolled_or_won & ~is_lost
    return enrolled_or_won, is_lost, open_pipeline


def _fmt_g(c: Column) -> Column:
    """Python ``:g`` for the whole-number durations used here (24 not 24.0) (T15)."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def revenue_note(df: DataFrame) -> Column:
    level = F.col("program_degree_level")
    months = _fmt_g(F.col("program_duration_months"))
    note = strip_ws(F.coalesce(F.col("duration_note"), F.lit("")))
    src = strip_ws(F.coalesce(F.col("program_revenue_source"), F.lit(""))) if "program_revenue_source" in df.columns else F.lit("")
    source_text = (F.when(src == R.TUITION_SOURCE_LABEL, "published tuition")
                   .when(src == "contact_program_total_tuition", "HubSpot contact tuition")
                   .when(src == "deal_revenue", "HubSpot deal revenue")
                   .otherwise("available tuition/revenue"))
    suffix = F.when(note != "", F.concat(F.lit("; "), note, F.lit("."))).otherwise(F.lit("."))
    return (
        F.when(level.isNull() | (level == ""), F.lit("Program duration could not be matched; update config/degree_tuition.json."))
        .when(F.coalesce(F.col("total_program_revenue"), F.lit(0.0)) <= 0, F.concat(
            level, F.lit(" potential tuition is based on published rates over "), months,
            F.lit(" months; realized revenue is not counted until a deal is won/countable.")))
        .otherwise(F.concat(level, F.lit(" revenue uses "), source_text, F.lit(" over "), months, F.lit(" months"), suffix))
    )


def add_program_revenue_fields(df: DataFrame, total_col: str = "revenue_attributed", program_col: str = "program",
                               config: Mapping | DataFrame | None = None) -> DataFrame:
    """Tuition fields, potential windows, realised windows, pipeline revenue, note (T4, T5)."""
    out = add_potential_fields(add_program_tuition_fields(df, program_col, config=config))
    return add_realized_fields(out, total_col)


def add_potential_fields(df: DataFrame) -> DataFrame:
    """What a program may bring, from its tuition fields alone."""
    out = df.withColumn("potential_program_revenue", number_column(df, "estimated_total_tuition", floor_zero=True, fill=0))
    potential = F.col("potential_program_revenue")
    out = out.withColumns({
        "potential_annualized_program_revenue": _per(potential, F.col("program_duration_years")),
        "potential_monthly_program_revenue": _per(potential, F.col("program_duration_months")),
    })
    return out.withColumns({name: _window(F.col("potential_monthly_program_revenue"), potential, m) for name, m in POTENTIAL_WINDOWS})


#: What ``add_program_tuition_fields`` and ``add_potential_fields`` give to a row without a program; all others are NULL.
NO_PROGRAM = {
    "duration_note": NO_LEVEL_NOTE, "tuition_estimate_source": NO_LEVEL_SOURCE, "revenue_confidence": NO_LEVEL_CONFIDENCE,
    "potential_program_revenue": 0.0, "potential_annualized_program_revenue": 0.0, "potential_monthly_program_revenue": 0.0,
    **{name: 0.0 for name, _ in POTENTIAL_WINDOWS},
}


REALIZED_FIELDS = ["total_program_revenue", "annualized_program_revenue", "monthly_program_revenue", *[name for name, _ in REVENUE_WINDOWS],
                   "potential_revenue", "enrolled_revenue", "open_pipeline_potential_revenue", "revenue_realization_note"]


def add_realized_fields(df: DataFrame, total_col: str) -> DataFrame:
    """Realised windows of a total, pipeline revenue and note, on rows that have the tuition and potential fields."""
    total = number_column(df, total_col, floor_zero=True, fill=0) if total_col in df.columns else F.lit(0.0)
    out = df.withColumn("total_program_revenue", total)
    out = out.withColumns({
        "annualized_program_revenue": _per(F.col("total_program_revenue"), F.col("program_duration_years")),
        "monthly_program_revenue": _per(F.col("total_program_revenue"), F.col("program_duration_months")),
    })
    enrolled_or_won, _, open_pipeline = revenue_status_masks(out)
    pot = F.col("potential_program_revenue")
    return out.withColumns({
        **{name: _window(F.col("monthly_program_revenue"), F.col("total_program_revenue"), m) for name, m in REVENUE_WINDOWS},
        "potential_revenue": F.when(open_pipeline, pot).otherwise(F.lit(0.0)),
        "enrolled_revenue": F.when(enrolled_or_won, pot).otherwise(F.lit(0.0)),
        "open_pipeline_potential_revenue": F.when(open_pipeline, pot).otherwise(F.lit(0.0)),
        "revenue_realization_note": revenue_note(out),
    })


def tuition_table(spark: SparkSession, overrides: Mapping | None = None) -> DataFrame:
    """``tuition_rows`` as a table, one row per level."""
    rows = tuition_rows(overrides)
    data = [(level, *[None if v.get(c) is None else str(v[c]) if c == "note" else float(v[c]) for c in TUITION_FIELDS]) for level, v in rows.items()]
    return spark.createDataFrame(data, "program_degree_level string, " + ", ".join(
        f"{c} {'string' if c == 'note' else 'double'}" for c in TUITION_FIELDS))


PRICE_FIELDS = ["tuition_per_credit", "credits_required", "estimated_total_tuition", "estimated_annual_tuition"]


def overridden(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rules`` with landed overrides (program_degree_level, any of the fields) merged in, field by field: a value
    that an override has replaces the rule's, its nulls leave it, and levels without a rule are added.  Comment
    rows (levels that start with '_') and rows without a level are left out; of several overrides of a level the
    newest by ``refreshed_at`` counts for each field, where they have that column, then the larger value."""
    has = [f for f in TUITION_FIELDS if f in overrides.columns]
    if not has:
        return rules.select("program_degree_level", *TUITION_FIELDS)
    when = F.col("refreshed_at") if "refreshed_at" in overrides.columns else F.lit(0)
    fresh = overrides.where(F.col("program_degree_level").isNotNull() & ~F.col("program_degree_level").startswith("_"))
    fresh = fresh.groupBy("program_degree_level").agg(*[
        F.max(F.when(F.col(f).isNotNull(), F.struct(when.alias("w"), F.col(f).alias("v"))))["v"].alias(f"__o_{f}") for f in has])
    out = rules.join(fresh, "program_degree_level", "full_outer")
    return out.select("program_degree_level", *[F.coalesce(F.col(f"__o_{f}").cast("string" if f == "note" else "double"), F.col(f)).alias(f) if f in has else F.col(f)
                                                for f in TUITION_FIELDS])


def refreshed_tuition(rules: DataFrame, prices: DataFrame, key: str = "page_id") -> DataFrame:
    """``rules`` with the prices of ``extract_price_table``: per level those of its newest page, all four from one page."""
    newest = prices.groupBy("program_degree_level").agg(F.max_by(F.struct(*PRICE_FIELDS), F.struct(key, *PRICE_FIELDS)).alias("p"))
    return overridden(rules, newest.select("program_degree_level", "p.*"))
