"""Scalar column expressions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen.  Helpers that need to look at the schema (``col_or``) do so at plan time.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK_TOKENS = ["nan", "nat", "<na>", "none"]
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000
MICROS_PER_DAY = 86_400_000_000
EPOCH_MS_THRESHOLD = 10_000_000_000
WHITE_SPACE = " \t\n\x0b\f\r"


def col_or(df: DataFrame, name: str, default=None) -> Column:
    """The column if the frame has it, else a literal default (schema-level choice)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))  # no regular expression: every text of every row passes here


def as_text(c: Column) -> Column:
    return c.cast("string")


def clean_text(c: Column, flavour: str = "trim") -> Column:
    """T1 blank handling; returns '' for blanks (never NULL).

    ``trim``: NULL -> '' and strip.  ``na``: also nan/nat/<na>/none -> ''.
    ``collapse``: nbsp -> space, strip, collapse inner whitespace.
    """
    text = F.coalesce(as_text(c), F.lit(""))
    if flavour == "collapse":
        text = F.regexp_replace(F.translate(text, "\u00a0", " "), r"\s+", " ")
        return strip_ws(text)
    text = strip_ws(text)
    if flavour == "na":
        return F.when(F.lower(text).isin(BLANK_TOKENS), F.lit("")).otherwise(text)
    return text


def has_text(c: Column, flavour: str = "trim") -> Column:
    return clean_text(c, flavour) != F.lit("")


def clean_id(c: Column) -> Column:
    """Trim to text, blank -> NULL."""
    return F.nullif(strip_ws(as_text(c)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    """Original value where it has text, else NULL (keeps the untrimmed value)."""
    return F.when(has_text(c), c)


def as_bool(c: Column) -> Column:
    """NULL -> false; text in {true, 1, yes} (case-insensitive)."""
    return F.coalesce(F.lower(as_text(c)).isin("true", "1", "yes"), F.lit(False))


def to_number(c: Column, floor_zero: bool = False, fill=None) -> Column:
    value = as_text(c).try_cast("double") if not isinstance(c, (int, float)) else F.lit(float(c))
    if fill is not None:
        value = F.coalesce(value, F.lit(float(fill)))
    if floor_zero:
        value = F.greatest(value, F.lit(0.0))
    return value


def number_column(df: DataFrame, name: str, floor_zero: bool = False, fill=None) -> Column:
    """``to_number`` of a column; a double or whole number is taken as it is, not by way of its text."""
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.LongType, T.IntegerType)):
        return to_number(F.col(name), floor_zero, fill)
    value = F.col(name).cast("double")
    value = value if fill is None else F.coalesce(value, F.lit(float(fill)))
    return F.greatest(value, F.lit(0.0)) if floor_zero else value


def first_nonempty(*cols: Column) -> Column:
    """Left-to-right first value whose trimmed text is non-blank (original value kept)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def safe_div(n: Column, d: Column) -> Column:
    """0.0 when the denominator is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def ts_literal(value) -> Column:
    """A UTC timestamp literal from a datetime/date/str."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.to_timestamp(F.lit(text))


def elapsed_days_floor(start: Column, end: Column) -> Column:
    """Floor of elapsed 24 h units (T7); negative partial days floor to -1."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_DAY))).cast("long")


def elapsed_days_fractional(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_DAY))


def month_label(c: Column, unknown: str | None = None) -> Column:
    label = F.date_format(c, "yyyy-MM")
    return F.coalesce(label, F.lit(unknown)) if unknown is not None else label


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c)


def money(c: Column) -> Column:
    """D6: money is summed as decimal so totals do not depend on row order."""
    return F.coalesce(c.cast("double"), F.lit(0.0)).cast(T.DecimalType(28, 6))


def sum_money(c: Column) -> Column:
    return F.coalesce(F.sum(money(c)), F.lit(0).cast(T.DecimalType(38, 6))).cast("double")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """OR of literal substring tests on an already lower-cased text."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    out = text.contains(terms[0].lower())
    for term in terms[1:]:
        out = out | text.contains(term.lower())
    return out


def first_matching_term(text: Column, terms: Sequence[str], transform=None) -> Column:
    """The first term (in list order) that is a substring of ``text``; NULL if none."""
    out = None
    for term in terms:
        label = transform(term) if transform else term
        out = (F.when(text.contains(term), F.lit(label)) if out is None
               else out.when(text.contains(term), F.lit(label)))
    return out if out is not None else F.lit(None).cast("string")


# --------------------------------------------------------------------------------------------
# T2: whole-column epoch-millisecond detection without a driver action
# --------------------------------------------------------------------------------------------

def _is_timestamp(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _as_number(c: Column) -> Column:
    """The text as a number, else NULL.  Text with a colon is a time, never a number, and empty text is none; casting
    them would throw and catch an exception per row."""
    text = as_text(c)
    return F.when((text != "") & ~text.contains(":"), text.try_cast("double"))


def epoch_ms_switch(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Per-column T2 decision as scalar-subquery columns (evaluated once, one row).

    A column is read as epoch milliseconds when more than half of *all* rows are numeric and
    the median of the numeric values exceeds 1e10.  The median test is rewritten with
    distributive aggregates so no task ever holds a whole column:
    ``median > t  <=>  2*cnt_gt > n  or (2*cnt_gt == n and (min_gt + max_le)/2 > t)``.
    """
    if not names:
        return {}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, name in enumerate(names):
        num = _as_number(F.col(name))
        big = num > F.lit(float(EPOCH_MS_THRESHOLD))
        aggs += [
            F.count(num).alias(f"__c{i}"),
            F.count_if(big).alias(f"__g{i}"),
            F.min(F.when(big, num)).alias(f"__mg{i}"),
            F.max(F.when(~big, num)).alias(f"__ml{i}"),
        ]
    stats = df.agg(*aggs)
    decisions = []
    for i, _ in enumerate(names):
        n_num = F.col(f"__c{i}")
        gt = F.col(f"__g{i}")
        median_big = (gt * 2 > n_num) | (
            (gt * 2 == n_num) & ((F.col(f"__mg{i}") + F.col(f"__ml{i}")) / 2 > F.lit(float(EPOCH_MS_THRESHOLD))))
        decisions.append(F.coalesce((n_num * 2 > F.col("__n")) & median_big, F.lit(False)).alias(f"m{i}"))
    packed = stats.select(F.struct(*decisions).alias("flags")).scalar()
    return {name: packed.getField(f"m{i}") for i, name in enumerate(names)}


def with_parsed_datetimes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Parse several text/number columns into UTC timestamps in place (T2, D1)."""
    present = [n for n in names if n in df.columns]
    typed = [n for n in present if _is_timestamp(df, n)]
    todo = [n for n in present if n not in typed]
    out = {n: F.col(n).cast("timestamp") for n in typed}
    switches = epoch_ms_switch(df, todo)
    if todo:
        # Bind the one-row decision once as a column so the scalar subquery is planned (and
        # executed) once, not once per parsed column.
        df = df.withColumn("__t2", F.struct(*[switches[n].alias(f"m{i}") for i, n in enumerate(todo)]))
    for i, name in enumerate(todo):
        num = _as_number(F.col(name))
        as_ms = F.timestamp_micros((num * F.lit(1000.0)).cast("long"))
        out[name] = F.when(F.col(f"__t2.m{i}"), as_ms).otherwise(parse_datetime_text(F.col(name)))
    return (df.withColumns(out).drop("__t2") if todo else df.withColumns(out)) if out else df


def parse_datetime_text(c: Column) -> Column:
    """Row-level lenient parse for text that is never epoch milliseconds."""
    return F.try_to_timestamp(strip_ws(as_text(c)))


def avg_exact(c: Column) -> Column:
    """Mean via an exact decimal sum (row-order independent); NULL when there are no values."""
    return (F.sum(c.cast("double").cast(T.DecimalType(28, 9))).cast("double") / F.count(c))


def mode_by_group(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value (D2).  Two partial
    aggregations: (keys, value) counts, then the arg-max per group."""
    counted = df.groupBy(*keys, value.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("__c")).alias("n"), F.col("__v").alias("v"))).getField("v").alias(out))
