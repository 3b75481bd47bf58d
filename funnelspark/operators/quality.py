"""QA checks, pivot grids and reconciliation.

Each table is scanned once by a wide aggregate; check rows are produced with ``stack``.  Source
coverage is one aggregate over the distinct sources of three tables; the names are a table of their own
(``source_coverage``) and the check rows hold their number.  All pivot sheets are made from one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.classify import source_set
from ..functions.expr import clean_text
from ..functions.numbering import numbered

QA_COLUMNS = ["check", "status", "severity", "count", "details"]


def qa_status(count: Column, severity: str) -> Column:
    if severity == "Info":
        return F.lit("Info")
    return F.when(count == 0, F.lit("Pass")).otherwise(F.lit("Review"))


def missing_count(c: Column) -> Column:
    """Blank count: NULL or whitespace-only text."""
    return F.count_if(clean_text(c) == "")


def duplicate_count(df: DataFrame, c: Column, out: str) -> DataFrame:
    """One row: non-blank values minus distinct non-blank values, by counting per value first."""
    values = df.select(clean_text(c).alias("__v")).where(F.col("__v") != "").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    return values.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias(out))


def invalid_date_count(c: Column) -> Column:
    """Present but unparsable as a date."""
    text = clean_text(c)
    return F.count_if((text != "") & F.try_to_timestamp(text).isNull())


def _rows(agg: DataFrame, specs: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """specs: (check, severity, details_sql_or_literal, count column over ``agg``) -> check rows."""
    cols = []
    for i, (check, severity, details, count) in enumerate(specs):
        cols.append(F.struct(F.lit(i).alias("order"), F.lit(check).alias("check"), qa_status(count, severity).alias("status"),
                             F.lit(severity).alias("severity"), F.coalesce(count, F.lit(0)).cast("long").alias("count"),
                             (details if isinstance(details, Column) else F.lit(details)).alias("details")))
    return agg.select(F.explode(F.array(*cols)).alias("r")).select("r.*")


def source_coverage(leads: DataFrame, enr: DataFrame, allocations: DataFrame) -> DataFrame:
    """(check, source): every source of one table that another lacks, one row each, uncut.  The three sets
    meet in one aggregate per source, which says where it occurs."""
    sets = {"crm": source_set(leads), "budget": source_set(allocations, "source"),
            "tracker": source_set(enr)}
    tagged = None
    for name, sources in sets.items():
        part = sources.withColumn("t", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    found = tagged.groupBy("source").agg(*[F.bool_or(F.col("t") == name).alias(name) for name in sets])
    gap = lambda check, a, b: F.when(F.col(a) & ~F.col(b), F.lit(check))
    gaps = F.array_compact(F.array(gap("Budget source not found in HubSpot", "budget", "crm"), gap("HubSpot source not found in budget", "crm", "budget"),
                                   gap("Tracker source not found in budget", "tracker", "budget")))
    return found.select(F.explode(gaps).alias("check"), "source")


def _one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates side by side: each extra frame is one packed scalar subquery
    (evaluated once), materialised as plain columns of the first frame's row."""
    out = frames[0]
    for f in frames[1:]:
        packed = f.select(F.struct(*f.columns).alias("s")).scalar()
        out = out.select("*", *[packed.getField(c).alias(c) for c in f.columns])
    return out


def qa_checks(leads: DataFrame, enr: DataFrame, allocations: DataFrame, pivot_diffs: DataFrame | None,
              state: Mapping | None = None, now=None) -> DataFrame:
    """Up to 23 check rows (check, status, severity, count, details)."""
    state = dict(state or {})
    lead_agg = leads.agg(
        missing_count(F.col("email")).alias("m_email"), missing_count(F.col("contact_owner")).alias("m_owner"),
        missing_count(F.col("lead_status")).alias("m_status"), missing_count(F.col("lifecycle_stage")).alias("m_life"),
        missing_count(F.col("create_date")).alias("m_create"), missing_count(F.col("degree")).alias("m_degree"),
        F.count_if(F.coalesce(F.col("normalized_source"), F.lit(R.UNKNOWN_SOURCE)) == R.UNKNOWN_SOURCE).alias("m_lsource"),
        F.count_if(F.lower(clean_text(F.col("lifecycle_stage"))) == "enrolled").alias("crm_enrolled"))
    enr_agg = enr.agg(
        missing_count(F.col("term")).alias("m_term"), missing_count(F.col("enrolled_date")).alias("m_date"),
        missing_count(F.col("source")).alias("m_esource"), F.count_if(F.col("revenue").cast("string").try_cast("double").isNull()).alias("m_rev"),
        missing_count(F.col("payment_funding")).alias("m_pay"), invalid_date_count(F.col("enrolled_date_text")).alias("bad_date"),
        F.count_if(F.col("days_to_enroll").cast("double") < 0).alias("neg_days"), F.count(F.lit(1)).alias("actual"))
    n_of = lambda check: F.count_if(F.col("check") == check)
    gaps = source_coverage(leads, enr, allocations).agg(
        n_of("Budget source not found in HubSpot").alias("bh_n"), n_of("HubSpot source not found in budget").alias("hb_n"),
        n_of("Tracker source not found in budget").alias("tb_n"))
    frames = [lead_agg, enr_agg, gaps, duplicate_count(leads, F.col("record_id"), "dup_id"),
              duplicate_count(leads, F.lower(clean_text(F.col("email"))), "dup_email")]
    if pivot_diffs is not None:
        frames.append(pivot_diffs.agg(F.count_if(F.coalesce(F.col("difference").cast("double"), F.lit(0.0)) != 0).alias("pivot_n")))
    row = _one_row(*frames)
    c = F.col
    specs = [
        ("Duplicate Record IDs", "High", "", c("dup_id")), ("Duplicate emails", "Medium", "", c("dup_email")),
        ("Missing email", "Medium", "", c("m_email")), ("Missing contact owner/UDR", "High", "", c("m_owner")),
        ("Missing lead status", "Medium", "", c("m_status")), ("Missing lifecycle stage", "Medium", "", c("m_life")),
        ("Missing create date", "Medium", "", c("m_create")), ("Missing Degree/Program", "Low", "", c("m_degree")),
        ("Missing source", "High", "", c("m_lsource")),
        ("Missing enrollment term", "High", "", c("m_term")), ("Missing enrolled date", "High", "", c("m_date")),
        ("Missing source", "Medium", "Enrollment tracker source field.", c("m_esource")),
        ("Missing revenue", "Medium", "", c("m_rev")), ("Missing payment/funding", "Low", "", c("m_pay")),
        ("Invalid dates", "Medium", "", c("bad_date")), ("Negative days to enroll", "High", "", c("neg_days")),
        ("HubSpot CRM enrolled vs tracker actual enrolled mismatch", "Medium",
         F.concat(F.lit("CRM enrolled="), F.format_number(c("crm_enrolled"), 0), F.lit("; tracker actual="),
                  F.format_number(c("actual"), 0), F.lit(".")), F.abs(c("crm_enrolled") - c("actual"))),
        ("Budget source not found in HubSpot", "Medium", "", c("bh_n")),
        ("HubSpot source not found in budget", "Medium", "", c("hb_n")),
        ("Tracker source not found in budget", "Medium", "", c("tb_n")),
    ]
    if pivot_diffs is not None:
        specs.append(("Uploaded pivot totals vs recalculated raw totals", "Medium", "", c("pivot_n")))
    if state.get("error"):
        specs.append(("HubSpot API fetch failure", "High", str(state["error"]), F.lit(1)))
    elif not state.get("token_present"):
        specs.append(("HubSpot API fetch failure", "Info", "No token configured; static uploaded baseline is in use.", F.lit(1)))
    else:
        specs.append(("HubSpot API fetch failure", "High", "", F.lit(0)))
    fetched = state.get("fetched_at")
    if fetched and now:
        hours = (now - fetched).total_seconds() / 3600
        specs.append(("Stale data warning", "Medium", f"Last live refresh age: {hours:.1f} hours.", F.lit(int(hours > 24))))
    else:
        specs.append(("Stale data warning", "Info", "Live HubSpot data has not been refreshed in this session.", F.lit(1)))
    return _rows(row, specs).orderBy("order").drop("order")


# ---- pivot grids -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Pivot:
    """An uploaded pivot sheet: leads (all, or those of one type) counted by a grouping and a status column."""

    name: str
    group: str
    status: str
    lead_type: str | None = None


def _pivot_entries(leads: DataFrame, pivots: Sequence[Pivot]) -> DataFrame:
    """(sheet, has_id, raw, label, status): every lead once for each pivot it belongs to, from one scan."""
    blank = lambda c: F.when(clean_text(c) == "", F.lit("(blank)")).otherwise(clean_text(c))
    entries = []
    for p in pivots:
        group = F.col(p.group)
        entry = F.struct(F.lit(p.name).alias("sheet"), F.when(clean_text(group) == "", F.lit("Unmapped")).otherwise(group.cast("string")).alias("raw"),
                         blank(group).alias("label"), blank(F.col(p.status)).alias("status"))
        entries.append(entry if p.lead_type is None else F.when(F.col("lead_type") == p.lead_type, entry))
    has_id = (clean_text(F.col("record_id")) != "").alias("has_id")
    return leads.select(has_id, F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*", "has_id")


def pivot_counts(leads: DataFrame, pivots: Sequence[Pivot]) -> DataFrame:
    """(sheet, raw, label, status, n, with_id): leads per cell of every pivot; what the sheets and their check are made of."""
    return _pivot_entries(leads, pivots).groupBy("sheet", "raw", "label", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_id").alias("with_id"))


def pivot_cells(counts: DataFrame) -> DataFrame:
    """The pivot sheets as cells, recomputed from ``pivot_counts``: a title, 'Row Labels' x status with 'Grand Total', and
    a line per label; leads without a record id don't count.  Lines and columns are numbered range by range over
    all sheets together, so a sheet's have gaps."""
    n = counts.where(F.col("with_id") > 0).groupBy("sheet", "label", "status").agg(F.sum("with_id").alias("n"))
    statuses = numbered(n.select("sheet", "status").distinct(), ["sheet", "status"], "col")
    labels = numbered(n.select("sheet", "label").distinct(), ["sheet", "label"], "line").withColumn("row", F.col("line") + 2).drop("line")
    last = statuses.agg(F.max("col") + 1).scalar()
    sheets = n.select("sheet").distinct()
    cell = lambda df, row, col, value: df.select("sheet", row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))
    totals = n.groupBy("sheet", "label").agg(F.sum("n").alias("n")).join(labels, ["sheet", "label"])
    parts = [
        cell(sheets, F.lit(0), F.lit(0), F.concat("sheet", F.lit(" pivot"))), cell(sheets, F.lit(2), F.lit(0), F.lit("Row Labels")),
        cell(sheets, F.lit(2), last, F.lit("Grand Total")), cell(statuses, F.lit(2), F.col("col"), F.col("status")),
        cell(n.join(statuses, ["sheet", "status"]).join(labels, ["sheet", "label"]), F.col("row"), F.col("col"), F.col("n")),
        cell(totals, F.col("row"), F.lit(0), F.col("label")), cell(totals, F.col("row"), last, F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pivot_sheet_rows(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Header row = first row holding both 'row labels' and 'grand total'; rows below it with a
    non-blank label other than 'grand total' / '(blank)'.  ``columns`` are the header names to
    keep (read from the header row: metadata-sized, so ``pivot`` needs no distinct scan)."""
    c = cells.select("sheet", "row", "col", "value", F.lower(clean_text(F.col("value"), "collapse")).alias("t"))
    hdr = (c.groupBy("sheet", "row").agg(F.bool_or(F.col("t") == "row labels").alias("a"), F.bool_or(F.col("t") == "grand total").alias("b"))
           .where("a AND b").groupBy("sheet").agg(F.min("row").alias("hdr_row")))
    heads = (c.join(hdr, "sheet").where(F.col("row") == F.col("hdr_row"))
             .select("sheet", "col", F.regexp_replace(F.regexp_replace(F.col("t"), "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("name")))
    heads = heads.withColumn("name", F.when(F.col("name") == "row_labels", F.lit("row_label")).otherwise(F.col("name")))
    body = c.join(hdr, "sheet").where(F.col("row") > F.col("hdr_row")).join(heads, ["sheet", "col"])
    labels = body.where(F.col("name") == "row_label").select("sheet", "row", clean_text(F.col("value"), "collapse").alias("row_label"))
    labels = labels.where((F.col("row_label") != "") & ~F.lower(F.col("row_label")).isin("grand total", "(blank)"))
    vals = body.where(F.col("name") != "row_label").join(labels, ["sheet", "row"])
    wide = vals.groupBy("sheet", "row", "row_label").pivot("name", list(columns)).agg(F.first("value"))
    return wide.drop("row")


def _compared(raw: DataFrame, pivot: DataFrame) -> DataFrame:
    """(pivot_name, g, raw_total) full outer (pivot_name, p, pivot_total), and the difference."""
    j = raw.join(pivot.withColumnRenamed("pivot_name", "__name"), (F.col("pivot_name") == F.col("__name")) & (F.col("g") == F.col("p")), "full_outer")
    return j.select(F.coalesce("pivot_name", "__name").alias("pivot_name"), F.coalesce("g", "p", F.lit("Unmapped")).alias("group"),
                    F.coalesce("raw_total", F.lit(0.0)).alias("raw_total"), F.coalesce("pivot_total", F.lit(0.0)).alias("pivot_total")
                    ).withColumn("difference", F.col("raw_total") - F.col("pivot_total"))


def _pivot_totals(rows: DataFrame, name) -> DataFrame:
    return rows.select(name.alias("pivot_name"), F.col("row_label").alias("p"),
                       F.coalesce(F.col("grand_total").try_cast("double"), F.lit(0.0)).alias("pivot_total"))


def compare_pivot_totals(raw: DataFrame, pivot: DataFrame, group_col: str, pivot_name: str) -> DataFrame:
    """Raw row counts per group (blank -> Unmapped, merged) ⟗ pivot grand totals, difference."""
    lab = F.when(clean_text(F.col(group_col)) == "", F.lit("Unmapped")).otherwise(F.col(group_col).cast("string"))
    counts = raw.groupBy(lab.alias("g")).agg(F.count(F.lit(1)).cast("double").alias("raw_total")).withColumn("pivot_name", F.lit(pivot_name))
    return _compared(counts, _pivot_totals(pivot, F.lit(pivot_name)))


def pivot_reconciliation(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """``compare_pivot_totals`` for all pivots at once: ``pivot_counts`` against the parsed sheets (sheet, row_label, grand_total)."""
    raw = counts.groupBy(F.col("sheet").alias("pivot_name"), F.col("raw").alias("g")).agg(F.sum("n").cast("double").alias("raw_total"))
    return _compared(raw, _pivot_totals(rows, F.col("sheet")))
