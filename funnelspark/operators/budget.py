"""Budget grids, term codes and UDR / budget performance.

Spreadsheet grids enter as a cells table ``(sheet, row, col, value)`` of any number of sheets.  Cells are
grouped into lines once; header row, total column, term columns and stop row are one row per sheet,
joined to its lines, so a workbook is parsed in one pass, never by iterating rows on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.classify import with_normalized_source_value
from ..functions.expr import avg_exact, clean_text, elapsed_days_floor, money, safe_div, strip_ws, sum_money, ts_literal
from ..session import cut_lineage

SPECIAL_LABELS = [("total", "Total"), ("starts", "Starts"), ("start%", "Start%")]
SUMMARY_METRICS = ["budget", "enrolled", "starts", "start%"]


def _season_label(code: Column) -> Column:
    out = None
    for c, label in R.SEASON_LABELS:
        out = F.when(code == c, F.lit(label)) if out is None else out.when(code == c, F.lit(label))
    return out


def with_display_term_label(df: DataFrame, src: str, out: str) -> DataFrame:
    """'SP2', 'Spring 2', 'SP2-G' -> 'Spring 2'; anything else -> the cleaned text."""
    df = with_term_token(df, src, "__dl")
    season, number = F.substring("__dl", 1, 2), F.substring("__dl", 3, 1)
    named = F.concat(_season_label(season), F.lit(" "), number)
    return df.withColumn(out, F.when(F.col("__dl").rlike("^(SP|SU|FA)[12]$"), named).otherwise(clean_text(F.col(src), "collapse"))).drop("__dl")


def with_term_header(df: DataFrame, src: str, out: str) -> DataFrame:
    """'SP2-G', 'SP-1 A', 'SU2 -A' -> struct(raw_term, term, term_label, term_metric); NULL if not a term.
    Staged as columns, which keeps the plan small when it is reused."""
    p = f"__th_{out}_"
    df = df.withColumn(p + "text", clean_text(F.col(src), "collapse"))
    df = df.withColumn(p + "cmp", F.translate(F.regexp_replace(F.upper(F.col(p + "text")), "[\\s_\u00a0]+", ""),
                                              "\u2013\u2014", "--"))
    df = df.withColumns({p + str(i): F.regexp_extract(F.col(p + "cmp"), R.TERM_HEADER_PATTERN, i) for i in (1, 2, 3)})
    season, number, suffix = F.col(p + "1"), F.col(p + "2"), F.col(p + "3")
    metric = F.when(suffix == "G", "goal").when(suffix == "A", "actual").otherwise("term")
    df = df.withColumn(out, F.when((F.col(p + "text") != "") & F.col(p + "cmp").rlike(R.TERM_HEADER_PATTERN), F.struct(
        F.col(p + "text").alias("raw_term"), F.concat(season, number).alias("term"),
        F.concat(_season_label(season), F.lit(" "), number).alias("term_label"), metric.alias("term_metric"))))
    return df.drop(*[p + x for x in ("text", "cmp", "1", "2", "3")])


def with_term_token(df: DataFrame, src: str, out: str) -> DataFrame:
    """Header form, 'SP2', or 'Spring 2' -> 'SP2'; blank -> ''; anything else -> the cleaned text."""
    p = f"__tt_{out}_"
    df = with_term_header(df, src, p + "hdr")
    df = df.withColumn(p + "text", clean_text(F.col(src), "collapse"))
    df = df.withColumns({
        p + "direct": F.regexp_extract(F.translate(F.regexp_replace(F.upper(F.col(p + "text")), "[\\s_\u00a0-]+", ""),
                                                   "\u2013\u2014", ""), R.TERM_CODE_PATTERN, 0),
        p + "words": strip_ws(F.regexp_replace(F.upper(F.col(p + "text")), "[^A-Z0-9]+", " ")),
    })
    df = df.withColumns({p + "ns": F.regexp_extract(F.col(p + "words"), R.TERM_NAME_PATTERN, 1),
                         p + "nn": F.regexp_extract(F.col(p + "words"), R.TERM_NAME_PATTERN, 2)})
    code = None
    for c_, label in R.SEASON_LABELS:
        cond = F.col(p + "ns") == label.upper()
        code = F.when(cond, F.lit(c_)) if code is None else code.when(cond, F.lit(c_))
    df = df.withColumn(out, F.when(F.col(p + "text") == "", F.lit("")).when(F.col(p + "hdr").isNotNull(), F.col(p + "hdr.term"))
                       .when(F.col(p + "direct") != "", F.col(p + "direct"))
                       .when(F.col(p + "ns") != "", F.concat(code, F.col(p + "nn"))).otherwise(F.col(p + "text")))
    return df.drop(*[p + x for x in ("hdr", "text", "direct", "words", "ns", "nn")])


def _cells(cells: DataFrame) -> DataFrame:
    return cells.select("sheet", "row", "col", "value", clean_text(F.col("value"), "collapse").alias("text"))


def budget_summary_rows(cells: DataFrame) -> DataFrame:
    """Rows whose 2nd column is Budget / Enrolled / Starts / Start%; value from the 3rd column."""
    c = _cells(cells)
    metric = c.where((F.col("col") == 1) & F.lower(F.col("text")).isin(SUMMARY_METRICS)).select(
        "sheet", "row", F.col("text").alias("metric"))
    value = c.where(F.col("col") == 2).select("sheet", "row", F.col("value").alias("value"))
    return (metric.join(value, ["sheet", "row"], "left")
            .select("sheet", F.col("row").alias("_seq"), "metric", "value",
                    F.col("value").try_cast("double").alias("numeric_value")))


def roundup_value(summary: DataFrame, metric: str) -> Column:
    """First (by sheet and row) numeric value of a named metric, case-insensitive; a scalar subquery."""
    hit = summary.where(F.lower(clean_text(F.col("metric"))) == metric.lower())
    return hit.agg(F.min_by("numeric_value", F.struct("sheet", "_seq"))).scalar()


def _cell(of: str, col: Column, field: str) -> Column:
    """A field of the cell in column ``col`` of the row's cells; null if there is none."""
    return F.get(F.filter(of, lambda x: x["col"] == col), 0)[field]


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One row per line of every sheet below its header: sheet, row, label, total, stop_row, values.

    A sheet's header is its first row with a 'budget' cell, the total column that row's last one, and names stand
    left of it; sheets may have them anywhere.  ``values`` holds the term columns to the right: col, raw_term,
    term, term_label, term_metric, value.  ``stop_row`` is the first 'Start%' line, and lines behind it are left
    out.  Cells are brought together by line once (a line is as wide as a sheet); what is known of a sheet is
    one row, joined to its lines.
    """
    c = _cells(cells)
    lines = c.groupBy("sheet", "row").agg(F.collect_list(F.struct("col", "value", "text")).alias("cells"))
    budget_cols = F.transform(F.filter("cells", lambda x: F.lower(x["text"]) == "budget"), lambda x: x["col"])
    heads = lines.withColumn("total_col", F.array_max(budget_cols)).where(F.col("total_col").isNotNull())
    heads = heads.groupBy("sheet").agg(F.min_by(F.struct("row", "total_col", "cells"), "row").alias("h"))
    heads = heads.select("sheet", F.col("h.row").alias("hdr_row"), F.col("h.total_col").alias("total_col"), F.col("h.cells").alias("cells"))
    heads = heads.where(F.col("total_col") > 0)
    names = heads.select("sheet", "total_col", F.explode("cells").alias("x")).where(F.col("x.col") > F.col("total_col")).select(
        "sheet", F.col("x.col").alias("col"), F.col("x.value").alias("value"))
    terms = with_term_header(names, "value", "meta").where(F.col("meta").isNotNull() & F.col("meta.term_metric").isin("actual", "goal"))
    terms = terms.groupBy("sheet").agg(F.collect_list(F.struct("col", "meta")).alias("terms"))  # as many as the sheet has columns
    heads = heads.drop("cells").join(terms, "sheet", "left")
    below = lines.join(heads, "sheet").where(F.col("row") > F.col("hdr_row"))
    value = lambda h: F.struct(h["col"].alias("col"), h["meta"]["raw_term"].alias("raw_term"), h["meta"]["term"].alias("term"),
                               h["meta"]["term_label"].alias("term_label"), h["meta"]["term_metric"].alias("term_metric"),
                               _cell("cells", h["col"], "value").try_cast("double").alias("value"))
    below = below.select("sheet", "row", _cell("cells", F.col("total_col") - 1, "text").alias("label"),
                         _cell("cells", F.col("total_col"), "value").try_cast("double").alias("total"),
                         F.coalesce(F.transform("terms", value), F.array()).alias("values")).where(F.col("label").isNotNull())
    stop = below.where(F.lower("label") == "start%").groupBy("sheet").agg(F.min("row").alias("stop_row"))
    return below.join(stop, "sheet", "left").where(F.col("stop_row").isNull() | (F.col("row") <= F.col("stop_row")))


def _special(low: Column) -> Column:
    return low.isin(*[k for k, _ in SPECIAL_LABELS])


def _term_rows(rows: DataFrame, dimension: str) -> DataFrame:
    low = F.lower(F.col("label"))
    special = _special(low)
    known = F.filter("values", lambda v: v["value"].isNotNull())
    goals = F.filter(known, lambda v: v["term_metric"] == "goal")
    rows = rows.where(special | (F.col("label") != "")).withColumn("known", known)
    rows = rows.withColumn("goals", F.aggregate(goals, F.lit(0.0), lambda acc, v: acc + v["value"]))
    rows = with_normalized_source_value(rows, F.col("label"), "__norm")
    special_name = None
    for k, v in SPECIAL_LABELS:
        special_name = F.when(low == k, F.lit(v)) if special_name is None else special_name.when(low == k, F.lit(v))
    metric = F.when(low == "starts", F.lit("starts")).when(low == "start%", F.lit("start_rate")).otherwise(F.col("v.term_metric"))
    planned = F.coalesce(F.col("total"), F.when(special, F.lit(0.0)).otherwise(F.col("goals")))
    return rows.withColumn("v", F.explode("known")).select(
        "sheet",
        F.when(special, F.lit("roundup_metric")).otherwise(F.lit(dimension)).alias("budget_dimension"),
        F.when(special, special_name).otherwise(F.col("label")).alias("budget_name"),
        F.when(special, special_name).otherwise(F.col("__norm")).alias("source"),
        "v.raw_term", "v.term", "v.term_label", metric.alias("term_metric"),
        F.col("v.value").alias("term_value"), F.col("v.value").alias("term_budget"), planned.alias("planned_budget"),
        F.col("row").alias("_row"), F.col("v.col").alias("_col"))


def _allocation_rows(rows: DataFrame, dimension: str) -> DataFrame:
    keep = (F.col("label") != "") & ~_special(F.lower(F.col("label"))) & F.col("total").isNotNull() & \
        (F.col("stop_row").isNull() | (F.col("row") < F.col("stop_row")))
    rows = with_normalized_source_value(rows.where(keep), F.col("label"), "__norm")
    norm = F.col("__norm")
    return rows.select("sheet", F.lit(dimension).alias("budget_dimension"), F.col("label").alias("budget_name"),
                       norm.alias("normalized_budget_name"), norm.alias("source"), F.col("total").alias("planned_budget"),
                       F.lit("goal").alias("budget_metric"), F.col("row").alias("_row"))


def _roundup_rows(rows: DataFrame) -> DataFrame:
    terms = _term_rows(rows, "UDR").withColumn("source", F.col("budget_name"))
    totals = _allocation_rows(rows, "UDR").select(
        "sheet", "budget_dimension", "budget_name", F.col("budget_name").alias("source"), F.lit(None).cast("string").alias("raw_term"),
        F.lit("Total").alias("term"), F.lit("Total").alias("term_label"), F.lit("total").alias("term_metric"),
        F.col("planned_budget").alias("term_value"), F.col("planned_budget").alias("term_budget"), "planned_budget",
        "_row", F.lit(None).cast("int").alias("_col"))
    return terms.unionByName(totals)


def budget_term_allocations(cells: DataFrame, dimension: str = "UDR allocation") -> DataFrame:
    """Term columns unpivoted to (name, raw_term, term, label, metric, value, planned); the Total /
    Starts / Start% rows become roundup metrics; rows after Start% are ignored."""
    return _term_rows(sheet_rows(cells), dimension)


def budget_allocations(cells: DataFrame, dimension: str = "UDR allocation") -> DataFrame:
    """One row per named line (not Total/Starts/Start%) that has a total in the total column."""
    return _allocation_rows(sheet_rows(cells), dimension)


def roundup_allocations(cells: DataFrame) -> DataFrame:
    """The tracker's roundup sheet: the term rows of ``budget_term_allocations`` under the dimension 'UDR',
    with labels as they stand, and one row per named line for its total."""
    return _roundup_rows(sheet_rows(cells))


def budget_tables(cells: DataFrame, dimension: str = "UDR allocation") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Allocations, term allocations and roundup rows of one workbook, whose lines are read once."""
    rows = cut_lineage(sheet_rows(cells))
    return _allocation_rows(rows, dimension), _term_rows(rows, dimension), _roundup_rows(rows)


def udr_key(c: Column) -> Column:
    """'udr NN' (lower) when the text is 'UDR <digits>', else the first word lower-cased."""
    text = strip_ws(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    first = F.get(F.split(F.lower(text), " "), 0)
    return F.when(text == "", F.lit("")).when(text.rlike(r"(?i)^UDR\s+\d+$"), F.lower(text)).otherwise(first)


def _tokens(selected: Sequence[str] | None) -> list[str]:
    """Plan-time normalisation of user-selected term labels (parameters, not data), as ``with_term_token``
    does for data: a season code, or the label itself; blank labels are none."""
    seasons = {label.upper(): code for code, label in R.SEASON_LABELS}
    out = set()
    for label in selected or []:
        text = " ".join(str(label).replace("\u00a0", " ").split())
        compact = re.sub(r"[\s_]+", "", text.upper()).translate({0x2013: "-", 0x2014: "-"})
        code = re.match(R.TERM_HEADER_PATTERN, compact) or re.match(R.TERM_CODE_PATTERN, compact.replace("-", ""))
        named = re.match(R.TERM_NAME_PATTERN, re.sub(r"[^A-Z0-9]+", " ", text.upper()).strip())
        if code:
            out.add(code[1] + code[2])
        elif named:
            out.add(seasons[named[1]] + named[2])
        elif text:
            out.add(text)
    return sorted(out)


def udr_budget_summary(terms: DataFrame, allocations: DataFrame, selected: Sequence[str] | None = None,
                       enr: DataFrame | None = None) -> DataFrame:
    """Annual goals (only with no term in force) ⟗ term actual/goal pivot; per UDR key sums,
    remaining >= 0, % of goal (T21).  With ``enr`` the ledger's only term is in force if none is selected."""
    tokens = _tokens(selected)
    names_low = F.lower(clean_text(F.col("budget_name")))
    t = with_term_token(terms.where(~names_low.isin("total", "starts", "start%")), "term", "__tok")
    if tokens:
        t = t.where(F.col("__tok").isin(tokens))
        any_term = F.lit(True)
    elif enr is not None:
        one = only_term(enr)
        t, any_term = t.where(one.isNull() | (F.col("__tok") == one)), one.isNotNull()
    else:
        any_term = F.lit(False)
    metric = F.lower(F.coalesce(F.col("term_metric"), F.lit("")))
    value = F.coalesce(F.col("term_value").cast("double"), F.lit(0.0))
    by_metric = (t.where(metric.isin("actual", "goal")).groupBy("budget_name")
                 .agg(sum_money(F.when(metric == "actual", value)).alias("budget_sheet_actual"),
                      sum_money(F.when(metric == "goal", value)).alias("term_goal")))
    annual = allocations.groupBy("budget_name").agg(sum_money(F.col("planned_budget")).alias("annual_goal"))
    merged = annual.where(~any_term).join(by_metric, "budget_name", "full_outer")
    merged = merged.withColumns({"budget_goal": F.coalesce(F.when(any_term, F.col("term_goal")).otherwise(F.col("annual_goal")), F.lit(0.0)),
                                 "budget_sheet_actual": F.coalesce(F.col("budget_sheet_actual"), F.lit(0.0))})
    merged = merged.withColumns({"budget_udr": clean_text(F.col("budget_name")), "_udr_key": udr_key(F.col("budget_name"))})
    g = merged.groupBy("_udr_key").agg(F.min("budget_udr").alias("budget_udr"),
                                        sum_money(F.col("budget_goal")).alias("budget_goal"),
                                        sum_money(F.col("budget_sheet_actual")).alias("budget_sheet_actual"))
    return g.withColumns({
        "budget_remaining": F.greatest(F.col("budget_goal") - F.col("budget_sheet_actual"), F.lit(0.0)),
        "budget_pct_goal": safe_div(F.col("budget_sheet_actual"), F.col("budget_goal")),
    })


def term_stats(terms: DataFrame, chosen: Callable[[Column], Column]) -> DataFrame:
    """goal / actual / starts / start_rate over the rows whose term token is ``chosen``, falling back from
    the Total row to the sum of named rows (T22).  One row; NULL where a statistic is unknown."""
    t = with_term_token(terms, "term", "__tok")
    t = t.where(chosen(F.col("__tok")))
    names = F.lower(clean_text(F.col("budget_name")))
    metric = F.lower(F.coalesce(F.col("term_metric"), F.lit("")))
    v = F.col("term_value").cast("double")
    named = ~names.isin("total", "starts", "start%")

    def s(cond: Column) -> Column:
        return F.when(F.count(F.when(cond, v)) > 0, F.sum(F.when(cond, v)))

    a = t.agg(s((names == "total") & (metric == "goal")).alias("__g_total"), s((names == "total") & (metric == "actual")).alias("__a_total"),
              s(metric == "starts").alias("starts"), s(named & (metric == "goal")).alias("__g_named"),
              s(named & (metric == "actual")).alias("__a_named"), F.avg(F.when(metric == "start_rate", v)).alias("__rate"))
    goal = F.coalesce(F.col("__g_total"), F.col("__g_named"))
    actual = F.coalesce(F.col("__a_total"), F.col("__a_named"))
    rate = F.when(F.col("starts").isNotNull() & F.coalesce(actual != 0, F.lit(False)), F.col("starts") / actual).otherwise(F.col("__rate"))
    return a.select(goal.alias("goal"), actual.alias("actual"), "starts", rate.alias("start_rate"))


def roundup_term_stats(terms: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    """``term_stats`` of the selected terms."""
    tokens = _tokens(selected)
    return term_stats(terms, lambda tok: tok.isin(tokens) if tokens else F.lit(False))


def udr_performance(leads: DataFrame, enr: DataFrame, terms: DataFrame, allocations: DataFrame,
                    selected: Sequence[str] | None = None, tracker_terms: DataFrame | None = None) -> DataFrame:
    """Lead performance ⟗ enrollment performance ⟗ budget by UDR key; tracker vs goal; sorted.

    Owners that share a key are added up and their rates taken from the sums.  The terms in force are
    the selected ones or the ledger's only one; without budget terms the tracker's serve."""
    from .enrollment import label_or, lead_performance_by
    lp = lead_performance_by(leads, "contact_owner")
    lp = lp.withColumns({"lead_udr": clean_text(F.col("contact_owner")), "_udr_key": udr_key(F.col("contact_owner"))}).drop("contact_owner")
    lp = lp.groupBy("_udr_key").agg(F.min("lead_udr").alias("lead_udr"), *[F.sum(c).alias(c) for c in [
        "leads", "contacted_progressed", "applicants", "crm_enrolled", "bad_leads", "uncontacted_leads"]])
    lp = lp.withColumns({rate: safe_div(F.col(part), F.col("leads")) for rate, part in [
        ("l2c", "contacted_progressed"), ("l2a", "applicants"), ("l2e", "crm_enrolled"), ("bad_lead_rate", "bad_leads")]})
    owner = label_or(F.col("udr"), "Missing")
    # per owner as it stands first: the key's regular expressions run on owners, not on rows; sums are exact decimals
    days = F.col("days_to_enroll").cast("double").cast("decimal(28,9)")
    ep = enr.groupBy("udr").agg(F.count("student").alias("__n"), F.sum(money(F.col("revenue"))).alias("__revenue"),
                                F.sum(days).alias("__days"), F.count("days_to_enroll").alias("__n_days"))
    ep = ep.groupBy(udr_key(owner).alias("_udr_key")).agg(
        F.min(owner).alias("tracker_udr"), F.sum("__n").alias("actual_enrollments"),
        F.sum("__revenue").cast("double").alias("revenue"),
        (F.sum("__days").cast("double") / F.sum("__n_days")).alias("average_days_to_enroll"))
    if tracker_terms is not None:
        bare = terms.agg(F.count(F.lit(1)) == 0).scalar()
        terms = terms.unionByName(tracker_terms.where(bare), allowMissingColumns=True)
    bp = udr_budget_summary(terms, allocations, selected, enr)
    j = lp.join(ep, "_udr_key", "full_outer").join(bp, "_udr_key", "full_outer")
    udr = F.coalesce(*[F.nullif(clean_text(F.col(c)), F.lit("")) for c in ["budget_udr", "tracker_udr", "lead_udr"]], F.lit("Unassigned"))
    nums = ["leads", "contacted_progressed", "applicants", "crm_enrolled", "bad_leads", "uncontacted_leads", "actual_enrollments",
            "revenue", "average_days_to_enroll", "budget_goal", "budget_sheet_actual", "budget_remaining",
            "l2c", "l2a", "l2e", "bad_lead_rate", "budget_pct_goal"]
    j = j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in nums}).withColumn("udr", udr)
    j = j.withColumn("tracker_vs_budget_goal", safe_div(F.col("actual_enrollments"), F.col("budget_goal")))
    cols = ["udr", "budget_goal", "budget_sheet_actual", "budget_pct_goal", "actual_enrollments", "tracker_vs_budget_goal",
            "budget_remaining", "leads", "contacted_progressed", "applicants", "crm_enrolled", "bad_leads", "l2c", "l2a", "l2e",
            "bad_lead_rate", "revenue", "average_days_to_enroll"]
    return j.select("_udr_key", *cols).orderBy(F.desc("tracker_vs_budget_goal"), F.desc("actual_enrollments"), F.desc("leads"), "_udr_key")


def budget_performance(leads: DataFrame, enr: DataFrame, summary: DataFrame) -> DataFrame:
    """Total budget (sum of every 'Budget' summary row, T14), variance, cost per lead / applicant /
    enrollment.  Cost per lead divides by lead rows, as the page does."""
    from .enrollment import lead_summary
    total = summary.where(F.lower(clean_text(F.col("metric"))) == "budget").agg(
        F.coalesce(F.sum("numeric_value"), F.lit(0.0))).scalar()
    n_leads = leads.agg(F.count(F.lit(1))).scalar()
    applicants = lead_summary(leads).select("applicants").scalar()
    e = enr.agg(F.count(F.lit(1)).alias("actual_enrollments"))
    act = F.col("actual_enrollments")
    return e.select(total.alias("total_budget"), act, safe_div(act, total).alias("budget_variance"),
                    safe_div(total, n_leads).alias("cost_per_lead"), safe_div(total, applicants).alias("cost_per_applicant"),
                    safe_div(total, act).alias("cost_per_enrollment"))


def in_effective_terms(token: Column, selected: Sequence[str] | None, enr: DataFrame) -> Column:
    """Whether a term token is in force: any of the selected terms, or, with none selected, the only term
    label of the ledger (no term is in force where the ledger has several)."""
    tokens = _tokens(selected)
    if tokens:
        return token.isin(tokens)
    return F.coalesce(token == only_term(enr), F.lit(False))


def only_term(enr: DataFrame) -> Column:
    """The token of the ledger's only non-blank term label, else NULL (one scalar subquery)."""
    labels = enr.select(clean_text(F.col("term_label")).alias("term_label")).where(F.col("term_label") != "").distinct()
    labels = with_term_token(labels, "term_label", "__tok")
    return labels.agg(F.when(F.count(F.lit(1)) == 1, F.min("__tok"))).scalar()


def required_weekly_pace(remaining: Column, last_term: Column, today) -> Column:
    """remaining / max(days to the last term date / 7, 1); 0 when nothing remains or no term dates."""
    days = F.greatest(elapsed_days_floor(ts_literal(today), last_term), F.lit(1))
    pace = remaining.cast("double") / F.greatest(days / F.lit(7.0), F.lit(1.0))
    return F.when((remaining <= 0) | last_term.isNull(), F.lit(0.0)).otherwise(pace)


def _or_chain(*vals: Column) -> Column:
    """Python ``a or b or c``: the first value that is neither NULL nor 0."""
    out = None
    for v in vals[:-1]:
        cond = v.isNotNull() & (v != 0)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(vals[-1]) if out is not None else vals[-1]


def _packed(df: DataFrame, prefix: str) -> list[Column]:
    """All columns of a one-row frame as columns of another row, through one scalar subquery."""
    s = df.select(F.struct(*df.columns).alias("s")).scalar()
    return [s.getField(c).alias(f"{prefix}{c}") for c in df.columns]


def executive_overview(leads: DataFrame, paid_leads: DataFrame | None, enr: DataFrame, budget_summary: DataFrame,
                       budget_terms: DataFrame, tracker_summary: DataFrame | None = None, tracker_terms: DataFrame | None = None,
                       selected: Sequence[str] | None = None, today=None) -> DataFrame:
    """26 measures with the goal / starts / actual / start-rate precedence chain (one row).  Every
    one-row input enters once as a packed scalar subquery; derived values are columns.  Without
    ``paid_leads`` the paid ones among ``leads`` are meant, which saves passes."""
    from .enrollment import lead_and_paid_summary, lead_summary
    tracker_summary = budget_summary.limit(0) if tracker_summary is None else tracker_summary
    tracker_terms = budget_terms.limit(0) if tracker_terms is None else tracker_terms
    chosen = lambda tok: in_effective_terms(tok, selected, enr)

    def firsts(summ: DataFrame) -> DataFrame:
        hit = summ.withColumn("__m", F.lower(clean_text(F.col("metric"))))
        return hit.agg(*[F.min_by(F.when(F.col("__m") == m.lower(), F.col("numeric_value")),
                                   F.when(F.col("__m") == m.lower(), F.struct("sheet", "_seq"))).alias(m.replace("%", "_pct"))
                         for m in ("Budget", "Starts", "Enrolled", "Start%")])

    base = enr.agg(F.count(F.lit(1)).alias("act"), sum_money(F.col("revenue")).alias("revenue"),
                   F.coalesce(avg_exact(F.col("days_to_enroll")), F.lit(0.0)).alias("avg_days"),
                   F.max(F.col("term").cast("timestamp")).alias("last_term"))
    row = base.select("*", *_packed(term_stats(budget_terms, chosen), "b_"), *_packed(term_stats(tracker_terms, chosen), "t_"),
                      *(_packed(lead_and_paid_summary(leads), "") if paid_leads is None
                        else [*_packed(lead_summary(leads), "l_"), *_packed(lead_summary(paid_leads), "p_")]),
                      *_packed(firsts(tracker_summary), "ts_"), *_packed(firsts(budget_summary), "bs_"))
    c = F.col
    row = row.withColumns({
        "goal": F.coalesce(c("b_goal"), c("t_goal"), _or_chain(c("ts_Budget"), c("bs_Budget"), F.lit(0.0))).cast("double"),
        "starts": F.coalesce(c("t_starts"), _or_chain(c("ts_Starts"), c("bs_Starts"), F.lit(0.0))).cast("double"),
        "enrolled": F.coalesce(c("t_actual"), _or_chain(c("ts_Enrolled"), c("bs_Enrolled"), F.lit(0.0))).cast("double"),
        "start_pct": F.coalesce(c("t_start_rate"), _or_chain(c("ts_Start_pct"), c("bs_Start_pct"), F.lit(None).cast("double"))),
    })
    row = row.withColumns({
        "start_rate": F.when(c("start_pct").isNotNull(), c("start_pct")).when(c("enrolled") != 0, c("starts") / c("enrolled"))
        .otherwise(F.lit(0.0)),
        "remaining": F.greatest(c("goal") - c("act"), F.lit(0.0)),
    })
    pace = F.lit(0.0) if today is None else required_weekly_pace(c("remaining"), c("last_term"), today)
    return row.select(
        c("l_total_leads").alias("total_leads"), _or_chain(c("p_total_leads"), c("l_paid_leads")).alias("paid_leads"),
        _or_chain(c("l_organic_leads"), c("p_organic_leads")).alias("organic_leads"), c("l_applicants").alias("applicants"),
        c("l_crm_enrolled").alias("crm_enrolled"), c("act").alias("actual_enrollments"), c("goal").alias("enrollment_goal"),
        "starts", "revenue", c("l_bad_leads").alias("bad_leads"), c("goal").alias("total_budget"),
        F.greatest(c("goal") - c("act"), F.lit(0.0)).alias("budget_remaining"), c("l_contacted_leads").alias("contacted_leads"),
        c("l_lead_to_contact_rate").alias("lead_to_contact_rate"), c("l_lead_to_applicant_rate").alias("lead_to_applicant_rate"),
        c("l_lead_to_crm_enrolled_rate").alias("lead_to_crm_enrolled_rate"), safe_div(c("act"), c("goal")).alias("percent_of_goal"),
        c("remaining").alias("remaining_enrollments"), pace.alias("weekly_pace_required"), "start_rate",
        safe_div(c("revenue"), c("act")).alias("revenue_per_enrollment"), c("avg_days").alias("average_days_to_enroll"),
        c("l_bad_lead_rate").alias("bad_lead_rate"), safe_div(c("goal"), c("l_total_leads")).alias("cost_per_lead"),
        safe_div(c("goal"), c("l_applicants")).alias("cost_per_applicant"), safe_div(c("goal"), c("act")).alias("cost_per_enrollment"))
