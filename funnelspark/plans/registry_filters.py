"""Queries of the column, filter and field-inventory operators, and of the reports' further inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.classify import source_set
from ..operators import budget as _B
from ..operators import cohorts as _C
from ..operators import enrollment as _E
from ..operators import kpi
from ..operators import privacy as _PR
from ..operators import profile as _PF
from ..sources import crm_view as CV
from . import oracle as O
from . import oracle_uploaded as U
from . import registry as G

QUERIES: dict = {}
ORACLE: dict = {}


# ---- columns of an upload -----------------------------------------------------------------------

#: Headings as people type them -> the raw leads' columns they hold.
UPLOAD_HEADINGS = [("Record ID", "record_id"), ("E-mail", "email"), ("Contact owner", "contact_owner"), ("Lead Status", "lead_status"),
                   ("lead_status", "lifecycle_stage"), ("Contact Owner!", "utm_source"), ("%", "degree"), ("lead status 2", "paid_lead_list"), ("  ", "create_date")]
UPLOAD_NAMES = ["record_id", "e_mail", "contact_owner", "lead_status", "lead_status_3", "contact_owner_2", "unnamed", "lead_status_2", "unnamed_2"]
UPLOAD_RENAMES = {"e_mail": "email", "lead_status_2": "lead_status", "lead_status_3": "lead_status", "contact_owner_2": "contact_owner"}


def _upload(spark, d):
    raw = CV.leads(spark, d)
    return raw.select(*[F.col(c) for _, c in UPLOAD_HEADINGS]).toDF(*[h for h, _ in UPLOAD_HEADINGS])


def q_coalesce_duplicate_columns(spark, d):
    return _E.coalesce_duplicate_columns(_E.standardize_columns(_upload(spark, d)), UPLOAD_RENAMES)


def _upload_sql() -> str:
    return "upload AS (SELECT " + ", ".join(f"{c} AS {n}" for n, (_, c) in zip(UPLOAD_NAMES, UPLOAD_HEADINGS)) + " FROM raw_leads)"


def sql_coalesce_duplicate_columns() -> str:
    first = lambda *cs: "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ")"
    return G._usql(f"""SELECT record_id, e_mail AS email, {first('contact_owner', 'contact_owner_2')} AS contact_owner,
        {first('lead_status', 'lead_status_3', 'lead_status_2')} AS lead_status, unnamed, unnamed_2 FROM upload""", [_upload_sql()], leads=True)


# ---- term labels ----------------------------------------------------------------------------------

#: Spellings of a term, dealt to orders by key (FIXED VALUES of the view).
TERM_SPELLINGS = ["spring 2", "FALL-1", "sp 2", "Su1", "summer", " ", "Spring  1-G", "SP-1 A", "fa_2 - g", "SU–2", "Winter 1", "sp3"]


def q_display_term_label(spark, d):
    orders = CV.read_table(spark, d, "orders")
    named = orders.select(G._V._cycle(F.col("o_orderkey"), TERM_SPELLINGS).alias("value"))
    texts = named.unionByName(CV.budget_cells(spark, d).select("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    return _B.with_display_term_label(texts, "value", "label")


def sql_display_term_label() -> str:
    ok, term, _, _ = U.parse_header_sql("value")
    text = U.collapse("value")
    direct = f"replace(replace(regexp_replace(upper({text}), '[\\s_{U.NBSP}-]+', '', 'g'), '–', ''), '—', '')"
    words = O.strip(f"regexp_replace(upper({text}), '[^A-Z0-9]+', ' ', 'g')")
    pair = lambda x, pat, i: f"regexp_extract({x}, '{pat}', {i})"
    d, w = "^(SP|SU|FA)([12])$", "^(SPRING|SUMMER|FALL)\\s*([12])$"
    token = f"""CASE WHEN {text} = '' THEN '' WHEN {ok} THEN {term} WHEN regexp_matches({direct}, '{d}') THEN {pair(direct, d, 0)}
        WHEN regexp_matches({words}, '{w}') THEN substr({pair(words, w, 1)}, 1, 2) || {pair(words, w, 2)} ELSE {text} END"""
    seasons = "CASE substr(token, 1, 2) " + " ".join(f"WHEN {O.q(c)} THEN {O.q(label)}" for c, label in R.SEASON_LABELS) + " END"
    return G._usql(f"""SELECT value, rows, CASE WHEN regexp_matches(token, '^(SP|SU|FA)[12]$') THEN {seasons} || ' ' || substr(token, 3, 1) ELSE {text} END AS label
      FROM (SELECT value, rows, {token} AS token FROM (SELECT value, count(*) AS rows FROM (SELECT value FROM cells
        UNION ALL SELECT {O.cycle('o_orderkey', TERM_SPELLINGS)} FROM orders) GROUP BY 1))""", U.cells_ctes())


# ---- filters ----------------------------------------------------------------------------------------

COHORT_FILTERS = {"modality": ["Online"], "campus": ["Campus 1", "Campus 2"], "cohort": [], "absent": ["x"], "salesman_name": [f"NATION_{i}" for i in range(1, 20)]}
ENROLLMENT_FILTERS = {"student_type": ["New"], "payment_funding": ["", "Self Pay"], "udr": [], "modality": ["A", "R"]}


def q_cohort_filter(spark, d):
    return _C.cohort_filter(G._prepared(spark, d), COHORT_FILTERS).select("contact_id", "cohort", "modality", "campus", "salesman_name")


def sql_cohort_filter() -> str:
    conds = [f"{O.txt_na(c)} IN ({', '.join(map(O.q, v))})" for c, v in COHORT_FILTERS.items() if v and c != "absent"]
    return G._sql(f"SELECT contact_id, cohort, modality, campus, salesman_name FROM cpp WHERE {' AND '.join(conds)}", G._cohort_ctes())


def q_enrollment_filters(spark, d):
    rows = _E.filter_date_range(_E.apply_filters(G._enr(spark, d), ENROLLMENT_FILTERS), "enrolled_date", "1994-06-01", "1997-05-31")
    return rows.select("row_key", "student", "udr", "student_type", "payment_funding", "modality", "enrolled_date")


def sql_enrollment_filters() -> str:
    conds = " AND ".join(f"coalesce({c}, '') IN ({', '.join(map(O.q, v))})" for c, v in ENROLLMENT_FILTERS.items() if v)
    return G._usql(f"""SELECT row_key, student, udr, student_type, payment_funding, modality, enrolled_date FROM enr
        WHERE {conds} AND enrolled_date >= DATE '1994-06-01' AND enrolled_date < DATE '1997-06-01'""", enr=True)


# ---- field inventory -------------------------------------------------------------------------------

def q_missing_fields(spark, d):
    wanted = _PF.wanted_fields(spark).select("object_type", "logical_name")
    return _PF.missing_fields(G.q_field_mapping(spark, d), wanted)


def sql_vendor_candidate_fields() -> str:
    terms = " OR ".join(f"contains(lower(property_name || ' ' || coalesce(label, '')), {O.q(t)})" for t in R.VENDOR_FIELD_TERMS)
    fixed = " UNION ".join(f"SELECT {O.q(f)}" for f in R.PREFERRED_SOURCE_FIELDS)
    return f"""SELECT property_name FROM ({G.sql_profile_fields()}) WHERE object_type = 'contact' AND usable AND ({terms}) UNION {fixed}"""


# ---- further inputs of reports ----------------------------------------------------------------------

#: The tracker's own roundup workbook: these sheets of the budget workbook.
TRACKER_SHEETS = ("Budget 10", "Budget 19")


def _overview_with_tracker(spark, d, selected=None):
    summary, _, terms, roundup = G._grid(spark, d)
    tracked = F.col("sheet").between(*TRACKER_SHEETS)
    return _B.executive_overview(G._leads(spark, d), None, G._enr(spark, d), summary, terms, summary.where(tracked), roundup.where(tracked),
                                 selected=selected, today=CV.TODAY)


def sql_overview_with_tracker(tokens: tuple[str, ...] = ()) -> str:
    within = f"sheet BETWEEN {O.q(TRACKER_SHEETS[0])} AND {O.q(TRACKER_SHEETS[1])}"
    names, m = f"lower({O.txt('budget_name')})", "lower(coalesce(term_metric, ''))"
    named = f"{names} NOT IN ('total', 'starts', 'start%')"
    s = lambda cond: f"(CASE WHEN count(CASE WHEN {cond} THEN term_value END) > 0 THEN sum(CASE WHEN {cond} THEN term_value END) END)"
    chosen = f"term IN ({', '.join(map(O.q, tokens))})" if tokens else "false"
    stats = lambda name, where: f"""{name} AS (SELECT coalesce(gt, gn) AS goal, coalesce(a_t, an) AS actual, starts,
          CASE WHEN starts IS NOT NULL AND coalesce(coalesce(a_t, an) <> 0, false) THEN starts / coalesce(a_t, an) ELSE rate END AS start_rate
        FROM (SELECT {s(f"{names} = 'total' AND {m} = 'goal'")} AS gt, {s(f"{names} = 'total' AND {m} = 'actual'")} AS a_t,
          {s(f"{m} = 'starts'")} AS starts, {s(f"{named} AND {m} = 'goal'")} AS gn, {s(f"{named} AND {m} = 'actual'")} AS an,
          avg(CASE WHEN {m} = 'start_rate' THEN term_value END) AS rate FROM term_allocations WHERE {chosen} AND {where}))"""  # noqa: E731
    first = lambda metric, where: f"(SELECT numeric_value FROM summary WHERE lower({O.txt('metric')}) = {O.q(metric.lower())} AND {where} ORDER BY sheet, _seq LIMIT 1)"

    def chain(metric, last):
        parts = [first(metric, within), first(metric, "true")]
        return "(CASE " + " ".join(f"WHEN {p} IS NOT NULL AND {p} <> 0 THEN {p}" for p in parts) + f" ELSE {last} END)"

    goal = f"CAST(coalesce((SELECT goal FROM bts), (SELECT goal FROM tts), {chain('Budget', '0.0')}) AS DOUBLE)"
    starts = f"CAST(coalesce((SELECT starts FROM tts), {chain('Starts', '0.0')}) AS DOUBLE)"
    enrolled = f"CAST(coalesce((SELECT actual FROM tts), {chain('Enrolled', '0.0')}) AS DOUBLE)"
    pct = f"coalesce((SELECT start_rate FROM tts), {chain('Start%', 'NULL')})"
    return G._usql(f"""SELECT goal AS enrollment_goal, starts, CASE WHEN pct IS NOT NULL THEN pct WHEN enrolled <> 0 THEN starts / enrolled ELSE 0.0 END AS start_rate,
        greatest(goal - act, 0.0) AS remaining_enrollments, {O.safe_div('act', 'goal')} AS percent_of_goal
      FROM (SELECT {goal} AS goal, {starts} AS starts, {enrolled} AS enrolled, {pct} AS pct, (SELECT count(*) FROM enr) AS act)""",
                   [stats("bts", "true"), stats("tts", within)], enr=True, grid=True)


OVERVIEW_COLUMNS = ["enrollment_goal", "starts", "start_rate", "remaining_enrollments", "percent_of_goal"]


def q_paid_lead_metrics(spark, d):
    s = G._s(spark, d)
    return kpi.paid_lead_metrics(s["contacts_clean"], s["lead_deal_fact"], kpi.vendor_costs(CV.vendor_costs_raw(spark, d)))


QUERIES.update({
    "standardize_columns": lambda s, d: _E.standardize_columns(_upload(s, d)),
    "coalesce_duplicate_columns": q_coalesce_duplicate_columns,
    "display_term_label": q_display_term_label,
    "cohort_filter": q_cohort_filter,
    "enrollment_filters": q_enrollment_filters,
    "source_set": lambda s, d: source_set(G._enr(s, d)),
    "redact_pii": lambda s, d: _PR.redact_pii(CV.leads(s, d)),
    "removed_fields": lambda s, d: _PF.removed_fields(G.q_field_mapping(s, d)),
    "missing_fields": q_missing_fields,
    "vendor_candidate_fields": lambda s, d: _PF.vendor_candidate_fields(G.q_profile_fields(s, d), R.PREFERRED_SOURCE_FIELDS),
    "executive_overview_tracker": lambda s, d: _overview_with_tracker(s, d).select(*OVERVIEW_COLUMNS),
    "executive_overview_tracker_term": lambda s, d: _overview_with_tracker(s, d, ["Spring 1"]).select(*OVERVIEW_COLUMNS),
    "paid_lead_metrics": q_paid_lead_metrics,
})
ORACLE.update({
    "standardize_columns": lambda: G._usql("SELECT * FROM upload", [_upload_sql()], leads=True),
    "coalesce_duplicate_columns": sql_coalesce_duplicate_columns,
    "display_term_label": sql_display_term_label,
    "cohort_filter": sql_cohort_filter,
    "enrollment_filters": sql_enrollment_filters,
    "source_set": lambda: G._usql(f"SELECT DISTINCT s AS source FROM (SELECT {U.norm_source('normalized_source')} AS s FROM enr) WHERE s <> {O.q(R.UNKNOWN_SOURCE)}", enr=True),
    "redact_pii": lambda: G._usql("SELECT * EXCLUDE (email) FROM raw_leads", leads=True),
    "removed_fields": lambda: f"""SELECT object_type, logical_name AS dashboard_field, 'No populated HubSpot property found.' AS reason, preferred_candidates
        FROM ({G.sql_choose_field_mapping()}) WHERE selected_property IS NULL""",
    "missing_fields": lambda: f"SELECT object_type, logical_name FROM ({G.sql_choose_field_mapping()}) WHERE selected_property IS NULL",
    "vendor_candidate_fields": sql_vendor_candidate_fields,
    "executive_overview_tracker": sql_overview_with_tracker,
    "executive_overview_tracker_term": lambda: sql_overview_with_tracker(("SP1",)),
    "paid_lead_metrics": lambda: f"SELECT *, (SELECT count(*) FROM supplier) > 0 AS vendor_cost_data_available FROM ({G.sql_paid_lead_metrics()})",
})
