"""DuckDB spelling of the uploaded-leads, enrollment and budget-grid path (correctness oracle)."""

from __future__ import annotations

from ..functions import rules as R
from ..sources import crm_view as V
from .oracle import cycle, q, safe_div, strip, txt

NBSP = " "


def collapse(x: str) -> str:
    return strip(f"regexp_replace(replace(coalesce(CAST({x} AS VARCHAR), ''), '{NBSP}', ' '), '\\s+', ' ', 'g')")


def norm_source(x: str) -> str:
    t = collapse(x)
    alias = " ".join(f"WHEN lower({t}) = {q(k)} THEN {q(v)}" for k, v in R.SOURCE_ALIASES)
    return f"(CASE WHEN {t} = '' THEN {q(R.UNKNOWN_SOURCE)} {alias} ELSE {t} END)"


def normalized_source(fields: list[str]) -> str:
    present = [f for f in R.SOURCE_PRIORITY if f in fields]
    first = "coalesce(" + ", ".join([f"nullif({collapse(f)}, '')" for f in present] + ["''"]) + ")"
    return norm_source(first)


def lead_type(fields: list[str], src: str) -> str:
    paid = collapse("paid_lead_list") if "paid_lead_list" in fields else "''"
    org = collapse("organic_lead_list") if "organic_lead_list" in fields else "''"
    low = f"lower({src})"
    hints = lambda terms: "(" + " OR ".join(f"contains({low}, {q(t)})" for t in terms) + ")"
    return (f"(CASE WHEN {paid} <> '' THEN 'Paid' WHEN {org} <> '' THEN 'Organic' WHEN {low} = {q(R.UNKNOWN_SOURCE.lower())} "
            f"THEN 'Unknown' WHEN {hints(R.PAID_HINTS)} THEN 'Paid' WHEN {hints(R.ORGANIC_HINTS)} THEN 'Organic' ELSE 'Unknown' END)")


LEAD_FIELDS = ["record_id", "email", "contact_owner", "lead_status", "lifecycle_stage", "paid_lead_list", "organic_lead_list",
               "utm_source", "create_date", "last_activity_date", "degree"]
ENR_FIELDS = ["row_key", "student", "udr", "program", "modality", "enrolled_date", "student_type", "payment_funding",
              "new_roll", "term", "source", "days_to_enroll", "revenue"]


def leads_ctes() -> list[str]:
    k = "c_custkey"
    created = (f"(CASE WHEN {k} % 5 = 0 THEN {V.TODAY_SECS} - ({k} % 60) * 86400 "
               f"ELSE {V.BASE_SECS} + (({k} * 37) % 2400) * 86400 END)")
    raw = f"""raw_leads AS (SELECT CASE WHEN {k} % 19 = 0 THEN '' ELSE CAST({k} AS VARCHAR) END AS record_id,
        CASE WHEN {k} % 11 = 0 THEN '' ELSE 'c' || CAST({k} AS VARCHAR) || '@mail.test' END AS email,
        n_name AS contact_owner, {cycle(k, V.LEAD_STATUS_CYCLE)} AS lead_status, {cycle(k, V.LIFECYCLE_CYCLE)} AS lifecycle_stage,
        CASE WHEN {k} % 6 < 2 THEN {cycle(k, V.LEAD_LISTS)} ELSE '' END AS paid_lead_list,
        CASE WHEN {k} % 6 >= 3 THEN {cycle(k, V.LEAD_LISTS)} ELSE '' END AS organic_lead_list,
        {cycle(k, V.UTM_SOURCE_CYCLE)} AS utm_source,
        make_timestamp(CAST({created} AS BIGINT) * 1000000) AS create_date,
        CASE WHEN {k} % 5 = 4 THEN NULL ELSE make_timestamp(CAST({V.TODAY_SECS} - (({k} * 13) % 90) * 86400 AS BIGINT) * 1000000) END
          AS last_activity_date,
        CASE WHEN {k} % 4 = 0 THEN 'Bachelor' WHEN {k} % 4 = 1 THEN 'Master' ELSE '' END AS degree
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
    src = normalized_source(LEAD_FIELDS)
    std = f"""leads_std AS (SELECT * REPLACE ({txt('record_id')} AS record_id, lower({txt('email')}) AS email,
        {txt('lead_status')} AS lead_status, {txt('lifecycle_stage')} AS lifecycle_stage, {txt('contact_owner')} AS contact_owner),
        {src} AS normalized_source FROM raw_leads)"""
    flags = f"""leads_f AS (SELECT *, {lead_type(LEAD_FIELDS, 'normalized_source')} AS lead_type,
        (last_activity_date IS NOT NULL OR lower({txt('lead_status')}) IN ({', '.join(q(x) for x in R.CONTACTED_STATUSES)})) AS is_contacted,
        lower({txt('lifecycle_stage')}) = 'applicant' AS is_applicant, lower({txt('lifecycle_stage')}) = 'enrolled' AS is_crm_enrolled,
        (lower({txt('lifecycle_stage')}) = 'not a lead' OR lower({txt('lead_status')}) IN ({', '.join(q(x) for x in R.BAD_LEAD_STATUSES)}))
          AS is_bad_lead FROM leads_std)"""
    return [raw, std, flags]


def enr_ctes() -> list[str]:
    ok = "l_orderkey"
    ship = "l_shipdate"
    raw = f"""raw_enr AS (SELECT CAST({ok} AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row_key,
        CASE WHEN {ok} % 40 = 0 THEN '' ELSE 'S' || CAST({ok} AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS student,
        n_name AS udr, p_type AS program, l_returnflag AS modality, CAST({ship} AS TIMESTAMP) AS enrolled_date,
        CASE WHEN l_linenumber % 2 = 0 THEN 'New' ELSE 'Returning' END AS student_type,
        CASE WHEN {ok} % 3 = 0 THEN 'Title IV' WHEN {ok} % 3 = 1 THEN 'Self Pay' ELSE '' END AS payment_funding,
        l_linestatus AS new_roll, date_trunc('quarter', CAST({ship} AS TIMESTAMP)) AS term,
        CASE WHEN l_partkey % 30 = 0 THEN '' ELSE p_brand END AS source,
        CAST(floor((epoch({ship}) - epoch(o_orderdate)) / 86400) AS BIGINT) AS days_to_enroll, l_extendedprice AS revenue
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)"""
    src = normalized_source(ENR_FIELDS)
    std = f"""enr AS (SELECT * REPLACE ({txt('student')} AS student, TRY_CAST(CAST(days_to_enroll AS VARCHAR) AS DOUBLE) AS days_to_enroll,
        TRY_CAST(CAST(revenue AS VARCHAR) AS DOUBLE) AS revenue), coalesce(strftime(term, '%Y-%m-%d'), '') AS term_label,
        {src} AS normalized_source FROM raw_enr WHERE {txt('student')} <> '')"""
    return [raw, std]


# ---- budget grid -------------------------------------------------------------------------------

def cells_ctes() -> list[str]:
    hs = V.BUDGET_TERM_HEADERS
    tcols = []
    for i, (_, t, m) in enumerate(hs):
        v = f"kk * 3 + {t}" if m == "g" else (f"kk * 2 + {t % 5}" if t <= 4 else "CAST(NULL AS BIGINT)")
        tcols.append(f"{v} AS t{i}")
    lines = f"""lines AS (SELECT nk, nk % {V.HEADER_ROWS} AS head, nk % {V.COLUMN_SHIFTS} AS shift, nk % {V.HEADER_ROWS} + 1 + k AS row,
        CASE WHEN k % 5 = 0 THEN 'UDR ' || lpad(CAST(k AS VARCHAR), 5, '0') ELSE n_name END AS name,
        CASE WHEN k % 8 = 7 THEN NULL ELSE kk * 18 + 21 END AS total, {', '.join(tcols)}
      FROM (SELECT s_suppkey AS k, s_suppkey % 50 AS kk, s_nationkey AS nk FROM supplier) JOIN nation ON nk = n_nationkey)"""
    sums = ("sums AS (SELECT nk, head, shift, max(row) + 1 AS base, sum(total) AS total, "
            + ", ".join(f"sum(t{i}) AS t{i}" for i in range(len(hs))) + " FROM lines GROUP BY nk, head, shift)")
    a_idx = [i for i, (_, _, m) in enumerate(hs) if m == "a"]
    numtxt = lambda x: f"coalesce(CAST(CAST({x} AS BIGINT) AS VARCHAR), '')"
    started = lambda i: f"floor(t{i} * CAST(0.7 AS DOUBLE))"
    ratio = lambda x, y: f"CAST(CAST(round(({x}) / nullif({y}, 0), 4) AS DECIMAL(10,4)) AS VARCHAR)"
    at = lambda i: f"{3 + i} + shift"
    from_lines = [("row", "1 + shift", "name"), ("row", "2 + shift", numtxt("total"))] + [("row", at(i), numtxt(f"t{i}")) for i in range(len(hs))]
    fixed = [("0", "0", "'2001 plan'"), ("head", "1 + shift", "'UDR'"), ("head", "2 + shift", "'Budget'")]
    fixed += [("head", at(i), q(h)) for i, (h, _, _) in enumerate(hs)]
    fixed += [("base", "1 + shift", "'Total'"), ("base", "2 + shift", numtxt("total"))]
    fixed += [("base", at(i), numtxt(f"t{i}")) for i in range(len(hs))]
    fixed += [("base + 1", "1 + shift", "'Starts'"), ("base + 1", "2 + shift", "''")]
    fixed += [("base + 1", at(i), numtxt(started(i))) for i in a_idx]
    fixed += [("base + 2", "1 + shift", "'Start%'"), ("base + 2", "2 + shift", "''")]
    fixed += [("base + 2", at(i), f"coalesce({ratio(started(i), f't{i}')}, '')") for i in a_idx]
    fixed += [("base + 3", "1 + shift", "'After stop'"), ("base + 3", "2 + shift", "'5'")]
    all_a = " + ".join(f"coalesce(t{i}, 0)" for i in a_idx)
    all_s = " + ".join(f"coalesce({started(i)}, 0)" for i in a_idx)
    plain = lambda x: f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    for off, label, v in [(5, "Budget", plain("total")), (6, "Enrolled", plain(all_a)), (7, "Starts", plain(all_s)), (8, "Start%", ratio(all_s, all_a)),
                          (9, "Budget", "''"), (10, "Budget", plain("t1 + t3"))]:
        fixed += [(f"base + {off}", "1", q(label)), (f"base + {off}", "2", v)]
    parts = [f"SELECT nk, {r} AS row, {c} AS col, {v} AS value FROM lines" for r, c, v in from_lines]
    parts += [f"SELECT nk, {r}, {c}, {v} FROM sums" for r, c, v in fixed]
    cells = ("cells AS (SELECT 'Budget ' || lpad(CAST(nk AS VARCHAR), 2, '0') AS sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, "
             f"CAST(value AS VARCHAR) AS value FROM ({' UNION ALL '.join(parts)}))")
    return [lines, sums, cells]


def parse_header_sql(x: str) -> tuple[str, str, str, str]:
    text = collapse(x)
    compact = f"replace(replace(regexp_replace(upper({text}), '[\\s_{NBSP}]+', '', 'g'), '–', '-'), '—', '-')"
    pat = q(r"^(SP|SU|FA)-?([12])(?:-?([AG]))?$")
    season, num, suf = (f"regexp_extract({compact}, {pat}, {i})" for i in (1, 2, 3))
    label = "(CASE " + " ".join(f"WHEN {season} = {q(c)} THEN {q(lab)}" for c, lab in R.SEASON_LABELS) + " END)"
    ok = f"({text} <> '' AND regexp_matches({compact}, {pat}))"
    metric = f"(CASE WHEN {suf} = 'G' THEN 'goal' WHEN {suf} = 'A' THEN 'actual' ELSE 'term' END)"
    return ok, f"{season} || {num}", f"{label} || ' ' || {num}", metric


def grid_ctes() -> list[str]:
    ok, term, label, metric = parse_header_sql("value")
    return cells_ctes() + [
        f"gc AS (SELECT sheet, row, col, value, {collapse('value')} AS text FROM cells)",
        "hdr AS (SELECT sheet, min(row) AS hdr_row FROM gc WHERE lower(text) = 'budget' GROUP BY 1)",
        """tot AS (SELECT gc.sheet, hdr.hdr_row, max(gc.col) AS total_col FROM gc JOIN hdr ON gc.sheet = hdr.sheet AND gc.row = hdr.hdr_row
            WHERE lower(gc.text) = 'budget' GROUP BY 1, 2 HAVING max(gc.col) > 0)""",
        """labels AS (SELECT gc.sheet, gc.row, gc.text AS label FROM gc JOIN tot ON gc.sheet = tot.sheet AND gc.col = tot.total_col - 1
            AND gc.row > tot.hdr_row)""",
        "stp AS (SELECT sheet, min(row) AS stop_row FROM labels WHERE lower(label) = 'start%' GROUP BY 1)",
        f"""hdrs AS (SELECT gc.sheet, gc.col, gc.text AS raw_term, {term} AS term, {label} AS term_label, {metric} AS term_metric
            FROM gc JOIN tot ON gc.sheet = tot.sheet AND gc.row = tot.hdr_row AND gc.col > tot.total_col
            WHERE gc.text <> '' AND {ok} AND {metric} IN ('actual', 'goal'))""",
        """grows AS (SELECT l.sheet, l.row, l.label, s.stop_row, TRY_CAST(t.value AS DOUBLE) AS total
            FROM labels l LEFT JOIN stp s ON s.sheet = l.sheet JOIN tot ON tot.sheet = l.sheet
            LEFT JOIN gc t ON t.sheet = l.sheet AND t.row = l.row AND t.col = tot.total_col
            WHERE s.stop_row IS NULL OR l.row <= s.stop_row)""",
        """gvals AS (SELECT gc.sheet, gc.row, gc.col, h.raw_term, h.term, h.term_label, h.term_metric, TRY_CAST(gc.value AS DOUBLE) AS term_value
            FROM gc JOIN hdrs h ON h.sheet = gc.sheet AND h.col = gc.col)""",
        """ginfo AS (SELECT r.sheet, r.row, count(v.term_value) AS n_terms, sum(CASE WHEN v.term_metric = 'goal' THEN v.term_value END) AS goal_sum
            FROM grows r LEFT JOIN gvals v ON v.sheet = r.sheet AND v.row = r.row GROUP BY 1, 2)""",
        f"""term_allocations AS (SELECT r.sheet,
            CASE WHEN lower(r.label) IN ('total','starts','start%') THEN 'roundup_metric' ELSE 'UDR allocation' END AS budget_dimension,
            CASE lower(r.label) WHEN 'total' THEN 'Total' WHEN 'starts' THEN 'Starts' WHEN 'start%' THEN 'Start%' ELSE r.label END AS budget_name,
            CASE lower(r.label) WHEN 'total' THEN 'Total' WHEN 'starts' THEN 'Starts' WHEN 'start%' THEN 'Start%' ELSE {norm_source('r.label')} END AS source,
            v.raw_term, v.term, v.term_label,
            CASE lower(r.label) WHEN 'starts' THEN 'starts' WHEN 'start%' THEN 'start_rate' ELSE v.term_metric END AS term_metric,
            v.term_value, v.term_value AS term_budget,
            CASE WHEN lower(r.label) IN ('total','starts','start%') THEN coalesce(r.total, 0.0) ELSE coalesce(r.total, coalesce(i.goal_sum, 0.0)) END
              AS planned_budget, r.row AS _row, v.col AS _col
          FROM grows r JOIN gvals v ON v.sheet = r.sheet AND v.row = r.row JOIN ginfo i ON i.sheet = r.sheet AND i.row = r.row
          WHERE v.term_value IS NOT NULL AND (lower(r.label) IN ('total','starts','start%')
                OR (r.label <> '' AND NOT (r.total IS NULL AND i.n_terms = 0))))""",
        f"""allocations AS (SELECT sheet, 'UDR allocation' AS budget_dimension, label AS budget_name,
            {norm_source('label')} AS normalized_budget_name, {norm_source('label')} AS source, total AS planned_budget,
            'goal' AS budget_metric, row AS _row FROM grows
          WHERE label <> '' AND lower(label) NOT IN ('total','starts','start%') AND total IS NOT NULL AND (stop_row IS NULL OR row < stop_row))""",
        """summary AS (SELECT m.sheet, m.row AS _seq, m.text AS metric, v.value, TRY_CAST(v.value AS DOUBLE) AS numeric_value
            FROM gc m LEFT JOIN gc v ON v.sheet = m.sheet AND v.row = m.row AND v.col = 2
            WHERE m.col = 1 AND lower(m.text) IN ('budget','enrolled','starts','start%'))""",
    ]


def udr_key_sql(x: str) -> str:
    t = strip(f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\\s+', ' ', 'g')")
    return (f"(CASE WHEN {t} = '' THEN '' WHEN regexp_matches({t}, '(?i)^UDR\\s+\\d+$') THEN lower({t}) "
            f"ELSE string_split(lower({t}), ' ')[1] END)")


def identity_sql(subset: str) -> str:
    rid = f"count(DISTINCT CASE WHEN ({subset}) AND {txt('record_id')} <> '' THEN {txt('record_id')} END)"
    em = f"count(DISTINCT CASE WHEN ({subset}) AND {txt('email')} <> '' THEN {txt('email')} END)"
    return f"(CASE WHEN {rid} > 0 THEN {rid} WHEN {em} > 0 THEN {em} ELSE count_if({subset}) END)"


SUBSETS = {"total": "true", "paid": "coalesce(lead_type, '') = 'Paid'", "organic": "coalesce(lead_type, '') = 'Organic'",
           "contacted": "is_contacted", "applicants": "is_applicant", "crm_enrolled": "is_crm_enrolled", "bad": "is_bad_lead"}


def lead_metric_select(prefix: list[str]) -> str:
    counts = ", ".join(f"{identity_sql(v)} AS {k}" for k, v in SUBSETS.items())
    return counts


def lead_perf_cols(dim: str) -> str:
    return (f"{dim}, total AS leads, paid AS paid_leads, organic AS organic_leads, contacted AS contacted_progressed, applicants, "
            f"crm_enrolled, bad AS bad_leads, greatest(total - contacted, 0) AS uncontacted_leads, "
            f"{safe_div('contacted', 'total')} AS l2c, {safe_div('applicants', 'total')} AS l2a, "
            f"{safe_div('crm_enrolled', 'total')} AS l2e, {safe_div('bad', 'total')} AS bad_lead_rate")
