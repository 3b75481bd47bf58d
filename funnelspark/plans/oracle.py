"""DuckDB spelling of the CRM view and silver tables, used as the correctness oracle.

This is an independent second spelling of the same rules in SQL (window functions instead of
grouped aggregates, ``CASE`` chains generated from the same fixed rule lists).  It only has
to run at the check scale; the Spark plan is the one built for scale.
"""

from __future__ import annotations

from ..functions import rules as R
from ..functions.classify import vendor_source_columns
from ..sources import crm_view as V

TODAY_TS = f"TIMESTAMP '{V.TODAY}'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean_id(x: str) -> str:
    return f"nullif({strip(f'CAST({x} AS VARCHAR)')}, '')"


def txt(x: str) -> str:
    """clean_text 'trim' flavour: '' for NULL."""
    return strip(f"coalesce(CAST({x} AS VARCHAR), '')")


def txt_na(x: str) -> str:
    t = txt(x)
    return f"(CASE WHEN lower({t}) IN ('nan','nat','<na>','none') THEN '' ELSE {t} END)"


def contains_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t.lower())})" for t in terms) + ")"


def first_term(text: str, terms, transform=lambda t: t) -> str:
    return "(CASE " + " ".join(f"WHEN contains({text}, {q(t)}) THEN {q(transform(t))}" for t in terms) + " END)"


def cycle(key: str, values) -> str:
    n = len(values)
    return "(CASE " + " ".join(f"WHEN {key} % {n} = {i} THEN {q(v)}" for i, v in enumerate(values)) + " END)"


def iso(secs: str) -> str:
    return f"strftime(make_timestamp(CAST({secs} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


def days_floor(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS BIGINT)"


def safe_div(n: str, d: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0.0)"


def money_sum(x: str) -> str:
    return f"CAST(coalesce(sum(CAST(coalesce(CAST({x} AS DOUBLE), 0.0) AS DECIMAL(28,6))), 0) AS DOUBLE)"


def as_bool(x: str) -> str:
    return f"coalesce(lower(CAST({x} AS VARCHAR)) IN ('true','1','yes'), false)"


# ---- CRM view ------------------------------------------------------------------------------

def view_ctes() -> list[str]:
    created = (f"(CASE WHEN c_custkey % 5 = 0 THEN {V.TODAY_SECS} - (c_custkey % 60) * 86400 "
               f"ELSE {V.BASE_SECS} + ((c_custkey * 37) % 2400) * 86400 END)")
    program = "(CASE " + " ".join(f"WHEN c_mktsegment = {q(s)} THEN {q(p)}" for s, p in V.SEGMENT_PROGRAM) + " ELSE '' END)"
    k = "c_custkey"
    contacts = f"""raw_contacts AS (SELECT
        CAST({k} AS VARCHAR) AS hs_object_id,
        {iso(created)} AS createdate,
        CASE WHEN {k} % 7 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS hubspot_owner_id,
        {iso(created + ' + 86400')} AS hubspot_owner_assigneddate,
        'Student' AS firstname, CAST({k} AS VARCHAR) AS lastname,
        CASE WHEN {k} % 11 = 0 THEN '' ELSE 'c' || CAST({k} AS VARCHAR) || '@mail.test' END AS email,
        CASE WHEN {k} % 13 = 0 THEN '555-' || CAST({k} AS VARCHAR) ELSE '' END AS phone,
        {cycle(k, V.LIFECYCLE_CYCLE)} AS lifecyclestage,
        {cycle(k, V.LEAD_STATUS_CYCLE)} AS hs_lead_status,
        {cycle(k, V.UTM_SOURCE_CYCLE)} AS utm_source,
        {cycle(k, V.UTM_MEDIUM_CYCLE)} AS utm_medium,
        CASE WHEN {k} % 5 = 0 THEN '' ELSE 'camp_' || CAST({k} % 5 AS VARCHAR) END AS utm_campaign,
        {program} AS program,
        CASE WHEN {k} % 23 = 0 THEN 'Master' ELSE '' END AS degree_level,
        {cycle(k, V.ENROLLMENT_STATUS_CYCLE)} AS enrollment_status,
        CASE WHEN {k} % 5 = 3 THEN {iso(created + ' + 30 * 86400')} ELSE '' END AS enrollment_date,
        CASE WHEN {k} % 5 = 2 THEN {iso(created + ' + 10 * 86400')} ELSE '' END AS application_date,
        CASE WHEN {k} % 4 = 0 THEN '2001 Fall I' ELSE '' END AS session_start,
        CASE WHEN {k} % 10 = 0 THEN 'Official 2001A' ELSE '' END AS cohort,
        'Campus ' || CAST({k} % 3 AS VARCHAR) AS campus_location,
        CASE WHEN {k} % 2 = 0 THEN 'Online' ELSE 'Hybrid' END AS modality,
        CASE WHEN {k} % 17 = 0 THEN '48000' ELSE '0' END AS standard_tuition_total,
        CASE WHEN {k} % 2 = 0 THEN {iso(created + f' + ({k} % 5) * 86400')} ELSE '' END AS hs_first_outreach_date,
        CASE WHEN {k} % 5 = 4 THEN '' ELSE CAST(({V.TODAY_SECS} - (({k} * 13) % 90) * 86400) * 1000 AS VARCHAR) END AS notes_last_updated,
        CASE WHEN {k} % 3 = 0 THEN {iso(f'{V.TODAY_SECS} + ({k} % 20) * 86400')} ELSE '' END AS notes_next_activity_date,
        CAST({k} % 12 AS VARCHAR) AS num_notes,
        CASE WHEN {k} % 3 = 1 THEN '' ELSE CAST(({k} % 20) * 3600000 AS VARCHAR) END AS hs_time_to_first_engagement
      FROM customer)"""
    stage = ("(CASE WHEN o_custkey % 4 = 0 THEN 'Open' "
             "WHEN o_custkey % 4 = 1 THEN (CASE WHEN o_orderstatus = 'O' THEN 'Closed Lost' ELSE 'Open' END) "
             "ELSE (CASE WHEN o_orderstatus = 'F' THEN 'Closed Won' WHEN o_orderstatus = 'O' THEN 'Closed Lost' ELSE 'Open' END) END)")
    osecs = "epoch(o_orderdate)"
    deals = f"""raw_deals AS (SELECT
        CAST(o_orderkey AS VARCHAR) AS hs_object_id,
        {iso(osecs)} AS createdate,
        CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_orderkey % 25 AS VARCHAR) END AS hubspot_owner_id,
        {stage} AS dealstage, 'default' AS pipeline,
        CASE WHEN {stage} = 'Open' THEN '' ELSE {iso(f'{osecs} + ((o_orderkey % 90) - 5) * 86400')} END AS closedate,
        CASE WHEN o_orderkey % 12 = 0 THEN '0' ELSE CAST(o_totalprice AS VARCHAR) END AS amount
      FROM orders)"""
    second = "((o_custkey % (SELECT max(c_custkey) FROM customer)) + 1)"
    assoc = f"""raw_associations AS (
        SELECT CAST(o_custkey AS VARCHAR) AS contact_id, CAST(o_orderkey AS VARCHAR) AS deal_id, 'contact_to_deal' AS association_type
          FROM orders WHERE o_orderkey % 20 <> 0 AND o_custkey % 25 <> 3
        UNION ALL
        SELECT CAST({second} AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'shared'
          FROM orders WHERE o_orderkey % 15 = 0 AND o_orderkey % 20 <> 0 AND {second} % 25 <> 3
        UNION ALL
        SELECT 'missing', CAST(o_orderkey AS VARCHAR), 'contact_to_deal' FROM orders WHERE o_orderkey % 997 = 0)"""
    owners = """raw_owners AS (SELECT CAST(n_nationkey AS VARCHAR) AS owner_id,
        CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END AS salesman_name,
        'n' || CAST(n_nationkey AS VARCHAR) || '@x.org' AS email FROM nation)"""
    atype = "(CASE " + " ".join(f"WHEN event_type = {q(e)} THEN {q(a)}" for e, a in V.EVENT_ACTIVITY_TYPE) + " END)"
    text = "(event_type || ' #' || json_extract_string(props, '$.k'))"
    acts = f"""raw_activities AS (SELECT {atype} AS activity_type, CAST(event_id AS VARCHAR) AS hs_object_id,
        CASE WHEN event_id % 50 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS contact_id,
        CAST((epoch_us(ts) // 1000) - CAST({V.ACTIVITY_SHIFT_DAYS} AS BIGINT) * 86400000 AS VARCHAR) AS hs_timestamp,
        CAST(event_id % 30 AS VARCHAR) AS hubspot_owner_id,
        CASE WHEN event_type = 'signup' THEN {text} END AS hs_call_title,
        CASE WHEN event_type = 'signup' THEN 'COMPLETED' END AS hs_call_status,
        CASE WHEN event_type = 'click' THEN {text} END AS hs_email_subject,
        CASE WHEN event_type = 'click' THEN 'SENT' END AS hs_email_status,
        CASE WHEN event_type = 'purchase' THEN {text} END AS hs_meeting_title,
        CASE WHEN event_type = 'purchase' THEN 'SCHEDULED' END AS hs_meeting_outcome,
        CASE WHEN event_type = 'view' THEN {text} END AS hs_note_body,
        CASE WHEN event_type = 'error' THEN {text} END AS hs_task_subject,
        CASE WHEN event_type = 'error' THEN (CASE WHEN value > 50 THEN 'COMPLETED' ELSE 'NOT_STARTED' END) END AS hs_task_status
      FROM events)"""
    names = f"""owner_names AS (SELECT {clean_id('owner_id')} AS oid,
        max(coalesce(nullif({txt('salesman_name')}, ''), nullif({txt('email')}, ''), {clean_id('owner_id')})) AS oname
      FROM raw_owners WHERE {clean_id('owner_id')} IS NOT NULL GROUP BY 1)"""
    return [contacts, deals, assoc, owners, acts, names]


# ---- parsing (T2) --------------------------------------------------------------------------

def ms_switch_cte(name: str, source: str, cols: list[str]) -> str:
    parts = ["count(*) AS n"]
    for i, c in enumerate(cols):
        num = f"TRY_CAST({c} AS DOUBLE)"
        parts += [f"count({num}) AS c{i}", f"count_if({num} > 1e10) AS g{i}",
                  f"min(CASE WHEN {num} > 1e10 THEN {num} END) AS mg{i}",
                  f"max(CASE WHEN {num} <= 1e10 THEN {num} END) AS ml{i}"]
    flags = ", ".join(
        f"coalesce((c{i} * 2 > n) AND ((g{i} * 2 > c{i}) OR (g{i} * 2 = c{i} AND (mg{i} + ml{i}) / 2 > 1e10)), false) AS f{i}"
        for i in range(len(cols)))
    return f"{name} AS (SELECT {flags} FROM (SELECT {', '.join(parts)} FROM {source}))"


def parsed(col: str, flag: str) -> str:
    num = f"TRY_CAST({col} AS DOUBLE)"
    return (f"(CASE WHEN {flag} THEN make_timestamp(CAST(trunc({num} * 1000) AS BIGINT)) "
            f"ELSE TRY_CAST({strip(f'CAST({col} AS VARCHAR)')} AS TIMESTAMP) END)")


# ---- classification / tuition / revenue ------------------------------------------------------

def source_text_sql(cols: list[str]) -> str:
    joined = "concat_ws(' | ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + ")"
    return f"regexp_replace({strip(joined)}, '^\\|+|\\|+$', '', 'g')"


def source_group_sql(text: str) -> str:
    t = f"lower({strip(f'coalesce({text}, {q(str())})')})"
    return (f"(CASE WHEN {t} = '' THEN 'Unknown' WHEN {contains_any(t, R.PAID_SOCIAL_TERMS)} THEN 'Paid Social' "
            f"WHEN {contains_any(t, R.PAID_SEARCH_TERMS)} THEN 'Paid Search' "
            f"WHEN {contains_any(t, ['organic', 'seo'])} THEN 'Organic Search' "
            f"WHEN {contains_any(t, ['referral', 'refer'])} THEN 'Referral' "
            f"WHEN {contains_any(t, ['email', 'newsletter'])} THEN 'Email' "
            f"WHEN contains({t}, 'direct') THEN 'Direct' ELSE 'Other' END)")


def alias_vendor_sql(low: str) -> str:
    return "(CASE " + " ".join(f"WHEN {contains_any(low, terms)} THEN {q(v)}" for v, terms in R.VENDOR_ALIASES) + " END)"


def first_part_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, '|'), lambda x: {strip('x')}), lambda x: x <> '')[1]"


def vendor_sql(cols: list[str]) -> tuple[str, str, str]:
    hv = [f"(CASE WHEN {txt(c)} <> '' THEN {alias_vendor_sql(f'lower({txt(c)})')} END)" for c in cols]
    mv = [first_part_sql(txt(c)) for c in cols]
    high_v = "coalesce(" + ", ".join(hv) + ")"
    med_v = "coalesce(" + ", ".join(mv) + ")"
    high_f = "(CASE " + " ".join(f"WHEN {h} IS NOT NULL THEN {q(c)}" for h, c in zip(hv, cols)) + " END)"
    med_f = "(CASE " + " ".join(f"WHEN {m} IS NOT NULL THEN {q(c)}" for m, c in zip(mv, cols)) + " END)"
    vendor = f"coalesce({high_v}, {med_v}, 'Unknown')"
    conf = f"(CASE WHEN {high_v} IS NOT NULL THEN 'High' WHEN {med_v} IS NOT NULL THEN 'Medium' ELSE 'Low' END)"
    field = f"coalesce({high_f}, {med_f}, '')"
    return vendor, conf, field


def degree_sql(x: str) -> str:
    t = f"lower({strip(f'CAST({x} AS VARCHAR)')})"
    master = f"({contains_any(t, ['master', 'mba', 'mscis', 'msai', 'ms '])} OR starts_with({t}, 'ms'))"
    return (f"(CASE WHEN {t} IS NULL OR {t} = '' OR {t} IN ('nan','nat','<na>','none') THEN NULL "
            f"WHEN contains({t}, 'certificate') THEN 'Certificate' WHEN contains({t}, 'associate') THEN 'Associate' "
            f"WHEN {contains_any(t, ['bachelor', 'bsba', 'bsbt'])} THEN 'Bachelor' WHEN {master} THEN 'Master' "
            f"WHEN {contains_any(t, ['doctoral', 'doctorate', 'doctor', 'dba'])} THEN 'Doctoral' END)")


def lookup_sql(level: str, idx: int) -> str:
    vals = []
    for row in R.DEGREE_TUITION:
        v = row[idx]
        vals.append(f"WHEN {level} = {q(row[0])} THEN {q(v) if isinstance(v, str) else f'CAST({v} AS DOUBLE)'}")
    return "(CASE " + " ".join(vals) + " END)"


def revenue_cols_sql(total: str, level: str, status: str, stage: str, won: str, lost: str) -> str:
    """SQL select list for the tuition + revenue fields given expressions for the inputs."""
    months, years = lookup_sql(level, 6), lookup_sql(level, 5)
    potential = f"greatest(coalesce({lookup_sql(level, 3)}, 0.0), 0.0)"
    tot = f"greatest(coalesce(TRY_CAST({total} AS DOUBLE), 0.0), 0.0)"
    monthly = f"(CASE WHEN {months} > 0 THEN {tot} / {months} ELSE 0.0 END)"
    p_monthly = f"(CASE WHEN {months} > 0 THEN {potential} / {months} ELSE 0.0 END)"
    st = f"lower(coalesce(CAST({status} AS VARCHAR), ''))"
    sg = f"lower(coalesce(CAST({stage} AS VARCHAR), ''))"
    is_lost = f"({lost} OR regexp_matches({sg}, {q(R.REVENUE_LOST_PATTERN)}))"
    eow = f"(regexp_matches({st}, {q(R.REVENUE_ENROLLED_PATTERN)}) OR {won} OR contains({sg}, 'won'))"
    open_ = f"(NOT {eow} AND NOT {is_lost})"
    cols = [
        f"{level} AS program_degree_level",
        f"{lookup_sql(level, 3)} AS estimated_total_tuition",
        f"{months} AS program_duration_months",
        f"{tot} AS total_program_revenue",
        f"(CASE WHEN {years} > 0 THEN {tot} / {years} ELSE 0.0 END) AS annualized_program_revenue",
    ]
    for name, m in [("six_month_revenue", 6), ("twelve_month_revenue", 12), ("twenty_four_month_revenue", 24)]:
        cols.append(f"least({monthly} * {m}.0, {tot}) AS {name}")
    cols += [f"{potential} AS potential_program_revenue",
             f"(CASE WHEN {years} > 0 THEN {potential} / {years} ELSE 0.0 END) AS potential_annualized_program_revenue"]
    for name, m in [("potential_six_month_revenue", 6), ("potential_twelve_month_revenue", 12),
                    ("potential_twenty_four_month_revenue", 24)]:
        cols.append(f"least({p_monthly} * {m}.0, {potential}) AS {name}")
    cols += [f"(CASE WHEN {open_} THEN {potential} ELSE 0.0 END) AS potential_revenue",
             f"(CASE WHEN {eow} THEN {potential} ELSE 0.0 END) AS enrolled_revenue",
             f"(CASE WHEN {open_} THEN {potential} ELSE 0.0 END) AS open_pipeline_potential_revenue"]
    return ",\n        ".join(cols)


# ---- silver --------------------------------------------------------------------------------

CONTACT_BASE_ORDER = (["contact_id", "_seq", "contact_created_at", "contact_owner_id", "owner_assigned_date",
                       "first_name", "last_name", "full_name", "student_name"] + R.CONTACT_TEXT_FIELDS
                      + ["program_total_tuition", "salesman_id", "salesman_name"])
CONTACT_DATES = [("contact_created_at", "createdate"), ("owner_assigned_date", "hubspot_owner_assigneddate"),
                 ("enrollment_date", "enrollment_date"), ("application_date", "application_date"),
                 ("last_activity_date", "notes_last_updated"), ("first_activity_date", "hs_first_outreach_date"),
                 ("next_activity_date", "notes_next_activity_date"), ("first_outreach_date", "hs_first_outreach_date")]
# Resolved logical -> physical for the CRM view (mapping + fallbacks); missing ones are NULL.
CONTACT_TEXT = {"email": "email", "phone": "phone", "lifecycle_stage": "lifecyclestage", "lead_status": "hs_lead_status",
                "utm_source": "utm_source", "utm_medium": "utm_medium", "utm_campaign": "utm_campaign",
                "campaign": "utm_campaign", "program": "program", "degree_level": "degree_level",
                "enrollment_status": "enrollment_status", "start_term": "session_start", "cohort": "cohort",
                "campus": "campus_location", "modality": "modality"}


def silver_ctes() -> list[str]:
    ctes = view_ctes()
    ctes.append(ms_switch_cte("c_flags", "raw_contacts", [raw for _, raw in CONTACT_DATES]))
    date_cols = ",\n        ".join(f"{parsed(raw, f'(SELECT f{i} FROM c_flags)')} AS {name}"
                                   for i, (name, raw) in enumerate(CONTACT_DATES))
    text_cols = []
    for name in R.CONTACT_TEXT_FIELDS:
        if name in dict(CONTACT_DATES) or name in R.CONTACT_DATE_FIELDS or name in (
                "num_notes", "number_of_sales_activities", "time_to_first_engagement"):
            continue
        text_cols.append(f"{CONTACT_TEXT[name] if name in CONTACT_TEXT else 'CAST(NULL AS VARCHAR)'} AS {name}")
    gen_name = strip(f"{txt('firstname')} || ' ' || {txt('lastname')}")
    ctes.append(f"""c0 AS (SELECT {clean_id('hs_object_id')} AS contact_id,
        TRY_CAST({clean_id('hs_object_id')} AS BIGINT) AS _seq,
        {clean_id('hubspot_owner_id')} AS contact_owner_id,
        firstname AS first_name, lastname AS last_name,
        CASE WHEN {txt(gen_name)} <> '' THEN {gen_name} END AS full_name,
        {', '.join(text_cols)},
        {date_cols},
        CAST(NULL AS TIMESTAMP) AS last_sales_activity_timestamp, CAST(NULL AS TIMESTAMP) AS first_engagement_date,
        coalesce(TRY_CAST(num_notes AS DOUBLE), 0.0) AS num_notes,
        coalesce(TRY_CAST(num_notes AS DOUBLE), coalesce(TRY_CAST(num_notes AS DOUBLE), 0.0)) AS number_of_sales_activities,
        TRY_CAST(hs_time_to_first_engagement AS DOUBLE) AS time_to_first_engagement,
        coalesce(TRY_CAST(standard_tuition_total AS DOUBLE), 0.0) AS program_total_tuition
      FROM raw_contacts)""")
    src_cols = vendor_source_columns(CONTACT_BASE_ORDER)
    vendor, conf, field = vendor_sql(src_cols)
    level = f"coalesce({degree_sql('degree_level')}, {degree_sql('program')})"
    ctes.append(f"""c1 AS (SELECT c0.* EXCLUDE (vendor) REPLACE (nullif(program, '') AS program),
        full_name AS student_name, contact_owner_id AS salesman_id,
        coalesce(owner_names.oname, 'Unassigned') AS salesman_name,
        {source_text_sql(src_cols)} AS source_text,
        {vendor} AS vendor, {conf} AS vendor_confidence, {field} AS vendor_source_field,
        {degree_sql('degree_level')} AS __explicit, {degree_sql('program')} AS __inferred
      FROM c0 LEFT JOIN owner_names ON owner_names.oid = c0.contact_owner_id)""")
    ctes.append(f"""c2 AS (SELECT c1.*, {contains_any('lower(source_text)', R.PAID_TERMS)} AS paid_lead_flag,
        {source_group_sql('source_text')} AS source_group, vendor AS paid_vendor,
        coalesce(__explicit, __inferred) AS degree_level_resolved,
        CASE WHEN __explicit IS NOT NULL THEN 'High' WHEN __inferred IS NOT NULL THEN 'Medium' ELSE 'Low' END AS revenue_confidence,
        {revenue_cols_sql('0', 'coalesce(__explicit, __inferred)', 'enrollment_status', "''", 'false', 'false')}
      FROM c1)""")
    # deals
    ctes.append(ms_switch_cte("d_flags", "raw_deals", ["createdate", "closedate"]))
    ctes.append(f"""deals_clean AS (SELECT {clean_id('hs_object_id')} AS deal_id,
        TRY_CAST({clean_id('hs_object_id')} AS BIGINT) AS _deal_seq,
        {parsed('createdate', '(SELECT f0 FROM d_flags)')} AS deal_created_at,
        {clean_id('hubspot_owner_id')} AS deal_owner_id, dealstage AS deal_stage, pipeline,
        {parsed('closedate', '(SELECT f1 FROM d_flags)')} AS close_date,
        CAST(NULL AS TIMESTAMP) AS closed_won_date,
        coalesce(TRY_CAST(amount AS DOUBLE), 0.0) AS deal_amount,
        coalesce(TRY_CAST(amount AS DOUBLE), coalesce(TRY_CAST(amount AS DOUBLE), 0.0), 0.0) AS revenue,
        contains(lower(coalesce(dealstage, '')), 'won') AS is_won,
        contains(lower(coalesce(dealstage, '')), 'lost') AS is_lost
      FROM raw_deals)""")
    ctes.append(f"""links AS (SELECT DISTINCT {clean_id('contact_id')} AS contact_id, {clean_id('deal_id')} AS deal_id,
        association_type FROM raw_associations
        WHERE {clean_id('contact_id')} IS NOT NULL AND {clean_id('deal_id')} IS NOT NULL)""")
    order_c = "coalesce(TRY_CAST(contact_id AS BIGINT), 9223372036854775807), contact_id, coalesce(association_type, '')"
    order_d = "coalesce(TRY_CAST(l.deal_id AS BIGINT), 9223372036854775807), l.deal_id, coalesce(l.association_type, '')"
    ctes.append(f"""ld AS (SELECT l.contact_id, l.deal_id, l.association_type, d.deal_owner_id, d.deal_created_at,
        {strip("coalesce(d.deal_stage, '')")} AS stage_txt,
        coalesce(d.is_won, false) AS won, coalesce(d.is_lost, false) AS lost,
        row_number() OVER (PARTITION BY l.contact_id, d.deal_owner_id IS NOT NULL ORDER BY {order_d}) AS owner_rn,
        row_number() OVER (PARTITION BY l.contact_id, {strip("coalesce(d.deal_stage, '')")} <> ''
                           ORDER BY d.deal_created_at IS NOT NULL DESC, d.deal_created_at DESC,
                           coalesce(TRY_CAST(l.deal_id AS BIGINT), 9223372036854775807) DESC, l.deal_id DESC,
                           coalesce(l.association_type, '') DESC) AS stage_rn
      FROM links l LEFT JOIN deals_clean d ON d.deal_id = l.deal_id)""")
    ctes.append("""summary AS (SELECT contact_id, bool_or(NOT won AND NOT lost) AS s_open, bool_or(won) AS s_won,
        bool_or(lost) AS s_lost,
        max(CASE WHEN owner_rn = 1 AND deal_owner_id IS NOT NULL THEN deal_owner_id END) AS fallback_deal_owner_id,
        max(CASE WHEN stage_rn = 1 AND stage_txt <> '' THEN stage_txt END) AS s_stage
      FROM ld GROUP BY contact_id)""")
    ctes.append("""c3 AS (SELECT c2.* EXCLUDE (salesman_id, salesman_name),
        coalesce(s.s_open, false) AS has_open_deal, coalesce(s.s_won, false) AS has_won_deal,
        coalesce(s.s_lost, false) AS has_lost_deal, s.s_stage AS latest_deal_stage,
        (c2.contact_owner_id IS NULL AND s.fallback_deal_owner_id IS NOT NULL) AS __fb,
        CASE WHEN c2.contact_owner_id IS NULL AND s.fallback_deal_owner_id IS NOT NULL THEN s.fallback_deal_owner_id
             ELSE c2.salesman_id END AS salesman_id
      FROM c2 LEFT JOIN summary s ON s.contact_id = c2.contact_id)""")
    status = ("concat_ws(' | ', " + ", ".join(
        f"CASE WHEN {txt(c)} <> '' THEN CAST({c} AS VARCHAR) END"
        for c in ["lifecycle_stage", "lead_status", "latest_deal_stage"]) + ")")
    st = f"lower({status})"
    age = days_floor("contact_created_at", TODAY_TS)
    inactive = days_floor("last_activity_date", TODAY_TS)
    ctes.append(f"""c4 AS (SELECT c3.*, coalesce(owner_names.oname, 'Unassigned') AS salesman_name,
        CASE WHEN c3.salesman_id IS NULL THEN 'missing_owner' WHEN __fb THEN 'fallback_to_deal_owner' ELSE 'contact_owner' END
          AS contact_attribution_type,
        {age} AS lead_age_days, {inactive} AS days_since_last_activity,
        last_activity_date IS NULL AS never_contacted, {st} AS __status
      FROM c3 LEFT JOIN owner_names ON owner_names.oid = c3.salesman_id)""")
    reach = f"({txt_na('email')} <> '' OR {txt_na('phone')} <> '')"

    def pts(cond, p):
        return f"(CASE WHEN coalesce({cond}, false) THEN {p} ELSE 0 END)"

    score = " + ".join([
        pts("lead_age_days <= 7", 25), pts("paid_lead_flag", 15), pts(contains_any("__status", R.QUALIFIED_TERMS), 20),
        pts("has_open_deal", 25), pts("days_since_last_activity <= 7", 20), pts("next_activity_date IS NOT NULL", 10),
        pts(reach, 5), pts("days_since_last_activity BETWEEN 15 AND 30", -20), pts("days_since_last_activity > 30", -40),
        pts("lead_age_days > 45 AND NOT has_open_deal", -25)])
    ctes.append(f"c5 AS (SELECT c4.*, {score} AS lead_score FROM c4)")
    reason = (f"coalesce({first_term('__status', R.SCORING_DEAD_TERMS, lambda t: t.replace(' ', '_'))}, "
              f"CASE WHEN lead_age_days > 60 AND NOT has_open_deal AND (days_since_last_activity IS NULL OR days_since_last_activity >= 30) "
              f"THEN 'inactive_60_days_no_open_deal' WHEN lead_age_days > 30 AND never_contacted THEN 'never_contacted_30_days' "
              f"WHEN lead_score < 15 THEN 'low_score' ELSE '' END)")
    ctes.append(f"c6 AS (SELECT c5.*, {reason} AS dead_reason FROM c5)")
    temp = (f"(CASE WHEN dead_reason <> '' OR lead_score < 15 THEN 'Dead' "
            f"WHEN lead_score >= 60 AND NOT {contains_any('__status', ['lost', 'disqualified'])} THEN 'Hot' "
            f"WHEN lead_score BETWEEN 35 AND 59 THEN 'Warm' ELSE 'Cold' END)")
    ctes.append(f"contacts_clean AS (SELECT c6.* EXCLUDE (__status), {temp} AS lead_temperature FROM c6)")
    # fact
    ctes.append(f"""deal_stats AS (SELECT deal_id, count(DISTINCT contact_id) AS deal_contact_count FROM links GROUP BY deal_id)""")
    ctes.append(f"""link_rank AS (SELECT l.*, row_number() OVER (PARTITION BY deal_id ORDER BY {order_c}) AS deal_rn FROM links l)""")
    fact_cols = ["contact_id", "deal_id", "fact_record_type", "contact_owner_id", "deal_owner_id", "deal_contact_count",
                 "__countable", "revenue", "is_won", "is_lost", "program_total_tuition", "program", "degree_level_resolved",
                 "revenue_confidence", "enrollment_status", "deal_stage", "close_date", "closed_won_date",
                 "contact_created_at", "deal_created_at", "paid_lead_flag", "source_group", "utm_campaign", "utm_source",
                 "vendor", "paid_vendor", "lead_temperature", "has_won_deal", "has_open_deal", "enrollment_date"]
    c_only = {"program_total_tuition", "program", "degree_level_resolved", "revenue_confidence", "enrollment_status",
              "contact_created_at", "paid_lead_flag", "source_group", "utm_campaign", "utm_source", "vendor", "paid_vendor",
              "lead_temperature", "has_won_deal", "has_open_deal", "enrollment_date", "contact_owner_id"}
    d_only = {"revenue", "is_won", "is_lost", "deal_stage", "close_date", "closed_won_date", "deal_created_at", "deal_owner_id"}

    def sel(kind):
        out = []
        for col in fact_cols:
            if col in ("contact_id", "deal_id"):
                src = {"assoc": f"lr.{col}", "contact": "c.contact_id" if col == "contact_id" else "CAST(NULL AS VARCHAR)",
                       "deal": "d.deal_id" if col == "deal_id" else "CAST(NULL AS VARCHAR)"}[kind]
            elif col == "fact_record_type":
                src = {"assoc": "'associated'", "contact": "'contact_without_deal'", "deal": "'deal_without_contact'"}[kind]
            elif col == "deal_contact_count":
                src = "coalesce(ds.deal_contact_count, 0)" if kind == "assoc" else "0"
            elif col == "__countable":
                src = {"assoc": "lr.deal_rn = 1", "contact": "false", "deal": "true"}[kind]
            elif col in c_only:
                src = f"c.{col}" if kind in ("assoc", "contact") else "NULL"
            elif col in d_only:
                src = f"d.{col}" if kind in ("assoc", "deal") else "NULL"
            out.append(f"{src} AS {col}")
        return ", ".join(out)

    ctes.append(f"""cdedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY _seq DESC NULLS LAST) AS __rn
        FROM contacts_clean WHERE contact_id IS NOT NULL) WHERE __rn = 1)""")
    ctes.append(f"""f0 AS (
        SELECT {sel('assoc')} FROM link_rank lr LEFT JOIN deal_stats ds ON ds.deal_id = lr.deal_id
          LEFT JOIN deals_clean d ON d.deal_id = lr.deal_id LEFT JOIN cdedup c ON c.contact_id = lr.contact_id
        UNION ALL
        SELECT {sel('contact')} FROM cdedup c WHERE c.contact_id NOT IN (SELECT contact_id FROM links)
        UNION ALL
        SELECT {sel('deal')} FROM deals_clean d WHERE d.deal_id IS NOT NULL AND d.deal_id NOT IN (SELECT deal_id FROM links))""")
    ctes.append("""f1 AS (SELECT f0.* EXCLUDE (__countable, revenue, is_won, is_lost),
        coalesce(contact_owner_id, deal_owner_id) AS salesman_id,
        CASE WHEN contact_owner_id IS NOT NULL THEN 'contact_owner' WHEN deal_owner_id IS NOT NULL THEN 'fallback_to_deal_owner'
             ELSE 'missing_owner' END AS attribution_type,
        coalesce(__countable, false) AND deal_id IS NOT NULL AS revenue_countable,
        coalesce(TRY_CAST(revenue AS DOUBLE), 0.0) AS revenue, coalesce(is_won, false) AS is_won, coalesce(is_lost, false) AS is_lost
      FROM f0)""")
    ct = "greatest(coalesce(TRY_CAST(program_total_tuition AS DOUBLE), 0.0), 0.0)"
    dr = "greatest(revenue, 0.0)"
    explicit = f"(CASE WHEN coalesce(revenue_confidence, '') = 'High' THEN degree_level_resolved END)"
    flevel = f"coalesce({degree_sql(explicit)}, {degree_sql('program')})"
    pub = f"greatest(coalesce({lookup_sql(flevel, 3)}, 0.0), 0.0)"
    ctes.append(f"""f2 AS (SELECT f1.*, coalesce(owner_names.oname, 'Unassigned') AS salesman_name,
        revenue_countable AS deal_countable,
        CASE WHEN revenue_countable AND is_won THEN revenue ELSE 0.0 END AS revenue_attributed,
        CASE WHEN revenue_countable AND is_won THEN 1 ELSE 0 END AS won_deal_count,
        CASE WHEN NOT (revenue_countable AND is_won) THEN 0.0 WHEN {ct} > 0 THEN {ct} WHEN {dr} > 0 THEN {dr} ELSE {pub} END
          AS program_revenue_input,
        CASE WHEN NOT (revenue_countable AND is_won) THEN 'not_countable_or_not_won' WHEN {ct} > 0 THEN 'contact_program_total_tuition'
             WHEN {dr} > 0 THEN 'deal_revenue' WHEN {pub} > 0 THEN {q(R.TUITION_SOURCE_LABEL)} ELSE 'missing_revenue' END
          AS program_revenue_source,
        {flevel} AS __flevel
      FROM f1 LEFT JOIN owner_names ON owner_names.oid = f1.salesman_id)""")
    days = days_floor("coalesce(contact_created_at, deal_created_at)", "close_date")
    ctes.append(f"""lead_deal_fact AS (SELECT f2.* EXCLUDE (__flevel, program_revenue_input),
        program_revenue_input,
        {revenue_cols_sql('program_revenue_input', '__flevel', 'enrollment_status', 'deal_stage', 'is_won', 'is_lost')},
        (deal_contact_count > 1 OR attribution_type = 'missing_owner') AS unclear_revenue_attribution,
        CASE WHEN {days} >= 0 THEN {days} END AS days_to_close
      FROM f2)""")
    return ctes


def with_silver(select_sql: str) -> str:
    return "WITH " + ",\n".join(silver_ctes()) + "\n" + select_sql


# ---- activity events -----------------------------------------------------------------------
RAW_ACTIVITY_COLUMNS = ["activity_type", "hs_object_id", "contact_id", "hs_timestamp", "hubspot_owner_id",
                        "hs_call_title", "hs_call_status", "hs_email_subject", "hs_email_status", "hs_meeting_title",
                        "hs_meeting_outcome", "hs_note_body", "hs_task_subject", "hs_task_status"]


def activity_ctes() -> list[str]:
    at = f"lower({txt('activity_type')})"
    label = ("(CASE " + " ".join(f"WHEN {at} = {q(k)} THEN {q(v)}" for k, v in R.ACTIVITY_TYPE_LABELS)
             + f" WHEN {at} <> '' THEN upper({at}[1]) || {at}[2:] ELSE 'Activity' END)")

    def per_type(table):
        parts = []
        for key, fields in table:
            present = [f"nullif({txt(f)}, '')" for f in fields if f in RAW_ACTIVITY_COLUMNS]
            val = f"coalesce({', '.join(present)}, '')" if present else "''"
            parts.append(f"WHEN {at} = {q(key)} THEN {val}")
        return "(CASE " + " ".join(parts) + " ELSE '' END)"

    return [
        f"""a0 AS (SELECT {txt('contact_id')} AS contact_id, {txt('coalesce(nullif(' + txt('hs_object_id') + ", ''), NULL)")} AS activity_id,
            CASE WHEN {txt('hs_timestamp')} <> '' THEN hs_timestamp END AS event_raw, {label} AS event_type,
            {clean_id('hubspot_owner_id')} AS owner_id, {per_type(R.ACTIVITY_DESCRIPTION_FIELDS)} AS description,
            {per_type(R.ACTIVITY_OUTCOME_FIELDS)} AS outcome, 'activity_object' AS source FROM raw_activities)""",
        ms_switch_cte("a_flags", "a0", ["event_raw"]),
        f"""activity_events AS (SELECT DISTINCT a0.contact_id, a0.activity_id, {parsed('event_raw', '(SELECT f0 FROM a_flags)')} AS event_date,
            a0.event_type, a0.owner_id, coalesce(owner_names.oname, 'Unassigned') AS owner, a0.description, a0.outcome, a0.source
          FROM a0 LEFT JOIN owner_names ON owner_names.oid = a0.owner_id
          WHERE a0.contact_id <> '' AND {parsed('event_raw', '(SELECT f0 FROM a_flags)')} IS NOT NULL)""",
    ]
