"""Queries over landed files: JSON pages with rejects, activity tables per type, versioned tables, baselines.

Each query lands what a refresh would land (files derived from the driver tables, below the shared
folder) and reads it back through the library; the SQL derives the same rows from the driver tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import tuition as TU
from ..functions.expr import sum_money
from ..operators import privacy as _PR
from ..operators import textjobs as _TJ
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import baseline as _BL
from ..sources import crm_view as CV
from ..sources import landed as _L
from ..sources import payloads as _PL
from ..sources import versions as V
from . import oracle as O
from . import registry as G
from .process import gold_facts

QUERIES: dict = {}
ORACLE: dict = {}


def landing_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"


# ---- owners, activity links, activities ---------------------------------------------------------

def _owner_pages(spark, d):
    return _L.read_landed_pages(spark, _L.owner_pages(spark, d, landing_folder(spark) + "/owners"), _PL.OWNER_PAGE_SCHEMA)


def _link_pages(spark, d):
    folders = _L.activity_link_pages(spark, d, landing_folder(spark))
    return {name: _L.read_landed_pages(spark, folder, _PL.LINK_PAGE_SCHEMA) for name, folder in folders.items()}


def _activity_links(spark, d):
    out = None
    for name, (good, _) in _link_pages(spark, d).items():
        part = _PL.flatten_activity_links(good, name)
        out = part if out is None else out.unionByName(part)
    return out


def q_landed_rejects(spark, d):
    rejects = {"owners": _owner_pages(spark, d)[1]} | {name: bad for name, (_, bad) in _link_pages(spark, d).items()}
    return _L.reject_counts(rejects)


def q_union_activities(spark, d):
    folder = _L.activity_tables(spark, d, landing_folder(spark))
    frames = _L.landed_tables(spark, folder, [*_L.LANDED_TYPES, _L.NOT_LANDED])
    out = _L.union_activities(frames, _activity_links(spark, d))
    return out.select("activity_type", "activity_id", "contact_id", "association_type", "hs_object_id", "hs_timestamp", "hs_call_title",
                      "hs_email_opens", "hs_meeting_hours", F.col("hs_meeting_place.number").alias("hs_meeting_place_number"))


def _page_sql(key: str) -> str:
    return f"({key} // {_L.PAGE_SIZE})"


def _page_kept_sql(key: str) -> str:
    return f"{_page_sql(key)} % {_L.BROKEN_EVERY} <> 3 AND {_page_sql(key)} % {_L.ERROR_EVERY} <> 5"


def _type_sql() -> str:
    return "(CASE event_type " + " ".join(f"WHEN '{kind}' THEN '{name}'" for name, kind in _L.LANDED_TYPES.items()) + " END)"


def _links_cte() -> str:
    return f"""landed AS (SELECT *, {_type_sql()} AS activity_type FROM events WHERE {_type_sql()} IS NOT NULL),
      links AS (SELECT DISTINCT activity_type, CAST(event_id AS VARCHAR) AS activity_id, CAST(contact AS VARCHAR) AS contact_id, type FROM (
        SELECT activity_type, event_id, user_id AS contact,
          CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Primary' ELSE CAST(event_id % 9 AS VARCHAR) END AS type
        FROM landed WHERE {_page_kept_sql('event_id')} AND event_id % 10 <> 1
        UNION ALL SELECT activity_type, event_id, user_id + 1,
          CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Primary' ELSE CAST(event_id % 9 AS VARCHAR) END
        FROM landed WHERE {_page_kept_sql('event_id')} AND event_id % 10 = 0))"""


def sql_flatten_owners() -> str:
    return f"""SELECT id AS owner_id, CAST(s_suppkey + 100000 AS VARCHAR) AS user_id, email, first_name, last_name,
        coalesce(nullif(trim(coalesce(trim(first_name), '') || ' ' || coalesce(last_name, '')), ''), email, id) AS salesman_name,
        s_suppkey % 6 = 0 AS archived
      FROM (SELECT *, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 4 <> 0 THEN 's' || s_suppkey || '@x.org' END AS email,
          CASE s_suppkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Supplier' END AS first_name,
          CASE WHEN s_suppkey % 5 < 2 THEN string_split(s_name, '#')[-1] END AS last_name
        FROM supplier WHERE {_page_kept_sql('s_suppkey')})"""


def sql_flatten_activity_links() -> str:
    return f"WITH {_links_cte()} SELECT activity_type, activity_id, contact_id, type FROM links"


def sql_union_activities() -> str:
    return f"""WITH {_links_cte()}
      SELECT a.activity_type, nullif(a.activity_id, '') AS activity_id, l.contact_id, l.type AS association_type, a.hs_object_id,
        CAST(epoch_us(a.ts) // 1000 AS VARCHAR) AS hs_timestamp, CASE WHEN a.activity_type = 'calls' THEN json_extract_string(a.props, '$.k') END AS hs_call_title,
        CASE WHEN a.activity_type = 'emails' THEN CAST(event_id % 5 AS INTEGER) END AS hs_email_opens,
        CASE WHEN a.activity_type = 'meetings' THEN a.value END AS hs_meeting_hours,
        CASE WHEN a.activity_type = 'meetings' THEN event_id % 30 END AS hs_meeting_place_number
      FROM (SELECT *, CASE WHEN event_id % 40 = 0 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS hs_object_id,
              CASE WHEN event_id % 40 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS activity_id FROM landed) a
        LEFT JOIN links l ON l.activity_type = a.activity_type AND l.activity_id = a.activity_id"""


def sql_landed_rejects() -> str:
    pages = f"""SELECT DISTINCT 'owners' AS kind, {_page_sql('s_suppkey')} AS page FROM supplier
      UNION SELECT {_type_sql()}, {_page_sql('event_id')} FROM events WHERE {_type_sql()} IS NOT NULL"""
    return f"""SELECT kind, CASE WHEN page % {_L.BROKEN_EVERY} = 3 THEN 'broken' ELSE 'no results' END AS reject_reason, count(*) AS pages
      FROM ({pages}) WHERE page % {_L.BROKEN_EVERY} = 3 OR page % {_L.ERROR_EVERY} = 5 GROUP BY 1, 2"""


QUERIES.update({
    "flatten_owners": lambda s, d: _PL.flatten_owners(_owner_pages(s, d)[0]),
    "flatten_activity_links": _activity_links,
    "union_activities": q_union_activities,
    "landed_rejects": q_landed_rejects,
})
ORACLE.update({
    "flatten_owners": sql_flatten_owners,
    "flatten_activity_links": sql_flatten_activity_links,
    "union_activities": sql_union_activities,
    "landed_rejects": sql_landed_rejects,
})


# ---- versioned tables, freshness, gold facts, the published baseline ------------------------------

REFRESHED_AT = "2001-07-31 06:00:00"
EXPECTED_TABLES = ["contacts_clean", "deals_clean", "lead_deal_fact", "student_journey_fact", "cohort_fact", "vendor_fact",
                   "salesman_revenue_fact", "activity_events"]


def _gold_store(spark, d) -> str:
    """The store after two refreshes: the silver tables, the fact by month of closing, then the gold facts."""
    def build():
        root = landing_folder(spark)
        s = G._s(spark, d)
        fact = s["lead_deal_fact"].withColumn("close_month", V.month_of(F.col("close_date")))
        V.commit_tables(spark, root, {"contacts_clean": s["contacts_clean"], "lead_deal_fact": fact, "deals_clean": s["deals_clean"].limit(0)},
                        partitions={"lead_deal_fact": ["close_month"]}, at="2001-07-30 06:00:00")
        gold = gold_facts(s, CV.vendor_costs_raw(spark, d), CV.TODAY)
        V.commit_tables(spark, root, gold | {"deals_clean": s["deals_clean"], "late_links": s["links"].limit(0)}, at=REFRESHED_AT)
        return root
    return G._landed(spark, d, "gold store", build)


def q_gold_facts(spark, d):
    return V.stored_tables(spark, _gold_store(spark, d))


def sql_gold_facts() -> str:
    parts = [f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM ({sql})) AS rows, {version} AS table_version, '{by}' AS partitioned_by" for name, sql, version, by in [
        ("contacts_clean", G._sql("SELECT contact_id FROM contacts_clean"), 1, ""),
        ("lead_deal_fact", G._sql("SELECT deal_id FROM lead_deal_fact"), 1, "close_month"),
        ("deals_clean", G._sql("SELECT deal_id FROM deals_clean"), 2, ""),
        ("student_journey_fact", G.ORACLE["student_journey_fact"](), 2, ""), ("cohort_fact", G.ORACLE["cohort_fields"](), 2, ""),
        ("vendor_fact", G.ORACLE["paid_vendor_performance"](), 2, ""), ("salesman_revenue_fact", G.ORACLE["salesman_metrics"](), 2, ""),
        ("late_links", "SELECT 1 WHERE false", 2, "")]]
    return " UNION ALL ".join(parts)


def q_table_freshness(spark, d):
    """From the manifest alone; the empty and missing tables as one text."""
    row = V.stored_freshness(spark, _gold_store(spark, d), CV.TODAY, EXPECTED_TABLES)
    return row.withColumn("empty_tables", F.array_join("empty_tables", ","))


def sql_table_freshness() -> str:
    return f"""SELECT TIMESTAMP '{REFRESHED_AT}' AS last_refresh, (epoch(TIMESTAMP '{CV.TODAY}') - epoch(TIMESTAMP '{REFRESHED_AT}')) / 3600.0 AS age_hours,
        epoch(TIMESTAMP '{CV.TODAY}') - epoch(TIMESTAMP '{REFRESHED_AT}') > 24 * 3600 AS stale, 'activity_events,late_links' AS empty_tables,
        (SELECT count(*) FROM orders) > 0 AS has_cache"""


FACT_MONTHS = ("1996-01", "1996-06")


def q_load_tables(spark, d):
    """Half a year of the stored fact: only its months' folders are read."""
    fact = V.read_tables(spark, _gold_store(spark, d), ["lead_deal_fact"])["lead_deal_fact"]
    return fact.where(F.col("close_month").between(*FACT_MONTHS)).groupBy("close_month").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_won").alias("won"), sum_money(F.col("revenue_attributed")).alias("revenue"))


def sql_load_tables() -> str:
    return G._sql(f"""SELECT strftime(close_date, '%Y-%m') AS close_month, count(*) AS rows, count_if(is_won) AS won, {O.money_sum('revenue_attributed')} AS revenue
        FROM lead_deal_fact WHERE strftime(close_date, '%Y-%m') BETWEEN '{FACT_MONTHS[0]}' AND '{FACT_MONTHS[1]}' GROUP BY 1""")


def q_published_baseline(spark, d):
    """What a reader finds in the published baseline: per table and owner label the rows and the sum of its figure."""
    leads, enr, (_, alloc, _, _) = G._leads(spark, d), G._enr(spark, d), G._grid(spark, d)
    paid = leads.where(F.col("lead_type") == "Paid")
    root = landing_folder(spark)
    _PR.publish_baseline(spark, root, {"leads": leads, "paid_leads": paid, "enrollments": enr, "allocations": alloc}, G._owner_map(spark, d),
                         _PR.public_metadata(leads, paid, enr, alloc), {"enrollments": G.STUDENT_ORDER}, at=REFRESHED_AT)
    held = V.read_tables(spark, root)
    out = None
    for name, label, figure in PUBLISHED:
        value = F.lit(0.0) if figure is None else F.col(figure)
        part = held[name].groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"), sum_money(value).alias("figure"))
        part = part.select(F.lit(name).alias("table"), "label", "rows", "figure")
        out = part if out is None else out.unionByName(part)
    meta = held["metadata"]
    return out.unionByName(meta.select(F.lit("metadata").alias("table"), F.lit(None).cast("string").alias("label"), F.col("udr_rows").alias("rows"),
                                       F.col("tracker_revenue").alias("figure")))


PUBLISHED = [("leads", "contact_owner", None), ("paid_leads", "contact_owner", None), ("enrollments", "udr", "revenue"), ("allocations", "budget_name", "planned_budget")]


def sql_published_baseline() -> str:
    source = {"leads": "leads_f", "paid_leads": "(SELECT * FROM leads_f WHERE lead_type = 'Paid')", "enrollments": "enr", "allocations": "allocations"}
    parts = []
    for name, label, figure in PUBLISHED:
        amount = "0.0" if figure is None else O.money_sum(f"t.{figure}")
        parts.append(f"""SELECT '{name}' AS "table", coalesce(m.pseudonym, t.{label}) AS label, count(*) AS rows, {amount} AS figure
          FROM {source[name]} t LEFT JOIN owner_map m ON m.label = {O.txt(f't.{label}')} GROUP BY 2""")
    parts.append(f"SELECT 'metadata', NULL, (SELECT count(*) FROM leads_f), {O.money_sum('revenue')} FROM enr")
    return G._usql(" UNION ALL ".join(parts), [G._owner_map_sql()], leads=True, enr=True, grid=True)


QUERIES.update({"gold_facts": q_gold_facts, "table_freshness": q_table_freshness, "load_tables": q_load_tables, "published_baseline": q_published_baseline})
ORACLE.update({"gold_facts": sql_gold_facts, "table_freshness": sql_table_freshness, "load_tables": sql_load_tables,
               "published_baseline": sql_published_baseline})


# ---- typed baseline files -------------------------------------------------------------------------

def _baseline_files(spark, d):
    def build():
        folder = _BL.enrollment_files(spark, d, landing_folder(spark) + "/enrollments")
        return _BL.load_baseline(spark, folder, _BL.ENROLLMENT_COLUMNS, "row_key", "enrollments")
    return G._landed(spark, d, "baseline files", build)


def sql_load_baseline() -> str:
    flags = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(["true", "false", "true", "NULL", "false"]))
    return f"""SELECT 'E' || k AS row_key, 'S' || k AS student, CASE WHEN k % 41 <> 0 THEN o_orderdate END AS enrolled_date,
        CASE WHEN k % 53 <> 0 AND k % 19 <> 0 THEN o_totalprice END AS revenue,
        CASE WHEN k % 29 = 0 THEN NULL WHEN k % 7 = 0 THEN k % 90 ELSE k % 90 - 5 END AS days_to_enroll,
        CASE WHEN k % 37 <> 0 THEN CASE k % 5 {flags} END END AS title_iv, CAST(NULL AS TIMESTAMP) AS term
      FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 97 <> 0"""


def sql_load_baseline_rejects() -> str:
    day = """CASE k % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"""
    flag = "CASE k % 5 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN 'YES' WHEN 3 THEN '' ELSE 'no' END"
    days = "CASE WHEN k % 29 = 0 THEN '12.5' WHEN k % 7 = 0 THEN (k % 90) || '.0' ELSE CAST(k % 90 - 5 AS VARCHAR) END"
    cells = " UNION ALL ".join(f"SELECT k, '{c}' AS \"column\", '{v}' AS value FROM o WHERE k % {n} = 0" for c, v, n in [
        ("enrolled_date", "TBD", 41), ("revenue", "n/a", 53), ("days_to_enroll", "12.5", 29), ("title_iv", "maybe", 37)])
    return f"""WITH o AS (SELECT *, o_orderkey AS k FROM orders)
      SELECT 'enrollments' AS "table", 'value' AS reason, 'E' || k AS row_key, "column", value FROM ({cells}) WHERE k % 97 <> 0
      UNION ALL SELECT 'enrollments', 'row', NULL, NULL, 'E' || k || ',Last, S' || k || ',' || CASE WHEN k % 41 = 0 THEN 'TBD' ELSE {day} END || ',' ||
        CASE WHEN k % 53 = 0 THEN 'n/a' WHEN k % 19 = 0 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END || ',' || {days} || ',' ||
        CASE WHEN k % 37 = 0 THEN 'maybe' ELSE {flag} END FROM o WHERE k % 97 = 0"""


QUERIES.update({"load_baseline": lambda s, d: _baseline_files(s, d)[0], "load_baseline_rejects": lambda s, d: _baseline_files(s, d)[1]})
ORACLE.update({"load_baseline": sql_load_baseline, "load_baseline_rejects": sql_load_baseline_rejects})


# ---- published prices, tuition rules --------------------------------------------------------------

def _prices(spark, d):
    def build():
        pages = _TJ.read_text_pages(spark, _L.land_price_pages(spark, d, landing_folder(spark) + "/prices"))
        return cut_lineage(_TJ.extract_price_table(pages))
    return G._landed(spark, d, "prices", build)


def _tuition_rules(spark, d):
    """The fixed table, refreshed from the newest published prices, then the landed overrides."""
    def build():
        folder = _BL.override_files(spark, d, landing_folder(spark) + "/overrides")
        overrides, _ = _BL.load_baseline(spark, folder, _BL.OVERRIDE_COLUMNS, "program_degree_level", "overrides")
        return cut_lineage(TU.overridden(TU.refreshed_tuition(TU.tuition_table(spark), _prices(spark, d)), overrides))
    return G._landed(spark, d, "tuition rules", build)


PROGRAM_REVENUE_COLUMNS = ["hs_object_id", "program_degree_level", "tuition_per_credit", "credits_required", "estimated_total_tuition",
                           "estimated_annual_tuition", "program_duration_years", "program_duration_months", "duration_note", "revenue_confidence",
                           "total_program_revenue", "annualized_program_revenue", "six_month_revenue", "potential_six_month_revenue",
                           "potential_revenue", "enrolled_revenue", "revenue_realization_note"]


def q_program_revenue(spark, d):
    out = TU.add_program_revenue_fields(CV.contacts(spark, d), "standard_tuition_total", config=_tuition_rules(spark, d))
    return out.select(*PROGRAM_REVENUE_COLUMNS)


def sql_extract_price_table() -> str:
    """Builds the page texts and parses them with the same patterns (never the numbers themselves)."""
    n = len(_L.PRICE_HEADINGS)
    heading = "CASE i " + " ".join(f"WHEN {i} THEN CASE WHEN credits % 2 = 0 THEN {O.q(even)} ELSE {O.q(odd)} END" for i, (_, even, odd) in enumerate(_L.PRICE_HEADINGS)) + " END"
    money = lambda x: f"'$' || format('{{:,}}', CAST({x} AS BIGINT))"
    total = "price * credits"
    parts = []
    for level, pattern in R.PRICE_LINE_PATTERNS:
        pat = O.q("(?i)" + pattern)
        num = lambda g: f"TRY_CAST(replace(regexp_extract(norm, {pat}, {g}), ',', '') AS BIGINT)"  # noqa: E731,B023
        parts.append(f"""SELECT page_id, {O.q(level)} AS program_degree_level, {num(1)} AS tuition_per_credit, {num(2)} AS credits_required,
            {num(3)} AS estimated_total_tuition, {num(4)} AS estimated_annual_tuition FROM landed WHERE regexp_matches(norm, {pat})""")
    return f"""WITH per AS (SELECT p_partkey // {_L.PARTS_PER_PAGE} AS page_id, p_partkey % {n} AS i, CAST(floor(max(p_retailprice)) AS BIGINT) AS price,
          min(p_size) + 12 AS credits, sum(p_size) AS size FROM part GROUP BY 1, 2),
        lines AS (SELECT page_id, i, size, CASE WHEN credits % 7 <> 0 THEN {heading} || CASE WHEN credits % 3 <> 0 THEN chr(10) || '  ' ELSE chr(9) END || {money('price')}
          || '  ' || credits || ' ' || {money(total)} || chr(9) || {money(f'floor(({total}) / greatest(floor(credits / 30), 1))')} ELSE '(on request)' END AS line FROM per),
        texts AS (SELECT page_id, sum(size) AS size, 'Tuition and fees' || chr(10) || 'Associate Degree from $999' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text
          FROM lines GROUP BY 1),
        landed AS (SELECT page_id, regexp_replace(CASE WHEN size % 4 = 0 THEN 'Prices on request.' || chr(10) || 'Certificate Programs: call us.'
          WHEN size % 3 = 0 THEN upper(text) ELSE text END, '\\s+', ' ', 'g') AS norm FROM texts) """ + " UNION ALL ".join(parts)


def _tuition_rules_cte() -> str:
    levels = " ".join(f"WHEN {i} THEN {O.q(x)}" for i, x in enumerate(_BL._OVERRIDE_LEVELS))
    fixed = ", ".join("(" + ", ".join(O.q(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in row) + ")" for row in R.DEGREE_TUITION)
    newest = lambda f: f"max_by({f}, refreshed_at) FILTER (WHERE {f} IS NOT NULL) AS {f}"
    prices = ", ".join(f"CAST(coalesce(p.{f}, f.{f}) AS DOUBLE) AS {f}" for f in TU.PRICE_FIELDS)
    more = ", ".join(f"coalesce(o.{f}, f.{f}) AS {f}" for f in ("duration_years", "duration_months", "note"))
    return f"""fixed AS (SELECT * FROM (VALUES {fixed}) t(program_degree_level, tuition_per_credit, credits_required, estimated_total_tuition,
          estimated_annual_tuition, duration_years, duration_months, note)),
        prices AS ({sql_extract_price_table()}),
        newest AS (SELECT program_degree_level, {', '.join(f'max_by({f}, page_id) AS {f}' for f in TU.PRICE_FIELDS)} FROM prices GROUP BY 1),
        files AS (SELECT CASE p_partkey % {len(_BL._OVERRIDE_LEVELS)} {levels} END AS program_degree_level, CASE WHEN p_size % 3 <> 0 THEN 'see ' || p_name END AS note,
          CAST(p_size + 6 AS DOUBLE) AS duration_months, CASE WHEN p_size % 2 = 0 THEN CAST(2 AS DOUBLE) END AS duration_years, p_partkey AS refreshed_at
          FROM part WHERE p_partkey % 101 = 7),
        overrides AS (SELECT program_degree_level, {', '.join(newest(f) for f in ('note', 'duration_months', 'duration_years'))} FROM files
          WHERE program_degree_level <> '' AND NOT starts_with(program_degree_level, '_') GROUP BY 1),
        rules AS (SELECT f.program_degree_level, {prices}, {more} FROM fixed f LEFT JOIN newest p USING (program_degree_level)
          LEFT JOIN overrides o USING (program_degree_level))"""


def sql_tuition_table() -> str:
    return f"WITH {_tuition_rules_cte()} SELECT * FROM rules"


def sql_program_revenue() -> str:
    level = f"coalesce({O.degree_sql('degree_level')}, {O.degree_sql('program')})"
    status = f"regexp_matches(lower(coalesce(enrollment_status, '')), {O.q(R.REVENUE_ENROLLED_PATTERN)})"
    per = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / {y} ELSE 0.0 END"
    months = "CASE WHEN duration_months = floor(duration_months) THEN CAST(CAST(duration_months AS BIGINT) AS VARCHAR) ELSE CAST(duration_months AS VARCHAR) END"
    return G._sql(f"""SELECT hs_object_id, c.level AS program_degree_level, tuition_per_credit, credits_required, estimated_total_tuition, estimated_annual_tuition,
        duration_years AS program_duration_years, duration_months AS program_duration_months,
        CASE WHEN c.level IS NULL THEN 'Program missing or not matched to a configured degree level.' ELSE coalesce(note, '') END AS duration_note, confidence AS revenue_confidence,
        total AS total_program_revenue, {per('total', 'duration_years')} AS annualized_program_revenue, least(({per('total', 'duration_months')}) * 6.0, total) AS six_month_revenue,
        least(({per('potential', 'duration_months')}) * 6.0, potential) AS potential_six_month_revenue, CASE WHEN {status} THEN 0.0 ELSE potential END AS potential_revenue,
        CASE WHEN {status} THEN potential ELSE 0.0 END AS enrolled_revenue,
        CASE WHEN c.level IS NULL THEN 'Program duration could not be matched; update config/degree_tuition.json.'
          WHEN total <= 0 THEN c.level || ' potential tuition is based on published rates over ' || {months} || ' months; realized revenue is not counted until a deal is won/countable.'
          ELSE c.level || ' revenue uses available tuition/revenue over ' || {months} || ' months' || CASE WHEN trim(coalesce(note, '')) <> '' THEN '; ' || trim(note) || '.' ELSE '.' END
        END AS revenue_realization_note
      FROM (SELECT *, {level} AS level, greatest(coalesce(TRY_CAST(standard_tuition_total AS DOUBLE), 0.0), 0.0) AS total,
          CASE WHEN {O.degree_sql('degree_level')} IS NOT NULL THEN 'High' WHEN {O.degree_sql('program')} IS NOT NULL THEN 'Medium' ELSE 'Low' END AS confidence FROM raw_contacts) c
        LEFT JOIN (SELECT *, greatest(coalesce(estimated_total_tuition, 0.0), 0.0) AS potential0 FROM rules) r ON r.program_degree_level = c.level
        , LATERAL (SELECT coalesce(potential0, 0.0) AS potential)""", [_tuition_rules_cte()])


QUERIES.update({"extract_price_table": _prices, "tuition_table": _tuition_rules, "program_revenue": q_program_revenue})
ORACLE.update({"extract_price_table": sql_extract_price_table, "tuition_table": sql_tuition_table, "program_revenue": sql_program_revenue})
